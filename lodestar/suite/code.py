"""Queries on source texts, symbols and nested documents, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import comments
from ..operators import macros, symbols, variants
from ..plans import stand_ins as t
from ..registry import query


@query("""WITH i AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS k FROM lineitem)
SELECT l_orderkey, '$' || repeat('.calls[0].inner', (k - 1)::INT) || '.data_types_used' AS path, '["T' || l_suppkey || '",{"n":' || k || '}]' AS value FROM i""")
def json_key_search(spark, d):
    """Every `data_types_used` of orders whose items are nested in each other, as deep as an order has items."""
    item = t.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey")
    listed = item.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("l"))  # an order's own

    def nested(inner, x):
        rest = F.when(inner["json"] != "", F.concat(F.lit(',"calls":[{"inner":'), inner["json"], F.lit("}]"))).otherwise("")
        json = F.concat(F.lit('{"line":'), x["l_linenumber"], F.lit(',"data_types_used":["T'), x["l_suppkey"], F.lit('",{"n":'), inner["k"], F.lit("}]"), rest, F.lit("}"))
        return F.struct((inner["k"] - 1).alias("k"), json.alias("json"))

    json = F.aggregate(F.reverse("l"), F.struct(F.size("l").alias("k"), F.lit("").alias("json")), nested, lambda s: s["json"])
    return variants.values_of(listed.select("l_orderkey", json.alias("json")), "json", "data_types_used")


SYMBOL = "p_name || '.' || p_brand || CASE l_suppkey % 3 WHEN 0 THEN '::' || p_type || '(int)' WHEN 1 THEN '.' || p_type || '.' || p_size ELSE ' in ' || p_type END"
KEY = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type || '.' || p_name WHEN 2 THEN p_brand || '.' || p_name || '(' || p_type || ')' ELSE p_name || '.' || p_type || '.' || p_size || '.' || p_brand || '.v' || (p_partkey % 2) END"


@query(rf"""WITH s AS (SELECT DISTINCT {SYMBOL} AS symbol FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 100 = 0),
q AS (SELECT symbol, list_slice(list_sort(list_transform(list_distinct(regexp_extract_all(split_part(symbol, '(', 1), '[A-Za-z0-9_:]+')), lambda x: {{'n': -length(x), 'x': x}})), 1, 10) AS w FROM s),
d AS (SELECT p_partkey AS place, {KEY} AS key, list_distinct(regexp_extract_all(split_part({KEY}, '(', 1), '[A-Za-z0-9_:]+')) AS w FROM part),
c AS (SELECT symbol, place, key, len(list_intersect(list_transform(q.w, lambda y: y.x), d.w)) AS o, len(d.w) AS n FROM q JOIN d ON len(d.w) <= 6),
f AS (SELECT symbol, list_reduce(list({{'key': key, 'o': o, 'n': n}} ORDER BY place), lambda a, b: CASE WHEN b.o > a.o AND b.n > a.n THEN b ELSE a END, {{'key': NULL::VARCHAR, 'o': 0::BIGINT, 'n': 0::BIGINT}}) AS b FROM c GROUP BY 1)
SELECT symbol, b.key AS key, b.o AS overlap, b.n AS size FROM f WHERE b.key IS NOT NULL""")
def symbol_best_definition(spark, d):
    part = t.table(spark, d, "part")
    item = t.table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey").where("l_orderkey % 100 = 0")
    asked = item.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.expr(SYMBOL).alias("symbol"))
    return symbols.best_definitions(asked, part.select(F.expr(KEY).alias("key"), F.col("p_partkey").alias("place")))


FUNCTION = "CASE p_partkey % 3 WHEN 0 THEN p_name || '(' || p_size || ')' WHEN 1 THEN '-' || upper(p_name) || 'Handler' ELSE 'my ' || p_name || ' ' || p_type END"
CALLED = "CASE c_custkey % 4 WHEN 0 THEN p_name || '(' || p_size || ')' WHEN 1 THEN p_name || 'WithOptions' WHEN 2 THEN 'the ' || p_name || ' of ' || c_custkey ELSE c_name END"
_NORM = "lower(regexp_replace(regexp_replace(trim(split_part({0}, '(', 1)), '^[-+]\\s*', ''), '(WithOptions|Handler|Callback)$', ''))"


@query(f"""WITH c AS (SELECT DISTINCT {CALLED} AS name FROM customer JOIN part ON p_partkey = c_custkey), k AS (SELECT p_partkey AS place, {FUNCTION} AS key FROM part WHERE p_partkey % 5 < 2),
cn AS (SELECT name, {_NORM.format('name')} AS norm FROM c), kn AS (SELECT place, key, {_NORM.format('key')} AS norm FROM k),
m AS (SELECT name, key, place, CASE WHEN name = key THEN 1 WHEN cn.norm = kn.norm THEN 2 ELSE 3 END AS step FROM cn JOIN kn ON name = key OR cn.norm = kn.norm OR cn.norm <> '' AND kn.norm <> '' AND (contains(cn.norm, kn.norm) OR contains(kn.norm, cn.norm))),
b AS (SELECT name, arg_min(key, (step, place, key)) AS key, min(step) AS step FROM m GROUP BY 1)
SELECT name, key, step FROM c LEFT JOIN b USING (name)""")
def symbol_function_lookup(spark, d):
    """Equal, normalised, then contained names; the first in order of those that match."""
    part, customer = t.table(spark, d, "part"), t.table(spark, d, "customer", "c_custkey", "c_name")
    called = customer.join(part, F.col("c_custkey") == F.col("p_partkey")).select(F.expr(CALLED).alias("name"))
    known = part.where("p_partkey % 5 < 2").select(F.expr(FUNCTION).alias("key"), F.col("p_partkey").alias("place"))
    return symbols.found_functions(called, known)


# a source text for each part: it names a macro, defines one by another (of a smaller number, or a ring), and mentions some that are none
MACRO = "'M_' || p_brand || '_' || (p_size % 7)"
SOURCE = """'#define M_' || p_partkey || ' ' || CASE p_partkey % 4 WHEN 0 THEN '!' ELSE '' END || 'M_' || CASE WHEN p_partkey % 11 = 0 THEN (p_partkey + 1) ELSE p_partkey // 3 END || CASE p_partkey % 3 WHEN 0 THEN ' // was M_9' ELSE '' END || chr(10)
|| CASE p_partkey % 5 WHEN 0 THEN '#ifdef M_' || p_partkey WHEN 1 THEN '#if defined(M_' || p_partkey || ')' WHEN 2 THEN '  # if !M_' || p_partkey || ' /* x */' WHEN 3 THEN '#if M_' || p_partkey || ' >= 2' ELSE '#ifndef __M_' || p_partkey END || chr(10)
|| 'int f = M_7; #if M_8' || chr(10) || '#define LIMIT ' || p_size || chr(10) || '#endif'"""


@query(f"""WITH RECURSIVE s AS (SELECT unnest(string_split({SOURCE}, chr(10))) AS line FROM part),
n AS (SELECT DISTINCT coalesce(nullif(regexp_extract(line, '#\\s*ifn?def\\s+([A-Za-z_]\\w*)', 1), ''), nullif(regexp_extract(line, '#\\s*if\\s+defined\\((\\w+)\\)', 1), ''), nullif(regexp_extract(line, '#\\s*if\\s+!?(M_\\d+)', 1), '')) AS macro FROM s WHERE regexp_matches(line, '#\\s*if')),
d AS MATERIALIZED (SELECT DISTINCT regexp_extract(line, '^#define (M_\\d+) !?(M_\\d+)', 1) AS macro, regexp_extract(line, '^#define (M_\\d+) !?(M_\\d+)', 2) AS base FROM s WHERE regexp_matches(line, '^#define M_\\d+ !?M_\\d+')),
c(macro, base, steps) AS (SELECT macro, base, 1 FROM d WHERE macro IN (SELECT macro FROM n) UNION SELECT c.macro, d.base, c.steps + 1 FROM c JOIN d ON d.macro = c.base WHERE c.steps < 40)
SELECT macro, base, min(steps) AS steps FROM c GROUP BY 1, 2 UNION ALL SELECT macro, '', 0 FROM n WHERE macro NOT LIKE '\\_\\_%' ESCAPE '\\' AND macro IS NOT NULL""")
def code_derived_macros(spark, d):
    """Macros that conditions name, and with them everything they are derived from."""
    source = F.expr(SOURCE.replace("//", "div", 1).replace("p_partkey div 3", "(p_partkey div 3)"))
    lines = t.table(spark, d, "part").select(F.explode(F.split(source, "\n")).alias("line"))
    named = macros.named(lines)
    return macros.closure(macros.derived(lines), named).unionByName(named.select("macro", F.lit("").alias("base"), F.lit(0).alias("steps")))


# a text of code for each part: comment signs in strings, blocks over lines, some of them never closed
CODE = """'  a = "// no ' || p_name || ' /* no */"; // yes ' || p_type || chr(10) || '/* ' || p_brand || chr(10) || 'more' || CASE p_partkey % 3 WHEN 0 THEN '' ELSE ' */ b' || p_size || ' = c / d;' END || chr(10)
|| '    c("' || p_size || '\\\\" /* no");' || CASE p_partkey % 3 WHEN 0 THEN '' ELSE ' /* in */' END || ' d();' || chr(10) || '' || chr(10) || '  // whole' || chr(10) || '   // whole too' || chr(10) || 'e = ''"''; // end'"""


@query(r"""WITH p AS (SELECT *, p_partkey % 3 = 0 AS o FROM part)
SELECT p_partkey,
  '  a = "// no ' || p_name || ' /* no */"; ' || chr(10) || chr(10) || CASE WHEN o THEN chr(10) || chr(10) || chr(10) || chr(10) || chr(10)
    ELSE ' b' || p_size || ' = c / d;' || chr(10) || '    c("' || p_size || '\" /* no");  d();' || chr(10) || chr(10) || '  ' || chr(10) || '   ' || chr(10) || 'e = ''"''; ' END AS bare,
  '  a = "// no ' || p_name || ' /* no */"; ' || chr(10) || '  // ...comments...' || CASE WHEN o THEN chr(10)
    || chr(10) || '  // ...comments...' ELSE chr(10) || ' b' || p_size || ' = c / d;' || chr(10) || '    c("' || p_size || '\" /* no");  d();' || chr(10) || chr(10) || '    // ...comments...' || chr(10) || 'e = ''"''; ' END AS pruned
FROM p""")
def code_without_comments(spark, d):
    code = F.expr(CODE)
    return t.table(spark, d, "part").select("p_partkey", comments.without_comments(code).alias("bare"), comments.pruned(code).alias("pruned"))

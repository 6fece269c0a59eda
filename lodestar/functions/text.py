"""Scalar functions on names, paths and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.when(F.contains(base_name(path), F.lit(".")), F.lower(F.element_at(F.split(path, "\\."), -1))).otherwise("")


def normal_function(name: Column) -> Column:
    """Lower case without a leading -/+ or a With..., Handler or Callback ending."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "^[-+]\\s*", ""), "(WithOptions|Handler|Callback)$", ""))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))


def has_component(path: Column, part: Column) -> Column:
    """Whether `part` is one or more whole, consecutive components of the path."""
    return F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.concat(F.lit("/"), part, F.lit("/")))


def name_tokens(name: Column) -> Column:
    """Runs of letters and parts between underscores and colons of the lower-cased name, distinct, in that order."""
    low = F.lower(name)
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), F.filter(F.split(low, "[_:]+"), lambda t: t != "")))


def symbol_tokens(symbol: Column) -> Column:
    """Identifiers of a symbol, its parameters left out."""
    return F.regexp_extract_all(F.substring_index(symbol, "(", 1), F.lit("[A-Za-z0-9_:]+"), F.lit(0))


def longest_tokens(symbol: Column, n: int) -> Column:
    """The n longest tokens, equal lengths by the alphabet."""
    ordered = F.array_sort(F.transform(F.array_distinct(symbol_tokens(symbol)), lambda t: F.struct((-F.length(t)).alias("k"), t.alias("t"))))
    return F.transform(F.slice(ordered, 1, n), lambda s: s["t"])


def bare_function(name: Column) -> Column:
    """A name up to its parameters."""
    return F.trim(F.substring_index(name, "(", 1))


def unqualified(name: Column) -> Column:
    """The last part of a name qualified by points or double colons, without parameters and type arguments."""
    return F.element_at(F.split(F.regexp_replace(bare_function(name), "<[^<>]*>", ""), r"::|\."), -1)


def readable_type(name: Column) -> Column:
    """camelCase, acronyms and underscores as words with a capital, the rest of a word as it is."""
    spaced = F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(spaced, " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def folder(path: Column) -> Column:
    """The folder of a path; that of a bare name is a point."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def relative(path: Column) -> Column:
    """Without any points and slashes at the beginning."""
    return F.ltrim(path, F.lit("./"))


def same_file(a: Column, b: Column) -> Column:
    """Equal paths, or one that ends with the other."""
    x, y = F.replace(a, F.lit("\\"), F.lit("/")), F.replace(b, F.lit("\\"), F.lit("/"))
    return (x == y) | F.endswith(x, y) | F.endswith(y, x)


def file_safe(name: Column, most: int = 50) -> Column:
    return F.left(F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_"), F.lit(most))


def line_range(value: Column) -> Column:
    """struct(lo, hi) of `45` or `45-48`, in order; null for anything else."""
    a, b = (F.expr("try_cast(null AS int)"),) * 2
    pattern = r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$"
    a = F.nullif(F.regexp_extract(value, pattern, 1), F.lit("")).cast("int")
    b = F.coalesce(F.nullif(F.regexp_extract(value, pattern, 2), F.lit("")).cast("int"), a)
    return F.when(a.isNotNull(), F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))


def numbered_lines(value: Column, first: int = 1) -> Column:
    """Every line with its number in front, right-aligned in five places."""
    return F.array_join(F.transform(F.split(value, "\n"), lambda line, i: F.concat(F.lpad((i + first).cast("string"), 5, " "), F.lit(" | "), line)), "\n")


def bare_lines(value: Column) -> Column:
    """Lines without the numbers that numbered_lines puts in front."""
    return F.array_join(F.transform(F.split(value, "\n"), lambda line: F.regexp_replace(line, r"^ *\d+ \| ", "")), "\n")


def has_numbers(value: Column) -> Column:
    return F.forall(F.split(value, "\n"), lambda line: line.rlike(r"^ *\d+ \| "))


def html_escaped(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def content_hash(*parts: Column) -> Column:
    """Sixteen hex digits over all parts; nulls count as empty, so that parts keep their places."""
    return F.left(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), F.lit(16))


def tag_list(tags: Column) -> Column:
    """Distinct sorted tags as JSON, null where there is none."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda x: F.trim(x)), lambda x: x != "")))
    return F.when(F.size(clean) > 0, F.to_json(clean))


def edges_of(path: Column) -> Column:
    """The steps of a path as structs (src, dst)."""
    return F.when(F.size(path) < 2, F.array().cast("array<struct<src:string,dst:string>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(path) - 2, F.lit(0))), lambda i: F.struct(F.get(path, i).cast("string").alias("src"), F.get(path, i + 1).cast("string").alias("dst")))
    )


def token_estimate(value: Column) -> Column:
    return F.floor(F.length(value) / 4).cast("long")


def range_checksum(name: Column, path: Column, first: Column, last: Column) -> Column:
    return F.left(F.md5(F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(":"), name)), F.lit(16))


def phrases(query: str, most: int = 12) -> list[str]:
    """The phrases of a free query: one for each part between white space, single characters left out."""
    import re

    found = (" ".join(t for t in re.sub(r"[^\w]+", " ", part).split() if len(t) > 1) for part in query.split())
    return [p for p in found if p][:most]

"""Fill-in-the-middle transformation (operator 12).

An Arrow-batched pandas UDF: the regex library's finditer gives the ends of a text's units, which are kept in one compact
array of offsets; two lookups in it slice the text into prefix, middle and suffix. hashlib makes the seed of a row, from
which cuts and form are drawn, and the digests of the output and of the text rebuilt from it.

Units are white space (space, \\t to \\r) with the word after it, or white space at the end. Forms: plain (the text as it is),
psm `<P>prefix<S>suffix<M>middle`, spm `<S>suffix<P>prefix<M>middle`. A text that holds a mark stays plain, so that the
first mark of each kind in an output is the mark itself, and restored() gives every text back.

Defined results: null text counts as empty, and empty texts are plain with 0 units; texts of any length are cut over the
whole of them; a null doc_id draws from `42:` alone; repeated rows and rows of one doc_id draw alike (cuts still depend on
the text's units); an empty table gives an empty result; other columns, whatever their names, are kept beside the result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKS = ("<P>", "<S>", "<M>")
SEED = 42
PLAIN_FROM = 50  # of h3 % 100
SPM_BELOW = 80  # of h4 % 100
RESULT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"


def ends_of(units: regex.Pattern, text: str) -> array:
    """Where each unit ends, in code points: four bytes a unit."""
    return array("I", (m.end() for m in units.finditer(text)))


def draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(units: regex.Pattern, text: str, h: list[int]) -> tuple:
    """(n, form, prefix's length, middle's length, output)."""
    ends = ends_of(units, text)
    n = len(ends)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, z = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if h[3] % 100 < SPM_BELOW:
        return n, "spm", a, z - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, z - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output of this form was made from."""
    if form == "plain":
        return output
    one, two = ("<S>", "<P>") if form == "spm" else ("<P>", "<S>")
    head, rest = output.removeprefix(one).split(two, 1)
    tail, middle = rest.split("<M>", 1)
    prefix, suffix = (tail, head) if form == "spm" else (head, tail)
    return prefix + middle + suffix


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def middles(docs: DataFrame, seed: int = SEED, to: str = "fim") -> DataFrame:
    """docs with a struct column `to` of RESULT's fields, made from doc_id and text."""

    @F.pandas_udf(RESULT)
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        units = regex.compile(UNIT)
        names = [f.split()[0] for f in RESULT.split(", ")]
        for ids, texts in parts:
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                n, form, a, z, output = transformed(units, text, draws(seed, None if doc_id is None else int(doc_id)))
                rows.append((n, form, a, z, output, sha256(output), sha256(restored(output, form))))
            made = pd.DataFrame(rows, columns=names)
            yield made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    # the id goes as text: pandas would turn a column of numbers with nulls into floats
    return docs.withColumn(to, cut(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middles(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select("doc_id", *[f"fim.{c}" for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")])


_SPACE = r"\x20\x09-\x0D"
ORACLE = {
    "op12_fill_middle": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s,
         regexp_extract_all(coalesce(text, ''), '[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+') AS u FROM documents),
h AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(s, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(s, 9, 8))::BIGINT % (len(u) + 1) AS b,
         ('0x' || substr(s, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(s, 25, 8))::BIGINT % 100 AS h4 FROM d),
f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(list_slice(u, 1, least(a, b)), '') AS p, array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') AS m,
         array_to_string(list_slice(u, greatest(a, b) + 1, n), '') AS z FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f"""
}
QUERIES = {"op12_fill_middle": op12_fill_middle}

"""Findings in text dumps, HTML and Markdown reports, and JSON in answers.

Balanced JSON needs a scan with state, so it is a Pandas UDF; everything else is expressions.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The headers of a block, those that must be there, and what separates blocks.
HEADERS = {"Title": "title", "Severity": "severity", "Category": "category", "File": "file_path", "Function": "function_name", "Lines": "line_number", "Impact": "description", "Evidence": "evidence", "Potential Solution": "suggestion"}
REQUIRED = ("Title", "Severity")
BETWEEN = "=" * 22


def issue_blocks(dumps: DataFrame, body: str, keep: list[str] | tuple = ()) -> DataFrame:
    """A row per block, with the columns in keep; a section runs from its header to the next one. A block without a required
    header is an error."""
    blocks = dumps.select(*keep, F.explode(F.split(body, rf"(?m)^?{BETWEEN}\s*\n?")).alias("b")).where(F.trim("b") != "")
    heads = "|".join(map(re.escape, HEADERS))
    section = lambda h: F.nullif(F.trim(F.regexp_extract("b", rf"(?s)(?:^|\n){re.escape(h)}:[ \t]*(.*?)(?=\n(?:{heads}):|\s*$)", 1)), F.lit(""))
    out = blocks.select(*keep, *[section(h).alias(c) for h, c in HEADERS.items()])
    for h in REQUIRED:
        out = out.withColumn(HEADERS[h], F.coalesce(HEADERS[h], F.raise_error(F.lit(f"a block has no {h}")).cast("string")))
    return out


def markdown_issues(pages: DataFrame, body: str) -> DataFrame:
    """A finding per page: the first heading, `**Name**: value` fields and the description."""
    return pages.select(*[c.alias(n) for n, c in markdown_fields(body).items()])


def markdown_fields(body: str) -> dict[str, Column]:
    field = lambda n: F.nullif(F.trim(F.regexp_extract(body, rf"(?im)^\s*[-*]?\s*\*\*{n}\*\*:?\s*(.*)$", 1)), F.lit(""))
    return {
        "title": F.trim(F.regexp_extract(body, r"(?m)^#\s+(.*)$", 1)), **{n: field(n) for n in ("severity", "category", "file", "function")},
        "description": F.trim(F.regexp_extract(body, r"(?is)\n##\s+description\s*\n(.*?)(?=\n##\s|$)", 1)),
    }


def balanced(text: str, opened: str, closed: str) -> list[str]:
    """The outermost balanced spans that are valid JSON, brackets inside strings not counted; one pass per failed start."""
    out, at = [], 0
    while (at := text.find(opened, at)) >= 0:
        depth, quoted, i = 0, False, at
        while i < len(text):
            c = text[i]
            if quoted:
                if c == "\\":
                    i += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == opened:
                depth += 1
            elif c == closed:
                depth -= 1
                if not depth:
                    break
            i += 1
        span = text[at : i + 1]
        if depth == 0 and i < len(text) and _valid(span):
            out.append(span)
            at = i + 1
        else:
            at += 1
    return out


def _valid(span: str) -> bool:
    try:
        json.loads(span)
    except ValueError:
        return False
    return True


def _cleaned(text: str | None) -> str | None:
    if text is None:
        return None
    found = sorted(balanced(text, "{", "}") + balanced(text, "[", "]"), key=len, reverse=True)
    if found:
        return found[0]
    fence = re.search(r"```(?:json)?\s*\n(.*?)```", text, re.S)
    return (fence[1] if fence else text).strip()


def cleaned_json(body: str) -> Column:
    """The largest balanced JSON value, else a fenced block, else the trimmed text."""
    return F.pandas_udf(lambda s: s.map(_cleaned), "string")(body)


def json_objects(body: str) -> Column:
    """Outermost JSON objects in a text, largest first."""
    return F.pandas_udf(lambda s: s.map(lambda t: sorted(balanced(t or "", "{", "}"), key=len, reverse=True)), "array<string>")(body)


def tool_requests(body: str) -> Column:
    """The distinct tools that a text asks for, in order."""

    def names(t: str | None) -> list[str]:
        asked = (json.loads(x).get("tool") for x in balanced(t or "", "{", "}"))
        return list(dict.fromkeys(x for x in asked if isinstance(x, str)))

    return F.pandas_udf(lambda s: s.map(names), "array<string>")(body)


def embedded_issues(pages: DataFrame, html: str, schema: str) -> DataFrame:
    """The objects of the array that follows `"issues":` in each page."""
    return pages.select(F.explode(embedded_array(html, schema)).alias("i")).select("i.*")


def embedded_array(html: str, schema: str) -> Column:
    def found(t: str | None) -> str:
        m = re.search(r"[\"']?issues[\"']?\s*[:=]\s*(?=\[)", t or "")
        spans = balanced(t[m.end() :], "[", "]") if m else []
        return spans[0] if spans else "[]"

    raw = F.pandas_udf(lambda s: s.map(found), "string")(html)
    return F.from_json(raw, f"array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in schema.split(','))}>>")


def repaired(files: DataFrame, body: str, schema: str) -> DataFrame:
    """files with `doc`, the body parsed; what does not parse is cleaned and parsed again, and is null if that fails too."""
    first = F.from_json(body, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = files.withColumn("_first", first).withColumn("_again", F.when(F.col("_first._bad").isNotNull(), cleaned_json(body)))
    again = F.from_json("_again", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = out.withColumn("_second", again)
    good = lambda c: F.when(F.col(f"{c}._bad").isNull() & F.col(c).isNotNull(), F.col(c).dropFields("_bad"))
    return out.withColumn("doc", F.coalesce(good("_first"), good("_second"))).drop("_first", "_again", "_second")


READERS = {".json": "json", ".html": "html", ".htm": "html", ".md": "markdown", ".txt": "text"}


def report_format(path: Column, body: Column) -> Column:
    """The first format that can read a report: by its ending, else by how it begins."""
    out = F.when(F.ltrim(body).startswith("{") | F.ltrim(body).startswith("["), "json").when(F.ltrim(body).startswith("<"), "html").when(F.ltrim(body).startswith("#"), "markdown").otherwise("text")
    for ending, name in READERS.items():
        out = F.when(F.lower(path).endswith(ending), name).otherwise(out)
    return out


def parsed(files: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """(path, format, title, severity) of the findings in reports of all formats, each read by the first format that can.

    JSON reports hold an array or an object of findings, HTML ones an embedded array, Markdown ones a finding, texts blocks.
    """
    known = files.withColumn("format", report_format(F.col(path), F.col(body)))
    one = lambda name: known.where(F.col("format") == name)
    kind = "title string, severity string"
    json_ = one("json").select(path, "format", F.explode(F.from_json(body, f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")).alias("i")).select(path, "format", "i.title", "i.severity")
    html = one("html").select(path, "format", F.explode(embedded_array(body, kind)).alias("i")).select(path, "format", "i.title", "i.severity")
    marked = one("markdown").select(path, "format", *[c.alias(n) for n, c in markdown_fields(body).items() if n in ("title", "severity")])
    text = issue_blocks(one("text"), body, keep=[path, "format"]).select(path, "format", "title", "severity")
    return json_.unionByName(html).unionByName(marked).unionByName(text)


def catalog(spark, entries: list[dict]) -> DataFrame:
    """A weakness catalogue, read on the driver (it is a file of some hundred entries), as a table."""
    return spark.createDataFrame(pd.DataFrame([{"id": str(e["id"]), "name": e.get("name", ""), "category": e.get("category", ""), "keywords": list(e.get("keywords", []))} for e in entries]))

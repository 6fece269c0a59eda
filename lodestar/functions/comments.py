"""Comments of C-like code taken out, with lines kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings, character constants, comments (unclosed ones to the end), and single other characters.
_PIECES = r'"(?:\\.|[^"\\\n])*"?|' + r"'(?:\\.|[^'\\\n])*'?" + r"|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|[^\"'/]+|/"
_NUMBER = r"^(\s*\d+\s*\|\s*)"
MARK = "// ...comments..."


def without_comments(code: Column) -> Column:
    """The code without comments; each line break inside a block comment stays, so that lines keep their numbers."""
    pieces = F.regexp_extract_all(code, F.lit(_PIECES), F.lit(0))
    kept = F.transform(pieces, lambda p: F.when(p.startswith("//"), F.lit("")).when(p.startswith("/*"), F.regexp_replace(p, "[^\n]", "")).otherwise(p))
    return F.array_join(kept, "")


def pruned(code: Column) -> Column:
    """The code with each run of lines that are comments only, or begin with one, as one MARK, indented as the last line of code.

    Numbers in front of lines (`12 | `) stay, stand outside comments and are not part of the code; empty lines stay.
    """
    lines = F.transform(F.split(code, "\n"), lambda x: F.struct(F.regexp_extract(x, _NUMBER, 1).alias("number"), F.regexp_replace(x, _NUMBER, "").alias("code")))
    bare = F.split(without_comments(F.array_join(F.transform(lines, lambda x: x["code"]), "\n")), "\n")
    both = F.zip_with(lines, bare, lambda a, b: F.struct(a["number"].alias("number"), F.trim(a["code"]).alias("was"), b.alias("now")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("marked"), F.lit("").alias("indent"))

    def step(s: Column, x: Column) -> Column:
        blank = F.trim(x["now"]) == ""
        comment = (blank & (x["was"] != "")) | x["was"].startswith("//") | x["was"].startswith("/*")
        line = F.when(comment, F.concat(s["indent"], F.lit(MARK))).otherwise(F.concat(x["number"], x["now"]))
        return F.struct(
            F.when(comment & s["marked"], s["out"]).otherwise(F.array_append(s["out"], line)).alias("out"), comment.alias("marked"),
            F.when(comment | blank, s["indent"]).otherwise(F.regexp_extract(x["now"], r"^(\s*)", 1)).alias("indent"),
        )

    return F.array_join(F.aggregate(both, start, step, lambda s: s["out"]), "\n")

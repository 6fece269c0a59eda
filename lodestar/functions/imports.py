"""Names that source files import, by language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How each language names what it imports; the first group is the name.
RULES = {
    "c": [r'(?m)^[ \t]*#[ \t]*(?:include|import)[ \t]*[<"]([^>"\n]+)[>"]'],
    "swift": [r"(?m)^[ \t]*(?:@testable[ \t]+)?import[ \t]+(?:struct[ \t]+|class[ \t]+|func[ \t]+)?([A-Za-z_][A-Za-z0-9_.]*)"],
    "java": [r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([A-Za-z_][A-Za-z0-9_.*]*)[ \t]*;"],
    "kotlin": [r"(?m)^[ \t]*import[ \t]+([A-Za-z_][A-Za-z0-9_.*]*)"],
    "go": [r'(?m)^[ \t]*import[ \t]+(?:[A-Za-z_.]+[ \t]+)?"([^"\n]+)"', r'(?m)^[ \t]+(?:[A-Za-z_.]+[ \t]+)?"([^"\n]+)"[ \t]*$'],
    "python": [r"(?m)^[ \t]*import[ \t]+([A-Za-z_][A-Za-z0-9_.]*)", r"(?m)^[ \t]*from[ \t]+([.A-Za-z_][A-Za-z0-9_.]*)[ \t]+import"],
    "javascript": [r"(?m)^[ \t]*import\b[^'\"\n]*['\"]([^'\"\n]+)['\"]", r"require\([ \t]*['\"]([^'\"\n]+)['\"][ \t]*\)"],
}


def included(body: Column, language: str) -> Column:
    """The distinct names that a file imports, in order of the rules."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(body, F.lit(r), F.lit(1)) for r in RULES[language]])))


def macros(body: Column) -> Column:
    """The macros that a file asks for."""
    rules = (r"(?m)^[ \t]*#[ \t]*if(?:n?def)?[ \t]+!?([A-Za-z_][A-Za-z0-9_]*)[ \t]*$", r"defined[ \t]*\(?[ \t]*([A-Za-z_][A-Za-z0-9_]*)")
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(body, F.lit(r), F.lit(1)) for r in rules])))

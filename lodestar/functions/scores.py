"""Scores of paths and names, confidence scales and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

#: Endings of source files, and words that are no function names.
SOURCES = (".mm", ".m", ".swift", ".cpp", ".c", ".h", ".hpp", ".py", ".js", ".ts", ".java", ".kt", ".rb", ".go", ".rs", ".cs", ".php", ".pl", ".sh", ".bash")
KEYWORDS = (
    "if", "else", "for", "while", "do", "switch", "case", "return", "break", "continue", "try", "catch", "throw", "class", "struct", "enum", "interface", "protocol", "public", "private",
    "protected", "static", "const", "void", "int", "float", "double", "bool", "string", "true", "false", "null", "nil", "self", "this", "import", "from", "as", "in", "is", "not", "and", "or",
)


def scale(score: Column, steps: list[tuple[float, str]], other: str) -> Column:
    """The first step that the score reaches."""
    out = F.lit(other)
    for least, name in sorted(steps):
        out = F.when(score >= least, name).otherwise(out)
    return out


def confidence(score: Column) -> Column:
    return scale(score, [(0.95, "very_high"), (0.85, "high"), (0.75, "medium"), (0.65, "low")], "very_low")


def percent(score: Column) -> Column:
    """Cut, not rounded."""
    return F.concat((score * 100).cast("int").cast("string"), F.lit("%"))


def redistributed(file: Column, function: Column, cosine: Column, has_file: Column, has_function: Column) -> Column:
    """The hybrid score, whose weights go to what there is."""
    return (
        F.when(has_file & has_function, 0.40 * file + 0.25 * function + 0.35 * cosine).when(has_file, 0.50 * file + 0.50 * cosine)
        .when(has_function, 0.40 * function + 0.60 * cosine).otherwise(cosine)
    )


def weights(given: dict[str, float], names: tuple[str, ...] = ("file", "function", "semantic")) -> dict[str, float]:
    """Weights that sum to one; a missing one is an error, a sum off by over .01 is set right."""
    if missing := [n for n in names if n not in given]:
        raise ValueError(f"missing weights: {', '.join(missing)}")
    total = sum(given[n] for n in names)
    return {n: given[n] / total if abs(total - 1) > 0.01 else given[n] for n in names}


def _folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_distinct(F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p != ""))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def file_name_score(a: Column, b: Column) -> Column:
    """0 for different base names, 1 for equal paths, else .8 and .2 times the share of common folders."""
    return F.when(text.base_name(a) != text.base_name(b), 0.0).when(a == b, 1.0).otherwise(0.8 + 0.2 * _shared(_folders(a), _folders(b)))


def path_score(a: Column, b: Column) -> Column:
    """1 for equal paths, .8 and more for one base name, .4 for one folder, up to .2 for common parts."""
    every = lambda p: F.array_distinct(F.filter(F.split(p, "/"), lambda x: x != ""))
    folder = lambda p: F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")
    bare = (F.size(_folders(a)) == 0) & (F.size(_folders(b)) == 0)
    same = F.when(bare, 1.0).otherwise(0.8 + 0.2 * _shared(_folders(a), _folders(b)))
    return F.when(a == b, 1.0).when(text.base_name(a) == text.base_name(b), same).when((folder(a) == folder(b)) & (folder(a) != "."), 0.4).otherwise(0.2 * _shared(every(a), every(b)))


def function_score(a: Column, b: Column) -> Column:
    """1 for equal normal names, .7 where one holds the other, .3 and .3 times the share of common tokens, else 0."""
    x, y = text.normal_function(a), text.normal_function(b)
    p, q = text.name_tokens(x), text.name_tokens(y)
    both = F.size(F.array_intersect(p, q))
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.7).when(both > 0, 0.3 + 0.3 * both / F.greatest(F.size(p), F.size(q))).otherwise(0.0)


def path_distance(base: Column, other: Column) -> Column:
    """Parts of both paths outside their common beginning."""
    a, b = F.split(base, "/"), F.split(other, "/")
    same = F.aggregate(F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1), F.lit(0), lambda n, i: F.when((n == i) & (F.get(a, i) == F.get(b, i)), n + 1).otherwise(n))
    return F.size(a) + F.size(b) - 2 * same


def _found(value: Column, patterns: list[str]) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(value, F.lit(p), F.lit(1)) for p in patterns]))


_EXT = "(?:mm|m|swift|cpp|c|h|hpp|py|js|ts|java|kt|rb|go|rs)"
#: How files and functions are named in reports, in the order in which they are looked for.
PATHS = [r"(?i)File:\s*([^\s\n]+)", r"(?i)Path:\s*([^\s\n]+)", rf"(?i)in\s+([^\s]+\.{_EXT})", rf"(?i)at\s+([^\s]+\.{_EXT})", rf"(?i)([A-Za-z][A-Za-z0-9_/\-\.]+\.{_EXT})", rf"(?i)(/[A-Za-z0-9_/\-\.]+\.{_EXT})"]
FUNCTIONS = [
    r"Function:\s*([^\s\n(]+)", r"function:\s*([^\s\n(]+)", r"Method:\s*([^\s\n(]+)", r"method:\s*([^\s\n(]+)", r"in\s+function\s+([^\s\n(]+)", r"in\s+method\s+([^\s\n(]+)", r"calling\s+([^\s\n(]+)",
    r"(-\[[^\]]+\])", r"(\+\[[^\]]+\])", r"func\s+([a-zA-Z_][a-zA-Z0-9_]*)", r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*\{", r"([a-zA-Z_][a-zA-Z0-9_]*)\(\)",
]


def file_paths(value: Column) -> Column:
    """The distinct file paths that a text names."""
    ending = lambda p: F.coalesce(F.greatest(*[F.endswith(p, F.lit(e)) for e in SOURCES]), F.lit(False))
    return F.array_distinct(F.filter(_found(value, PATHS), lambda p: ending(p) & (F.length(p) >= 4) & ~p.rlike("[<>\"'`|*?]")))


def function_names(value: Column) -> Column:
    """The distinct function names that a text names."""
    named = lambda n: n.startswith("-[") | n.startswith("+[") | n.rlike(r"^[\p{L}_]")
    return F.array_distinct(F.filter(_found(value, FUNCTIONS), lambda n: (F.length(n) >= 2) & ~F.lower(n).isin(*KEYWORDS) & named(n)))

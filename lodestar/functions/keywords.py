"""Keywords of function names with their parameter types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that say nothing about a function.
IGNORED = [
    "double", "float", "int", "long", "short", "char", "void", "bool", "unsigned", "signed", "size_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "int8_t", "int16_t", "int32_t", "int64_t", "CFTimeInterval",
    "const", "volatile", "mutable", "static", "inline", "virtual", "explicit", "const&", "bool&", "int&", "double&", "float&",
    "std", "string", "vector", "map", "set", "unordered_map", "unordered_set", "optional", "pair", "tuple", "shared_ptr", "unique_ptr", "weak_ptr",
    "id", "NSString", "NSArray", "NSDictionary", "NSSet", "NSNumber", "CFStringRef", "CFArrayRef", "CFDictionaryRef", "T", "Self", "self", "this", "nullptr", "NULL", "true", "false",
]


def _selector(name: Column) -> Column:
    """Class and parts of `-[Class part:part:]`."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(name), r"^[-+]*\s*\[?", ""), r"\]$", "")
    head, rest = F.regexp_extract(inner, r"^\s*(\S+)", 1), F.regexp_extract(inner, r"^\s*\S+\s+(.*)$", 1)
    return F.concat(F.array(head), F.split(rest, ":"))


def _qualified(name: Column) -> Column:
    """Parts of `a::b<T>::c(type, other<type>)`, those of each parameter after the ones in its angle brackets."""
    before = F.substring_index(name, "(", 1)
    own = F.transform(F.split(before, "::"), lambda p: F.regexp_replace(p, "<[^>]*>", ""))
    inside = F.regexp_extract(name, r"(?s)\((.*)\)", 1)

    def of(p: Column) -> Column:
        plain = F.regexp_replace(p, "<[^>]*>", "")
        return F.concat(F.regexp_extract_all(p, F.lit(r"<\s*(?:const\s+)?([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), F.split(plain, r"[\s*&]+|::"))

    return F.concat(own, F.flatten(F.transform(F.split(inside, ","), of)))


def keywords(name: Column, libraries: list[str] | tuple = ()) -> Column:
    """The distinct keywords of a function name in order, without what is ignored and names of libraries, whatever the case."""
    low = sorted({w.lower() for w in (*IGNORED, *libraries)})
    wanted = lambda w: (w != "") & ~F.lower(w).isin(low)
    parts = F.when(F.trim(name).rlike(r"^[-+]?\["), _selector(name)).otherwise(_qualified(name))
    bare = F.transform(F.filter(F.transform(parts, lambda w: F.trim(w)), wanted), lambda w: F.regexp_replace(w, "^~", ""))
    tokens = F.flatten(F.transform(bare, lambda w: F.split(F.regexp_replace(w, r"[<>&\[\]]", " "), r"\s+")))
    return F.array_distinct(F.filter(tokens, wanted))

"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980, with the author's later changes) in column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of the published algorithm and what stands in their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# y is a vowel, Y one that counts as a consonant
V, C = "[aeiouy]", "[^aeiouy]"
ONE = f"{C}*{V}+{C}"  # a stem that begins so has a measure over 0
TWO = f"{C}*{V}+{C}+{V}+{C}"  # over 1
CVC = f"{C}{V}[^aeiouywxY]"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|YY)$"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _marked(w: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiou])y", "$1Y")
    return F.replace(out, F.lit("yy"), F.lit("yY"))


def _plural(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), F.regexp_replace(w, "es$", "")).when(w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)


def _past(w: Column) -> Column:
    """-eed, -ed and -ing, and what their removal leaves to mend."""
    stem = F.regexp_replace(w, "(ed|ing)$", "")
    mended = _bound(
        stem,
        lambda s: F.when(s.rlike("(at|bl|iz)$"), F.concat(s, F.lit("e"))).when(s.rlike(DOUBLE), F.regexp_replace(s, ".$", "")).when(s.rlike(f"^{C}*{V}+{C}+$") & s.rlike(f"{CVC}$"), F.concat(s, F.lit("e"))).otherwise(s),
    )
    return F.when(w.endswith("eed"), F.regexp_replace(w, f"^({ONE}.*)eed$", "$1ee")).when(w.rlike(f"{V}.*(ed|ing)$"), mended).otherwise(w)


def _last_y(w: Column) -> Column:
    return F.regexp_replace(w, f"^(.*{V}.*)[yY]$", "$1i")


def _replaced(rules: dict[str, str], measure: str) -> Callable[[Column], Column]:
    """The longest suffix that a word has is replaced, if what stands before it has the measure."""

    def step(w: Column) -> Column:
        out = None
        for suffix in sorted(rules, key=len, reverse=True):
            stem = F.left(w, F.length(w) - len(suffix))
            ends = w.endswith(suffix) if suffix != "ion" else w.rlike("[st]ion$")
            new = F.when(stem.rlike(f"^{measure}"), F.concat(stem, F.lit(rules[suffix]))).otherwise(w)
            out = F.when(ends, new) if out is None else out.when(ends, new)
        return out.otherwise(w)

    return step


def _last_e(w: Column) -> Column:
    """-e goes beyond a measure of one, or at one where the stem does not end short; then -ll."""
    bare = F.regexp_replace(w, "e$", "")
    short = _bound(bare, lambda s: F.when(s.rlike(f"^{TWO}") | (s.rlike(f"^{ONE}") & ~s.rlike(f"{CVC}$")), s).otherwise(F.concat(s, F.lit("e"))))
    return _bound(F.when(w.endswith("e"), short).otherwise(w), lambda x: F.when(x.endswith("ll") & x.rlike(f"^{C}*{V}+{C}+{V}+.*ll$"), F.regexp_replace(x, "l$", "")).otherwise(x))


STEPS = (_marked, _plural, _past, _last_y, _replaced(STEP_2, ONE), _replaced(STEP_3, ONE), _replaced(dict.fromkeys(STEP_4, ""), TWO), _last_e)


def porter(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters stay."""
    out = word
    for step in STEPS:
        out = _bound(out, step)
    return F.when(F.length(word) > 2, F.replace(out, F.lit("Y"), F.lit("y"))).otherwise(word)

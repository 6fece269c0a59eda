"""Main text of web pages by differencing with the nearest page of the host (operator 10).

A page is read into lines (the blocks of its text), each with its place: inside an article, inside something that
is never main text (menus, headers, footers, asides, forms, scripts, adverts, notices, comments), or neither. Pages
are put in the order of (host, path); each is paired with the one of its two neighbours on the host whose path
shares more segments. The pair's lines are aligned by longest common subsequence and shared lines are deleted:
what two pages of a site repeat in the same order is its frame.

Every page is aligned, whether or not it marks an article. Two guards keep copied main text: where half or more of a
page's article lines are shared, the articles are near-copies and stay; where all lines of a page are shared, the
pair are copies of each other and nothing is deleted.

Defined results: null or empty html has the empty text; a host's only page is not differenced; pages with equal
URLs are neighbours in the order of page_id; URLs without a host form one host; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Elements of HTML by their part in a page.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "xmp", "title"}
NEVER = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "object", "canvas", "video", "audio"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SPACES = {"br", "td", "th", "img"}
CLASS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    r"sidebar|side-bar|footer|header|masthead|comment|comments|disqus|replies|respond|related|share|sharing|social|newsletter|subscribe|signup|login|search|pagination|pager|widget|toolbar|copyright)(?:$|[\s_-]|\d)",
    re.I,
)
ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)(.*)$", re.S)

SOMEWHERE, ARTICLE = 0, 1
LONGEST_TABLE = 50_000_000  # cells of an alignment's table held at once


def dropped(tag: str, attributes: str) -> bool:
    if tag in NEVER:
        return True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id") and CLASS.search(value) or name == "role" and value.lower() in ROLE or name == "aria-hidden" and value.lower() == "true":
            return True
    return name_hidden(attributes)


def name_hidden(attributes: str) -> bool:
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes, re.I))


def lines(html: str) -> tuple[list[str], list[int]]:
    """The text blocks of a page in order, and whether each stands in an article."""
    out: list[str] = []
    place: list[int] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open containers: tag, in something that is dropped, in an article
    off = inside = False

    def close():
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(text)
                place.append(ARTICLE if inside else SOMEWHERE)

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            if not off:
                parts.append(html[at:])
            break
        if m.start() > at and not off:
            parts.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, shut = m[2].lower(), bool(m[1])
        if tag in RAW and not shut:
            if not m[0].endswith("/>") or tag != "svg":
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            elif tag in SPACES and not off:
                parts.append(" ")
            continue
        block = tag in BLOCKS or tag in NEVER
        if block:
            close()
        if shut:
            if any(t == tag for t, _, _ in stack):
                while stack:
                    t, was_off, was_in = stack.pop()
                    if was_off != off or was_in != inside:
                        close()
                    off, inside = was_off, was_in
                    if t == tag:
                        break
            continue
        gone = dropped(tag, m[3])
        if tag in ("p", "li") and not gone and stack and stack[-1][0] == tag:  # a paragraph ends the one before it
            _, off, inside = stack.pop()
        if block or gone or tag == "span":
            stack.append((tag, off, inside))
            off = off or gone
            inside = inside or tag in ("article", "main") or "itemprop" in m[3] and "articleBody" in m[3]
    close()
    return out, place


def place_of(url: str | None) -> tuple[str, str]:
    m = HOST.match((url or "").strip())
    return (m[1].lower(), m[2] + m[3]) if m else ("", url or "")


def path_likeness(a: str, b: str) -> tuple[int, int]:
    """Leading path segments, then characters, that two paths share."""
    x, y = a.split("/"), b.split("/")
    same = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return same, next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


def shared(a: list[int], b: list[int], cells: int = LONGEST_TABLE) -> set[int]:
    """Positions of a in a longest common subsequence with b.

    Lines that only one side has are left out first. A table of over `cells` cells is halved as Hirschberg does, so
    memory stays bounded and the subsequence is a longest one at every size.
    """
    in_b, in_a = set(b), set(a)
    left = [i for i, x in enumerate(a) if x in in_b]
    right = [x for x in b if x in in_a]
    out: set[int] = set()
    work = [(left, right)]
    while work:
        rows, columns = work.pop()
        least = min(len(rows), len(columns))
        n = next((k for k in range(least) if a[rows[k]] != columns[k]), least)
        out.update(rows[:n])
        rows, columns = rows[n:], columns[n:]
        least = min(len(rows), len(columns))
        n = next((k for k in range(least) if a[rows[-1 - k]] != columns[-1 - k]), least)
        out.update(rows[len(rows) - n :])
        rows, columns = rows[: len(rows) - n], columns[: len(columns) - n]
        if not rows or not columns:
            continue
        if len(rows) == 1 or len(rows) * len(columns) <= cells:
            out |= _aligned(a, rows, columns)
            continue
        half = len(rows) // 2
        ahead = _lengths([a[i] for i in rows[:half]], columns)
        behind = _lengths([a[i] for i in reversed(rows[half:])], columns[::-1])[::-1]
        cut = int(np.argmax(ahead + behind))
        work += [(rows[:half], columns[:cut]), (rows[half:], columns[cut:])]
    return out


def _bits(right: list[int]) -> dict[int, int]:
    at: dict[int, int] = {}
    for j, x in enumerate(right):
        at[x] = at.get(x, 0) | 1 << j
    return at


def _lengths(left: list[int], right: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of left with right[:j], for every j from 0."""
    at, full = _bits(right), (1 << len(right)) - 1
    row = full
    for x in left:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    grown = np.unpackbits(np.frombuffer((~row & full).to_bytes(-(-len(right) // 8), "little"), np.uint8), bitorder="little")[: len(right)]
    return np.concatenate(([0], np.cumsum(grown, dtype=np.int64)))


def _aligned(a: list[int], left: list[int], right: list[int]) -> set[int]:
    """Positions among left of a longest common subsequence of a with right (rows of the table as bits of whole numbers)."""
    at = _bits(right)
    full = (1 << len(right)) - 1
    row, rows = full, []
    for i in left:
        hit = row & at.get(a[i], 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out, j = set(), len(right) - 1
    for k in range(len(left) - 1, -1, -1):  # a zero bit: the table grows there
        before = rows[k - 1] if k else full
        grown = ~rows[k] & full & ((1 << (j + 1)) - 1)
        if (grown.bit_count()) > (~before & full & ((1 << (j + 1)) - 1)).bit_count():
            hits = at.get(a[left[k]], 0) & ((1 << (j + 1)) - 1)
            need = grown.bit_count()
            while hits:  # the match that leaves as much to its left as the table says
                p = hits.bit_length() - 1
                if (~before & full & ((1 << p) - 1)).bit_count() == need - 1:
                    out.add(left[k])
                    j = p - 1
                    break
                hits &= (1 << p) - 1
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*(.*)$", 1), F.lit(""))
    key = F.struct(host.alias("host"), path.alias("path"), F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("id")).alias("key")

    def parse(batches):
        for b in batches:
            got = [lines(h) if h else ([], []) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("key"), pa.array([x for x, _ in got], pa.list_(pa.string())), pa.array([p for _, p in got], pa.list_(pa.int8()))], ["page_id", "url", "key", "lines", "place"])

    keyed = pages.select("page_id", "url", key, "html")
    parsed = keyed.mapInArrow(common.freeing(parse), f"page_id {kind}, url string, key {keyed.schema['key'].dataType.simpleString()}, lines array<string>, place array<tinyint>")
    runs = common.ordered_blocks(pages.select(key), parsed, "key", 8 * common.partitions(spark), before=True)

    def difference(batches):
        held: list[dict] = []  # at most three pages: the last two done with and the next

        def finish(prev, row, nxt):
            pairs = [r for r in (prev, nxt) if r is not None and r["key"]["host"] == row["key"]["host"] and r["block"] == row["block"]]
            keep = row["lines"]
            if pairs:
                other = max(pairs, key=lambda r: (*path_likeness(row["key"]["path"], r["key"]["path"]), r is prev))
                h = lambda r: [xxhash.xxh64_intdigest(x) for x in r["lines"]]
                gone = shared(h(row), h(other))
                article = {i for i, p in enumerate(row["place"]) if p}
                if 2 * len(gone & article) >= len(article):  # near-copies of one article
                    gone -= article
                if len(gone) < len(keep):
                    keep = [x for i, x in enumerate(keep) if i not in gone]
            return row["page_id"], row["url"], "\n".join(keep)

        schema = None
        for b in batches:
            schema = b.schema
            out = []
            for row in b.to_pylist():
                held.append(row)
                if len(held) >= 2 and held[-1]["block"] != held[-2]["block"]:
                    if held[-2]["copy"] == 0:
                        out.append(finish(held[-3] if len(held) > 2 else None, held[-2], None))
                    held = held[-1:]
                elif len(held) >= 2:
                    if held[-2]["copy"] == 0:
                        out.append(finish(held[-3] if len(held) > 2 else None, held[-2], held[-1]))
                    held = held[-2:]
            yield batch(out, schema)
        if held and held[-1]["copy"] == 0:
            yield batch([finish(held[-2] if len(held) > 1 else None, held[-1], None)], schema)

    def batch(rows, schema):
        i, u, t = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(i, schema.field("page_id").type), pa.array(u, pa.string()), pa.array(t, pa.string()), pa.array(np.array([len(x) for x in t], np.int64))], ["page_id", "url", "text", "n_chars"])

    return runs.mapInArrow(common.freeing(difference), f"page_id {kind}, url string, text string, n_chars bigint")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages", "page_id", "url", "html"))


ORACLE: dict[str, str] = {}
QUERIES = {"op10_page_text": op10_page_text}

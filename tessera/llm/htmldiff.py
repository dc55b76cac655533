"""Operator 4: main text of web pages by nearest-URL page differencing.

A page is cut into lines, the texts of its blocks in page order.  Within each
host, pages are paired with the one whose path is nearest: they are sorted by
path, and of both neighbours the one with the longer common beginning is taken.
The lines of a pair are aligned by their longest common subsequence, and lines
that the pair shares are the site's, not the page's: they are deleted.

Differencing alone cannot tell an advert that changes from page to page from the
article, nor a passage that two articles quote from a shared menu.  Marked-up
structure decides where it is there: menus, headers, footers, sidebars, notices,
adverts, forms, scripts and comments go by their element, role, or a whole name in
class or id (html, body, main and article never go by class or id); if
a page has an ``article`` (or ``main``) element, its lines are the article's and
are kept even if shared.  Differencing decides for all other lines.

Scale: pages of one host with the same lines are one entry, and only hashes of
the lines are sorted and compared; the texts are never shuffled for that.  The
sort is a range partitioning by host, path and lines, so that a host with a
third of all pages is spread over many tasks; the entries at the partitions' ends
(two each) meet their neighbours by one small window.

Defined results: a null or empty page, and one without text, is the empty
string.  A page that has no other entry in its host, or all of whose open lines
are shared, keeps its open lines.  Repeated rows get equal results.  Null urls
belong to the host and path ''.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, stored

RUN_PAGES = 500  # pages held as Python objects at once

# ----------------------------------------------------------------- parsing

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
_RAW = r"script|style|template|iframe|svg|canvas|object|textarea|audio|video"
_DROPPED = frozenset("head nav footer aside form button select option menu dialog label fieldset datalist map annotation annotation-xml".split())
_FRAMES = frozenset("html body main article".split())  # never unwanted by class or id
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice "
    "notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup signin login menu menus nav navbar navigation "
    "breadcrumb breadcrumbs sidebar sidebars widget widgets related recommended recommendations share sharing social comment comments reply replies respond "
    "disqus footer masthead search searchbox pagination pager toolbar skip form hidden".split()
)
_HEADERS = frozenset(("header", "topbar"))
# Compound names: a name from above, first, with one of these after it; or, as the
# last part, one of those that name a place on the page.  Names that only say
# something about an element ("has-comments", "no-sidebar") stay.
_HOLDERS = frozenset(
    "area bar block box button buttons container form group holder inner item items link links list menu notice panel row section slot thread unit widget "
    "wrap wrapper zone".split()
)
_PLACES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comments cookie cookies footer masthead menu modal nav navbar navigation "
    "newsletter overlay pagination popup promo sharing sidebar sponsor sponsored toolbar".split()
)
_STATES = frozenset("has have no not with without is js show hide".split())
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<({_RAW})(?![\w:-])(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?:/>|>.*?(?:</\1\s*>|$))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?][^>]*>?|<[a-zA-Z][^>]*(?:>|$)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

OPEN, ARTICLE, UNWANTED = 0, 1, 2  # where a line stands


def _names_unwanted(name: str, names: frozenset[str]) -> bool:
    """Does a class or id, whole or compound, stand for one of the names?"""
    if name in names:
        return True
    parts = [x for x in re.split("[-_]+", name) if x]
    first, rest = parts[:1], parts[1:]
    if not rest or _STATES & set(parts):
        return False
    return (first[0] in names and all(x in names or x in _HOLDERS for x in rest)) or (rest[-1] in names and rest[-1] in _PLACES | _HEADERS)


def _unwanted(name: str, attributes: str, in_article: bool) -> bool:
    """Is the element one that holds no main text?"""
    if name in _DROPPED or (name in ("header", "math", "noscript") and not in_article):
        return True
    if not attributes:
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id"):
            names = _NAMES if in_article else _NAMES | _HEADERS
            if name not in _FRAMES and any(_names_unwanted(x, names) for x in value.split()):
                return True
        elif key == "role" and value in _ROLES:
            return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """(line, OPEN, ARTICLE or UNWANTED) of the blocks of a page."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    article = 0  # open article and main elements
    skip, depth = "", 0  # the unwanted element that is open, and its like within

    def end_block() -> None:
        line = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if line:
            out.append((line, UNWANTED if skip else ARTICLE if article else OPEN))

    at, html = 0, html or ""
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        closing = m[2] == "/"
        if name in _BLOCK:
            end_block()
        elif name in ("br", "td", "th", "img"):
            parts.append(" ")
        if skip in ("p", "li") and name in _BLOCK and (skip == "p" or name == "li" or closing):
            end_block()
            skip = ""  # its end tag may be left out
            if closing and name in ("p", "li"):
                continue
        if skip:
            if name == skip:
                depth += -1 if closing else 1
                if not depth:
                    end_block()
                    skip = ""
        elif closing:
            if name in ("article", "main"):
                article = max(0, article - 1)
        elif name not in _VOID:
            if _unwanted(name, m[4], article > 0):
                end_block()
                skip, depth = name, 1
            elif name in ("article", "main"):
                article += 1
    parts.append(html[at:])
    end_block()
    return out


# ------------------------------------------------------------- differencing


def shared_lines(mine: list[int], other: list[int]) -> list[int]:
    """Places in ``mine`` of a longest common subsequence with ``other``.

    Bit-parallel: a row of len(mine) bits for each line of ``other`` that occurs
    in ``mine``; the zeros among the first i bits of row j count what the first i
    and j lines have in common.  The rows are then walked back.
    """
    lo = 0
    while lo < min(len(mine), len(other)) and mine[lo] == other[lo]:
        lo += 1
    hi = 0
    while hi < min(len(mine), len(other)) - lo and mine[-1 - hi] == other[-1 - hi]:
        hi += 1
    a = mine[lo : len(mine) - hi]
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    b = [x for x in other[lo : len(other) - hi] if x in where]
    full = (1 << len(a)) - 1
    rows = [full]
    for x in b:
        s = rows[-1]
        u = s & where[x]
        rows.append(((s + u) | (s - u)) & full)

    def common(i: int, j: int) -> int:
        return i - (rows[j] & ((1 << i) - 1)).bit_count()

    found, i, j = [], len(a), len(b)
    while i and j and (n := common(i, j)):
        if common(i, j - 1) == n:
            j -= 1
        elif common(i - 1, j) == n:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append(lo + i)
    return sorted([*range(lo), *found, *range(len(mine) - hi, len(mine))])


def common_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def nearest_shared(row: dict, before: dict | None, after: dict | None) -> list[int]:
    """Lines of ``row`` that the nearer neighbour of its host has too."""
    near = [n for n in (before, after) if n is not None and n["host"] == row["host"]]
    if not near:
        return []
    return shared_lines(row["lines"], max(near, key=lambda n: common_start(row["path"], n["path"]))["lines"])


_ROW = [("host", pa.string()), ("path", pa.string()), ("digest", pa.int64()), ("lines", pa.list_(pa.int64()))]
_PAIRED = pa.schema([*_ROW, ("place", pa.string()), ("inner", pa.struct(_ROW)), ("shared", pa.list_(pa.int32()))])
_PAIRED_SQL = "host string, path string, digest bigint, lines array<bigint>, place string, inner struct<host:string,path:string,digest:bigint,lines:array<bigint>>, shared array<int>"


def template_lines(entries: DataFrame) -> DataFrame:
    """(host, digest, shared): for every entry (host, path, digest, lines) the
    places of the lines that it shares with its nearest entry of the host."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.select("host", "path", "digest", "lines").repartitionByRange(parts, "host", "path", "digest").sortWithinPartitions("host", "path", "digest")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs rows inside a partition; its first and last row know only one
        neighbour (``inner``) and are marked by ``place``."""
        before = row = None
        for batch in batches:
            out = []
            for after in batch.to_pylist():
                if row is not None:
                    done = {"place": None, "shared": nearest_shared(row, before, after)} if before else {"place": "first", "inner": after}
                    out.append(row | done)
                before, row = row, after
            yield pa.RecordBatch.from_pylist(out, schema=_PAIRED)
        if row is not None:
            yield pa.RecordBatch.from_pylist([row | {"place": "last" if before else "only", "inner": before}], schema=_PAIRED)

    def at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                before = r["inner"] if r["place"] == "last" else r["before"]
                after = r["inner"] if r["place"] == "first" else r["after"]
                out.append({"host": r["host"], "digest": r["digest"], "shared": nearest_shared(r, before, after)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("host", pa.string()), ("digest", pa.int64()), ("shared", pa.list_(pa.int32()))]))

    found = stored(ordered.mapInArrow(within, _PAIRED_SQL), "page-pairs")
    inside = found.where("place IS NULL").select("host", "digest", "shared")
    # at most two rows for each partition
    order = Window.orderBy("host", "path", "digest")
    row = F.struct("host", "path", "digest", "lines")
    edges = found.where("place IS NOT NULL").withColumns({"before": F.lag(row).over(order), "after": F.lead(row).over(order)})
    return inside.unionByName(edges.drop("shared").mapInArrow(at_edges, "host string, digest bigint, shared array<int>"))


# ---------------------------------------------------------------- operator


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep..., text, n_lines, n_shared): the main text of every row."""
    from tessera.llm.urlfilter import host_and_path

    @F.arrow_udf("struct<lines:array<string>,kinds:array<int>>")
    def parse(pages_: pa.Array) -> pa.Array:
        kind = pa.struct([("lines", pa.list_(pa.string())), ("kinds", pa.list_(pa.int32()))])
        parts = [pa.array([], kind)]
        for at in range(0, len(pages_), RUN_PAGES):
            found = (page_lines(h.as_py()) for h in pages_[at : at + RUN_PAGES])
            parts.append(pa.array([{"lines": [x for x, _ in f], "kinds": [k for _, k in f]} for f in found], kind))
        return pa.concat_arrays(parts)

    host, path = host_and_path(col(url_col))
    parsed = pages.select(F.struct(*[col(c) for c in keep]).alias("kept"), host.alias("host"), path.alias("path"), parse(col(html_col)).alias("p"))
    hashes = F.transform("p.lines", lambda x: F.xxhash64(x))
    lined = parsed.select("kept", "host", "path", "p", hashes.alias("lines")).withColumn("digest", F.xxhash64("lines"))
    entries = lined.groupBy("host", "digest").agg(F.min("path").alias("path"), F.first("lines").alias("lines"))
    shared = template_lines(entries)
    met = lined.select("kept", "host", "digest", "p").join(shared, ["host", "digest"], "left")
    return met.select("kept.*", text_of(F.col("p"), F.col("shared")).alias("text"), F.size("p.lines").alias("n_lines"), F.coalesce(F.size("shared"), F.lit(0)).alias("n_shared"))


def text_of(parsed: Column, shared: Column) -> Column:
    """The lines that stay, one below the other."""

    @F.arrow_udf("string")
    def run(parsed_: pa.Array, shared_: pa.Array) -> pa.Array:
        return pa.array((kept_text(p["lines"], p["kinds"], s or []) for p, s in ((a.as_py(), b.as_py()) for a, b in zip(parsed_, shared_))), pa.string())

    return run(parsed, shared)


def kept_text(lines: list[str], kinds: list[int], shared: list[int]) -> str:
    if ARTICLE in kinds:
        return "\n".join(x for x, k in zip(lines, kinds) if k == ARTICLE)
    common = set(shared)
    own = [x for i, (x, k) in enumerate(zip(lines, kinds)) if k == OPEN and i not in common]
    return "\n".join(own or [x for x, k in zip(lines, kinds) if k == OPEN])

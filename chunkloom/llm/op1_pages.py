"""Main text of web pages, by differencing each page with its nearest neighbours by URL.

A page becomes lines: the white-space-normalised text of its blocks, each with the innermost blocks it
stands in and with what markup says of it (boilerplate, part of the article, or unknown). Within a
host distinct pages are ordered by URL path, and each is paired with those before and after it. Their
lines, text and place together, are aligned by a longest common subsequence, and shared lines are
deleted. A copy of a whole page is no neighbour of it.

Markup decides what differencing leaves open: shared lines within an article element stay, as copied
passages are shared too, and lines that no neighbour shares go if markup calls them boilerplate.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm._shared import map_arrow, slices, written

#: Elements whose content is never main text.
DROPPED = frozenset("script style noscript template nav header footer aside form head title iframe object embed svg canvas button select option textarea input label fieldset dialog menu datalist audio video map math".split())
#: Elements whose content is taken as it stands: markup within it is none, up to the end tag.
RAW = frozenset("script style textarea title iframe noscript template".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(("article", "main"))
#: Words of class and id values, role values and such that mark parts beside the article.
MARKED = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comments-area consent cookie cookies copyright disqus footer header menu menubar modal nav navbar navigation newsletter notice notices pagination popup popups promo promoted promotion related respond share sharing sidebar sidebars signup skip-link social sponsor sponsored subscribe subscription toolbar toc widget widgets contentinfo complementary search reply replies alert alerts".split())
#: Those of them that also mark a part as one piece of a longer name, as in top-nav.
MARKED_PIECES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer menu nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsored subscribe widget".split())
#: Elements of running text: within an article their names tell of what they say, not of a part beside it, and an id of theirs is an anchor.
TEXT_ELEMENTS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre em strong b i u a code cite q span table thead tbody tr td th dl dt dd figure figcaption hgroup".split())
#: A name that begins so tells of another part.
ELSEWHERE = ("has-", "no-", "with-", "without-")
#: An element that closes another one of its own kind left open.
SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Quotes count only after an equals sign, so that an apostrophe in a bare value ends with the tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAMES = re.compile(r"[a-z0-9]+(?:[-_]+[a-z0-9]+)*")
_SPACE = re.compile(r"\s+")

BOILERPLATE, UNKNOWN, ARTICLE = 0, 1, 2
#: Cells of an alignment table that are held at once; longer pairs of pages are divided.
LCS_CELLS = 1 << 27


#: How many of the innermost blocks around a line count as its place.
PLACE_BLOCKS = 3


def _marked(element: str, attributes: str, inside: bool) -> bool:
    """Whether attributes mark an element as beside the article; inside: it stands in an article element."""
    if not attributes.strip() or element in ("html", "body"):
        return False
    text = element in TEXT_ELEMENTS
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            if text and (inside or name == "id"):
                continue
            for word in _NAMES.findall(value.replace("_", "-")):
                if word in MARKED:
                    return True
                if element not in CONTAINERS and not word.startswith(ELSEWHERE) and not MARKED_PIECES.isdisjoint(word.split("-")):
                    return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def parse_lines(page: str | None) -> list[tuple[str, int, str]]:
    """(text, state, place) of each block with text, in page order. References are decoded once; white space is one
    space; place names the innermost blocks around the line."""
    out: list[tuple[str, int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each one starts a part to drop
    open_names: dict[str, int] = {}
    dropped = inside = 0
    held = UNKNOWN

    def flush() -> None:
        nonlocal parts
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                around = [name for name, _ in stack[-16:] if name in BLOCKS]
                out.append((text, held, "/".join(around[-PLACE_BLOCKS:])))
            parts = []

    def close(at: int) -> None:
        nonlocal dropped, inside
        for name, gone in stack[at:]:
            dropped -= gone
            inside -= name in CONTAINERS
            open_names[name] -= 1
        del stack[at:]

    page = page or ""
    at = 0
    while True:
        found = _TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            state = BOILERPLATE if dropped else ARTICLE if inside else UNKNOWN
            if state != held:
                flush()
                held = state
            parts.append(text)
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        if found[1]:
            if open_names.get(name):  # a stray end tag costs nothing, however many elements are open
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                close(i)
            continue
        for other in SELF_CLOSING.get(name, ()):
            if stack and stack[-1][0] == other:
                close(len(stack) - 1)
        attributes = found[3] or ""
        gone = name in DROPPED or _marked(name, attributes, inside > 0)
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        stack.append((name, gone))
        open_names[name] = open_names.get(name, 0) + 1
        dropped += gone
        inside += name in CONTAINERS
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices of a in a longest common subsequence of a and b; bit-parallel over b, divided where both are long."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    middle = _common(a[head : len(a) - tail], b[head : len(b) - tail], head)
    return [*range(head), *middle, *range(len(a) - tail, len(a))]


def _common(a: list[int], b: list[int], base: int) -> list[int]:
    shared = set(a) & set(b)
    left = [(i, x) for i, x in enumerate(a) if x in shared]
    b = [x for x in b if x in shared]
    if not left:
        return []
    if len(left) * len(b) > LCS_CELLS and len(left) > 1:  # Hirschberg: only two rows of the table at a time
        half = len(left) // 2
        up = _prefix_lengths([x for _, x in left[:half]], b)
        down = _prefix_lengths([x for _, x in left[half:]][::-1], b[::-1])[::-1]
        cut = int(np.argmax(up + down))
        first, second = [left[:half], b[:cut]], [left[half:], b[cut:]]
        return [i for part, other in (first, second) for i in _picked(part, other, base)]
    return _picked(left, b, base)


def _picked(left: list[tuple[int, int]], b: list[int], base: int) -> list[int]:
    if len(left) * len(b) > LCS_CELLS and len(left) > 1:
        return [left[k][0] + base for k in _common([x for _, x in left], b, 0)]
    rows = _rows([x for _, x in left], b)
    out, j = [], len(b)
    for i in range(len(left) - 1, -1, -1):
        while j and not _gains(rows[i], j):
            j -= 1
        if not j:
            break
        above = rows[i - 1] if i else -1
        if _count(rows[i], j) > _count(above, j):
            out.append(left[i][0] + base)
            j -= 1
    return out[::-1]


def _rows(a: list[int], b: list[int]) -> list[int]:
    """For each prefix of a, a bit string with a 0 at j where the LCS with b's first j + 1 grows."""
    match: dict[int, int] = {}
    for j, x in enumerate(b):
        match[x] = match.get(x, 0) | 1 << j
    full, v, rows = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for x in a:
        u = v & match.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _gains(row: int, j: int) -> bool:
    return not row >> (j - 1) & 1


def _count(row: int, j: int) -> int:
    return j - ((row & ((1 << j) - 1)).bit_count())


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    row = _rows(a, b)[-1] if a else (1 << len(b)) - 1
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def line_key(text: str, place: str) -> int:
    """What two lines must have in common to be shared: their text, and the blocks they stand in."""
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(f"{place}\n{text}")
    return value - (1 << 64) if value >> 63 else value


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def line_table(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path and a page's lines: texts, keys and states; and version, which equal lists of lines share.

    One row a row of pages. Null html has no lines; null ids and urls stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                found = [parse_lines(page) for page in piece.column(2).to_pylist()]
                columns = [pa.array([[t for t, _, _ in own] for own in found], pa.list_(pa.string())), pa.array([[line_key(t, at) for t, _, at in own] for own in found], pa.list_(pa.int64())), pa.array([[s for _, s, _ in own] for own in found], pa.list_(pa.int8()))]
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], *columns], names=["page_id", "url", "texts", "keys", "states"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    lines = map_arrow(rows, run, "page_id long, url string, texts array<string>, keys array<long>, states array<tinyint>")
    known = F.coalesce("url", F.lit(""))
    return lines.withColumns({"host": host(known), "path": path(known), "version": F.xxhash64("keys", "states")})


def shared_lines(lines: DataFrame) -> DataFrame:
    """(host, version, shared) of page versions that share lines with a neighbour: which of their lines those are.

    Equal pages of a host are one version, at the least of their paths, so a copy is no neighbour. Versions
    are sorted by host, path and content across all tasks, so a host may be of any size; a version's rank
    then finds its neighbours by an equi-join on a key that no two versions share.
    """
    versions = lines.where(F.size("keys") > 0).groupBy("host", "version").agg(F.min("path").alias("path"), F.first("keys").alias("keys"))
    ordered = versions.repartitionByRange("host", "path", "version").sortWithinPartitions("host", "path", "version")
    table = written(ordered.drop("path").withColumn("at", F.monotonically_increasing_id()).withColumns({"part": F.shiftright("at", 33), "pos": F.expr("at & 8589934591")}).drop("at"), "ordered")
    parts = table.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row for each task of the sort: few, whatever the input.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = table.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("pos")).drop("part", "pos", "before")
    near = ranked.select("rank", F.col("host").alias("near_host"), F.col("keys").alias("near"))
    last, following = near.select((F.col("rank") + 1).alias("rank"), F.struct("near_host", "near").alias("last")), near.select((F.col("rank") - 1).alias("rank"), F.struct("near_host", "near").alias("following"))
    paired = ranked.join(last, "rank", "left").join(following, "rank", "left")
    paired = paired.select("host", "version", "keys", *(F.when(F.col(f"{side}.near_host") == F.col("host"), F.col(f"{side}.near")).alias(side) for side in ("last", "following")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for keys, *sides in zip(*(batch.column(i).to_pylist() for i in range(2, 5))):
                at = {i for side in sides if side for i in common_lines(keys, side)}
                found.append([i in at for i in range(len(keys))] if at else None)
            shared = pa.array(found, pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], shared], names=["host", "version", "shared"]).filter(shared.is_valid())

    return map_arrow(paired, run, "host string, version long, shared array<boolean>")


#: Versions that share lines are broadcast while they take no more bytes than this; beyond, their join is shuffled.
BROADCAST_BYTES = 16 << 20


def decided_lines(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url and lines: struct(text, state, shared, stays) of each line of every row of pages, in order.

    A shared line goes unless it stands in an article element; of the others those go that markup calls
    boilerplate. A page of which nothing would stay keeps the lines that markup says nothing of.
    """
    table = written(line_table(pages), "lines")
    found = written(shared_lines(table.select("host", "path", "version", "keys")), "shared")
    size = found.agg(F.coalesce(F.sum(F.size("shared") + 96), F.lit(0))).first()[0]
    met = table.select("page_id", "url", "host", "version", "texts", "states").join(F.broadcast(found) if size <= broadcast_bytes else found, ["host", "version"], "left")

    def judged(text: Column, i: Column) -> Column:
        state, shared = F.get("states", i), F.coalesce(F.get("shared", i), F.lit(False))
        return F.struct(text.alias("text"), state.alias("state"), shared.alias("shared"), ((state == ARTICLE) | ((state == UNKNOWN) & ~shared)).alias("stays"))

    def spared(x: Column) -> Column:
        return F.struct(x["text"].alias("text"), x["state"].alias("state"), x["shared"].alias("shared"), (x["state"] == UNKNOWN).alias("stays"))

    lines = met.select("page_id", "url", F.transform("texts", judged).alias("lines"))
    return lines.withColumn("lines", F.when(F.exists("lines", lambda x: x["stays"]), F.col("lines")).otherwise(F.transform("lines", spared)))


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages, repeated ids included.

    Null html gives empty text. Pages without a host are neighbours of each other; equal pages of a host
    get equal texts; an empty table gives an empty result. Other columns are ignored.
    """
    staying = F.transform(F.filter("lines", lambda x: x["stays"]), lambda x: x["text"])
    return decided_lines(pages, broadcast_bytes).select("page_id", "url", F.array_join(staying, "\n").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


#: For pages whose article is one element of headings, paragraphs, line breaks and inline markup, as in the test tables.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
l AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1|br)>'), lambda x:
  trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[\s\x{85}\x{A0}]+', ' ', 'g'))) AS ls FROM a),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(ls, lambda x: x <> ''), chr(10)), '') AS text FROM l)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""


def op1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))

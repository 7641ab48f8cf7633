"""Main text of web pages, by page structure and by differencing pages of a host.

A page is cut into lines, one per block. Every page is held against another one: pages of a
host are sorted by path, each is paired with the neighbour whose path has more in common with
its own, and the lines of both are aligned by longest common subsequence. Lines in common
belong to the host, the others to the page.

Markup is held against that. Lines inside ``article`` or ``main``, unless an element around them
says that they are not text (menus, footers, forms, comments and so on), are a region. Articles
share whole passages with other articles, so a region with a line of the page's own is the main
text, whole. One that has none is a box that pages of the host repeat if the page's own lines
elsewhere are longer, and they are the main text then, as they are in a page without a region.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.components import stored
from orderloom.llm.ngram_join import within
from orderloom.llm.url_filter import split_url
from orderloom.llm.words import content_hashes

# Element names by what they mean for the text.
REGIONS = frozenset(["article", "main"])
CHROME = frozenset(
    "nav header footer aside form menu dialog button select textarea noscript template iframe "
    "object svg canvas audio video map head title".split()
)
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template")
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr "
    "ul".split()
)
#: Elements that a block may end without an end tag of their own.
LOOSE = frozenset("p li dt dd option td th tr".split())
# Words that mean chrome, alone or with each other and with words of place and form.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie "
    "cookies consent disqus form login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted related replies reply respond search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
PLACE_WORDS = frozenset(
    "area article articles bar block bottom box button buttons column container content entry "
    "footer global group header icons inner item items left link links list main outer page "
    "panel post posts primary reader right secondary section site slot thread top unit user "
    "wrap wrapper".split()
)
# An article has headers and footers of its own; these are the page's.
EDGE_WORDS = frozenset(["header", "footer"])
PAGE_WORDS = frozenset("bottom container global inner main page site top wrap wrapper".split())
#: Elements whose id may name a part of the page; that of a paragraph or heading is an anchor.
PARTS = frozenset("div dl ol section table ul".split())
CHROME_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar".split()
)
#: Elements that a slash ends.
FOREIGN = frozenset(["svg", "math"])
INSIDE, OPEN, AROUND = 0, 1, 2

_SPACE = r"[ \t\n\f\r]"
#: The attributes of a tag, without stepping back. A quote opens a value only after an equals
#: sign; one that is never closed takes the rest of the page, and the tag is not matched.
_ATTRIBUTES = (
    rf"(?:[ \t\n\f\r/]++|(?:=[^ \t\n\f\r/>=]*+|[^ \t\n\f\r/>=]++)"
    rf"(?:{_SPACE}*+={_SPACE}*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+|(?=>|\Z)))?+)*+"
)
_TAG = re.compile(rf"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)({_ATTRIBUTES})>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)([^>]*+)>")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_RAW_END = {n: re.compile(rf"</{n}(?=[ \t\n\f\r/>])", re.I) for n in RAW}
#: One attribute after the other, name and value, so that no value is searched for names.
_ATTRIBUTE = re.compile(
    rf"(=[^ \t\n\f\r/>=]*|[^ \t\n\f\r/>=]+)(?:{_SPACE}*={_SPACE}*(\"[^\"]*\"|'[^']*'|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*))?"
)


@dataclass(frozen=True)
class Line:
    text: str
    where: int


def _is_chrome(name: str, attributes: str) -> bool:
    if name in CHROME:
        return True
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value in CHROME_ROLES:
            return True
        if key == "class" or (key == "id" and name in PARTS):
            if any(map(means_chrome, value.split())):
                return True
    return False


def means_chrome(label: str) -> bool:
    """Whether a class or id, taken whole, names a part of the page that is not its text.

    ``site-header``, ``comment-list`` and ``ad-1`` do; ``entry-header``, ``share-price`` and
    ``search-results`` do not.
    """
    words = {w for w in re.split(r"[^a-z0-9]+", label) if len(w) > 1 and not w.isdigit()}
    if words & EDGE_WORDS and words <= EDGE_WORDS | PAGE_WORDS:
        return True
    return bool(words & CHROME_WORDS) and words <= CHROME_WORDS | PLACE_WORDS


def _tags(html: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """Where markup starts and ends, with name, attributes and whether it ends an element.

    Comments have no name, a raw element is one piece. After a quote that is never closed, tags
    end at the first angle bracket; a tag without any is text. Every character is looked at a
    fixed number of times, however broken the markup is.
    """
    at, pattern = html.find("<"), _TAG
    while at >= 0:
        following = html[at + 1 : at + 2]
        name = attributes = ""
        end = False
        if following in ("!", "?") or (following == "/" and not _is_letter(html[at + 2 : at + 3])):
            stop = _COMMENT.match(html, at).end()
        elif following == "/" or _is_letter(following):
            tag = pattern.match(html, at)
            if tag is None:
                pattern = _LOOSE_TAG
                tag = pattern.match(html, at)
            if tag is None:
                return
            end, name, attributes, stop = bool(tag[1]), tag[2].lower(), tag[3], tag.end()
            if not end and name in _RAW_END:
                name, close = "", _RAW_END[name].search(html, stop)
                close = close and _LOOSE_TAG.match(html, close.start())
                stop = close.end() if close else len(html)
        else:
            at = html.find("<", at + 1)
            continue
        yield at, stop, name, attributes, end
        at = html.find("<", stop)


def _is_letter(c: str) -> bool:
    return "a" <= c <= "z" or "A" <= c <= "Z"


def page_lines(html: str) -> list[Line]:
    """The page's blocks in order, white space collapsed, empty ones left out.

    A document head, scripts, styles, comments and markup are no lines. An element left open
    ends with the one around it. Several articles that together hold less text than what is
    open around them are teasers, and open as well.
    """
    lines: list[Line] = []
    parts: list[str] = []
    # Open elements: name, whether it opens a region, whether it is chrome.
    stack: list[tuple[str, bool, bool]] = []
    # Where elements of a name, and blocks, are open in the stack.
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    regions = chrome = at = articles = mains = 0

    def close_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append(Line(text, AROUND if chrome else INSIDE if regions else OPEN))
            parts.clear()

    def pop_to(depth: int) -> None:
        nonlocal regions, chrome
        while len(stack) > depth:
            name, region, skipped = stack.pop()
            places[name].pop()
            if name in BLOCKS:
                blocks.pop()
            regions -= region
            chrome -= skipped

    for start, stop, name, attributes, end in _tags(html):
        if start > at:
            parts.append(unescape(html[at:start]))
        at = stop
        if not name:
            continue
        block = name in BLOCKS
        if block:
            close_block()
        elif name == "br":
            parts.append(" ")
        if end:
            # An end tag does not reach out of the block around it.
            if places.get(name) and (block or not blocks or blocks[-1] <= places[name][-1]):
                depth = places[name][-1]
                if stack[depth][2]:
                    close_block()
                pop_to(depth)
        elif name not in VOID and not (name in FOREIGN and attributes.endswith("/")):
            if block:
                # A paragraph left open ends at any block, an item or cell at one like it.
                for loose in ("p", name if name in LOOSE else "p"):
                    if blocks and stack[blocks[-1]][0] == loose:
                        pop_to(blocks[-1])
            if name == "body":
                # The head ends here even if it was never closed.
                pop_to(0)
            region, skipped = name in REGIONS, _is_chrome(name, attributes)
            if skipped:
                close_block()
            if region and not regions and not chrome and not skipped:
                articles += name == "article"
                mains += name == "main"
            places.setdefault(name, []).append(len(stack))
            if block:
                blocks.append(len(stack))
            stack.append((name, region, skipped))
            regions += region
            chrome += skipped
    if at < len(html):
        parts.append(unescape(html[at:]))
    close_block()
    if articles > 1 and not mains:
        sizes = [sum(len(x.text) for x in lines if x.where == w) for w in (INSIDE, OPEN)]
        if sizes[0] < sizes[1]:
            return [Line(x.text, OPEN if x.where == INSIDE else x.where) for x in lines]
    return lines


def main_lines(lines: list[Line], shared: set[int] = frozenset()) -> list[str]:
    """The main text: the lines of a marked region, or else those neither around nor shared.

    ``shared`` are the positions of the lines in common with the nearest page.
    """
    if has_region(lines) and not repeats_region(line_places(lines), shared):
        return [line.text for line in lines if line.where == INSIDE]
    return [x.text for i, x in enumerate(lines) if x.where == OPEN and i not in shared]


def has_region(lines: list[Line]) -> bool:
    return any(line.where == INSIDE for line in lines)


def line_places(lines: list[Line]) -> np.ndarray:
    """Code points of each line: of one in a region below zero, of one around the text zero."""
    sign = {INSIDE: -1, OPEN: 1, AROUND: 0}
    return np.array([sign[line.where] * len(line.text) for line in lines], np.int32)


def repeats_region(places: np.ndarray, shared: set[int] | list[int]) -> bool:
    """Whether a page's region is all shared, and shorter than the open lines that are not."""
    own = np.ones(len(places), bool)
    own[list(shared)] = False
    region = places < 0
    return not own[region].any() and places[own].sum() > -places[region].sum(dtype=np.int64)


def line_hashes(lines: list[Line]) -> np.ndarray:
    data = [line.text.encode() for line in lines]
    bounds = np.cumsum([0, *map(len, data)])
    joined = np.frombuffer(b"".join(data), np.uint8)
    return content_hashes(joined, bounds[:-1], bounds[1:]).astype(np.int64)


def common_lines(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Divide and conquer over rows of lengths: memory grows with the lines of a page, not with
    their square.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a_rest, b_rest = a[head : len(a) - tail], b[head : len(b) - tail]
    # Lines of one page only are in no common subsequence, and most lines are such.
    a_at = np.flatnonzero(np.isin(a_rest, b_rest))
    middle = _subsequence(a_rest[a_at], b_rest[np.isin(b_rest, a_rest)])
    return [*range(head), *(head + int(a_at[i]) for i in middle), *range(len(a) - tail, len(a))]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        step = row.copy()
        step[1:] = np.maximum(step[1:], np.where(b == x, row[:-1] + 1, 0))
        row = np.maximum.accumulate(step)
    return row


def _subsequence(a: np.ndarray, b: np.ndarray) -> list[int]:
    if not len(a) or not len(b):
        return []
    if len(a) == 1:
        return [0] if (b == a[0]).any() else []
    half = len(a) // 2
    split = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    return _subsequence(a[:half], b[:split]) + [
        half + i for i in _subsequence(a[half:], b[split:])
    ]


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, host, path, html) as (key, host, path, marked, hashes, places)."""
    for batch in batches:
        marked, hashes, places = [], [], []
        for html in batch.column(3):
            lines = page_lines(html.as_py() or "")
            marked.append(has_region(lines))
            hashes.append(line_hashes(lines))
            places.append(line_places(lines))
        bounds = np.cumsum([0, *map(len, hashes)]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.int64), *hashes])
        sizes = np.concatenate([np.zeros(0, np.int32), *places])
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(i) for i in range(3)], pa.array(marked),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(sizes)),
            ],
            ["key", "host", "path", "marked", "hashes", "places"],
        )


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions of the lines that a page shares with the nearer of its neighbours."""
    for batch in batches:
        shared = []
        for row in batch.to_pylist():
            near = [
                (common_prefix(row["path"], row[f"{side}_path"]), row[f"{side}_hashes"])
                for side in ("before", "after")
                if row[f"{side}_hashes"] is not None
            ]
            partner = max(near, key=lambda x: x[0])[1] if near else []
            own, other = np.array(row["hashes"], np.int64), np.array(partner, np.int64)
            shared.append(common_lines(own, other))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(shared, pa.list_(pa.int32()))],
            ["host", "content", "shared"],
        )


def _undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, marked, places, shared) as (key, shared), without regions that stand."""
    for batch in batches:
        places, shared = batch.column(2), batch.column(3)
        stays = [
            not marked.as_py() or repeats_region(np.array(p.as_py(), np.int32), s.as_py())
            for marked, p, s in zip(batch.column(1), places, shared)
        ]
        kept = pa.array(stays, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(kept), shared.filter(kept)], ["key", "shared"]
        )


def shared_lines(pages: DataFrame) -> DataFrame:
    """``key, shared`` for pages without a region that stands; ``pages`` has ``key, url, html``.

    All pages are differenced. Those whose region has lines of its own are left out afterwards.

    Equal pages of a host count once, so a page is never held against its own copy and a
    large group of copies is one row. Pages are numbered in the order of host and path over
    range partitions, and neighbours meet by number: no host is ever gathered in one task.
    """
    rows = pages.select("key", "html", *[c.alias(n) for n, c in split_url(F.col("url")).items()])
    profiles = stored(
        rows.select("key", "host", "path", "html").mapInArrow(
            _profiles, "key bigint, host string, path string, marked boolean, hashes array<bigint>, places array<int>"
        ),
        "page-lines",
    ).withColumn("content", F.xxhash64("hashes"))
    distinct = profiles.groupBy("host", "content").agg(
        F.min("path").alias("path"), F.first("hashes").alias("hashes")
    )
    # Bounds of range partitions are sampled: stored once, so that all that follows agrees.
    ordered = stored(
        distinct.repartitionByRange("host", "path", "content")
        .sortWithinPartitions("host", "path", "content")
        .withColumn("_id", F.monotonically_increasing_id()),
        "page-order",
    ).withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    starts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    numbered = ordered.join(F.broadcast(starts), "_part").withColumn(
        "_at", F.col("_start") + F.col("_row")
    ).select("_at", "host", "content", "path", "hashes")

    def neighbour(side: str, step: int) -> DataFrame:
        return numbered.select(
            (F.col("_at") - step).alias("_at"), F.col("host").alias(f"{side}_host"),
            F.col("path").alias(f"{side}_path"), F.col("hashes").alias(f"{side}_hashes"),
        )

    met = numbered
    for side, step in (("before", -1), ("after", 1)):
        same = F.col(f"{side}_host") == F.col("host")
        met = met.join(neighbour(side, step), "_at", "left").withColumns(
            {c: F.when(same, F.col(c)) for c in (f"{side}_path", f"{side}_hashes")}
        )
    found = met.select(
        "host", "content", "path", "hashes",
        "before_path", "before_hashes", "after_path", "after_hashes",
    ).mapInArrow(_differences, "host string, content bigint, shared array<int>")
    return profiles.select("key", "host", "content", "marked", "places").join(
        found, ["host", "content"]
    ).select("key", "marked", "places", "shared").mapInArrow(
        _undecided, "key bigint, shared array<int>"
    ).distinct()


def extract_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page: the main text and its code points.

    Blocks are joined by a line feed. A null or empty html has an empty text, and so has a
    page of nothing but chrome. A null url has an empty host and path; such pages are paired
    among themselves. A page whose host has no other content loses no lines. Repeated
    rows and null ids stay as they are; other columns are not read; an empty table gives none.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(
        F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"),
        F.xxhash64(page_id, url, html).alias("key"),
    )
    shared = stored(shared_lines(rows), "shared-lines")
    # Pages whose region stands are most; the others are joined to their lines.
    if shared.isEmpty():
        ready = rows.withColumn("shared", F.lit(None).cast("array<int>"))
    else:
        keys = shared.select("key")
        ready = within(rows, keys, "key", "left_anti").withColumn(
            "shared", F.lit(None).cast("array<int>")
        ).unionByName(within(rows, keys, "key").join(shared, "key"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                "\n".join(main_lines(page_lines(h.as_py() or ""), set(s.as_py() or ())))
                for h, s in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()),
                 pa.array([len(t) for t in found], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    return ready.select("id", "url", "html", "shared").mapInArrow(
        texts, f"id {kind}, url string, text string, n_chars bigint"
    ).withColumnRenamed("id", page_id)

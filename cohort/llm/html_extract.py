"""HTML extraction by nearest-URL page differencing.

Pages of a host are ordered by URL path; those that follow each other with the same lines (copies) count as one page,
so that a page is never compared with its copy but with the nearest that differs. They are taken in couples of
neighbours (the last of an odd number joins the couple before it). The text lines of a couple are aligned by their
longest common subsequence; lines that both pages have are template and are deleted. A page whose host has no
other page than copies has no partner and loses nothing by it.

All lines that a reader sees take part in the comparison: menus, headers, footers, adverts and comments too, since these
are what neighbours share. Differencing alone can't give the article, though: neighbours share lines of their articles
(copies, a common opening line), and menus, adverts or footers may differ from page to page. So a line inside the page's
main element (``article``, ``main`` or a part marked as such) is never deleted as shared; and of the lines that no
neighbour shares, those of elements that aren't text of the page by their kind (menus, forms ...) or by a whole token
of their class or id go as well. An article or main element in one of these is text all the same, unless that is a menu,
aside, footer, advert, list of comments or of other articles, or not shown at all.

Cases: null html gives the empty text; a null or odd url counts as host and path ''; broken markup is read as far as it
goes; rows that repeat are copies, and get the same text; a page without any
text gives ''; an empty table gives no rows; input columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import bz2
import hashlib
import json
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohort.llm.common import discard, map_arrow, materialise, ship

# Elements of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
                   "thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("script style noscript template svg canvas iframe object head title nav header footer aside form button select textarea menu dialog".split())
#: Of these, elements whose content no reader sees as text: not even lines to compare.
UNSEEN = frozenset("script style noscript template svg canvas iframe object head title select textarea".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
CLOSES_P = BLOCKS
#: A token of a class or id is a mark if its parts are such words, or words for a place or a container beside at least one of them:
#: cookie-banner, comment-list and main-nav are marks, no-sidebar and content-sidebar-wrap are not.
_MARK = (r"(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|nav|navbar|navigation|menu|breadcrumbs?|"
         r"sidebar|side|widget|footer|header|masthead|cookies?|consent|gdpr|notice|popup|modal|overlay|comments?|commentlist|replies|respond|"
         r"discussion|disqus|share|social|related|recommend(?:ed|ations)?|newsletter|subscribe|subscription|signup|login|search|pagination|pager|toolbar|skip)")
_PLACE = r"(?:list|area|sections?|container|slot|box|bar|left|right|top|bottom|buttons?|links?|posts|form|threads?|items?|panel|unit|block|user|reader|main|site)"
MARKS = re.compile(rf"(?:^|\s)(?:{_PLACE}[_-]+)*{_MARK}(?:[_-]+(?:{_MARK}|{_PLACE}))*(?=$|\s)", re.I)
#: Parts left out with all that is in them; in others that are left out, an article or main element is text again.
CLOSED = NOT_TEXT - {"header", "form", "button"}
CLOSED_ROLES = ROLES - {"banner", "search", "form"}
_PART = r"(?:ads?|adverts?|advertisement|nav|navbar|navigation|footer|comments?|commentlist|replies|respond|discussion|disqus|related|recommend(?:ed|ations)?)"
CLOSED_MARKS = re.compile(rf"(?:^|\s)(?:{_PLACE}[_-]+)*{_PART}(?:[_-]+(?:{_MARK}|{_PLACE}))*(?=$|\s)", re.I)
MAIN_MARKS = re.compile(r"(?:^|[\s_-])(?:article|article-body|post-body|entry-content|post-content|main-content|story|story-body)(?:$|\s)", re.I)
_GAP = re.compile(r"\s+")


#: What a line is: text anywhere, text of the main element, or text of a menu, advert or the like.
PLAIN, MAIN, MARKED = 0, 1, 2


class Reader(HTMLParser):
    """Collects blocks of text as (text, kind), in time linear in the page: no tag looks at more than it opens or closes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int]] = []
        self.open: list[tuple[str, bool, bool, bool, bool]] = []  # element, marked, closed, main, unseen
        self.at: dict[str, list[int]] = {}  # positions of the open elements of a name
        self.mains = 0
        self.now: list[str] = []
        self.aside: list[str] = []

    def flush(self) -> None:
        for parts, kind in ((self.now, MAIN if self.mains else PLAIN), (self.aside, MARKED)):
            if parts:
                text = _GAP.sub(" ", "".join(parts)).strip()
                if text:
                    self.blocks.append((text, kind))
                parts.clear()

    def cut(self, place: int) -> None:
        """Closes the elements from a place on."""
        while len(self.open) > place:
            tag, _, _, main, _ = self.open.pop()
            self.at[tag].pop()
            self.mains -= main

    def last(self, tag: str) -> int:
        found = self.at.get(tag)
        return found[-1] if found else -1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P:  # a block ends an open paragraph
            self.end_open("p", ("article", "section", "div", "main", "body", "td", "li", "blockquote"))
        if tag == "li":
            self.end_open("li", ("ul", "ol", "menu"))
        about = dict(attrs)
        role, named = about.get("role"), f"{about.get('class') or ''} {about.get('id') or ''}"
        _, above, closed_above, _, unseen = self.open[-1] if self.open else (tag, False, False, False, False)
        told = tag in ("article", "main") or role in ("main", "article") or about.get("itemprop") == "articleBody"
        main = told or bool(MAIN_MARKS.search(named))
        hidden = "hidden" in about or about.get("aria-hidden") == "true"
        marked = not main and tag not in ("html", "body")
        closed = closed_above or tag in CLOSED or role in CLOSED_ROLES or hidden or marked and bool(CLOSED_MARKS.search(named))
        closed = closed or main and tag == "article" and bool(re.search(r"(?:^|[\s_-])(?:comments?|replies|reply)(?:$|[\s_-])", named, re.I))
        skip = tag in NOT_TEXT and not (tag == "header" and self.mains) or role in ROLES or marked and bool(MARKS.search(named))
        skip = closed or skip or above and not told
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, skip, closed, main and not skip, unseen or hidden or tag in UNSEEN))
        self.mains += main and not skip

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def end_open(self, tag: str, stop: tuple[str, ...]) -> None:
        place = self.last(tag)
        if place >= 0 and all(self.last(s) < place for s in stop):
            self.cut(place)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        place = self.last(tag)
        if place >= 0:
            self.cut(place)

    def handle_data(self, data):
        _, skip, _, _, unseen = self.open[-1] if self.open else ("", False, False, False, False)
        if not unseen:
            (self.aside if skip else self.now).append(data)


def blocks_of(html: str | None) -> list[tuple[str, bool]]:
    """Blocks of text in page order, each with whether it lies in a main element; menus, scripts and the like are left out."""
    return [(text, kind == MAIN) for text, kind in lines_of(html) if kind != MARKED]


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """Blocks of text in page order, each with its kind; scripts, hidden parts and the like are left out."""
    reader = Reader()
    try:
        reader.feed(html or "")
        reader.close()
    except (AssertionError, ValueError):  # the parser gives up on some broken declarations
        pass
    reader.flush()
    return reader.blocks


def shared_lines(a: list, b: list) -> tuple[set[int], set[int]]:
    """Positions of the longest common subsequence of two lists of lines, in each."""
    names: dict[str, int] = {}
    x = np.array([names.setdefault(t, len(names)) for t in a], np.int64)
    y = np.array([names.setdefault(t, len(names)) for t in b], np.int64)
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    one, two = {*range(head), *range(len(x) - tail, len(x))}, {*range(head), *range(len(y) - tail, len(y))}
    common = set(x[head:len(x) - tail].tolist()) & set(y[head:len(y) - tail].tolist())
    p = [k for k in range(head, len(x) - tail) if int(x[k]) in common]
    q = [k for k in range(head, len(y) - tail) if int(y[k]) in common]
    for i, j in _aligned(x[p], y[q]):
        one.add(p[i])
        two.add(q[j])
    return one, two


def _aligned(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence, in space linear in the lines: halves of the first list are
    aligned on their own with the parts of the second that go with them, down to tables of ``CELLS``."""
    found, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= CELLS or b - a == 1:
            found += [(a + i, c + j) for i, j in _table(x[a:b], y[c:d])]
            continue
        half = (a + b) // 2
        ahead, behind = _lengths(x[a:half], y[c:d]), _lengths(x[half:b][::-1], y[c:d][::-1])
        cut = c + int(np.argmax(ahead + behind[::-1]))
        todo += [(a, half, c, cut), (half, b, cut, d)]
    return found


#: Cells of a table of lengths that is still made whole.
CELLS = 1 << 20


def _table(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence, by the whole table of lengths."""
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, v in enumerate(x, 1):
        row = np.maximum(table[i - 1, 1:], np.where(y == v, table[i - 1, :-1] + 1, 0))
        table[i, 1:] = np.maximum.accumulate(row)
    found, i, j = [], len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            found.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return found


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x with each prefix of y (the empty one first).

    A row of lengths is one long integer: bit j is off where the length grows with line j of y. Lines that
    occur often keep their bits, so that these take a few bytes a line.
    """
    places: dict[int, list[int]] = {}
    for j, v in enumerate(y.tolist()):
        places.setdefault(v, []).append(j)
    often: dict[int, int] = {}
    for v, at in places.items():
        if len(at) > 8:
            bits = np.zeros(len(y), np.uint8)
            bits[at] = 1
            often[v] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << len(y)) - 1
    row = full
    for v in x.tolist():
        met = often.get(v)
        if met is None:
            met = 0
            for j in places.get(v, ()):
                met |= 1 << j
        grown = row & met
        row = ((row + grown) | (row - grown)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(y) // 8), "little"), np.uint8), bitorder="little")[:len(y)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)


def couples(pages: DataFrame, rows_each: int = 2000) -> DataFrame:
    """Rows (row, host, place, couple) for pages (row, url, digest): neighbours by URL path share the number of their couple.

    place numbers the different pages of a host by path: copies that follow each other have one place. Places come from
    a range sort of the keys alone: those begun before a range (a count for each range and host) plus those begun
    within the range. A host of any size is spread over ranges; no host is one task.
    """
    keys = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "digest", "row")
    parts = max(1, -(-keys.count() // rows_each))
    ordered = materialise(keys.repartitionByRange(parts, "host", "path", "digest", "row").withColumn("range", F.spark_partition_id()), "page-order")
    ends = ordered.groupBy("host", "range").agg(F.max(F.struct("path", "digest", "row")).getField("digest").alias("end"))
    following = Window.partitionBy("host").orderBy("range")
    ends = ends.select("host", "range", F.lag("end").over(following).alias("earlier"))
    within = Window.partitionBy("host", "range").orderBy("path", "digest", "row")
    begun = ordered.join(ends, ["host", "range"]).withColumn("before", F.coalesce(F.lag("digest").over(within), "earlier")).withColumn(
        "new", F.when(F.col("before") == F.col("digest"), 0).otherwise(1))
    begun = materialise(begun.withColumn("r", F.sum("new").over(within.rowsBetween(Window.unboundedPreceding, 0))).select("host", "range", "row", "new", "r"), "page-places")
    discard(ordered)
    counts = begun.groupBy("host", "range").agg(F.sum("new").alias("n"))
    before = Window.partitionBy("host").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("host", "range", "start")
    sizes = counts.groupBy("host").agg(F.sum("n").alias("pages"))
    ranked = begun.join(starts.join(sizes, "host"), ["host", "range"]).withColumn("place", F.col("start") + F.col("r") - 1)
    last = F.greatest(F.floor(F.col("pages") / 2) - 1, F.lit(0))  # the odd page joins the last couple
    return ranked.select("row", "host", "place", F.least(F.floor(F.col("place") / 2), last).alias("couple"))


#: Pages are kept, and shuffled to their cuts, by blocks that are compressed as a whole: at most so many pages (a power of
#: two, numbers of rows are made of it), and no further page once there are so many bytes of text.
BLOCK_PAGES, BLOCK_BYTES = 64, 1 << 18
#: A line has no white space but single blanks, so that these stand between the lines of a page and the pages of a block.
LINE, PAGE = "\n", "\x1e"


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_blocks, n_shared), one per row of pages: main text, its blocks, and template lines deleted."""
    kind = pages.schema["page_id"].dataType.simpleString()
    read = map_arrow(pages.select("page_id", "url", "html"), _read,
                     f"page_id array<{kind}>, url array<string>, digest array<binary>, keys array<binary>, lines binary")
    read = materialise(read.withColumn("block", F.monotonically_increasing_id()), "page-lines")
    row = (F.col("block") * BLOCK_PAGES + F.col("at")).alias("row")
    own = read.select("block", F.posexplode(F.arrays_zip("url", "digest")).alias("at", "page")).select(row, "page.url", "page.digest")
    numbered = materialise(couples(own), "page-couples")
    # one row stands for a place, so that copies are compared once; only hashes of lines meet, texts stay where they are
    places = numbered.groupBy("host", "place", "couple").agg(F.min("row").alias("row"))
    ship(pages.sparkSession)
    keys = read.select("block", F.posexplode("keys").alias("at", "keys")).select(row, "keys")
    met = keys.join(places, "row").groupBy("host", "couple")
    found = met.applyInArrow(_difference, "host string, place long, cut array<int>, n_shared long")
    found = numbered.select("row", "host", "place").join(found, ["host", "place"])
    found = found.groupBy(F.expr(f"row div {BLOCK_PAGES}").alias("block")).agg(F.collect_list(F.struct("row", "cut", "n_shared")).alias("cuts"))
    found = materialise(found, "page-cuts")
    discard(numbered)
    rows = read.select("block", "page_id", "url", "lines").join(found, "block").select("page_id", "url", "lines", "cuts")
    return map_arrow(rows, _texts, f"page_id {kind}, url string, text string, n_blocks long, n_shared long")


def _read(batches):
    """A row for each block of pages: lists of what is kept of each page, and the lines of all, compressed."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_PAGES):
            part = batch.slice(at, BLOCK_PAGES)
            digests, keys, texts, packed, ends, size = [], [], [], [], [0], 0
            for html in part.column(2).to_pylist():
                page = lines_of(html)
                # copies are pages with the same text, whatever their menus and adverts; of these lines only the hash is kept
                own = json.dumps([b for b in page if b[1] != MARKED], ensure_ascii=False).encode("utf-8", "surrogatepass")
                digests.append(hashlib.blake2b(own, digest_size=16).digest())
                keys.append(np.array([_key(t) << 2 | k for t, k in page], np.uint64).tobytes())
                texts.append(LINE.join(t for t, k in page if k != MARKED))
                size += len(own)
                if size >= BLOCK_BYTES or len(digests) == part.num_rows:
                    packed.append(bz2.compress(PAGE.join(texts).encode("utf-8", "surrogatepass")))
                    ends.append(len(digests))
                    texts, size = [], 0
            lists = [*part.columns[:2], pa.array(digests, pa.binary()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in lists), pa.array(packed, pa.binary())],
                                             names=["page_id", "url", "digest", "keys", "lines"])


def _key(text: str) -> int:
    """62 bits of a hash of a line; the kind takes the other two."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 2


def _difference(group: pa.Table) -> pa.Table:
    """For each place of a couple: which of its lines (menus and the like not counted) go, and how many lines were found to be template."""
    places = group["place"].to_pylist()
    order = sorted(range(group.num_rows), key=places.__getitem__)
    keys = [np.frombuffer(k, np.uint64) for k in group["keys"].to_pylist()]
    lines = [(k >> np.uint64(2)).tolist() for k in keys]
    shared: list[set[int]] = [set() for _ in lines]
    for i, j in zip(order, order[1:], strict=False):
        one, two = shared_lines(lines[i], lines[j])
        shared[i] |= one
        shared[j] |= two
    cuts, gone = [], []
    for own, both in zip(keys, shared, strict=True):
        kinds = own & np.uint64(3)
        text = np.cumsum(kinds != MARKED) - 1  # a line's number among those that can be text
        cuts.append([int(text[k]) for k in sorted(both) if kinds[k] == PLAIN])
        gone.append(sum(1 for k in both if kinds[k] != MAIN))
    return pa.table({"host": group["host"], "place": group["place"], "cut": pa.array(cuts, pa.list_(pa.int32())), "n_shared": pa.array(gone, pa.int64())})


def _texts(batches):
    for batch in batches:
        for k, (packed, cuts) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            cuts = sorted(cuts.as_py(), key=lambda c: c["row"])
            texts, blocks = [], []
            for page, cut in zip(bz2.decompress(packed.as_py()).decode("utf-8", "surrogatepass").split(PAGE), cuts, strict=True):
                gone = set(cut["cut"])
                kept = [t for n, t in enumerate(page.split(LINE) if page else ()) if n not in gone]
                texts.append("\n\n".join(kept))
                blocks.append(len(kept))
            shared = pa.array([c["n_shared"] for c in cuts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, batch.column(1)[k].values, pa.array(texts, pa.string()), pa.array(blocks, pa.int64()), shared],
                                             names=["page_id", "url", "text", "n_blocks", "n_shared"])

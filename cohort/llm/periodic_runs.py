"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words that repeats with smallest period q, of length ``max(least, 2 * q)`` or more, that no
neighbouring word extends with period q. Words are runs of characters other than ASCII white space.

1. Short periods (below ``2 * FIRST``) by direct lag scans: maximal stretches of words that equal those q further on.
2. Scale W = FIRST, 2 FIRST, 4 FIRST, ... finds periods from 2 W to 4 W. Every window of W words gives its leftmost
   minimum. The first window of a run and the one a period later are equal, so their minima m and m + q are both
   positions of the scale, with equal W words from there on. Pairs of positions with equal words at such a distance are
   seeds. In a stretch with a much shorter period all positions are equal: they form a chain (distances of W / 2 at most).
   Two positions of one chain seed nothing new, and of m and m + q one at least begins its chain - otherwise both chains
   would go on to the left, and so would the run - so that only pairs with a beginning of a chain are tried. Beginnings
   with equal words lie more than W / 2 apart, hence every position is in a bounded number of pairs: seeds grow with the text.
3. Seeds are extended in both directions, over hashes of 2**k words, which meet a differing word at k = 0 exactly.
   Stretches found with several periods keep the smallest, their true one.

Documents are taken together, about ``WORDS`` words at a time (a longer one alone), with a word of its own between them.
Stretches of two words or more count as equal if their 64-bit hashes agree.

Cases: null, empty and blank texts have no words and no runs, and collapse to the empty text; runs may overlap, each
drops its own words; keys may be null or repeat, every row is treated by itself; empty tables give no rows; other
columns of the input are ignored. Memory grows with the longest text: about 150 bytes a word beside the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import WORD, map_arrow

#: Least length of a run in words.
LEAST = 12
#: Words of a window of the smallest scale; lags below twice as many are scanned directly.
FIRST = 8
#: Hashes of 2**k words are kept up to this k for extensions.
LEVELS = 12
#: Words that are searched together.
WORDS = 200_000

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _mix(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    """64-bit hash of pairs; one to one in x if y is fixed."""
    z = x * np.uint64(0x9E3779B97F4A7C15) + y
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def _lags(ids: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of at least ``least`` words with period ``lag``."""
    if len(ids) <= lag:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = np.zeros(len(ids) - lag + 2, np.int8)
    same[1:-1] = ids[lag:] == ids[:-lag]
    turns = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = turns[::2], turns[1::2] + lag
    long = ends - starts >= least
    return starts[long], ends[long]


def _extend(hashes: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """For each pair of positions, how many words from there on (step 1) or before them (step -1) are equal."""
    got = np.zeros(len(a), np.int64)
    for k in range(len(hashes) - 1, -1, -1):
        h, size = hashes[k], 1 << k
        live = np.arange(len(a))
        while len(live):
            shift = got[live] if step > 0 else -got[live] - size
            x, y = a[live] + shift, b[live] + shift
            inside = (x >= 0) & (y < len(h))
            live, x, y = live[inside], x[inside], y[inside]
            live = live[h[x] == h[y]]
            got[live] += size
            if k < len(hashes) - 1:
                break
    return got


def _seeds(key: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position, distance) of equal keys, 2 to 4 widths apart, one of the two the beginning of its chain."""
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    twin = key[1:] == key[:-1]
    some = np.r_[twin, False] | np.r_[False, twin]
    key, at = key[some], at[some]
    if not len(at):
        return at, at
    new = np.r_[True, key[1:] != key[:-1]]
    head = new | (np.diff(at, prepend=at[:1]) > width // 2)
    chain = np.cumsum(head)
    place = np.cumsum(new) * (int(at.max()) + 4 * width + 1) + at
    heads = np.flatnonzero(head)

    def reach(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(place, low), np.searchsorted(place, high)
        n = hi - lo
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.repeat(heads, n), other

    x, y = reach(place[heads] + 2 * width, place[heads] + 4 * width)
    v, u = reach(place[heads] - 4 * width + 1, place[heads] - 2 * width + 1)
    first, second = np.r_[x, u], np.r_[y, v]
    apart = chain[first] != chain[second]
    first, second = first[apart], second[apart]
    return at[first], at[second] - at[first]


def find_runs(ids: np.ndarray, doc: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs in ``ids``; ``doc`` numbers the documents, which distinct words keep apart."""
    found = [(s, e, np.full(len(s), q)) for q in range(1, 2 * FIRST) for s, e in [_lags(ids, q, max(least, 2 * q))]]
    hashes = [_mix(ids.astype(np.uint64), 0)]
    level, low, at, width, seeds = hashes[0], hashes[0], np.arange(len(ids)), 1, []
    while 4 * width <= longest:
        if width >= FIRST:
            positions = at[np.r_[True, at[1:] != at[:-1]]]
            positions = positions[positions < len(level)]
            seeds.append(_seeds(_mix(level[positions], doc[positions]), positions, width))
        level = _mix(level[:-width], level[width:])
        left, right = low[:-width], low[width:]
        at = np.where(left <= right, at[:-width], at[width:])
        low = np.minimum(left, right)
        width *= 2
        if len(hashes) <= LEVELS:
            hashes.append(level)
    if seeds and any(len(x) for x, _ in seeds):
        m, q = (np.concatenate(x) for x in zip(*seeds, strict=True))
        q, m = np.divmod(np.unique(q * len(ids) + m), len(ids))
        start, end = m - _extend(hashes, m, m + q, -1), m + q + _extend(hashes, m, m + q, 1)
        long = end - start >= np.maximum(least, 2 * q)
        found.append((start[long], end[long], q[long]))
    start, end, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][:len(start)]
    return start[first], end[first], q[first]


def _kept(n: int, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Words that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + q, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) == 0


def _search(texts: list[bytes], least: int) -> tuple[list[int], list[list[dict]], list[str]]:
    """Number of words, runs and collapsed text of each text."""
    words = [t.split() for t in texts]  # of bytes: at ASCII white space
    count = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(count + 1) - count
    known: dict[bytes, int] = {}
    ids = np.empty(int(count.sum()) + len(words) + 1, np.int64)
    doc = np.empty(len(ids), np.uint64)
    ids[0], doc[0] = 2**62, 0
    for k, w in enumerate(words):
        b, n = begin[k], len(w)
        ids[b:b + n] = [known.setdefault(x, len(known)) for x in w]
        ids[b + n] = 2**62 + k + 1
        doc[b:b + n + 1] = k
    start, end, q = find_runs(ids, doc, int(count.max(initial=0)), least)
    of = np.searchsorted(begin, start, "right") - 1
    runs: list[list[dict]] = [[] for _ in words]
    collapsed = [b" ".join(w).decode() for w in words] if not len(of) else [None] * len(words)
    for k in range(len(words)) if len(of) else ():
        lo, hi = np.searchsorted(of, [k, k + 1])
        if lo == hi:
            collapsed[k] = b" ".join(words[k]).decode()
            continue
        s, e, p = start[lo:hi] - begin[k], end[lo:hi] - begin[k], q[lo:hi]
        order = np.lexsort((p, s))
        runs[k] = [{"start": a, "length": b, "period": c} for a, b, c in zip(s[order].tolist(), (e - s)[order].tolist(), p[order].tolist(), strict=True)]
        keep = _kept(len(words[k]), s, e, p)
        collapsed[k] = b" ".join([words[k][i] for i in np.flatnonzero(keep).tolist()]).decode()
    return count.tolist(), runs, collapsed


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Rows (key, n_words, runs, collapsed) per row of docs: runs by start and period, and the text without repetitions."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            at, size = 0, 0
            for k, t in enumerate(texts):
                size += len(t) // 6 + 1
                if size >= WORDS or k == len(texts) - 1:
                    count, runs, collapsed = _search(texts[at:k + 1], least)
                    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                    yield pa.RecordBatch.from_arrays([ids.slice(at, k + 1 - at), pa.array(count, pa.int64()), pa.array(runs, kinds), pa.array(collapsed, pa.string())],
                                                     names=[key, "n_words", "runs", "collapsed"])
                    at, size = k + 1, 0

    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Column:
    """The text, of every tenth document by the CRC of its key with a periodic end: the query's test of the search."""
    h = F.crc32(F.col(key).cast("string"))
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))

    def repeated(w: Column) -> Column:
        n, g = F.array_size(w).cast("long"), F.floor(h / 10)
        a = F.try_mod(g, n)
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.element_at(w, (a + i % p + 1).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")).otherwise(F.lit(""))

    whole = F.transform(F.array(words), repeated)[0]
    return F.when(h % 10 == 0, whole).otherwise(F.col(text))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: number of runs, the longest one, digests of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.withColumn("best", best)
    return rows.select(key, "n_words", F.array_size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                       (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
                       F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))

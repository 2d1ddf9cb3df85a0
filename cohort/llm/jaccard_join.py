"""N-gram Jaccard join by T-occurrence search over inverted lists, exact.

The set of a document is its distinct n-word shingles. Two documents link if their sets' Jaccard similarity is at
least ``percent`` / 100. Equal sets form one class; links are sought between classes.

1. Merging: classes that agree on a few minima of their hashes are compared with four classes of their bucket.
   This only joins what belongs together early, so that large groups of near copies are one component from here on.
2. Order: shingles are ranked by (long list, hash). A first pass counts, over all classes, in how many prefixes a
   shingle lies; two bitmaps of fixed size hold which shingles are shared and which lists are long. A wrong bit
   changes the order or the work, not the result.
3. T-occurrence: of two linked sets, the prefixes of length n - ceil(0.8 n) + l share l shingles at least. Each class
   posts its prefix into the inverted lists. As in DivideSkip, the L long lists of a prefix are not merged: a pair must
   meet all but L of the required occurrences in short lists to be a candidate. A class whose short lists can't decide (fewer than a fifth
   of its shingles in short lists) posts into its long lists as well. Only pairs from different components of step 1
   are counted. Lists of at most ``CROWD`` classes are merged by an equi-join and a count per pair.
4. Candidates that reach the required number are verified on whole sets: the shorter, long lists included, is probed
   in the longer by binary search, and the pair stays if the overlap reaches the required one.
5. Lists of more classes are merged in tasks: crowded lists that share a class are one group, a group's sets are cut
   into blocks, and each task merges the lists of the whole sets of two blocks, class by class. Only links that join
   components leave it, so that no pair is a row; the classes a task compares are bounded by ``BLOCK`` and ``BLOCK_SHINGLES``.
6. Links give components.

No step emits the pairs within a group of copies or of near copies, nothing but bitmaps of fixed size and counts
reaches the driver (no join broadcasts a side, since that is built there), and every list, pair and set is spread by Spark's joins, whose hot keys may be split. A group of M
classes that don't link still takes M * M / 2 comparisons, and each of its sets is sent to M / ``BLOCK`` tasks.

Cases: A-Z count as a-z; null texts and texts without words have an empty set, no links, and their own id as
component; a text of fewer than n words has one shingle, all its words; rows that repeat are copies of each
other; a null doc_id stays null with the component of its set; an empty table gives no rows; columns other than
doc_id and text are ignored. Two different shingles count as one if their 64-bit hashes agree (2**-60 a pair).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm import shingles as S
from cohort.llm.common import components, dealt, map_arrow, materialise, ship

WORDS = 5
PERCENT = 80
#: A list is long if more prefixes than this hold its shingle.
LONG = 16
#: Bits of a bitmap, as a power of two.
BITS = 24
#: Minima that a document is first compared by, and how many make a key.
BINS, PER_KEY = 18, 3
#: Pairs that one task verifies at a time, on average.
BLOCK_PAIRS = 4096
#: Classes of a list whose pairs are rows, at most; a longer one is merged in tasks.
CROWD = 32
#: Classes of a block of a crowded group, and shingles of their sets, on average at most.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
_NO_ID = -(2**63)


def required(n: np.ndarray | int, percent: int = PERCENT):
    """Least overlap of a set of n with any set that it links to: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def bitmap(rows: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """2**bits bits, set at column modulo 2**bits; built by aggregation, at most 2**bits / 8 bytes reach the driver."""
    place = F.pmod(F.col(column), F.lit(1 << bits)) + 1  # bit positions count from 1
    parts = rows.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts:
        at = (r["b"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)[:len(out) - at]
    return out


def has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def members(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """Rows (doc_id, cls, check, n, keys), one per row of docs; cls null for an empty set."""
    def run(batches):
        for batch in batches:
            size = batch.num_rows
            cls, check, count = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            keys = np.zeros((size, BINS // PER_KEY), np.int64)
            for i, own in S.sets(batch.column(1), n):
                cls[i], check[i] = S.set_keys(own)
                count[i] = len(own)
                minima = np.zeros(BINS, np.uint64)
                found, first = np.unique(own % np.uint64(BINS), return_index=True)
                minima[found.astype(np.int64)] = own[first]
                keys[i] = S.mixed(np.bitwise_xor.reduce(S.mixed(minima + np.arange(1, BINS + 1, dtype=np.uint64)).reshape(-1, PER_KEY), axis=1)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cls, mask=count == 0), pa.array(check, mask=count == 0), pa.array(count),
                 pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BINS // PER_KEY).cast(pa.list_(pa.int64()))],
                names=["doc_id", "cls", "check", "n", "keys"])

    return map_arrow(_rows(docs), run, "doc_id long, cls long, check long, n long, keys array<long>")


def class_sets(docs: DataFrame, ids: np.ndarray, n: int = WORDS) -> DataFrame:
    """Rows (doc_id, cls, hashes) of the documents whose id has a bit in ids."""
    spread = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        bits = spread.value
        for batch in batches:
            own = _ids(batch.column(0))
            part = batch.filter(pa.array(has(bits, own.view(np.uint64))))
            own, out = _ids(part.column(0)), []
            for i, s in S.sets(part.column(1), n):
                out.append((int(own[i]), S.set_keys(s)[0], s.tobytes()))
                if len(out) == 512:
                    yield _set_batch(out)
                    out = []
            if out:
                yield _set_batch(out)

    return map_arrow(_rows(docs), run, "doc_id long, cls long, hashes binary")


def _set_batch(rows: list) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["doc_id", "cls", "hashes"])


def verified(docs: DataFrame, pairs: DataFrame, n: int = WORDS, percent: int = PERCENT, sets: DataFrame | None = None) -> DataFrame:
    """Of pairs (x, rx, y, ry) of classes and the documents that stand for them, those (x, y) that link; sets as of class_sets."""
    if sets is None:
        sets = class_sets(docs, bitmap(pairs.select(F.col("rx").alias("r")).unionByName(pairs.select(F.col("ry").alias("r"))), "r"), n)
    # a grid of blocks of classes, so that a set is sent once to a block pair and not once for each of its pairs
    side = max(1, math.isqrt(pairs.count() // BLOCK_PAIRS))
    grid = pairs.select("x", "rx", "y", "ry", F.pmod(F.xxhash64("x"), F.lit(side)).alias("bx"), F.pmod(F.xxhash64("y"), F.lit(side)).alias("by"))
    ends = grid.select(F.col("x").alias("cls"), F.col("rx").alias("doc_id"), "bx", "by").unionByName(
        grid.select(F.col("y").alias("cls"), F.col("ry").alias("doc_id"), "bx", "by")).distinct()
    needed = ends.join(dealt(sets), ["cls", "doc_id"]).select(F.col("bx").alias("gx"), F.col("by").alias("gy"), "cls", "hashes")

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        own = {c: np.frombuffer(h.as_py(), np.uint64) for c, h in zip(sets["cls"].to_pylist(), sets["hashes"], strict=True)}
        keep = []
        for x, y in zip(pairs["x"].to_pylist(), pairs["y"].to_pylist(), strict=True):
            p, q = own[x], own[y]
            near = 100 * min(len(p), len(q)) >= percent * max(len(p), len(q))
            common = S.overlap(p, q) if near else 0
            keep.append(near and 100 * common >= percent * (len(p) + len(q) - common))
        return pairs.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    ship(docs.sparkSession)
    return grid.groupBy("bx", "by").cogroup(needed.groupBy("gx", "gy")).applyInArrow(run, "x long, y long").distinct()


def _prefix_counts(docs: DataFrame, reps: np.ndarray, n: int, percent: int) -> DataFrame:
    """Rows (token, count): in how many prefixes, by hash alone, each shingle lies; counted in each batch first."""
    spread = docs.sparkSession.sparkContext.broadcast(reps)

    def run(batches):
        bits = spread.value
        for batch in batches:
            part = batch.filter(pa.array(has(bits, _ids(batch.column(0)).view(np.uint64))))
            got = [s[:len(s) - required(len(s), percent) + extra(len(s))] for _, s in S.sets(part.column(1), n)]
            if got:
                token, count = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count.astype(np.int64))], names=["token", "count"])

    return map_arrow(_rows(docs), run, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))


def _prefix(s: np.ndarray, long: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """(places of the shingles to post, length of the hash prefix, shingles that aren't posted because their lists are long)."""
    size = len(s)
    spare = size - required(size, percent)  # a prefix of spare + l shingles shares l
    want = spare + extra(size)
    far = has(long, s)
    light = np.flatnonzero(~far)
    if len(light) <= spare:  # short lists alone can't decide
        return np.r_[light, np.flatnonzero(far)[:want - len(light)]], want, 0
    return light[:want], want, max(0, want - len(light))


def _later(docs: DataFrame, reps: np.ndarray, long: np.ndarray, n: int, percent: int) -> DataFrame:
    """Rows (token): shingles beyond the hash prefix that come into a posted prefix in place of long lists.

    The first pass hasn't counted them there, so that a shingle it met once may still be in a second list.
    """
    spread = docs.sparkSession.sparkContext.broadcast((reps, long))

    def run(batches):
        reps, long = spread.value
        for batch in batches:
            part = batch.filter(pa.array(has(reps, _ids(batch.column(0)).view(np.uint64))))
            got = []
            for _, s in S.sets(part.column(1), n):
                chosen, want, _ = _prefix(s, long, percent)
                got.append(s[chosen[chosen >= want]])
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(got)).view(np.int64))], names=["token"])

    return map_arrow(_rows(docs), run, "token long")


def extra(n: int) -> int:
    """Shingles that linked prefixes share at least (l): one, and one more for each 32 of the set."""
    return 1 + n // 32


def postings(docs: DataFrame, reps: np.ndarray, shared: np.ndarray, long: np.ndarray, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (token, cls, rep, n, rest, lost): prefixes in inverted lists.

    rest: shingles after the prefix; lost: shingles of the prefix that aren't posted because their lists are long.
    """
    spread = docs.sparkSession.sparkContext.broadcast((reps, shared, long))
    names = ["token", "cls", "rep", "n", "rest", "lost"]

    def run(batches):
        reps, shared, long = spread.value
        for batch in batches:
            part = batch.filter(pa.array(has(reps, _ids(batch.column(0)).view(np.uint64))))
            ids, seen, out = _ids(part.column(0)), set(), []
            for i, s in S.sets(part.column(1), n):
                cls = S.set_keys(s)[0]
                if (cls, int(ids[i])) in seen:  # a wrong bit lets copies pass that don't stand for their class
                    continue
                seen.add((cls, int(ids[i])))
                size = len(s)
                chosen, want, lost = _prefix(s, long, percent)
                # shingles of the hash prefix that no other prefix holds, posted ones included, are in no list of two
                chosen = chosen[(chosen >= want) | has(shared, s[chosen])]
                if len(chosen):
                    out.append((s[chosen], cls, int(ids[i]), size, size - want, lost))
            if out:
                times = [len(x[0]) for x in out]
                columns = [np.concatenate([x[0] for x in out]).view(np.int64)] + [np.repeat(np.array([x[k] for x in out], np.int64), times) for k in range(1, 6)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return map_arrow(_rows(docs), run, ", ".join(f"{c} long" for c in names))


def live_lists(lists: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(short, crowded): rows of the lists, keyed by ``by``, that hold classes of different components."""
    mixed = materialise(lists.groupBy(*by).agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("m")).where("a <> b").select(*by, "m"), "live-lists")
    return tuple(lists.join(dealt(mixed.where(some).select(*by)), by) for some in (F.col("m") <= CROWD, F.col("m") > CROWD))


def candidates(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (x, y) of different components that occur together in enough lists (token, cls, rep, n, rest, lost, comp).

    Linked sets share ``percent`` / (100 + percent) of both sizes' sum; what isn't in both prefixes lies after the
    prefix that ends first, so that all but rest occurrences, less those in unposted lists, must be met, and one at least.
    A pair that also meets in a crowded list is compared there.
    """
    columns = ("cls", "n", "rest", "lost", "comp")
    overlap = F.ceil(F.lit(percent) * (F.col("n_x") + F.col("n_y")) / F.lit(100 + percent) - F.lit(1e-9))
    need = F.greatest(F.lit(1), overlap - F.greatest("rest_x", "rest_y") - F.greatest("lost_x", "lost_y"))
    left = lists.select("token", *[F.col(c).alias(f"{c}_x") for c in columns])
    right = lists.select("token", *[F.col(c).alias(f"{c}_y") for c in columns])
    near = (F.col("cls_x") < F.col("cls_y")) & (F.col("comp_x") != F.col("comp_y")) & (
        100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    met = left.join(dealt(right), "token").where(near).groupBy("cls_x", "cls_y").agg(
        F.count("*").alias("met"), F.min(need).alias("need"))
    return met.where("met >= need").select(F.col("cls_x").alias("x"), F.col("cls_y").alias("y"))


def crowds(spots: DataFrame, by: list[str], few: int = 0) -> DataFrame:
    """Rows (crowd, side, cls, rep, n, comp, ...) of crowded lists' classes, each once; lists that share a class are one crowd.

    side: blocks that a crowd's classes are dealt into.
    """
    low = spots.groupBy(*by).agg(F.min("cls").alias("low"))
    met = components(spots.join(dealt(low), by).select("cls", "low"), "cls", "low", few)
    once = spots.drop(*by).dropDuplicates(["cls"]).join(dealt(met), F.col("cls") == F.col("node")).drop("node").withColumnRenamed("component", "crowd")
    side = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("side")
    return materialise(once.join(dealt(once.groupBy("crowd").agg(side)), "crowd"), "crowds")


def crowd_links(crowd: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (x, y) that join the components of classes of one crowd; sets as of class_sets.

    Rows of crowds with a column marks (array) link only if marks agree at one place at least.
    """
    marks = [c for c in crowd.columns if c == "marks"]
    own = F.pmod(F.xxhash64("cls"), F.col("side"))
    cells = crowd.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("side").cast("long") - 1)).alias("other")).select(
        "crowd", F.least("own", "other").alias("bx"), F.greatest("own", "other").alias("by"), "own", "cls", F.col("rep").alias("doc_id"), "comp", *marks)

    def run(rows: pa.Table) -> pa.Table:
        first = np.unique(rows["cls"].to_numpy(), return_index=True)[1]  # rows that repeat have their sets twice
        rows = rows.take(pa.array(first))
        cls, at = rows["cls"].to_numpy(), rows["own"].to_numpy()
        both = rows["bx"][0].as_py() != rows["by"][0].as_py()
        signs = np.array(rows["marks"].to_pylist(), np.int64) if marks else None
        pairs = merged([np.frombuffer(h.as_py(), np.uint64) for h in rows["hashes"]], rows["comp"].to_numpy(), at if both else None, signs, percent)
        x, y = cls[pairs[:, 0]], cls[pairs[:, 1]]
        return pa.table({"x": pa.array(np.minimum(x, y), pa.int64()), "y": pa.array(np.maximum(x, y), pa.int64())})

    ship(crowd.sparkSession)
    return cells.join(dealt(sets), ["cls", "doc_id"]).select("crowd", "bx", "by", "own", "cls", "comp", "hashes", *marks).groupBy("crowd", "bx", "by").applyInArrow(run, "x long, y long").distinct()


def merged(sets: list[np.ndarray], comp: np.ndarray, block: np.ndarray | None, marks: np.ndarray | None, percent: int = PERCENT) -> np.ndarray:
    """Places (x, y) of linked sets, one for each two components that links join; of different blocks, if there are blocks.

    The lists of a set's shingles are merged by counting how often they hold each other set: whole overlaps, no pair kept.
    """
    m, size, least = len(sets), np.array([len(s) for s in sets]), required(np.array([len(s) for s in sets]), percent)
    token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(m), size)
    while True:  # a set links to none if others hold too few of its shingles
        shared = count[token] > 1
        token, row = token[shared], row[shared]
        keep = (np.bincount(row, minlength=m) >= least)[row]
        if keep.all():
            break
        token, row = token[keep], row[keep]
        count = np.bincount(token, minlength=len(count))
    start = np.searchsorted(row, np.arange(m + 1))
    right = np.ones(m, bool) if block is None else block == block.max()
    inside = np.flatnonzero(right[row])
    listed = row[inside[np.argsort(token[inside], kind="stable")]]
    length = np.bincount(token[inside], minlength=len(count))
    begin = np.cumsum(length) - length
    comp, out = comp.copy(), []
    for x in np.flatnonzero(start[1:] > start[:-1]):
        if block is not None and right[x]:
            continue
        own = token[start[x]:start[x + 1]]
        times = length[own]
        places = np.repeat(begin[own] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        met = np.bincount(listed[places], minlength=m)
        y = np.flatnonzero((100 * met >= percent * (size[x] + size - met)) & (comp != comp[x]))
        if marks is not None:
            y = y[(marks[y] == marks[x]).any(axis=1)]
        y = y[np.unique(comp[y], return_index=True)[1]]
        if len(y):
            out.append(np.stack([np.full(len(y), x), y], axis=1))
            comp[np.isin(comp, comp[y])] = comp[x]
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def links_by_merging(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified links (x, y) between classes and a few classes of a bucket that they share.

    The smallest and the largest by key and by a hash of it: four centres, since two near copies of one text need not
    be near enough to each other, and most members reach one of several.
    """
    keys = classes.select("cls", "rep", "n", F.posexplode("keys").alias("band", "key"))
    low = keys.groupBy("band", "key").agg(
        *[f(F.struct(h.alias("h"), "cls", "rep", "n")).alias(f"low{k}") for k, (f, h) in enumerate(
            (f, h) for f in (F.min, F.max) for h in (F.col("cls"), F.xxhash64("cls")))], F.count("*").alias("m")).where("m > 1")
    low = low.select("band", "key", F.explode(F.array_distinct(F.array(*[F.struct(f"low{k}.cls", f"low{k}.rep", f"low{k}.n") for k in range(4)]))).alias("low"))
    pairs = keys.join(dealt(low), ["band", "key"]).where(
        (F.col("cls") != F.col("low.cls")) & (100 * F.least("n", "low.n") >= percent * F.greatest("n", "low.n")))
    pairs = materialise(pairs.select(F.col("cls").alias("x"), F.col("rep").alias("rx"), F.col("low.cls").alias("y"), F.col("low.rep").alias("ry")).distinct(), "near-pairs")
    return verified(docs, pairs, n, percent)


def jaccard_join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of docs."""
    rows = materialise(members(docs, n), "shingle-sets")
    full = rows.where(F.col("cls").isNotNull())
    classes = materialise(full.groupBy("cls").agg(
        F.coalesce(F.min("doc_id"), F.lit(_NO_ID)).alias("rep"), F.max("n").alias("n"), F.max("keys").alias("keys"),
        F.min("check").alias("c1"), F.max("check").alias("c2")), "shingle-classes")
    if classes.where("c1 <> c2").limit(1).count():
        raise ArithmeticError("two different sets have the same 64-bit key; run again with another shingle length or seed")
    early = components(links_by_merging(docs, classes, n, percent), "x", "y")
    placed = materialise(classes.join(dealt(early), F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("component", "cls").alias("comp")), "near-components")
    reps = bitmap(classes, "rep")
    counted = materialise(_prefix_counts(docs, reps, n, percent).where("count > 1"), "prefix-counts")
    shared, long = bitmap(counted, "token"), bitmap(counted.where(F.col("count") > LONG), "token")
    shared |= bitmap(_later(docs, reps, long, n, percent), "token")
    lists = postings(docs, reps, shared, long, n, percent).join(dealt(placed.select("cls", "rep", "comp")), ["cls", "rep"])
    short, crowded = live_lists(materialise(lists, "inverted-lists"), ["token"])
    found = materialise(candidates(short, percent), "candidates")
    crowd = crowds(crowded.select("token", "cls", "rep", "n", "comp"), ["token"])
    stands = placed.select("cls", "rep")
    found = found.join(dealt(stands.select(F.col("cls").alias("x"), F.col("rep").alias("rx"))), "x").join(dealt(stands.select(F.col("cls").alias("y"), F.col("rep").alias("ry"))), "y")
    needed = bitmap(found.select(F.col("rx").alias("r")).unionByName(found.select(F.col("ry").alias("r"))).unionByName(crowd.select(F.col("rep").alias("r"))), "r")
    sets = materialise(class_sets(docs, needed, n), "needed-sets")
    links = verified(docs, found, n, percent, sets).unionByName(crowd_links(crowd, sets, percent))
    comp = placed.select("cls", "comp")
    between = links.join(dealt(comp.select(F.col("cls").alias("x"), F.col("comp").alias("u"))), "x").join(dealt(comp.select(F.col("cls").alias("y"), F.col("comp").alias("v"))), "y")
    late = components(between.select("u", "v"))
    final = placed.join(dealt(late), F.col("comp") == F.col("node"), "left").select("cls", "rep", F.coalesce("component", "comp").alias("final"))
    lowest = final.groupBy("final").agg(F.min(F.when(F.col("rep") != _NO_ID, F.col("rep"))).alias("found"))
    label = final.join(dealt(lowest), "final").select("cls", "found")
    out = rows.join(dealt(label), "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("found")).alias("component_id"))

"""Nearest centres for any number of centres, by bounds on boxes (C4, C5, C12 beyond a few dozen centres).

Centres are dealt into blocks of neighbours: range partitions of the coordinate that varies most, in each of them ranges of the next
one, and so on. A block's box, the least and largest value of each coordinate, bounds how near and how far its centres can be to
a row. A row looks at the block whose box is nearest (and the one that reaches farthest), which gives a bound, and then only at the
blocks whose boxes lie within it. The result is exact, ties go to the smallest id.

Centres are a table, and its measured size decides how they reach the rows: up to ``CARRIED_BYTES`` as one value that every task
holds (no shuffle of rows), beyond it by joins of rows and blocks, in which a block that many rows look at is read in
several pieces. Only the boxes of the blocks, some root of the number of centres, are carried then.

Boxes and blocks are looked at in tasks by numpy, for a batch of rows at a time: a table of rows by boxes, then for each block
a table of the rows that look at it by its centres, both in bounded pieces.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort.operators.metrics import confidence, margin
from cohort.session import shared_table, ship

#: Centres of up to this size travel with the tasks; a block of the joined form holds about this many centres or their root.
CARRIED_BYTES = 32 << 20
BLOCK = 256
#: Relative slack of bounds, far above the rounding of norms and distances.
SLACK = 1e-9
#: Entries of a table of rows by boxes or by centres that a task holds at once.
TABLE = 1 << 20


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda v: v.cast("double"))


def norm_of(x: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), lambda s, t: s + t))


def square_distance(x: Column, v: Column) -> Column:
    """Squared Euclidean distance of two arrays, summed in their order."""
    return F.aggregate(F.zip_with(x, v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t)


def box_blocks(centres: DataFrame, id_col: str, vector_col: str, block: int = BLOCK) -> DataFrame:
    """Rows (block, lo, hi, members): centres that lie near each other, with the bounds of every coordinate; a table in the shared folder.

    Centres without an id, without a vector or with a null or NaN coordinate are left out.
    """
    rows = centres.select(F.col(id_col).alias("id"), doubles(F.col(vector_col)).alias("v")).withColumn("norm", norm_of(F.col("v")))
    rows = shared_table(rows.where(F.col("id").isNotNull() & F.col("norm").isNotNull() & ~F.isnan("norm")), "centres")
    k = rows.count()
    if not k:
        raise ValueError("no centres")
    parts = -(-k // max(block, math.isqrt(k)))
    spread = [F.max(F.get("v", F.lit(i))) - F.min(F.get("v", F.lit(i))) for i in range(rows.agg(F.max(F.size("v"))).first()[0])]
    wide = rows.agg(*spread).first()
    axes = sorted(range(len(wide)), key=lambda i: (-(wide[i] or 0.0), i))[:4]
    axes = axes[:max(1, math.ceil(math.log2(parts)))]
    each = math.ceil(parts ** (1 / len(axes))) if axes else 1
    cells = rows.withColumn("block", F.lit(0))
    for i in axes:  # cut points of a cell come from all its centres: each - 1 numbers a cell
        at = F.get("v", F.lit(i))
        cuts = cells.groupBy("block").agg(F.percentile_approx(at, [j / each for j in range(1, each)] or [0.5], 1000).alias("cuts"))
        met = cells.join(F.broadcast(cuts), "block").withColumn("at", at)
        below = F.size(F.filter("cuts", lambda c: c < F.col("at"))) if each > 1 else F.lit(0)
        cells = met.select("id", "v", "norm", (F.col("block") * each + below).alias("block"))
    bound = lambda f: F.array(*[f(F.get("v", F.lit(i))) for i in range(len(wide))])
    packed = cells.groupBy("block").agg(bound(F.min).alias("lo"), bound(F.max).alias("hi"), F.collect_list(F.struct("norm", "id", "v")).alias("members"))
    return shared_table(packed, "centre-blocks")


def _gap(b: Column, x: Column) -> Column:
    """Least distance of a row to a block's box."""
    off = F.zip_with(x, F.arrays_zip(b["lo"].alias("lo"), b["hi"].alias("hi")), lambda v, k: F.greatest(k["lo"] - v, v - k["hi"], F.lit(0.0)))
    return norm_of(off)


@dataclass
class Found:
    """What rows have found so far: the least distance (squared) with its centre, the next one, the largest. Ties go to the lower rank."""

    at: np.ndarray  # place of the centre, -1 for none
    rank: np.ndarray
    best: np.ndarray
    second: np.ndarray
    far: np.ndarray

    @staticmethod
    def none(n: int) -> Found:
        return Found(np.full(n, -1), np.full(n, np.iinfo("int64").max), np.full(n, np.inf), np.full(n, np.inf), np.full(n, -np.inf))

    def visit(self, rows: np.ndarray, x: np.ndarray, members: np.ndarray, ranks: np.ndarray, first: int) -> None:
        """Rows (places of x) look at the members of a block, which are in order of their ranks and begin at the place ``first``."""
        step = max(1, TABLE // 8 // len(members))
        for part in (rows[i:i + step] for i in range(0, len(rows), step)):
            d2, own = np.zeros((len(part), len(members))), x[part]
            for j, v in enumerate(members.T):
                off = own[:, j, None] - v
                off *= off
                d2 += off
            if not np.isfinite(d2).all():
                d2[np.isnan(d2)] = np.inf
            i = d2.argmin(axis=1)
            least, rank, best = d2[np.arange(len(part)), i], ranks[i], self.best[part]
            next_one = np.partition(d2, 1, axis=1)[:, 1] if len(members) > 1 else np.inf
            self.second[part] = np.minimum(np.minimum(np.maximum(best, least), self.second[part]), next_one)
            better = (least < best) | ((least == best) & (rank < self.rank[part]))
            won = part[better]
            self.at[won], self.rank[won], self.best[won] = first + i[better], rank[better], least[better]
            self.far[part] = np.maximum(self.far[part], d2.max(axis=1))

    def within(self, norm: np.ndarray, wanted: int) -> np.ndarray:
        """How far off (squared) a box may be to matter still: the distance found so far, none while there are too few."""
        return (np.sqrt(self.second if wanted > 1 else self.best) * (1 + SLACK) + norm * SLACK) ** 2

    def beyond(self, norm: np.ndarray) -> np.ndarray:
        """How far (squared) a box must reach to matter still."""
        with np.errstate(invalid="ignore"):  # nothing is beyond what is infinitely far
            return np.maximum(np.sqrt(np.maximum(self.far, 0.0)) * (1 - SLACK) - norm * SLACK, 0.0) ** 2


@dataclass
class Boxes:
    """Bounds of the blocks (blocks x coordinates), in order of the blocks' numbers."""

    block: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Least squared distances of rows to the boxes (boxes x rows)."""
        out = np.zeros((len(self.lo), len(x)))
        for j, v in enumerate(x.T):
            off = np.maximum(self.lo[:, j, None] - v, v - self.hi[:, j, None])
            np.maximum(off, 0.0, out=off)
            out += off * off
        return out

    def reaches(self, x: np.ndarray) -> np.ndarray:
        """Largest squared distances of rows to the boxes (boxes x rows)."""
        out = np.zeros((len(self.lo), len(x)))
        for j, v in enumerate(x.T):
            off = np.maximum(np.abs(v - self.lo[:, j, None]), np.abs(v - self.hi[:, j, None]))
            out += off * off
        return out

    def slices(self, n: int) -> Iterator[slice]:
        step = max(1, TABLE // len(self.lo))
        return (slice(i, i + step) for i in range(0, n, step))


def _bounds(table: pa.Table) -> Boxes:
    wide = lambda c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    return Boxes(table["block"].to_numpy(), wide("lo"), wide("hi"))


def _members(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(ids, vectors, ends) of lists of members."""
    flat = column.flatten()
    v = flat.field("v")
    return flat.field("id"), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))


def _ranks(ids: pa.Array) -> np.ndarray:
    """Places of the ids in their order."""
    return pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy(zero_copy_only=False).astype("int64")


def _whole(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the vectors of d coordinates, none of them null or NaN."""
    size = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(size == d)
    flat = vectors.take(pa.array(places)).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(places), d)
    there = ~np.isnan(x).any(axis=1)
    return places[there], x[there]


def _spread(values: np.ndarray, places: np.ndarray, n: int) -> pa.Array:
    """Values at their places of n, null elsewhere."""
    out, there = np.zeros(n, values.dtype), np.zeros(n, bool)
    out[places], there[places] = values, True
    return pa.array(out, mask=~there)


def _searched(x: np.ndarray, boxes: Boxes, vectors: np.ndarray, ranks: np.ndarray, ends: np.ndarray, wanted: int, farthest: bool) -> Found:
    """All that rows find: first in the block whose box is nearest (and the one that reaches farthest), then in those within what was found."""
    out, begins = Found.none(len(x)), np.r_[0, ends[:-1]]
    for piece in boxes.slices(len(x)):
        y, norm = x[piece], np.sqrt((x[piece] ** 2).sum(axis=1))
        found, all_rows = Found.none(len(y)), np.arange(len(y))
        seen = np.zeros((len(ends), len(y)), bool)

        def look(block: int, rows: np.ndarray, y=y, found=found, seen=seen) -> None:
            rows = rows[~seen[block, rows]]
            if len(rows):
                own = slice(begins[block], ends[block])
                seen[block, rows] = True
                found.visit(rows, y, vectors[own], ranks[own], begins[block])

        gaps, reaches = boxes.gaps(y), boxes.reaches(y) if farthest else None
        for start in (gaps.argmin(axis=0), *([reaches.argmax(axis=0)] if farthest else [])):
            order = np.argsort(start, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(start[order])) + 1):
                look(start[rows[0]], rows)
        for block in np.flatnonzero((gaps <= found.within(norm, wanted)).any(axis=1)):
            look(block, all_rows[gaps[block] <= found.within(norm, wanted)])
        if farthest:
            for block in np.flatnonzero((reaches >= found.beyond(norm)).any(axis=1)):
                look(block, all_rows[reaches[block] >= found.beyond(norm)])
        for name in ("at", "rank", "best", "second", "far"):
            getattr(out, name)[piece] = getattr(found, name)
    return out


def _carried(rows: DataFrame, blocks: DataFrame, wanted: int, farthest: bool, id_type: T.DataType) -> DataFrame:
    """rows with _found (id, d2, second, far)."""
    table = blocks.select("block", "lo", "hi", F.sort_array(F.transform("members", lambda m: F.struct(m["id"].alias("id"), m["v"].alias("v")))).alias("members")).orderBy("block").toArrow()
    ids, vectors, ends = _members(table["members"].combine_chunks())
    spread = rows.sparkSession.sparkContext.broadcast((_bounds(table), ids, vectors, _ranks(ids), ends))
    ship(rows.sparkSession)

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        boxes, ids, vectors, ranks, ends = spread.value
        for batch in batches:
            places, x = _whole(batch, vectors.shape[1])
            got = _searched(x, boxes, vectors, ranks, ends, wanted, farthest)
            at = _spread(got.at, places, len(batch))
            yield pa.StructArray.from_arrays([ids.take(at), *[_spread(v, places, len(batch)) for v in (got.best, got.second, got.far)]], ["id", "d2", "second", "far"])

    kind = T.StructType([T.StructField("id", id_type), *[T.StructField(c, T.DoubleType()) for c in ("d2", "second", "far")]])
    return rows.withColumn("_found", F.arrow_udf(found, kind)("_x"))


def _asked(boxes, choose: Callable[[Boxes, np.ndarray, Found], np.ndarray], d: int):
    """Column of the blocks that rows (x, d2, second, far) look at, as ``choose`` marks them in a table of boxes by rows."""
    def asked(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        own = boxes.value
        for x, *known in batches:
            places, m = _whole(x, d)
            best, second, far = (np.where(np.isnan(v), fill, v) for v, fill in zip(
                (k.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)[places] for k in known), (np.inf, np.inf, -np.inf), strict=True))
            counts, lists = np.zeros(len(x), "int64"), []
            for piece in own.slices(len(m)):
                known_here = Found.none(len(m[piece]))
                known_here.best, known_here.second, known_here.far = best[piece], second[piece], far[piece]
                row, block = np.nonzero(choose(own, m[piece], known_here).T)
                counts[places[piece]] = np.bincount(row, minlength=len(m[piece]))
                lists.append(own.block[block])
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(np.concatenate(lists) if lists else np.empty(0, "int32"), pa.int32()))

    return F.arrow_udf(asked, T.ArrayType(T.IntegerType()))


def _visit(pairs: DataFrame, blocks: DataFrame, rows_each: int, id_type: T.DataType) -> DataFrame:
    """Rows (_row, _x, d2, id, second, far) of pairs (_row, _x, block); a block with many pairs meets them in several pieces."""
    counts = pairs.groupBy("block").count().select("block", F.ceil(F.col("count") / rows_each).alias("pieces"))
    sizes = counts.agg(F.map_from_entries(F.collect_list(F.struct("block", "pieces")))).scalar()  # one number a block
    members = F.sort_array(F.transform("members", lambda m: F.struct(m["id"].alias("id"), m["v"].alias("v"))))
    sides = blocks.join(counts, "block").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).select("block", "piece", members.alias("members"))
    dealt = pairs.withColumn("piece", F.pmod(F.xxhash64("_row"), F.element_at(sizes, F.col("block"))))
    ship(pairs.sparkSession)

    def met(rows: pa.Table, side: pa.Table) -> pa.Table:
        ids, vectors, _ = _members(side["members"].combine_chunks())
        places, x = _whole(rows["_x"].combine_chunks(), vectors.shape[1])
        found = Found.none(len(x))
        found.visit(np.arange(len(x)), x, vectors, np.arange(len(ids)), 0)
        got = rows.select(["_row", "_x"]).take(pa.array(places))
        columns = {"d2": pa.array(found.best), "id": ids.take(pa.array(found.at)), "second": pa.array(found.second), "far": pa.array(found.far)}
        return pa.table({"_row": got["_row"], "_x": got["_x"], **columns})

    return dealt.groupBy("block", "piece").cogroup(sides.groupBy("block", "piece")).applyInArrow(met, T.StructType([*pairs.schema.fields[:2], *[T.StructField(c, id_type if c == "id" else T.DoubleType()) for c in ("d2", "id", "second", "far")]]))


def _gathered(seen: DataFrame) -> DataFrame:
    """One row for each _row, of the least distances that it met in every block."""
    best = seen.groupBy("_row").agg(F.first("_x").alias("_x"), F.min(F.struct("d2", "id")).alias("b"), F.sort_array(F.collect_list("d2")).alias("all"), F.min("second").alias("second"), F.max("far").alias("far"))
    return best.select("_row", "_x", "b.d2", "b.id", F.least(F.get("all", F.lit(1)), "second").alias("second"), "far")


def _joined(rows: DataFrame, blocks: DataFrame, wanted: int, farthest: bool, rows_each: int, id_type: T.DataType) -> DataFrame:
    """rows with _found (id, d2, second, far)."""
    rows = shared_table(rows.withColumn("_row", F.monotonically_increasing_id()), "search-rows")
    bounds = _bounds(blocks.select("block", "lo", "hi").orderBy("block").toArrow())
    boxes, d = rows.sparkSession.sparkContext.broadcast(bounds), bounds.lo.shape[1]
    ship(rows.sparkSession)

    def first(own: Boxes, x: np.ndarray, found: Found) -> np.ndarray:
        out = np.zeros((len(own.lo), len(x)), bool)
        out[own.gaps(x).argmin(axis=0), np.arange(len(x))] = True
        if farthest:
            out[own.reaches(x).argmax(axis=0), np.arange(len(x))] = True
        return out

    def rest(own: Boxes, x: np.ndarray, found: Found) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1))
        out = own.gaps(x) <= found.within(norm, wanted)
        if farthest:
            out |= own.reaches(x) >= found.beyond(norm)
        return out & ~first(own, x, found)

    none = F.lit(None).cast("double")
    asked = rows.select("_row", "_x")
    pairs = asked.select("_row", "_x", F.explode(_asked(boxes, first, d)("_x", none, none, none)).alias("block"))
    seen = shared_table(_gathered(_visit(pairs, blocks, rows_each, id_type)), "search-first")
    more = seen.select("_row", "_x", F.explode(_asked(boxes, rest, d)("_x", "d2", "second", "far")).alias("block"))
    found = _gathered(seen.unionByName(_visit(more, blocks, rows_each, id_type)))
    return rows.join(found.select("_row", F.struct("id", "d2", "second", "far").alias("_found")), "_row", "left").drop("_row")


def nearest(df: DataFrame, centres: DataFrame, vector: Column, id_col: str = "cluster_id", vector_col: str = "v", facts: bool = False,
            assigned_col: str | None = None, carried_bytes: int = CARRIED_BYTES, rows_each: int = 100_000) -> DataFrame:
    """df with its nearest centre: cluster_id, min_sq_dist, min_dist; with ``facts`` also second_dist, max_dist, confidence, margin.

    ``vector`` is an array column of df, ``vector_col`` one of centres, whose ids are unique. Confidence is that of ``assigned_col`` (a
    centre's id; null where there is no such centre), else of the nearest. A row with a null coordinate gets the
    smallest id and null distances, one with a NaN the smallest id and NaN. An empty df gives no rows; no centre raises. Columns
    of df that begin with an underscore may not be named as the helpers here (_x, _n, _found, _row).
    """
    blocks = box_blocks(centres, id_col, vector_col)
    facts_of = blocks.agg(F.sum(F.size("members")).alias("k"), F.max(F.size(F.get("members", F.lit(0))["v"])).alias("d"),
                          F.min(F.array_min(F.transform("members", lambda m: m["id"]))).alias("least")).first()
    wanted, id_type = 2 if facts else 1, centres.schema[id_col].dataType
    rows = df.withColumn("_x", doubles(vector)).withColumn("_n", norm_of(F.col("_x")))
    if facts_of["k"] * (8 * facts_of["d"] + 32) <= carried_bytes:
        rows = _carried(rows, blocks, wanted, facts, id_type)
    else:
        rows = _joined(rows, blocks, wanted, facts, rows_each, id_type)
    whole = F.col("_n").isNotNull() & ~F.isnan("_n")
    best = F.when(whole, F.col("_found"))
    d2 = F.when(whole, best["d2"]).otherwise(F.col("_n"))
    # coalesce: an id is never null, and Catalyst infers no filters from it
    out = rows.withColumn("cluster_id", F.coalesce(best["id"], F.lit(facts_of["least"]))).withColumn("min_sq_dist", d2).withColumn("min_dist", F.sqrt("min_sq_dist"))
    if facts:
        out = out.withColumn("second_dist", F.sqrt(F.when(whole & (F.lit(facts_of["k"]) > 1), best["second"]))).withColumn("max_dist", F.when(whole, F.sqrt(best["far"])))
        own = F.col("min_dist")
        if assigned_col:
            members = centres.select(F.col(id_col).alias("_id"), doubles(F.col(vector_col)).alias("_v"))
            out = out.join(members, F.col(assigned_col) == F.col("_id"), "left")
            own = F.sqrt(square_distance(F.col("_x"), F.col("_v")))
        sure = confidence(F.array("min_dist", own, "max_dist"), F.lit(2))
        apart = margin(F.filter(F.array("min_dist", "second_dist"), lambda d: d.isNotNull()))
        out = out.withColumn("confidence", F.when(whole & own.isNotNull(), sure)).withColumn("margin", F.when(whole, apart))
        out = out.drop("_id", "_v")
    return out.drop("_x", "_n", "_found")

"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources, in code-point order with null last, have base weights 1, 2, 3, repeating; they share all words of the
corpus by weight, none more than ``cap`` times its own size, the excess going to the others by weight.

Curriculum: each source has a schedule, piecewise linear over the training time 0..1. Its integral, scaled to the
target, is the words demanded of the source up to a time. A source hands its documents out in a fixed random
order, round after round, until its target is met; the words handed out before a document are inverted through
the integrated schedule into the document's training position, and documents are range-sorted by position.

Cases: null or empty texts have size 0, take nothing and have no position; a null source is a source of its own;
rows that repeat are ordered next to each other and both take part; a source without words has target 0; an empty
table gives an empty result; only doc_id, text and source are read, so that other columns cannot clash.
A source may hold most rows: its order is cut into ranges of a hash, summed before they are joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohort.llm.common import materialise, word_count

#: No document is taken more often than this.
CAP = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: Schedules, repeating over the sources: (time, relative weight) points; early, steady and late sources.
CURRICULA = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
#: Rows of a source in one range of its order, on average.
RANGE_ROWS = 2048


def shares(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Targets: the sum of sizes by weight, none above cap times its size, the excess shared again."""
    target, rest, open_ = [0.0] * len(sizes), float(sum(sizes)), [k for k, s in enumerate(sizes) if s > 0]
    while open_:
        weight = sum(weights[k] for k in open_)
        full = [k for k in open_ if rest * weights[k] / weight > cap * sizes[k]]
        if not full:
            for k in open_:
                target[k] = rest * weights[k] / weight
            break
        for k in full:
            target[k] = float(cap * sizes[k])
        rest -= sum(target[k] for k in full)
        open_ = [k for k in open_ if k not in full]
    return target


def integrated(points, target: float) -> list[tuple[float, float, float, float]]:
    """Segments (time, words before it, words per time at its start, slope) of a schedule scaled to the target."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))
    scale, before, out = target / area, 0.0, []
    for (t0, w0), (t1, w1) in zip(points, points[1:], strict=False):
        out.append((t0, before, w0 * scale, (w1 - w0) * scale / (t1 - t0)))
        before += (t1 - t0) * (w0 + w1) / 2 * scale
    return out


def position(words: Column, segments: Column) -> Column:
    """Time at which the integrated schedule has demanded so many words."""
    last = F.element_at(F.filter(segments, lambda s: s["before"] <= words), -1)
    over = words - last["before"]
    root = F.sqrt(F.greatest(last["rate"] * last["rate"] + 2 * last["slope"] * over, F.lit(0.0)))
    return F.least(last["time"] + F.when(over <= 0, F.lit(0.0)).otherwise(2 * over / (last["rate"] + root)), F.lit(1.0))


def mix(docs: DataFrame, weights=WEIGHTS, curricula=CURRICULA, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken, position, positions, tie), one per row of docs, range-sorted by position.

    taken: words that the mix takes of the document, repeats counted; positions: training time of each of its rounds,
    position the first; tie: a hash of the text, which tells rows with one id apart.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    rows = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("tie")), "mix-sizes")
    # one row per source reaches the driver
    found = sorted(((r["source"], r["s"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()),
                   key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [s for _, s, _ in found]
    target = shares(sizes, [weights[k % len(weights)] for k in range(len(found))], cap)
    digits = max(1, math.ceil(math.log(max(1.0, max((n for *_, n in found), default=1) / RANGE_ROWS), 16)))
    plan = [(name, s, target[k], round(target[k]), integrated(curricula[k % len(curricula)], target[k])) for k, (name, s, _) in enumerate(found)]
    sources = spark.createDataFrame(plan, "name string, source_size long, target double, goal long, "
                                    "segments array<struct<time:double,before:double,rate:double,slope:double>>")
    cut = rows.withColumn("range", F.substring("key", 1, digits))
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy("source", "range").agg(F.sum("size").alias("in_range")).withColumn("range_start", F.coalesce(F.sum("in_range").over(by_range), F.lit(0)))
    # as many rows as sources; name and target of each row's source
    ranges = ranges.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).select(
        F.col("source").alias("s_"), F.col("range").alias("r_"), "range_start", "source_size", "target", "goal", "segments")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        ranges, F.col("source").eqNullSafe(F.col("s_")) & (F.col("range") == F.col("r_")))
    start = F.col("range_start") + F.col("before")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("goal") - rounds * F.col("source_size")
    taken = F.col("size") * rounds + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    out = placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), start.alias("start"), "segments", "tie")
    times = F.ceil(F.col("taken") / F.col("size")) - 1
    out = out.withColumn("positions", F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0).cast("long"), times), lambda e: position(
        (F.col("start") + e * F.col("source_size")).cast("double"), F.col("segments")))))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", F.col("positions")[0].alias("position"), "positions", "tie").orderBy("position", "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """Rows (doc_id, position): every round of every document that the mix takes, range-sorted by position."""
    return mixed.where("taken > 0").select("doc_id", F.explode("positions").alias("position")).orderBy("position", "doc_id")

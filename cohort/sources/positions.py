"""Row positions in input order, without sorting rows in one task.

* ``running_offsets``: prefix sums of counts (per file, per split), range-partitioned; the driver sees one sum per partition.
* ``numbered``: 1..n over a sort order, by range partitions and their counts.
* ``file_positions``: Parquet rows by file and ``_metadata.row_index``: a scan and a join with one row per file.
* ``sheet_positions``: records of ``read_sheets(..., places=True)`` by file, split and place in the split.

Positions depend on the files alone: two independent reads of one input join by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohort.session import shared_table


def _bases(spark: SparkSession, totals: list[tuple[int, int]]) -> DataFrame:
    """(part, base): sums of the parts before; one row per range partition."""
    rows, base = [], 0
    for part, n in sorted(totals):
        rows.append((part, base))
        base += n
    return spark.createDataFrame(rows, "part int, base long")


def running_offsets(counts: DataFrame, order: list[str], n: str = "n") -> DataFrame:
    """``counts`` with ``offset``, the sum of ``n`` over all rows before in ``order``."""
    placed = shared_table(counts.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "offsets")
    totals = [(r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum(n).alias("n")).collect()]
    before = F.coalesce(F.sum(n).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("before", before).join(_bases(counts.sparkSession, totals), "part").withColumn("offset", F.col("base") + F.col("before")).drop("part", "base", "before")


def numbered(keys: DataFrame, order: list[str], out: str = "position", parts: int | None = None) -> DataFrame:
    """``keys`` with 1..n in ``order`` (nulls first): range-sorted and written once, so that numbers never change."""
    dealt = keys.repartitionByRange(parts, *order) if parts else keys.repartitionByRange(*order)
    placed = dealt.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = shared_table(placed, "numbered").withColumn("part", F.shiftrightunsigned("at", 33).cast("int"))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()
    bases = _bases(keys.sparkSession, [(r["part"], r["n"]) for r in counts])
    within = F.col("at") - F.shiftleft(F.col("part").cast("long"), 33)
    return placed.join(bases, "part").withColumn(out, F.col("base") + within + 1).drop("part", "at", "base")


def file_positions(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, out: str = "position") -> DataFrame:
    """Rows of Parquet files with their position, from 1, by file path and row in the file."""
    scan = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows = scan.select(*(columns or scan.columns), *place)
    counts = scan.select(place[0]).groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
    offsets = shared_table(running_offsets(counts, ["_file"]).select("_file", "offset"), "file-offsets")
    return rows.join(offsets, "_file").withColumn(out, F.col("offset") + F.col("_row") + 1).drop("_file", "_row", "offset")


def sheet_positions(records: DataFrame, out: str = "position") -> DataFrame:
    """Records of ``read_sheets(..., places=True)`` with their position, from 1, by file and place; places are dropped."""
    counts = records.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("n"))
    offsets = shared_table(running_offsets(counts, ["_file", "_split"]).select("_file", "_split", "offset"), "split-offsets")
    within = F.row_number().over(Window.partitionBy("_file", "_split").orderBy("_at"))
    return records.withColumn("_n", within).join(offsets, ["_file", "_split"]).withColumn(out, F.col("offset") + F.col("_n")).drop("_file", "_split", "_at", "_n", "offset")

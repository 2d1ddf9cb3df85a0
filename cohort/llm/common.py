"""Helpers shared by the corpus operators: shared folder, materialising, words, links -> components."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.session import ship  # noqa: F401 (the operators here take it from this module)

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``; a scratch folder only for local sessions."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    base = tempfile.mkdtemp(prefix="corpus-")
    spark.sparkContext.setCheckpointDir(base)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: a lost executor costs nothing that is already written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder that materialise() wrote df to, when nothing reads it any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch at most: batches hold whole texts or sets, on both sides of the pipe.
BATCH_ROWS = 1000


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def dealt(df: DataFrame) -> DataFrame:
    """One side of a join for which both are dealt out by key, at any size.

    Spark would take a side that it finds to have some MB to the driver, where it becomes a table of several times that, and the joins
    of a plan do so at once.
    """
    return df.hint("merge")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, bound as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: For ``few`` of components(): links that one task takes to their components; more are contracted in rounds first.
FEW_LINKS = 1 << 16


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component): the greater root of a link is hung below the least it meets, until none differ."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = at[:len(u)], at[len(u):], np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        if (low == high).all():
            return nodes, nodes[up]
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]


def _few_components(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            node, component = _roots(*map(np.concatenate, zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])

    return map_arrow(edges.coalesce(1), run, "node long, component long")


def _settled(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, u: str = "u", v: str = "v", few: int = 0) -> DataFrame:
    """Connected components of undirected links: rows ``(node, component)``, component = smallest node reachable.

    Alternating large-star / small-star rounds, each a minimum per node (combined before the shuffle) and an
    equi-join; every round is checkpointed, nothing but two numbers reaches the driver. Once no more than ``few`` links are
    left, one task ends the work: rounds over a few are all start-up time. Nodes without links are absent.
    A node with many links is one key of a join that the adaptive planner may split, never a collected group; no round's table is
    taken to the driver.
    Null ends and self-links are ignored; no links give no rows.
    """
    shared_dir(links.sparkSession)
    u, v = F.col(u).cast("long"), F.col(v).cast("long")
    edges = (links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
             .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct().checkpoint())
    state = _settled(edges)
    while state[0]:
        if state[0] <= few:
            return _few_components(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(dealt(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(dealt(low), "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).distinct()
        edges = small.checkpoint()
        before, state = state, _settled(edges)
        if state == before:
            break
    member = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return member.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

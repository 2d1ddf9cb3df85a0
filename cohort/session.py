"""Session helpers: a local session for tests/bench, checkpoint folder policy, the library on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "cohort",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided one."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    parts = shuffle_partitions or int(os.environ.get("COHORT_SHUFFLE_PARTITIONS", "8"))
    spark = (SparkSession.builder.master(master).appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(parts))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("COHORT_DRIVER_MEMORY", "16g"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage and is only read.
    It is filled in here only for local-mode sessions (tests, bench), with a
    fresh scratch folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        path = tempfile.mkdtemp(prefix="cohort-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint folder and read it back.

    A table that is read again more than once: lineage is cut, a lost executor loses nothing, and Spark knows its size.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=1)
def _archive() -> str:
    """A zip file of this library."""
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="library-"), os.path.basename(top) + ".zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    own = os.path.join(folder, name)
                    out.write(own, os.path.relpath(own, os.path.dirname(top)))
    return path


def ship(spark: SparkSession) -> None:
    """Hand this library to the executors, once per application: their Python needs it to run the operators' functions."""
    context = spark.sparkContext
    if not getattr(context, "_library_shipped", False):
        context.addPyFile(_archive())
        context._library_shipped = True

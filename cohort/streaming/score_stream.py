"""File-drop scoring with Structured Streaming.

New sheets landed in a folder (Parquet, as written by ``sources.scan.land``,
or delimited text with a known header) are scored with a FROZEN model: the
scaler, centres and labels are literals in the projection, so the stream is
stateless map-only work -- no shuffle, no state store, exactly-once into a
file sink through the checkpoint in shared storage.  ``trigger`` defaults
to ``availableNow`` (process what has landed, then stop) and can be any
processing-time interval for a standing scorer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohort.functions.text import null_tokens
from cohort.operators import features as FE
from cohort.operators import gates as G
from cohort.operators import score as S
from cohort.plans.jobs import Model


def sheet_stream(spark: SparkSession, source_dir: str, schema: T.StructType, fmt: str = "parquet",
                 sep: str = ",", encoding: str = "UTF-8", max_files_per_trigger: int | None = None
                 ) -> DataFrame:
    """Streaming read of landed sheets with an explicit schema (no inference)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "parquet":
        return r.parquet(source_dir)
    df = (r.option("header", True).option("sep", sep).option("encoding", encoding)
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .csv(source_dir))
    return df.select(*[null_tokens(F.col(f"`{c}`")).alias(c) for c in df.columns])


def scored_stream(stream: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Header resolution + features + frozen-model scoring on a streaming frame."""
    cells = G.resolve_headers(stream)
    fm = FE.feature_matrix(cells, model.as_of, keep=keep)
    return S.score_rows(fm, model.scaler, model.centroids, [(c, lab) for c, _, lab in model.labels],
                        keep=keep)


def start_scoring(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                  model: Model, schema: T.StructType, keep: list[str], fmt: str = "parquet",
                  trigger: dict | None = None, **read_opts) -> StreamingQuery:
    """Start the scorer; each micro-batch appends scored rows to ``sink_dir``."""
    out = scored_stream(sheet_stream(spark, source_dir, schema, fmt, **read_opts), model, keep)
    w = (out.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start(sink_dir)

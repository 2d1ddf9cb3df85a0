"""Scoring: frozen scaler -> nearest centre -> label -> confidence -> risk.

One chained projection per row (scaler and up to ``LITERAL_CENTROIDS`` centres and labels
are literals). More centres go through ``search.nearest`` and more labels are a table, which Spark
broadcasts or shuffles by its size. No shuffle until a summary groups the scored rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort import contract as K
from cohort.functions.cells import masked_value
from cohort.functions.text import clean_text, fixed
from cohort.operators.features import Scaler, standardize
from cohort.operators.metrics import (LITERAL_CENTROIDS, Centroids, assign_nearest, confidence,
                                      margin, with_distances)
from cohort.operators.search import nearest


def risk_level(label: Column, table: dict[str, str] | None = None,
               default: str = K.RISK_DEFAULT) -> Column:
    """Label -> risk level through a parameter table; others -> ``default``."""
    tab = K.RISK_BY_LABEL if table is None else table
    expr = None
    for lab, risk in tab.items():
        expr = F.when(label == lab, F.lit(risk)) if expr is None else expr.when(label == lab, F.lit(risk))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def label_expr(cluster: Column, labels: list[tuple[int, str]]) -> Column:
    """Label of a cluster id from k in-memory (id, label) pairs; else 'Cluster <id>'."""
    default = F.concat(F.lit(K.LABEL_DEFAULT_PREFIX), cluster.cast("string"))
    expr = None
    for cid, lab in labels:
        expr = F.when(cluster == cid, F.lit(lab)) if expr is None else expr.when(cluster == cid, F.lit(lab))
    return default if expr is None else expr.otherwise(default)


def collect_labels(labels: DataFrame) -> list[tuple[int, str]]:
    """(cluster_id, label) pairs of a model's label table (one row per cluster)."""
    return [(int(r[0]), r[1]) for r in labels.select("cluster_id", "label").collect()]


def label_lookup(df: DataFrame, labels: DataFrame | list[tuple[int, str]], cluster_col: str = "cluster_id",
                 out: str = "classification") -> DataFrame:
    """Label lookup; missing -> 'Cluster <id>'.

    In-memory labels become a CASE expression up to ``LITERAL_CENTROIDS`` -- no join.  A label
    DataFrame, or more labels, are joined, by broadcast if Spark finds them small.
    """
    if isinstance(labels, list) and len(labels) <= LITERAL_CENTROIDS:
        return df.withColumn(out, label_expr(F.col(cluster_col), labels))
    if isinstance(labels, list):
        labels = df.sparkSession.createDataFrame(labels, "cluster_id int, label string")
    lab = labels.select(F.col("cluster_id").alias("_cid"), F.col("label").alias("_lab"))
    j = df.join(lab, df[cluster_col] == F.col("_cid"), "left")
    return j.withColumn(out, F.coalesce(F.col("_lab"), F.concat(
        F.lit(K.LABEL_DEFAULT_PREFIX), F.col(cluster_col).cast("string")))).drop("_cid", "_lab")


def score_rows(features: DataFrame, scaler: Scaler, centroids: Centroids,
               labels: DataFrame | list[tuple[int, str]],
               keep: list[str] | None = None, risk_table: dict[str, str] | None = None,
               assigned_col: str | None = None) -> DataFrame:
    """Score rows: (keep..., cluster_id, classification, confidence, margin, risk_level).

    ``assigned_col`` (optional) gives a cluster other than the nearest one
    for the confidence formula; by default the nearest is used.
    """
    keep = keep if keep is not None else [c for c in features.columns if c not in scaler.features]
    z = standardize(features, scaler, keep=keep)
    if centroids.k > LITERAL_CENTROIDS:
        x = F.array(*[F.col(f).cast("double") for f in centroids.features])
        a = nearest(z, centroids.vectors(z.sparkSession), x, facts=True, assigned_col=assigned_col)
    else:
        a = with_distances(assign_nearest(z, centroids), centroids)
        ids = F.array(*[F.lit(i) for i in centroids.ids])
        target = F.col(assigned_col) if assigned_col else F.col("cluster_id")
        pos = F.array_position(ids, target).cast("int")
        a = (a.withColumn("confidence", confidence(F.col("distances"), pos))
             .withColumn("margin", margin(F.col("distances"))))
    a = label_lookup(a, labels)
    a = a.withColumn("risk_level", risk_level(F.col("classification"), risk_table))
    return a.select(*keep, "cluster_id", "classification", "confidence", "margin", "risk_level")


def report_rows(scored: DataFrame, id_columns: list[str], case_col: str = "case_no",
                mask: bool = True) -> DataFrame:
    """Report table: ID, identifiers, Classificação, Confiança text, Nível_de_Risco, Cluster_ID.

    A CPF is masked unless ``mask`` is off."""
    return scored.select(
        F.col(case_col).alias("ID"), *[(masked_value(c, c) if mask else F.col(c)).alias(c) for c in id_columns],
        F.col("classification").alias("Classificação"),
        F.concat(fixed(F.col("confidence"), 1), F.lit("%")).alias("Confiança"),
        F.col("risk_level").alias("Nível_de_Risco"),
        F.col("cluster_id").alias("Cluster_ID"))


# --------------------------------------------------------------------------- insights

INSIGHT_SCHEMA = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("details", T.ArrayType(T.StringType())),
    T.StructField("training_summary", T.StringType()),
    T.StructField("training_details", T.ArrayType(T.StringType())),
])


def insight_catalogue(spark: SparkSession) -> DataFrame:
    """Default insight dimension: (label, summary, details, training_summary, training_details)."""
    rows = [(lab, summ, list(det), None, None) for lab, summ, det in K.INSIGHTS]
    return spark.createDataFrame(rows, INSIGHT_SCHEMA)


def insight_merge(defaults: DataFrame, parsed: DataFrame) -> DataFrame:
    """Full outer join on label: parsed training fields override when present."""
    p = parsed.select(F.col("label").alias("_l"), F.col("training_summary").alias("_ts"),
                      F.col("training_details").alias("_td"))
    j = defaults.join(p, defaults["label"] == p["_l"], "full_outer")
    has_td = F.col("_td").isNotNull() & (F.size(F.col("_td")) > 0)
    return j.select(
        F.coalesce(F.col("label"), F.col("_l")).alias("label"),
        F.col("summary"), F.col("details"),
        F.when(F.col("_ts").isNotNull() & (F.col("_ts") != ""), F.col("_ts"))
         .otherwise(F.col("training_summary")).alias("training_summary"),
        F.when(has_td, F.col("_td")).otherwise(F.col("training_details")).alias("training_details"))


def insight_lookup(df: DataFrame, insights: DataFrame, label_col: str = "classification") -> DataFrame:
    """Attach summary / details / training context with defaults for unknown labels."""
    ins = insights.select(F.col("label").alias("_il"), "summary", "details", "training_summary", "training_details")
    j = df.join(ins, df[label_col] == F.col("_il"), "left")
    return (j.withColumn("summary", F.coalesce(F.col("summary"), F.lit(K.NO_SUMMARY)))
            .withColumn("details", F.coalesce(F.col("details"), F.array().cast("array<string>")))
            .withColumn("training_details",
                        F.coalesce(F.col("training_details"), F.array().cast("array<string>")))
            .drop("_il"))


def observed_insights(scored: DataFrame, insights: DataFrame,
                      label_col: str = "classification") -> DataFrame:
    """Insight bullets once per label observed in the scored rows:
    (label, summary, position, bullet)."""
    seen = scored.select(F.col(label_col).alias("label")).distinct()
    cat = insights.select("label", "summary", "details")
    known = cat.join(seen, "label", "left_semi")
    unknown = (seen.join(cat.select("label"), "label", "left_anti")
               .select("label", F.lit(K.NO_SUMMARY).alias("summary"),
                       F.array().cast("array<string>").alias("details")))
    allr = known.unionByName(unknown)
    return allr.select("label", "summary",
                       F.posexplode_outer("details").alias("position", "bullet")).select(
        "label", "summary", (F.col("position") + 1).alias("position"), "bullet")


def first_bullets(insights: DataFrame, n: int = 2) -> DataFrame:
    """(label, bullets = first n details, remark = first detail or summary)."""
    return insights.select(
        "label", F.slice(F.col("details"), 1, n).alias("bullets"),
        F.coalesce(F.try_element_at(F.col("details"), F.lit(1)), F.col("summary")).alias("remark"))


def clean_label(c: Column, default: str = K.NOT_INFORMED) -> Column:
    return clean_text(c, default)

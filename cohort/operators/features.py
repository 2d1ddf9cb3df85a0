"""Feature matrix, scaler fit and standardisation.

* ``feature_matrix``: two narrow projections (cell keys, then encoders); a
  feature exists only when its source column does.
* ``scaler_fit``: mean, then *population* std of every feature, in two
  aggregate passes (partial aggregation map-side, tiny buffers) whose sums
  don't depend on the partitions.  The result is a feature-count-sized table; ``Scaler`` holds it as literals.
* ``standardize``: ``(x - mean) / scale`` with scale = std, or 1 where the
  std is 0 -- a projection, no join, no shuffle.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort import contract as K
from cohort.functions import encode as E
from cohort.functions import text as TX
from cohort.functions.sums import long_means

_KEYS = {
    # source key -> [(key column, expression on the raw cell)]
    "idade": lambda c, o: [("_k_age", TX.strip_u(c.cast("string")))],
    "estado_civil": lambda c, o: [("_k_civil", TX.collapse_ws(c))],
    "bolsa_familia": lambda c, o: [("_k_benefit", TX.collapse_ws(c))],
    "grau_escolaridade": lambda c, o: list(zip(["_k_edu_blank", "_k_edu1", "_k_edu2"],
                                               E.education_keys(c))),
    "situacao_escolar": lambda c, o: [("_k_school", E.lower_key(c))],
    "situacao_trabalho": lambda c, o: [("_k_work", E.lower_key(c))],
    "remuneracao": lambda c, o: [("_k_money", TX.strip_u(E.money_text(c)))],
    "procurando_trabalho": lambda c, o: [("_k_looking", TX.collapse_ws(c))],
    "uso_drogas": lambda c, o: [("_k_drugs", E.lower_key(c))],
    "data_cadastro": lambda c, o: [("_k_date", E.parse_date(c, o["date_patterns"]))],
}


def _num(k: Column) -> Column:
    return F.when(k.rlike(E.NUMBER_RE), k.try_cast("double"))


_FROM_KEYS = {
    "age": lambda o: F.coalesce(_num(F.col("_k_age")), F.lit(0.0)),
    "marital_status_single": lambda o: F.coalesce(
        F.col("_k_civil").isin(*K.SINGLE_VALUES), F.lit(False)).cast("int"),
    "marital_status_married": lambda o: F.coalesce(
        F.col("_k_civil").isin(*K.MARRIED_VALUES), F.lit(False)).cast("int"),
    "family_benefit": lambda o: E.binary_from_key(F.col("_k_benefit")),
    "education_level": lambda o: E.education_from_keys(
        F.col("_k_edu_blank"), F.col("_k_edu1"), F.col("_k_edu2")),
    "studying": lambda o: F.coalesce(F.col("_k_school") == K.STUDYING_VALUE,
                                     F.lit(False)).cast("int"),
    "employment_signal": lambda o: E.employment_from_key(F.col("_k_work")),
    "income": lambda o: F.coalesce(_num(F.col("_k_money")), F.lit(0.0)),
    "looking_for_job": lambda o: E.binary_from_key(F.col("_k_looking")),
    "substance_dependency": lambda o: E.substance_from_key(F.col("_k_drugs"),
                                                           o["missing_substance"]),
    "program_duration": lambda o: F.coalesce(F.round(
        F.datediff(F.lit(o["as_of"]).cast("date"), F.col("_k_date")) /
        F.lit(K.DAYS_PER_MONTH), 1), F.lit(0.0)),
}


def _opts(as_of, missing_substance, date_patterns) -> dict:
    return {"as_of": as_of, "missing_substance": missing_substance,
            "date_patterns": date_patterns}


def feature_matrix(df: DataFrame, as_of: _dt.date | str, keep: list[str] | None = None,
                   missing_substance: int = 1,
                   date_patterns: list[str] | None = None) -> DataFrame:
    """Cells (canonical keys) -> feature columns, carrying ``keep`` columns.

    Two projections: each cell's normalised key (strip / lower / collapse /
    accent fold / date parse) is computed ONCE, then the encoders decide on
    the keys.  Keys are referenced by several branches, so Catalyst keeps
    the two projections apart instead of re-evaluating regexes per branch.
    """
    keep = ["row_id"] if keep is None else keep
    opts = _opts(as_of, missing_substance, date_patterns)
    kept = [c for c in keep if c in df.columns]
    key_cols = []
    for source in dict.fromkeys(src for _, src, _ in K.FEATURES):
        if source in df.columns:
            key_cols += [e.alias(n) for n, e in _KEYS[source](F.col(source), opts)]
    keyed = df.select(*[F.col(c) for c in kept], *key_cols)
    feats = [_FROM_KEYS[name](opts).cast(typ).alias(name)
             for name, source, typ in K.FEATURES if source in df.columns]
    return keyed.select(*[F.col(c) for c in kept], *feats)


def present_features(df: DataFrame) -> list[str]:
    return [f for f in K.FEATURE_NAMES if f in df.columns]


@dataclass(frozen=True)
class Scaler:
    """Fitted standardiser: per-feature mean and population std (as literals)."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    @property
    def scales(self) -> tuple[float, ...]:
        return tuple(s if s and s > 0 else 1.0 for s in self.stds)

    def to_df(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([T.StructField("feature", T.StringType()),
                               T.StructField("mean", T.DoubleType()),
                               T.StructField("std", T.DoubleType()),
                               T.StructField("scale", T.DoubleType())])
        rows = list(zip(self.features, self.means, self.stds, self.scales))
        return spark.createDataFrame(rows, schema)

    @staticmethod
    def from_df(df: DataFrame) -> "Scaler":
        rows = df.select("feature", "mean", "std").collect()  # one row per feature
        order = {f: i for i, f in enumerate(K.FEATURE_NAMES)}
        rows = sorted(rows, key=lambda r: order.get(r["feature"], len(order)))
        return Scaler(tuple(r["feature"] for r in rows), tuple(float(r["mean"]) for r in rows),
                      tuple(float(r["std"]) if r["std"] is not None else 0.0 for r in rows))


def scaler_stats(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Long table (feature, mean, std, scale): means, then deviations from them, in sums that no plan changes (``sums``).

    The means (one number per feature) come to the driver between the two passes.
    """
    feats = features or present_features(df)
    means = long_means(df, {f: F.col(f) for f in feats}).first()
    off = {f: F.col(f).cast("double") - F.lit(means[f]) for f in feats}
    squares = long_means(df, {f: off[f] * off[f] for f in feats})
    wide = squares.select(*[e for f in feats for e in (F.lit(means[f]).cast("double").alias(f"{f}__mean"), F.sqrt(f).alias(f"{f}__std"))])
    stack = ", ".join(f"'{f}', `{f}__mean`, `{f}__std`" for f in feats)
    long = wide.selectExpr(f"stack({len(feats)}, {stack}) as (feature, mean, std)")
    return long.withColumn("scale", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)))


def scaler_fit(df: DataFrame, features: list[str] | None = None) -> Scaler:
    """Fit the scaler (two passes; collects one row per feature)."""
    return Scaler.from_df(scaler_stats(df, features))


def standardize(df: DataFrame, scaler: Scaler, keep: list[str] | None = None,
                weights: dict[str, float] | None = None, suffix: str = "") -> DataFrame:
    """Apply a fitted (frozen) scaler; optional weights multiply AFTER scaling."""
    missing = [f for f in scaler.features if f not in df.columns]
    if missing:
        raise ValueError(feature_contract_message(missing))
    keep = [c for c in df.columns if c not in scaler.features] if keep is None else keep
    cols = [F.col(c) for c in keep]
    for f, m, s in zip(scaler.features, scaler.means, scaler.scales):
        z = (F.col(f).cast("double") - F.lit(m)) / F.lit(s)
        if weights is not None:
            z = z * F.lit(float(weights.get(f, 1.0)))
        cols.append(z.alias(f + suffix))
    return df.select(*cols)


def feature_contract_message(missing_features: list[str]) -> str:
    """Missing features -> de-duplicated source headers, in feature order."""
    src = {f: K.REQUIRED_HEADERS[s] for f, s, _ in K.FEATURES}
    seen: list[str] = []
    for f in missing_features:
        name = src.get(f, f)
        if name not in seen:
            seen.append(name)
    return "missing required columns: " + ", ".join(seen)


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Dense ML vector column for ``pyspark.ml`` estimators."""
    return VectorAssembler(inputCols=list(features), outputCol=out,
                           handleInvalid="error").transform(df)

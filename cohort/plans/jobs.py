"""Training and scoring jobs.

Training: cells -> persisted features -> scaler -> z vectors in blocks
-> k sweep (restarts per k, distributed fits) -> choose k -> best fit ->
profiles and labels (1 grouped aggregate over k groups) -> model tables.
Scoring: frozen scaler + centres + labels as literals -> one projection.

What reaches the driver is bounded by the model, never by the data: 11
scaler rows, k x 11 centre values, <= 4 sweep rows, k label rows.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort import contract as K
from cohort.operators import features as FE
from cohort.operators import kmeans as KM
from cohort.operators import metrics as M
from cohort.operators import profile as P
from cohort.operators import score as S
from cohort.operators.sweep import METRICS
from cohort.plans.intake import AS_OF, intake
from cohort.sources.publish import current, publish


@dataclass
class Model:
    """A trained cohort model: everything scoring needs, all bounded by k x d."""

    scaler: FE.Scaler
    centroids: M.Centroids
    labels: list[tuple[int, float, str]]
    sweep: list[tuple[int, float, float, float]]
    best_k: int
    best_k_score: float | None
    selected_k: int
    selected_k_score: float | None
    total_records: int
    as_of: str
    trained_at: str = field(default_factory=lambda: _dt.datetime.now().isoformat(timespec="seconds"))
    source: str = ""
    centroid_silhouettes: dict[int, float] = field(default_factory=dict)  # by k, beside the sweep's own silhouette

    @property
    def features(self) -> list[str]:
        return list(self.scaler.features)

    def labels_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.labels, "cluster_id int, score double, label string")

    def metadata(self, model_path: str = "", scaler_path: str = "") -> dict:
        return {"training_datetime": self.trained_at, "source_file": self.source,
                "total_records": self.total_records, "selected_k": self.selected_k,
                "silhouette_score": self.selected_k_score, "best_k": self.best_k,
                "best_k_score": self.best_k_score, "feature_names": self.features,
                "model_path": model_path, "scaler_path": scaler_path}


def _prepare(cells: DataFrame, as_of) -> tuple[DataFrame, DataFrame, FE.Scaler, list[str]]:
    """Feature matrix (persisted: the scaler, the fits and the assignment read it) -> scaler -> z + raw features (a projection), scaler, features."""
    fm = FE.feature_matrix(cells, as_of, keep=["row_id"]).persist(StorageLevel.MEMORY_AND_DISK)
    feats = FE.present_features(fm)
    scaler = FE.scaler_fit(fm, feats)
    z = FE.standardize(fm, scaler, keep=["row_id"] + feats, suffix="__z")
    zf = [f"{f}__z" for f in feats]
    return fm, FE.assemble(z, zf), scaler, feats


def train(cells: DataFrame, as_of=AS_OF, k_min: int = K.K_MIN, k_max: int = K.K_MAX,
          n_init: int = K.N_INIT, seed: int = K.SEED, max_iter: int = K.MAX_ITER,
          parallelism: int = 4, source: str = "") -> tuple[Model, DataFrame]:
    """Train on a sheet of cells (canonical keys + row_id).

    Returns the model and the training rows with their features and cluster (persisted).
    """
    spark = cells.sparkSession
    fm, vec, scaler, feats = _prepare(cells, as_of)
    zf = [f"{f}__z" for f in feats]
    n = fm.count()
    ks = KM.k_range(n, k_min, k_max)
    sweep_rows: list[tuple[int, float, float, float]] = []
    near: dict[int, float] = {}
    fits: dict[int, KM.Fit] = {}
    if ks:
        metrics, fits = KM.k_sweep(vec, zf, ks, n_init, seed, max_iter, parallelism)
        found = metrics.orderBy("k").collect()  # <= k_max rows
        sweep_rows, near = [tuple(r)[:4] for r in found], {r["k"]: r["centroid_silhouette"] for r in found}
    if sweep_rows:
        choice = KM.choose_k(metrics).first()
        best_k, best_score = int(choice["best_k"]), choice["best_k_score"]
        selected_k, selected_score = int(choice["selected_k"]), choice["selected_k_score"]
    else:  # too few rows or distinct points for a sweep
        best_k, best_score, selected_k, selected_score = (K.FALLBACK_K, None, K.FALLBACK_K, None)
    fit = fits.get(selected_k) or KM.kmeans_fit(vec, min(selected_k, max(n, 1)), n_init, seed, max_iter, parallelism=parallelism)
    cents = M.Centroids.from_model(fit.model, zf)
    assigned = M.assign_nearest(vec, cents).drop(*zf, "features").persist(StorageLevel.MEMORY_AND_DISK)
    means = P.cluster_means(assigned, feats)
    labs = [(int(r["cluster_id"]), float(r["score"]), r["label"])
            for r in P.cluster_label(P.cluster_score(means)).collect()]  # k rows
    model = Model(scaler, M.Centroids(cents.ids, tuple(feats), cents.values), labs, sweep_rows,
                  best_k, best_score, selected_k, selected_score, n, str(as_of), source=source, centroid_silhouettes=near)
    fm.unpersist()
    return model, assigned


# --------------------------------------------------------------------------- scoring

def score(cells: DataFrame, model: Model, as_of=None, keep: list[str] | None = None,
          risk_table: dict[str, str] | None = None) -> DataFrame:
    """Score a sheet with a frozen model (fails on missing fitted features)."""
    as_of = as_of or model.as_of
    keep = keep if keep is not None else [c for c in cells.columns]
    fm = FE.feature_matrix(cells, as_of, keep=keep)
    spark = cells.sparkSession
    del spark
    return S.score_rows(fm, model.scaler, model.centroids, [(c, lab) for c, _, lab in model.labels],
                        keep=keep, risk_table=risk_table)


# --------------------------------------------------------------------------- persistence

def save(model: Model, spark: SparkSession, path: str) -> str:
    """Publish the model as a new version under ``path`` (shared storage): Parquet tables and metadata JSON.

    Readers see the version before until all of the new one is there. Returns the version's folder.
    """
    def write(folder: str) -> None:
        model.scaler.to_df(spark).coalesce(1).write.parquet(f"{folder}/scaler")
        model.centroids.to_df(spark).coalesce(1).write.parquet(f"{folder}/centroids")
        model.labels_df(spark).coalesce(1).write.parquet(f"{folder}/labels")
        rows = [(*r, model.centroid_silhouettes.get(r[0])) for r in model.sweep]
        spark.createDataFrame(rows, SWEEP).coalesce(1).write.parquet(f"{folder}/sweep")
        meta = model.metadata(f"{folder}/centroids", f"{folder}/scaler")
        meta["as_of"] = model.as_of
        metadata_df(spark, meta).coalesce(1).write.json(f"{folder}/metadata")

    return publish(spark, path, write)


SWEEP = METRICS
METADATA_SCHEMA = T.StructType([
    T.StructField("training_datetime", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("total_records", T.LongType()),
    T.StructField("selected_k", T.IntegerType()),
    T.StructField("silhouette_score", T.DoubleType()),
    T.StructField("best_k", T.IntegerType()),
    T.StructField("best_k_score", T.DoubleType()),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("model_path", T.StringType()),
    T.StructField("scaler_path", T.StringType()),
    T.StructField("as_of", T.StringType()),
])


def metadata_df(spark: SparkSession, meta: dict) -> DataFrame:
    row = tuple(meta.get(f.name) for f in METADATA_SCHEMA.fields)
    return spark.createDataFrame([row], METADATA_SCHEMA)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata with an explicit schema; a missing path gives an empty frame, any other fault is raised."""
    try:
        return spark.read.schema(METADATA_SCHEMA).json(f"{current(spark, path)}/metadata")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], METADATA_SCHEMA)


def load(spark: SparkSession, path: str) -> Model:
    """The model version that counts when this is called."""
    path = current(spark, path)
    sc = FE.Scaler.from_df(spark.read.parquet(f"{path}/scaler"))
    cl = spark.read.parquet(f"{path}/centroids").collect()  # k x d rows
    feats = list(sc.features)
    ids = sorted({int(r["cluster_id"]) for r in cl})
    vals = {(int(r["cluster_id"]), r["feature"]): float(r["value"]) for r in cl}
    cents = M.Centroids(tuple(ids), tuple(feats), tuple(tuple(vals[i, f] for f in feats) for i in ids))
    labs = [(int(r["cluster_id"]), float(r["score"]), r["label"])
            for r in spark.read.parquet(f"{path}/labels").collect()]
    rows = spark.read.schema(SWEEP).parquet(f"{path}/sweep").orderBy("k").collect()
    sweep, near = [tuple(r)[:4] for r in rows], {r["k"]: r["centroid_silhouette"] for r in rows}
    md = read_metadata(spark, path).first()
    return Model(sc, cents, labs, sweep, md["best_k"], md["best_k_score"], md["selected_k"],
                 md["silhouette_score"], md["total_records"], md["as_of"], md["training_datetime"],
                 md["source_file"], near)


# --------------------------------------------------------------------------- flagship

def flagship(spark: SparkSession, sf_dir: str, n_init: int = K.N_INIT) -> DataFrame:
    """Train on the intake sheet, then score every row with the trained model."""
    cells = intake(spark, sf_dir)
    model, _ = train(cells, n_init=n_init, parallelism=8, source=f"{sf_dir}/orders.parquet")
    scored = score(cells, model, keep=["row_id", "nome", "cpf"])
    return scored.select("row_id", "nome", "cpf", "cluster_id", "classification",
                         F.round("confidence", 1).alias("confidence"), "risk_level")

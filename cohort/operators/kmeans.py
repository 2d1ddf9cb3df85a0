"""k-means fit with restarts, the k sweep and the choice of k.

Every restart of every k starts from the centres that ``pyspark.ml.clustering.KMeans`` would draw (k-means||, all of them in a few
passes: ``starts``).  The Lloyd iterations of all of them then go together: a pass over the rows moves
the centres of every fit that still moves, so that the passes are those of the slowest fit and not the sum of all.  The best
restart is the one with the least training cost.  The rows are kept once, as packed blocks of doubles; nothing but counts of partitions, centres,
their candidates and costs reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort import contract as K
from cohort.operators.features import assemble
from cohort.operators.blocks import Blocks, block_sums, kept, packed, pieces, scored, stacked
from cohort.operators.metrics import Centroids, assign_nearest
from cohort.operators.starts import starts
from cohort.operators.sweep import sweep_metrics


@dataclass
class Model:
    """The centres of a fit."""

    centres: np.ndarray
    features_col: str

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 (the name that KMeansModel has)
        return list(self.centres)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the nearest centre as ``_pred``."""
        names = tuple(f"x{i}" for i in range(self.centres.shape[1]))
        centres = Centroids(tuple(range(len(self.centres))), names, tuple(map(tuple, self.centres.tolist())))
        near = assign_nearest(df.withColumn("_x", vector_to_array(self.features_col)), centres, vector_col="_x")
        return near.select(*df.columns, F.col("cluster_id").alias("_pred"))


@dataclass
class Fit:
    k: int
    seed: int
    cost: float
    model: Model


# scikit-learn stops when the TOTAL squared centre shift <= tol * mean feature
# variance; Spark stops when EVERY centre moves <= tol (Euclidean).  Per-centre
# shifts of sqrt(tol * var / k) guarantee the former (var = 1 once standardised).
SKLEARN_TOL = 1e-4


def spark_tol(k: int, tol: float | None = None, mean_variance: float = 1.0) -> float:
    return tol if tol is not None else (SKLEARN_TOL * mean_variance / max(k, 1)) ** 0.5


def _move(rows: Blocks, sets: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """One Lloyd iteration of every set of centres in one pass: (moved centres, cost by the centres before); empty clusters stay."""
    offsets, d = np.cumsum([0, *map(len, sets)]), sets[0].shape[1]
    alike = []  # sets of one size: (groups of their clusters, groups of their costs, centres)
    for k in sorted(set(map(len, sets))):
        own = [i for i, c in enumerate(sets) if len(c) == k]
        alike.append((np.concatenate([offsets[i] + np.arange(k) for i in own]), int(offsets[-1]) + np.array(own), stacked([sets[i] for i in own])))

    def measure(x: np.ndarray):
        for piece in pieces(x, int(offsets[-1])):
            y = x[piece]
            wide, square = np.column_stack([y, np.ones(len(y))]), (y * y).sum(axis=1)
            for clusters, costs, centres in alike:
                d2 = scored(y, centres)
                best = d2.min(axis=1)
                sums = (d2 == best[:, None]).astype("float64").reshape(len(clusters), -1) @ wide
                if sums[:, -1].sum() != best.size:  # ties go to the first
                    first = d2.argmin(axis=1)[:, None] == np.arange(centres.shape[1])[:, None]
                    sums = first.astype("float64").reshape(len(clusters), -1) @ wide
                yield clusters, sums[:, -1].astype("int64"), sums[:, :-1]
                cost = np.zeros((len(costs), d))
                cost[:, 0] = np.maximum(best + square, 0.0).sum(axis=1)
                yield costs, len(y), cost

    n, s = block_sums(rows, int(offsets[-1]) + len(sets), d, measure)
    out = []
    for i, (first, c) in enumerate(zip(offsets, sets, strict=False)):
        mine, sums = n[first:first + len(c)], s[first:first + len(c)]
        out.append((np.where(mine[:, None] > 0, sums / np.maximum(mine, 1)[:, None], c), float(s[offsets[-1] + i, 0])))
    return out


def fit_all(vectors: DataFrame, tasks: list[tuple[int, int]], max_iter: int = K.MAX_ITER, tol: float | None = None,
            features_col: str = "features", parallelism: int = K.N_INIT, rows: Blocks | None = None) -> list[Fit]:
    """One fit per (k, seed). A fit ends when each of its centres moves by its tolerance at most, or after ``max_iter`` passes.

    ``rows``: the vectors as ``kept`` blocks, if there already. All fits go together, whatever ``parallelism``.
    """
    own = rows is None
    rows = kept(packed(vectors, vector_to_array(features_col))) if own else rows
    centres = starts(rows, tasks)
    costs, moving = [0.0] * len(tasks), list(range(len(tasks)))
    for _ in range(max_iter):
        still = []
        for i, (moved, cost) in zip(moving, _move(rows, [centres[i] for i in moving]), strict=True):
            if ((moved - centres[i]) ** 2).sum(axis=1).max() > spark_tol(tasks[i][0], tol) ** 2:
                still.append(i)
            centres[i], costs[i] = moved, cost
        moving = still
        if not moving:
            break
    if own:
        rows.unpersist()
    return [Fit(k, seed, cost, Model(c, features_col)) for (k, seed), c, cost in zip(tasks, centres, costs, strict=True)]


def kmeans_restarts(vectors: DataFrame, k: int, n_init: int = K.N_INIT, seed: int = K.SEED,
                    max_iter: int = K.MAX_ITER, tol: float | None = None,
                    features_col: str = "features", parallelism: int = K.N_INIT) -> list[Fit]:
    """All restarts (seeds seed..seed+n_init-1) of one k."""
    return fit_all(vectors, [(k, seed + i) for i in range(n_init)], max_iter, tol, features_col, parallelism)


def kmeans_fit(vectors: DataFrame, k: int, n_init: int = K.N_INIT, seed: int = K.SEED,
               max_iter: int = K.MAX_ITER, tol: float | None = None,
               features_col: str = "features", parallelism: int = K.N_INIT) -> Fit:
    """Best of ``n_init`` restarts by training cost (first seed wins ties)."""
    fits = kmeans_restarts(vectors, k, n_init, seed, max_iter, tol, features_col, parallelism)
    return min(fits, key=lambda f: (f.cost, f.seed))


def vectors_of(z: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """``keep``, the standardised features and their vector: a projection, for rows whose features are persisted already."""
    keep = keep if keep is not None else [c for c in z.columns if c not in features]
    return assemble(z, features).select(*keep, *features, "features")


def persist_vectors(z: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Assemble and persist the standardised vectors.

    MEMORY_AND_DISK: a lost executor's blocks are recomputed from the short
    scan->project lineage, or read back from disk when evicted.
    """
    return vectors_of(z, features, keep).persist(StorageLevel.MEMORY_AND_DISK)


def k_range(n_rows: int, k_min: int = K.K_MIN, k_max: int = K.K_MAX) -> list[int]:
    """k = k_min .. min(k_max, n-1)."""
    return list(range(k_min, min(k_max + 1, n_rows)))


def k_sweep(vectors: DataFrame, features: list[str], ks: list[int], n_init: int = K.N_INIT,
            seed: int = K.SEED, max_iter: int = K.MAX_ITER, parallelism: int = K.N_INIT
            ) -> tuple[DataFrame, dict[int, Fit]]:
    """Rows (k, inertia, silhouette, davies_bouldin, centroid_silhouette) and the best fit per k.

    All fits of all k share their passes (``fit_all``); the metrics of all k are measured together
    (``sweep_metrics``). A k for which the rows have too few different points gives fewer centres and is left out.
    """
    tasks = [(k, seed + i) for k in ks for i in range(n_init)]
    if not tasks:
        return sweep_metrics(vectors, {}, features), {}
    rows = kept(packed(vectors, vector_to_array("features")))
    fits = fit_all(vectors, tasks, max_iter, parallelism=parallelism, rows=rows)
    best: dict[int, Fit] = {}
    for fit in fits:  # the first seed wins ties
        if len(fit.model.clusterCenters()) == fit.k and (fit.k not in best or fit.cost < best[fit.k].cost):
            best[fit.k] = fit
    metrics = sweep_metrics(rows, {k: Centroids.from_model(f.model, features) for k, f in best.items()}, features)
    rows.unpersist()
    return metrics, best


def choose_k(metrics: DataFrame, floor: float = K.SILHOUETTE_FLOOR,
             fallback: int = K.FALLBACK_K, metric: str = "silhouette") -> DataFrame:
    """First k with the maximum ``metric``; below ``floor`` (or none) -> fallback.

    ``metric``: ``silhouette`` (squared-Euclidean, against members) or ``centroid_silhouette`` (Euclidean, against centres).

    Returns (best_k, best_k_score, selected_k, selected_k_score).
    """
    best = metrics.agg(
        F.max_by(F.col("k"), F.struct(F.col(metric), -F.col("k"))).alias("best_k"),
        F.max(metric).alias("best_k_score"))
    sel = best.select(
        "best_k", "best_k_score",
        F.when(F.col("best_k").isNull() | (F.col("best_k_score") < F.lit(floor)),
               F.lit(fallback)).otherwise(F.col("best_k")).cast("int").alias("selected_k"))
    return (sel.join(metrics.select(F.col("k").alias("selected_k"),
                                    F.col(metric).alias("selected_k_score")),
                     "selected_k", "left")
            .select("best_k", "best_k_score", "selected_k", "selected_k_score"))

"""Quality metrics of many models over the same rows in two passes, whatever their number.

Tasks take the rows in blocks (``blocks``). The first pass assigns them under each model and sums by (k, cluster); the second
measures them against the clusters' members' means. What comes back is one row per model and cluster.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.operators.blocks import Blocks, block_sums, nearest_of, square_distances
from cohort.operators.metrics import Centroids

METRICS = "k int, inertia double, silhouette double, davies_bouldin double, centroid_silhouette double"


def centroid_silhouette(distances: np.ndarray) -> np.ndarray:
    """Rows' silhouettes by their distances to the centres (centres x rows): (b - a) / b for the nearest a and the next b; 0 for one centre."""
    if len(distances) < 2:
        return np.zeros(distances.shape[1])
    a, b = np.partition(distances, 1, axis=0)[:2]
    return np.divide(b - a, b, out=np.zeros_like(b), where=b > 0)


def _silhouette(near: np.ndarray, mean_d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows' silhouettes from their mean squared distances to the clusters' members (clusters x rows); singletons and equal distances 0."""
    if len(mean_d) < 2:
        return np.zeros(len(near))
    at = np.arange(len(near))
    size = n[near]
    a = mean_d[near, at] * size / np.maximum(size - 1.0, 1.0)
    others = mean_d.copy()
    others[near, at] = np.inf
    b = others.min(axis=0)
    most = np.maximum(a, b)
    return np.where(size > 1, np.divide(b - a, most, out=np.zeros_like(b), where=most > 0), 0.0)


def sweep_metrics(df: DataFrame | Blocks, models: dict[int, Centroids], features: list[str]) -> DataFrame:
    """(k, inertia, silhouette, davies_bouldin, centroid_silhouette), one row per model, rows assigned to their nearest centre.

    ``silhouette`` is the squared-Euclidean one against the clusters' members, ``centroid_silhouette`` the Euclidean one
    against the model's centres. A model with one used cluster has silhouette 0 and Davies-Bouldin infinite. ``df`` may be kept blocks.
    """
    spark = (df.rows if isinstance(df, Blocks) else df).sparkSession
    if not models:
        return spark.createDataFrame([], METRICS)
    ks, d = sorted(models), len(features)
    centres = [np.array(models[k].values)[np.argsort(models[k].ids)] for k in ks]  # ties go to the smallest id
    starts = np.cumsum([0, *map(len, centres)])
    rows = df if isinstance(df, Blocks) else df.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"))

    def first(x: np.ndarray):
        norm = (x * x).sum(axis=1)
        for at, c in zip(starts, centres, strict=False):
            d2 = square_distances(x, c)
            near, best = nearest_of(d2)
            own = (near == np.arange(len(c))[:, None]).astype("float64")
            sums = own @ np.column_stack([x, norm, best, centroid_silhouette(np.sqrt(d2))])
            for j, count in enumerate(own.sum(axis=1).astype("int64")):
                if count:
                    yield at + j, count, sums[j]

    n, s = block_sums(rows, int(starts[-1]), d + 3, first)
    if not n.any():
        return spark.createDataFrame([], METRICS)
    mean, spread = s[:, :d] / np.maximum(n, 1)[:, None], s[:, d] / np.maximum(n, 1)

    def second(x: np.ndarray):
        norm = (x * x).sum(axis=1)
        for at, c in zip(starts, centres, strict=False):
            used = np.flatnonzero(n[at:at + len(c)])
            near = np.searchsorted(used, nearest_of(square_distances(x, c))[0])
            mu, width = mean[at + used], spread[at + used][:, None]
            mean_d = norm - 2.0 * (mu @ x.T) + width
            mean_d[mean_d <= 1e-12 * (norm + width)] = 0.0  # rounding noise
            sil = _silhouette(near, mean_d, n[at + used].astype("float64"))
            off = x - mu[near]
            apart = np.sqrt((off * off).sum(axis=1))
            for j, g in enumerate(used):
                mine = near == j
                if mine.any():
                    yield at + g, int(mine.sum()), np.array([sil[mine].sum(), apart[mine].sum()])

    _, more = block_sums(rows, int(starts[-1]), 2, second)
    out = []
    for k, at, c in zip(ks, starts, centres, strict=False):
        used = at + np.flatnonzero(n[at:at + len(c)])
        total = int(n[used].sum())
        sil = more[used, 0].sum() / total if len(used) > 1 else 0.0
        out.append((k, float(s[used, d + 1].sum()), float(sil), _davies_bouldin(mean[used], more[used, 1] / n[used]), float(s[used, d + 2].sum() / total)))
    return spark.createDataFrame(out, METRICS)


def _davies_bouldin(points: np.ndarray, scatter: np.ndarray) -> float:
    """From the means and scatters of a model's clusters; zero separations count as infinite, flat data as 0."""
    if len(points) < 2:
        return float("inf")
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    if apart.max() <= 1e-8 or scatter.max() <= 1e-8:
        return 0.0
    ratio = np.divide(scatter[:, None] + scatter[None], apart, out=np.zeros_like(apart), where=apart > 0)
    return float(ratio.max(axis=1).mean())

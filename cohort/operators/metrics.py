"""Centroid geometry: assignment, distances, inertia, silhouette, Davies-Bouldin.

Centroids are k x d numbers that a fit has given, so the driver holds them. Up to
``LITERAL_CENTROIDS`` they travel as literals inside the projection: assigning rows
is a narrow map with no join and no shuffle. Beyond that they are data, so that the
plan doesn't grow with k: nearest centres come from ``search.nearest``, which takes tables
of centres of any size too, silhouette and Davies-Bouldin from the forms for array columns.
Per-cluster statistics are one ``groupBy(cluster)`` with map-side partial aggregation
(k groups), so even a cluster holding a third of all rows only ever ships
k partial buffers per task.

The silhouette here is the squared-Euclidean one in closed form
(per-cluster count, vector sum and sum of squared norms), O(n*k): exact,
pair-free, and the value ``pyspark.ml.evaluation.ClusteringEvaluator``
computes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort import contract as K
from cohort.functions.sums import exact_avg, exact_sum, long_means, long_sums
from cohort.functions.text import round_half_even

#: Up to this many centres are written into the plan, more are data; the results are the same.
LITERAL_CENTROIDS = 64


@dataclass(frozen=True)
class Centroids:
    ids: tuple[int, ...]
    features: tuple[str, ...]
    values: tuple[tuple[float, ...], ...]

    @property
    def k(self) -> int:
        return len(self.ids)

    @staticmethod
    def from_df(df: DataFrame, features: list[str], id_col: str = "cluster_id") -> "Centroids":
        """Collect a wide centroid table of a model (one row per cluster); a table that grows with the data stays one (``search.nearest``)."""
        rows = sorted(df.select(id_col, *features).collect(), key=lambda r: r[id_col])
        return Centroids(tuple(int(r[id_col]) for r in rows), tuple(features),
                         tuple(tuple(float(r[f]) for f in features) for r in rows))

    @staticmethod
    def from_model(model, features: list[str]) -> "Centroids":
        centers = model.clusterCenters()
        return Centroids(tuple(range(len(centers))), tuple(features),
                         tuple(tuple(float(v) for v in c) for c in centers))

    def vectors(self, spark: SparkSession) -> DataFrame:
        """Rows (cluster_id, v)."""
        return spark.createDataFrame([(i, list(v)) for i, v in zip(self.ids, self.values, strict=True)], "cluster_id int, v array<double>")

    def to_df(self, spark: SparkSession) -> DataFrame:
        """Long form (cluster_id, feature, value)."""
        schema = T.StructType([T.StructField("cluster_id", T.IntegerType()),
                               T.StructField("feature", T.StringType()),
                               T.StructField("value", T.DoubleType())])
        rows = [(i, f, v) for i, vec in zip(self.ids, self.values)
                for f, v in zip(self.features, vec)]
        return spark.createDataFrame(rows, schema)

    def to_wide_df(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([T.StructField("cluster_id", T.IntegerType())] +
                              [T.StructField(f, T.DoubleType()) for f in self.features])
        return spark.createDataFrame([(i, *vec) for i, vec in zip(self.ids, self.values)], schema)


def group_centroids(df: DataFrame, features: list[str], group_col: str) -> DataFrame:
    """Mean vector per group (one partial-aggregated pass): the fixed centroids."""
    rows = df.select(F.col(group_col).cast("int").alias("cluster_id"), *features)
    return long_means(rows, {f: F.col(f) for f in features}, ["cluster_id"]).drop("rows")


def _vec(features: list[str] | tuple[str, ...], vector_col: str | None, i: int) -> Column:
    if vector_col is not None:
        return F.col(vector_col).getItem(i).cast("double")
    return F.col(features[i]).cast("double")


def _array(features: tuple[str, ...], vector_col: str | None) -> Column:
    """A row's coordinates as one array of doubles."""
    if vector_col is not None:
        return F.transform(F.col(vector_col), lambda v: v.cast("double"))
    return F.array(*[F.col(f).cast("double") for f in features])


def sq_distance(c: Centroids, j: int, vector_col: str | None = None) -> Column:
    """Squared Euclidean distance to centroid j, summed in feature order.

    With ``vector_col`` (an array column) the sum is a higher-order
    ``zip_with`` + ``aggregate`` over a literal centre array, so the
    expression size does not grow with the dimension.
    """
    if vector_col is not None:
        centre = F.array(*[F.lit(float(v)) for v in c.values[j]])
        diffs = F.zip_with(F.col(vector_col), centre,
                           lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
        return F.aggregate(diffs, F.lit(0.0), lambda acc, t: acc + t)
    terms = [(_vec(c.features, vector_col, i) - F.lit(v)) ** 2
             for i, v in enumerate(c.values[j])]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def with_distances(df: DataFrame, c: Centroids, vector_col: str | None = None,
                   out: str = "distances") -> DataFrame:
    """Euclidean distances to every centroid, as an array in cluster-id order."""
    if c.k > LITERAL_CENTROIDS:
        every = c.vectors(df.sparkSession).agg(F.sort_array(F.collect_list(F.struct("cluster_id", "v"))).alias("all")).scalar()
        met = df.withColumns({"_centres": every, "_row": _array(c.features, vector_col)})
        return met.withColumn(out, F.transform("_centres", lambda k: F.sqrt(F.aggregate(
            F.zip_with("_row", k["v"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t)))).drop("_centres", "_row")
    return df.withColumn(out, F.array(*[F.sqrt(sq_distance(c, j, vector_col))
                                        for j in range(c.k)]))


def assign_nearest(df: DataFrame, c: Centroids, vector_col: str | None = None,
                   keep_distances: bool = False) -> DataFrame:
    """Nearest centroid (first id on ties) + squared and plain distance to it."""
    if c.k > LITERAL_CENTROIDS:
        from cohort.operators import search  # which builds on this module
        out = search.nearest(df, c.vectors(df.sparkSession), _array(c.features, vector_col))
        return with_distances(out, c, vector_col) if keep_distances else out
    pairs = F.array(*[F.struct(sq_distance(c, j, vector_col).alias("d2"),
                               F.lit(c.ids[j]).alias("id")) for j in range(c.k)])
    best = F.array_min(pairs)
    # coalesce: the id is never null, and saying so keeps Catalyst from
    # inferring (and pushing below this projection) is-not-null join filters
    out = (df.withColumn("_best", best)
           .withColumn("cluster_id", F.coalesce(F.col("_best.id"), F.lit(c.ids[0])).cast("int"))
           .withColumn("min_sq_dist", F.col("_best.d2"))
           .withColumn("min_dist", F.sqrt(F.col("_best.d2")))
           .drop("_best"))
    if keep_distances:
        out = with_distances(out, c, vector_col)
    return out


def centroid_distances_long(df: DataFrame, c: Centroids, id_col: str = "row_id",
                            vector_col: str | None = None) -> DataFrame:
    """One row per (row, centroid): k rows per input row."""
    d = with_distances(df.select(id_col, *(c.features if vector_col is None else [vector_col])),
                       c, vector_col)
    ids = F.array(*[F.lit(i) for i in c.ids]) if c.k <= LITERAL_CENTROIDS else (
        c.vectors(df.sparkSession).agg(F.sort_array(F.collect_list("cluster_id")).alias("ids")).scalar())
    return (d.select(id_col, F.arrays_zip(ids.alias("cluster_id"),
                                          F.col("distances").alias("distance")).alias("z"))
            .select(id_col, F.explode_outer("z").alias("z"))
            .select(id_col, F.col("z.cluster_id").cast("int").alias("cluster_id"),
                    F.col("z.distance").alias("distance")))


def inertia(assigned: DataFrame) -> DataFrame:
    """Sum of squared distances of rows to their own centroid."""
    return assigned.agg(exact_sum(F.col("min_sq_dist")).alias("inertia"))


def cluster_stats(df: DataFrame, features: list[str], cluster_col: str = "cluster_id") -> DataFrame:
    """Per cluster: n, per-feature sums, sum of squared norms (k rows)."""
    sq = None
    for f in features:
        t = F.col(f).cast("double") ** 2
        sq = t if sq is None else sq + t
    sums = long_sums(df.withColumn("cluster_id", F.col(cluster_col)), {**{f: F.col(f) for f in features}, "_psi": sq}, ["cluster_id"])
    return sums.select("cluster_id", F.col("rows").alias("n"), *[f"s_{f}" for f in features], F.col("s__psi").alias("psi"))


def silhouette_sq(df: DataFrame, features: list[str], cluster_col: str = "cluster_id") -> DataFrame:
    """Mean squared-Euclidean silhouette (singletons 0; one cluster -> 0).

    Per point x in cluster i: D_c(x) = |x|^2 - 2 x.Y_c/N_c + Psi_c/N_c;
    a = D_i * N_i/(N_i-1), b = min_{c != i} D_c, s = (b-a)/max(a,b).
    """
    spark = df.sparkSession
    stats = cluster_stats(df, features, cluster_col).limit(LITERAL_CENTROIDS + 1).collect()
    if len(stats) > LITERAL_CENTROIDS:  # the same closed form with the clusters as data
        return silhouette_sq_vector(df.select(_array(tuple(features), None).alias("x"), F.col(cluster_col).alias("c")), "x", "c")
    if len(stats) < 2:
        return spark.createDataFrame([(0.0,)], "silhouette double")
    norm = None
    for f in features:
        t = F.col(f).cast("double") ** 2
        norm = t if norm is None else norm + t
    cl = F.col(cluster_col)
    dexpr, sizes = {}, {}
    for r in stats:
        n = float(r["n"])
        dot = None
        for f in features:
            t = F.col(f).cast("double") * F.lit(r[f"s_{f}"] / n)
            dot = t if dot is None else dot + t
        dexpr[r["cluster_id"]] = clamped(norm - F.lit(2.0) * dot + F.lit(r["psi"] / n), norm + F.lit(r["psi"] / n))
        sizes[r["cluster_id"]] = n
    # per-cluster mean squared distances in their own projection (each is
    # read twice below, so Catalyst keeps the projection and codegen small)
    pre = df.select(cl.alias("_c"), *[d.alias(f"_d{i}") for i, d in enumerate(dexpr.values())])
    ids = list(dexpr)
    c = F.col("_c")
    own_d = own_n = None
    for i, cid in enumerate(ids):
        d = F.col(f"_d{i}")
        own_d = F.when(c == cid, d) if own_d is None else own_d.when(c == cid, d)
        nl = F.lit(sizes[cid])
        own_n = F.when(c == cid, nl) if own_n is None else own_n.when(c == cid, nl)
    b = F.least(*[F.when(c != cid, F.col(f"_d{i}")) for i, cid in enumerate(ids)])
    a = own_d * own_n / F.nullif(own_n - F.lit(1.0), F.lit(0.0))
    s = silhouette_of(own_n, a, b)
    return pre.select(s.alias("_s")).agg(exact_avg(F.col("_s")).alias("silhouette"))


def davies_bouldin(df: DataFrame, features: list[str], cluster_col: str = "cluster_id") -> DataFrame:
    """Davies-Bouldin index with centroids = member means (two passes over df).

    Zero centroid separations count as infinite (ratio 0); all-zero
    scatter or separation gives 0; one cluster gives +inf.
    """
    spark = df.sparkSession
    groups = group_centroids(df, features, cluster_col)
    if groups.limit(LITERAL_CENTROIDS + 1).count() > LITERAL_CENTROIDS:
        return davies_bouldin_vector(df.select(_array(tuple(features), None).alias("x"), F.col(cluster_col).alias("c")), "x", "c")
    cents = Centroids.from_df(groups, features)
    if cents.k < 2:
        return spark.createDataFrame([(float("inf"),)], "davies_bouldin double")
    cl = F.col(cluster_col)
    own = None
    for j, cid in enumerate(cents.ids):
        d = F.sqrt(sq_distance(cents, j))
        own = F.when(cl == cid, d) if own is None else own.when(cl == cid, d)
    # S_j for every cluster as one row (k columns) in the same pass.
    pre = df.select(cl.alias("_c"), own.alias("_own"))
    scatter = pre.groupBy("_c").agg(exact_avg(F.col("_own")).alias("_s"))
    one = scatter.agg(*[F.max(F.when(F.col("_c") == cid, F.col("_s"))).alias(f"S_{cid}") for cid in cents.ids])
    sep = {}
    for i in range(cents.k):
        for j in range(cents.k):
            sep[i, j] = sum((a - b) ** 2 for a, b in zip(cents.values[i], cents.values[j])) ** 0.5
    ratios = []
    for i, ci in enumerate(cents.ids):
        terms = [F.lit(0.0)]
        for j, cj in enumerate(cents.ids):
            if i != j and sep[i, j] > 0:
                terms.append((F.col(f"S_{ci}") + F.col(f"S_{cj}")) / F.lit(sep[i, j]))
        ratios.append(F.greatest(*terms) if len(terms) > 1 else terms[0])
    db = ratios[0]
    for r in ratios[1:]:
        db = db + r
    db = db / F.lit(float(cents.k))
    max_s = F.greatest(*[F.col(f"S_{c}") for c in cents.ids])
    flat = F.lit(max(sep.values()) <= 1e-8)
    return one.select(F.when(flat | (max_s <= F.lit(1e-8)), F.lit(0.0))
                      .otherwise(db).alias("davies_bouldin"))


def distinct_labels(df: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    return df.agg(F.count_distinct(F.col(cluster_col)).alias("distinct_labels"))


def confidence(distances: Column, assigned_index: Column) -> Column:
    """Closeness of the assigned centre relative to nearest/farthest, 30..95, 1 dp.

    ``assigned_index`` is the 1-based position of the assigned cluster in
    ``distances``; equal nearest and farthest give the flat value.
    """
    d_a = F.element_at(distances, assigned_index)
    d_min, d_max = F.array_min(distances), F.array_max(distances)
    raw = (F.lit(1.0) - (d_a - d_min) / (d_max - d_min)) * F.lit(100.0)
    clamped = F.greatest(F.lit(K.CONFIDENCE_MIN), F.least(F.lit(K.CONFIDENCE_MAX), raw))
    return F.when(d_max == d_min, F.lit(K.CONFIDENCE_FLAT)).otherwise(round_half_even(clamped, 1))


def margin(distances: Column) -> Column:
    """1 - d1/d2 for the two nearest centres (0 when they tie or k = 1)."""
    s = F.array_sort(distances)
    d1, d2 = F.element_at(s, 1), F.element_at(s, 2)
    return F.when((F.size(s) < 2) | (d2 <= 0), F.lit(0.0)).otherwise(F.lit(1.0) - d1 / d2)


# --------------------------------------------------------------------------- vector columns

def vector_centroids(df: DataFrame, vector_col: str, group_col: str) -> Centroids:
    """Mean vector per group for an array column: one vector sum per group and task; one row per group reaches the driver."""
    rows = sorted(_vector_stats(df, vector_col, group_col).collect(), key=lambda r: r["g"])
    dim = len(rows[0]["s"]) if rows else 0
    feats = tuple(f"{vector_col}[{i}]" for i in range(dim))
    return Centroids(tuple(r["g"] for r in rows), feats, tuple(tuple(v / r["n"] for v in r["s"]) for r in rows))


def _vector_stats(df: DataFrame, vector_col: str, group_col: str) -> DataFrame:
    """(g, n, s, psi): rows, vector sum and sum of squared norms of each group; rows without a group are left out."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    base = df.select(F.col(group_col).cast("int").alias("g"), x.alias("x")).where(F.col("g").isNotNull())
    norm = F.aggregate(F.transform("x", lambda v: v * v), F.lit(0.0), lambda a, b: a + b)
    summed = Summarizer.metrics("sum").summary(array_to_vector("x")).getField("sum")
    return base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), vector_to_array(summed).alias("s"), F.sum(norm).alias("psi"))


def _center_lookup(spark: SparkSession, centers: dict[int, list[float]]) -> DataFrame:
    """Groups and their mean vectors as a table (c, mu)."""
    return spark.createDataFrame([(c, m) for c, m in sorted(centers.items())], "c int, mu array<double>")


def silhouette_sq_vector(df: DataFrame, vector_col: str, cluster_col: str = "cluster_id") -> DataFrame:
    """Squared-Euclidean silhouette for an array column (same closed form), for any number of clusters.

    The clusters' sums come as one row each; every row then meets them as one array of structs (k x d numbers),
    so that the plan doesn't grow with k or d. Distances that are rounding noise count as 0.
    """
    spark = df.sparkSession
    stats = _vector_stats(df, vector_col, cluster_col)
    clusters = stats.agg(F.sort_array(F.collect_list(F.struct(
        F.col("g").alias("c"), F.col("n").cast("double").alias("n"),
        F.transform("s", lambda v: v / F.col("n")).alias("mu"), (F.col("psi") / F.col("n")).alias("spread")))).alias("all"))
    if stats.limit(2).count() < 2:
        return spark.createDataFrame([(0.0,)], "silhouette double")
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    base = df.select(F.col(cluster_col).cast("int").alias("_c"), x.alias("_x")).where(F.col("_c").isNotNull())
    norm = F.aggregate(F.transform("_x", lambda v: v * v), F.lit(0.0), lambda a, b: a + b)
    rows = base.withColumns({"_norm": norm, "all": clusters.scalar()})  # one value: the table of clusters

    def distance(k: Column) -> Column:
        dot = F.aggregate(F.zip_with("_x", k["mu"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return clamped(F.col("_norm") - F.lit(2.0) * dot + k["spread"], F.col("_norm") + k["spread"])

    rows = rows.withColumn("_d", F.transform("all", lambda k: F.struct(k["c"].alias("c"), k["n"].alias("n"), distance(k).alias("d"))))
    own = F.element_at(F.filter("_d", lambda k: k["c"] == F.col("_c")), 1)
    other = F.array_min(F.transform(F.filter("_d", lambda k: k["c"] != F.col("_c")), lambda k: k["d"]))
    pre = rows.select(own.alias("_own"), other.alias("_b"))
    n = F.col("_own.n")
    pre = pre.select(n.alias("_n"), (F.col("_own.d") * n / F.nullif(n - F.lit(1.0), F.lit(0.0))).alias("_a"), "_b")
    return pre.agg(F.avg(silhouette_of(F.col("_n"), F.col("_a"), F.col("_b"))).alias("silhouette"))


def clamped(distance: Column, scale: Column) -> Column:
    """A mean squared distance, 0 where it is rounding noise of numbers as large as scale."""
    return F.when(distance <= F.lit(1e-12) * scale, F.lit(0.0)).otherwise(distance)


def silhouette_of(n: Column, a: Column, b: Column) -> Column:
    """Silhouette of a row whose cluster has n rows, from its mean distances; equal distances, two zeros included, give 0."""
    return (F.when(n <= 1, F.lit(0.0)).when(a < b, F.lit(1.0) - a / b)
            .when(a > b, b / a - F.lit(1.0)).otherwise(F.lit(0.0)))


def davies_bouldin_vector(df: DataFrame, vector_col: str, cluster_col: str = "cluster_id") -> DataFrame:
    """Davies-Bouldin for an array column, centroids = member means; zero separations count as infinite, flat data as 0."""
    cents = vector_centroids(df, vector_col, cluster_col)
    spark = df.sparkSession
    if cents.k < 2:
        return spark.createDataFrame([(float("inf"),)], "davies_bouldin double")
    centers = _center_lookup(spark, {c: list(v) for c, v in zip(cents.ids, cents.values, strict=True)})
    near = df.select(F.col(cluster_col).cast("int").alias("c"), F.col(vector_col).alias("x")).join(centers, "c")
    square = F.aggregate(F.zip_with("x", "mu", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, b: a + b)
    spread = dict(near.groupBy("c").agg(F.avg(F.sqrt(square)).alias("s")).collect())  # one number per cluster
    points, s = np.array(cents.values), np.array([spread[c] for c in cents.ids])
    worst, widest = np.zeros(cents.k), 0.0
    for i in range(cents.k):
        apart = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        widest = max(widest, float(apart.max()))
        far = apart > 0
        worst[i] = ((s[i] + s[far]) / apart[far]).max() if far.any() else 0.0
    value = 0.0 if widest <= 1e-8 or s.max() <= 1e-8 else float(worst.mean())
    return spark.createDataFrame([(value,)], "davies_bouldin double")

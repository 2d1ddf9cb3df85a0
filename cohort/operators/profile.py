"""Cluster profiles, readiness score, labels and per-cluster text.

Profiles are ONE wide ``groupBy(cluster_id)`` per statistic family (map-side
partial aggregation, k groups), unpivoted afterwards on the k-row result.
Medians and quartiles are exact, by distributed selection of ranks
(``quantiles``): no group's values meet in one task (``approx=True`` switches
to ``percentile_approx``).
Ranking windows run over k rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort import contract as K
from cohort.functions.sums import exact_avg
from cohort.functions.text import fixed, round_half_even
from cohort.operators.quantiles import quantile_columns, value_stats


def _stack(df: DataFrame, keys: list[str], items: list[tuple[str, list[str]]],
           names: list[str], label: str = "feature") -> DataFrame:
    """Unpivot a wide per-group row: items = [(label value, [col per name])]."""
    parts = []
    for lab, cols in items:
        parts.append(f"'{lab}', " + ", ".join(f"`{c}`" for c in cols))
    expr = f"stack({len(items)}, {', '.join(parts)}) as ({label}, {', '.join(names)})"
    return df.selectExpr(*[f"`{k}`" for k in keys], expr)


def cluster_size(assigned: DataFrame, cluster_ids: list[int] | None = None,
                 cluster_col: str = "cluster_id") -> DataFrame:
    """(cluster_id, size, percentage); listed clusters with no rows get size 0."""
    counts = assigned.groupBy(F.col(cluster_col).cast("int").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("size"))
    if cluster_ids is not None:
        spark = assigned.sparkSession
        ids = spark.createDataFrame([(int(i),) for i in cluster_ids], "cluster_id int")
        counts = (ids.join(counts, "cluster_id", "left")
                  .select("cluster_id", F.coalesce("size", F.lit(0)).cast("long").alias("size")))
    total = F.sum("size").over(Window.partitionBy())
    return counts.select("cluster_id", "size",
                         (F.col("size") * F.lit(100.0) / total).alias("percentage"))


def cluster_means(assigned: DataFrame, features: list[str],
                  cluster_col: str = "cluster_id") -> DataFrame:
    """Wide (cluster_id, size, <feature means>) -- k rows.

    Means don't depend on the order of summation: features of at most one decimal are summed as decimals and
    divided once, the others (age, income) as limbs (``sums``) and settled to 9 decimals.
    """
    def mean(f: str):
        if f in K.FREE_DECIMALS:
            return F.round(exact_avg(F.col(f)), 9)
        return F.sum(F.col(f).cast("decimal(20,1)")).cast("double") / F.count(F.col(f))

    return assigned.groupBy(F.col(cluster_col).cast("int").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("size"), *[mean(f).alias(f) for f in features])


def profile_numeric(assigned: DataFrame, features: list[str], cluster_col: str = "cluster_id",
                    approx: bool = False) -> DataFrame:
    """(cluster_id, feature, mean, median, std_dev); std of one row is null."""
    rows = assigned.select(F.col(cluster_col).cast("int").alias("cluster_id"), *features)
    stats = value_stats(rows, features, ["cluster_id"])
    if approx:
        wide = rows.groupBy("cluster_id").agg(*[F.percentile_approx(F.col(f).cast("double"), 0.5, 100000).cast("double").alias(f) for f in features])
        medians = _stack(wide, ["cluster_id"], [(f, [f]) for f in features], ["median"])
    else:
        medians = quantile_columns(rows, features, {"median": 0.5}, ["cluster_id"], stats=stats)
    out = _beside(stats, medians, ["cluster_id", "feature"])
    return out.select("cluster_id", "feature", "mean", "median", F.col("std").alias("std_dev"))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe keys: a few rows per group and feature."""
    right = right.withColumnsRenamed({k: f"{k}__" for k in keys})
    return left.join(right, [left[k].eqNullSafe(right[f"{k}__"]) for k in keys], "left").drop(*[f"{k}__" for k in keys])


def profile_mode(assigned: DataFrame, columns: list[str],
                 cluster_col: str = "cluster_id") -> DataFrame:
    """(cluster_id, col, most_common, frequency): mode over non-null values,
    smallest value on ties; frequency = share of the whole cluster, in %."""
    # one pass: every (column, value) pair of a row from a single projection
    # (a union of per-column selects would re-run the upstream plan per column)
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    longv = assigned.select(F.col(cluster_col).cast("int").alias("cluster_id"),
                            F.explode_outer(pairs).alias("p")).select("cluster_id", "p.col", "p.value")
    counts = longv.groupBy("cluster_id", "col", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("cluster_id", "col").agg(F.sum("n").alias("size"))
    w = Window.partitionBy("cluster_id", "col").orderBy(F.col("n").desc(), F.col("value"))
    top = (counts.where(F.col("value").isNotNull())
           .withColumn("rk", F.row_number().over(w)).where("rk = 1"))
    return (top.join(sizes, ["cluster_id", "col"])
            .select("cluster_id", "col", F.col("value").alias("most_common"),
                    (F.col("n") * F.lit(100.0) / F.col("size")).alias("frequency")))


def feature_summary(df: DataFrame, features: list[str], approx: bool = False) -> DataFrame:
    """describe(): count, mean, std, min, 25/50/75 %, max and null count per feature."""
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    stats = value_stats(df, features)
    if approx:
        wide = df.agg(*[F.percentile_approx(F.col(f).cast("double"), p, 100000).cast("double").alias(f"{f}__{n}") for f in features for n, p in quartiles.items()])
        found = _stack(wide, [], [(f, [f"{f}__{n}" for n in quartiles]) for f in features], list(quartiles))
    else:
        found = quantile_columns(df, features, quartiles, stats=stats)
    return _beside(stats, found, ["feature"]).select("feature", F.col("n").alias("count"), "mean", "std", F.col("lo").alias("min"),
                                                     "p25", "p50", "p75", F.col("hi").alias("max"), "nulls")


def _rule(x: Column, op: str, threshold: float) -> Column:
    return {">=": x >= threshold, ">": x > threshold, "<=": x <= threshold}[op]


def score_expr(columns: list[str]) -> Column:
    """Readiness score from cluster means (absent or NaN/null mean adds 0)."""
    total = F.lit(0.0)
    for feature, rules in K.SCORE_RULES:
        if feature not in columns:
            continue
        x = F.col(feature)
        pts = None
        for op, thr, p in rules:
            cond = _rule(x, op, thr)
            pts = F.when(cond, F.lit(p)) if pts is None else pts.when(cond, F.lit(p))
        total = total + F.coalesce(pts.otherwise(F.lit(0.0)), F.lit(0.0))
    return total


def cluster_score(means: DataFrame) -> DataFrame:
    return means.select("cluster_id", score_expr(means.columns).alias("score"))


def label_expr(rank: Column, n: Column) -> Column:
    return (F.when(n == 1, F.lit(K.LABEL_SINGLE))
            .when(rank == 1, F.lit(K.LABEL_RELEASE))
            .when((n >= 3) & (rank == 2), F.lit(K.LABEL_MONITOR))
            .otherwise(F.lit(K.LABEL_INTENSIVE)))


def cluster_label(scores: DataFrame) -> DataFrame:
    """Rank by score desc (ties: lower id first) and name (k rows, one window)."""
    w = Window.orderBy(F.col("score").desc(), F.col("cluster_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return (scores.withColumn("rank", F.row_number().over(w)).withColumn("n", n)
            .select("cluster_id", "score", "rank", label_expr(F.col("rank"), F.col("n")).alias("label")))


def _fmt(prefix: str, x: Column, digits: int, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), fixed(x, digits), F.lit(suffix))


HIGHLIGHT_PARTS = [
    ("education_level", lambda x: _fmt("educação média=", x, 2)),
    ("income", lambda x: _fmt("renda média=R$ ", x, 2)),
    ("looking_for_job", lambda x: _fmt("busca emprego=", x * 100, 0, "%")),
    ("employment_signal", lambda x: _fmt("emprego sinal=", x, 2)),
    ("substance_dependency", lambda x: _fmt("dependência=", x * 100, 0, "%")),
    ("program_duration", lambda x: _fmt("tempo programa=", x, 1, "m")),
]


def cluster_highlights(means: DataFrame, limit: int = 4) -> DataFrame:
    """First ``limit`` available mean highlights, comma separated."""
    parts = [fn(F.col(f)) for f, fn in HIGHLIGHT_PARTS if f in means.columns]
    arr = F.filter(F.array(*[F.when(p.isNotNull(), p) for p in parts]), lambda x: x.isNotNull())
    return means.select("cluster_id", F.array_join(F.slice(arr, 1, limit), ", ").alias("highlights"))


def education_phrase(x: Column) -> Column:
    expr = None
    for op, thr, phrase in K.EDU_PHRASES:
        cond = _rule(x, op, thr)
        expr = F.when(cond, F.lit(phrase)) if expr is None else expr.when(cond, F.lit(phrase))
    return expr.otherwise(F.lit(K.EDU_PHRASE_NONE))


def pct1(x: Column) -> Column:
    """Proportion -> percent with one decimal."""
    return round_half_even(x * F.lit(100.0), 1)


def _ok(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def release_notes(means: DataFrame) -> DataFrame:
    """(cluster_id, position, note) -- reasons sentences for every cluster row."""
    cols = means.columns
    def m(f):  # noqa: E306
        return F.col(f).cast("double") if f in cols else F.lit(None).cast("double")
    inc, look, stud = m("income"), m("looking_for_job"), m("studying")
    emp, dur, edu = m("employment_signal"), m("program_duration"), m("education_level")
    notes = F.array(
        F.when(_ok(inc), _fmt("Renda média declarada de R$ ", inc, 2,
                              ", indicando alguma ocupação")),
        F.when(_ok(look) & _ok(stud), F.concat(
            pct1(look).cast("string"), F.lit("% buscando emprego e "),
            pct1(stud).cast("string"), F.lit("% estudando (sinais de engajamento)"))),
        F.when(_ok(emp), _fmt("Sinal de emprego médio ", emp, 2,
                              " (0=desempregado, 0.6=informal, 1=formal)")),
        F.when(_ok(dur), _fmt("Tempo médio no programa de ", dur, 1, " meses")),
        F.when(_ok(edu), _fmt("Escolaridade média ", edu, 2,
                              ", acima do grupo de Apoio Intensivo")),
    )
    kept = F.filter(notes, lambda x: x.isNotNull())
    kept = F.when(F.size(kept) == 0, F.array(F.lit(K.RELEASE_NOTES_FALLBACK))).otherwise(kept)
    return (means.select("cluster_id", F.posexplode_outer(kept).alias("position", "note"))
            .select("cluster_id", (F.col("position") + 1).alias("position"), "note"))


def cluster_summary_lines(means: DataFrame, labels: DataFrame) -> DataFrame:
    """Ten analytic lines per cluster: (cluster_id, line_no, text)."""
    cols = means.columns
    def m(f):  # noqa: E306
        return F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in cols else F.lit(0.0)
    j = means.join(F.broadcast(labels.select("cluster_id", "label")), "cluster_id", "left")
    label = F.coalesce(F.col("label"), F.concat(F.lit(K.LABEL_DEFAULT_PREFIX),
                                                F.col("cluster_id").cast("string")))
    j = j.withColumn("_pct", F.col("size") * F.lit(100.0) / F.sum("size").over(Window.partitionBy()))
    pct = F.col("_pct")
    p = lambda f: pct1(m(f)).cast("string")
    lines = F.array(
        F.concat(F.lit("[Cluster "), F.col("cluster_id").cast("string"), F.lit("] "), label),
        F.concat(F.lit("Tamanho: "), F.col("size").cast("string"), F.lit(" ("), fixed(pct, 1),
                 F.lit("%)")),
        _fmt("Idade média: ", m("age"), 1, " anos"),
        F.concat(_fmt("Escolaridade média: ", m("education_level"), 2, " → "),
                 education_phrase(m("education_level"))),
        F.concat(F.lit("Benefício social: "), p("family_benefit"), F.lit("% recebem Bolsa Família")),
        F.concat(F.lit("Estudando atualmente: "), p("studying"), F.lit("%")),
        F.concat(F.lit("Buscando emprego: "), p("looking_for_job"), F.lit("%")),
        F.concat(F.lit("Dependência química: "), p("substance_dependency"),
                 F.lit("% informaram uso")),
        _fmt("Renda média declarada: R$ ", m("income"), 2),
        _fmt("Tempo médio no programa: ", m("program_duration"), 1, " meses"),
    )
    return (j.select("cluster_id", F.posexplode_outer(lines).alias("line_no", "text"))
            .select("cluster_id", (F.col("line_no") + 1).alias("line_no"), "text"))

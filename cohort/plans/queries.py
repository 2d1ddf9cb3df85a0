"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query starts from the driver tables (mostly the ``intake`` view over
``orders``) and runs over the whole table.  Clustering-shaped operators that
the SQL oracle must check use *fixed centroids*: the mean standardised
vector of each education level (a deterministic grouping of the data).
Computed doubles are rounded (4-6 dp) and ``+ 0.0`` normalises -0.0, so the
value hash is engine independent.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort import contract as K
from cohort.functions import cells as C
from cohort.functions import encode as E
from cohort.functions import text as TX
from cohort.operators import features as FE
from cohort.operators import gates as G
from cohort.operators import metrics as M
from cohort.operators import profile as P
from cohort.operators import score as S
from cohort.operators import summary as SU
from cohort.operators.kmeans import choose_k
from cohort.operators.sweep import sweep_metrics
from cohort.plans.intake import AS_OF, intake, to_sheet

FEATS = K.FEATURE_NAMES


def R(c: Column | str, d: int = 6) -> Column:
    """Round and normalise negative zero."""
    return F.round(TX.col(c).cast("double"), d) + F.lit(0.0)


# --------------------------------------------------------------------------- building blocks

def raw(spark: SparkSession, sf: str) -> DataFrame:
    return intake(spark, sf)


def features(spark: SparkSession, sf: str) -> DataFrame:
    return FE.feature_matrix(raw(spark, sf), AS_OF)


def fitted(spark: SparkSession, sf: str):
    """(feature matrix with grp, scaler, standardised z with grp)."""
    # read by the scaler pass, the centre pass and the output: encode once
    fm = features(spark, sf).withColumn("grp", F.col("education_level")).persist(StorageLevel.MEMORY_AND_DISK)
    scaler = FE.scaler_fit(fm, FEATS)
    z = FE.standardize(fm, scaler, keep=["row_id", "grp"])
    return fm, scaler, z


def fixed_centroids(z: DataFrame) -> M.Centroids:
    """Fixed centres: mean standardised vector per education level."""
    return M.Centroids.from_df(M.group_centroids(z, FEATS, "grp"), FEATS)


def assigned(spark: SparkSession, sf: str):
    """(fm, scaler, z assigned to fixed centres, centroids)."""
    fm, scaler, z = fitted(spark, sf)
    cents = fixed_centroids(z)
    return fm, scaler, M.assign_nearest(z, cents), cents


ZF = [f"{f}__z" for f in FEATS]


def fixed_fit(spark: SparkSession, sf: str) -> tuple[DataFrame, FE.Scaler, M.Centroids]:
    """(persisted feature matrix, scaler, fixed centres of the z features)."""
    fm, scaler, z = fitted(spark, sf)
    cents = fixed_centroids(z)
    return fm, scaler, M.Centroids(cents.ids, tuple(ZF), cents.values)


def features_assigned(spark: SparkSession, sf: str) -> tuple[DataFrame, M.Centroids]:
    """Raw features + z features + nearest fixed cluster, one row per person, from the persisted feature matrix."""
    fm, scaler, zc = fixed_fit(spark, sf)
    return M.assign_nearest(FE.standardize(fm, scaler, keep=fm.columns, suffix="__z"), zc), zc


def raw_assigned(spark: SparkSession, sf: str) -> tuple[DataFrame, M.Centroids]:
    """Raw cells + raw features + z features + nearest fixed cluster, one row per person.

    Raw cells and raw features ride along the standardisation as extra
    columns of the same projection (no self-join on row_id). Only the features are
    persisted, for the passes that fit; the cells, many times their size, are read and encoded by the pass that gives them out.
    """
    _, scaler, zc = fixed_fit(spark, sf)
    r = raw(spark, sf)
    fm = FE.feature_matrix(r, AS_OF, keep=r.columns).withColumn("grp", F.col("education_level"))
    z = FE.standardize(fm, scaler, keep=fm.columns, suffix="__z")
    return M.assign_nearest(z, zc, keep_distances=True), zc


def labels_of(a: DataFrame) -> DataFrame:
    """(cluster_id, score, rank, label) from raw-feature means per cluster."""
    return P.cluster_label(P.cluster_score(P.cluster_means(a, FEATS)))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Score every row against the fixed centres with learned labels."""
    a, zc = raw_assigned(spark, sf)
    labs = S.collect_labels(labels_of(features_assigned(spark, sf)[0]))  # k rows -> literals: no join
    ids = F.array(*[F.lit(i) for i in zc.ids])
    out = (a.withColumn("confidence", M.confidence(F.col("distances"),
                                                   F.array_position(ids, F.col("cluster_id")).cast("int")))
           .withColumn("margin", M.margin(F.col("distances"))))
    out = S.label_lookup(out, labs)
    return out.withColumn("risk_level", S.risk_level(F.col("classification")))


# --------------------------------------------------------------------------- F: cell functions

def q_normalize_text(spark, sf):
    r = raw(spark, sf)
    return r.select("row_id", TX.normalize_text("grau_escolaridade").alias("education_key"),
                    TX.normalize_text("estado_civil").alias("civil_key"))


def q_collapse_ws(spark, sf):
    r = raw(spark, sf)
    return r.select("row_id", TX.collapse_ws("estado_civil").alias("civil"),
                    TX.collapse_ws("bolsa_familia").alias("benefit"))


def q_coerce_number(spark, sf):
    return raw(spark, sf).select("row_id", E.coerce_number("idade").alias("age"))


def q_marital_one_hot(spark, sf):
    r = raw(spark, sf)
    return r.select("row_id", E.marital_single("estado_civil").alias("marital_status_single"),
                    E.marital_married("estado_civil").alias("marital_status_married"))


def q_parse_binary(spark, sf):
    r = raw(spark, sf)
    return r.select("row_id", E.parse_binary("bolsa_familia").alias("family_benefit"),
                    E.parse_binary("procurando_trabalho").alias("looking_for_job"))


def q_encode_education(spark, sf):
    return raw(spark, sf).select("row_id", E.encode_education("grau_escolaridade").alias("education_level"))


def q_parse_money(spark, sf):
    return raw(spark, sf).select("row_id", R(E.parse_money("remuneracao")).alias("income"))


def q_studying_flag(spark, sf):
    return raw(spark, sf).select("row_id", E.studying_flag("situacao_escolar").alias("studying"))


def q_employment_signal(spark, sf):
    return raw(spark, sf).select("row_id", E.employment_signal("situacao_trabalho").alias("employment_signal"))


def q_substance_flag(spark, sf):
    return raw(spark, sf).select("row_id", E.substance_flag("uso_drogas").alias("substance_dependency"))


def q_program_duration(spark, sf):
    return raw(spark, sf).select("row_id", E.program_duration("data_cadastro", AS_OF).alias("program_duration"))


def q_feature_matrix(spark, sf):
    fm = features(spark, sf)
    return fm.select("row_id", *[R(f).alias(f) if f == "income" else F.col(f) for f in FEATS])


def q_unrecognised_values(spark, sf):
    return G.unrecognised_values(raw(spark, sf))


def q_scaler_fit(spark, sf):
    st = FE.scaler_stats(features(spark, sf), FEATS)
    return st.select("feature", R("mean").alias("mean"), R("std").alias("std"), R("scale").alias("scale"))


def q_standardize(spark, sf):
    _, _, z = fitted(spark, sf)
    return z.select("row_id", *[R(f, 5).alias(f) for f in FEATS])


def q_weighted_features(spark, sf):
    fm = features(spark, sf)
    sc = FE.scaler_fit(fm, FEATS)
    z = FE.standardize(fm, sc, keep=["row_id"], weights=K.FEATURE_WEIGHTS)
    return z.select("row_id", *[R(f, 5).alias(f) for f in FEATS])


# --------------------------------------------------------------------------- P: gates

def q_has_meaningful_data(spark, sf):
    r = raw(spark, sf)
    return G.has_meaningful_data(r, [c for c in r.columns if c != "row_id"])


def q_drop_empty_rows(spark, sf):
    r = raw(spark, sf)
    return G.drop_empty_rows(r, [c for c in r.columns if c != "row_id"]).select("row_id")


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """The intake sheet with faults: no civil status, blank dates, every 50th row without a cell, a sheet number on every third."""
    r = raw(spark, sf).drop("estado_civil").withColumns({"data_cadastro": F.lit("  "), "id_atendido": F.when(F.col("row_id") % 3 == 0, F.col("row_id").cast("string"))})
    none = F.col("row_id") % 50 == 0
    return r.select("row_id", *[F.when(~none, F.col(c)).alias(c) for c in r.columns if c != "row_id"])


def q_empty_rows_dropped(spark, sf):
    r = gappy(spark, sf)
    return G.drop_empty_rows(r, [c for c in r.columns if c != "row_id"]).select("row_id")


def q_meaningful_by_sheet(spark, sf):
    """A sheet with data, and the same sheet with every cell blank or a word for nothing."""
    r = raw(spark, sf).drop("row_id")
    blank = r.select(*[F.when(F.col(c).isNull(), F.lit("nan")).otherwise(F.lit(" \t")).alias(c) for c in r.columns])
    return G.has_meaningful_data(r).select(F.lit("intake").alias("sheet"), "has_data").unionByName(G.has_meaningful_data(blank).select(F.lit("blank").alias("sheet"), "has_data"))


def q_required_columns(spark, sf):
    return G.required_columns(to_sheet(raw(spark, sf)))


def q_identifier_detect(spark, sf):
    return G.identifier_detect(to_sheet(raw(spark, sf)))


def q_identifier_pick(spark, sf):
    return G.identifier_pick(to_sheet(raw(spark, sf)))


def q_identifier_projection(spark, sf):
    sheet = to_sheet(raw(spark, sf))
    out = G.identifier_projection(sheet)
    return out.select("row_id", F.col("Nome").alias("nome"), F.col("CPF").alias("cpf"))


def q_case_number(spark, sf):
    return G.case_number(raw(spark, sf).select("row_id")).select("row_id", "case_no")


def q_feature_contract(spark, sf):
    """Scoring a sheet without the civil-status and date columns."""
    r = raw(spark, sf).drop("estado_civil", "data_cadastro")
    fm = FE.feature_matrix(r, AS_OF)
    return G.feature_contract_df(fm, FEATS)


# --------------------------------------------------------------------------- C: centroid metrics

def q_nearest_centroid(spark, sf):
    _, _, a, _ = assigned(spark, sf)
    return a.select("row_id", "cluster_id", R("min_dist").alias("min_dist"))


def q_centroid_distances(spark, sf):
    _, _, z = fitted(spark, sf)
    d = M.centroid_distances_long(z, fixed_centroids(z))
    return d.select("row_id", "cluster_id", R("distance").alias("distance"))


def q_inertia(spark, sf):
    _, _, a, _ = assigned(spark, sf)
    return M.inertia(a).select(R("inertia", 4).alias("inertia"))


def q_silhouette_sq(spark, sf):
    _, _, a, _ = assigned(spark, sf)
    return M.silhouette_sq(a, FEATS).select(R("silhouette").alias("silhouette"))


def q_davies_bouldin(spark, sf):
    _, _, a, _ = assigned(spark, sf)
    return M.davies_bouldin(a, FEATS).select(R("davies_bouldin").alias("davies_bouldin"))


def q_distinct_labels(spark, sf):
    _, _, a, _ = assigned(spark, sf)
    return M.distinct_labels(a)


def fixed_sweep(spark, sf) -> DataFrame:
    """k = 2..4: nearest of the first k fixed centres; metrics per k."""
    _, _, z = fitted(spark, sf)
    cents = fixed_centroids(z)
    return sweep_metrics(z, {k: M.Centroids(cents.ids[:k], cents.features, cents.values[:k]) for k in range(2, cents.k + 1)}, FEATS)


def q_k_sweep_fixed(spark, sf):
    m = fixed_sweep(spark, sf)
    return m.select("k", R("inertia", 4).alias("inertia"), R("silhouette").alias("silhouette"),
                    R("davies_bouldin").alias("davies_bouldin"))


def q_centroid_silhouette(spark, sf):
    """Silhouette by distances to the centres, and the k that it chooses."""
    m = fixed_sweep(spark, sf)
    c = choose_k(m, metric="centroid_silhouette")
    chosen = c.select(F.col("best_k").alias("k"), F.lit(True).alias("best"))
    return m.select("k", R("centroid_silhouette").alias("centroid_silhouette")).join(chosen, "k", "left").withColumn("best", F.coalesce("best", F.lit(False)))


def q_choose_k(spark, sf):
    c = choose_k(fixed_sweep(spark, sf))
    return c.select("best_k", R("best_k_score").alias("best_k_score"), "selected_k",
                    R("selected_k_score").alias("selected_k_score"))


def q_confidence(spark, sf):
    _, _, z = fitted(spark, sf)
    cents = fixed_centroids(z)
    a = M.with_distances(M.assign_nearest(z, cents), cents)
    ids = F.array(*[F.lit(i) for i in cents.ids])
    return a.select(
        "row_id", "cluster_id", F.col("grp").cast("int").alias("assigned"),
        R(M.confidence(F.col("distances"), F.array_position(ids, F.col("grp")).cast("int")), 4)
        .alias("confidence_assigned"),
        R(M.confidence(F.col("distances"), F.array_position(ids, F.col("cluster_id")).cast("int")), 4)
        .alias("confidence_nearest"),
        R(M.margin(F.col("distances"))).alias("margin"))


# --------------------------------------------------------------------------- A: profiles

def q_cluster_size(spark, sf):
    a, zc = features_assigned(spark, sf)
    return P.cluster_size(a, list(zc.ids)).select("cluster_id", "size", R("percentage").alias("percentage"))


def q_cluster_size_listed(spark, sf):
    """Ten listed clusters, most of them without rows."""
    _, _, a, _ = assigned(spark, sf)
    return P.cluster_size(a, list(range(10))).select("cluster_id", "size", R("percentage").alias("percentage"))


def q_profile_numeric(spark, sf):
    a, _ = features_assigned(spark, sf)
    p = P.profile_numeric(a, FEATS)
    return p.select("cluster_id", "feature", R("mean").alias("mean"), R("median").alias("median"),
                    R("std_dev").alias("std_dev"))


def q_profile_mode(spark, sf):
    a, _ = raw_assigned(spark, sf)
    p = P.profile_mode(a, ["estado_civil", "situacao_trabalho"])
    return p.select("cluster_id", "col", "most_common", R("frequency").alias("frequency"))


def q_feature_summary(spark, sf):
    s = P.feature_summary(features(spark, sf), FEATS)
    return s.select("feature", "count", *[R(c).alias(c) for c in
                                          ["mean", "std", "min", "p25", "p50", "p75", "max"]], "nulls")


def q_cluster_score(spark, sf):
    a, _ = features_assigned(spark, sf)
    return P.cluster_score(P.cluster_means(a, FEATS)).select("cluster_id", R("score").alias("score"))


def q_cluster_label(spark, sf):
    a, _ = features_assigned(spark, sf)
    return labels_of(a).select("cluster_id", R("score").alias("score"), "rank", "label")


def q_cluster_highlights(spark, sf):
    a, _ = features_assigned(spark, sf)
    return P.cluster_highlights(P.cluster_means(a, FEATS))


def q_education_phrase(spark, sf):
    a, _ = features_assigned(spark, sf)
    m = P.cluster_means(a, FEATS)
    return m.select("cluster_id", R("education_level").alias("education_mean"),
                    P.education_phrase(F.col("education_level")).alias("phrase"))


def q_release_notes(spark, sf):
    a, _ = features_assigned(spark, sf)
    m = P.cluster_means(a, FEATS)
    rel = labels_of(a).where(F.col("label") == K.LABEL_RELEASE).select("cluster_id")
    return P.release_notes(m.join(rel, "cluster_id", "left_semi"))


def q_cluster_summary_lines(spark, sf):
    a, _ = features_assigned(spark, sf)
    return P.cluster_summary_lines(P.cluster_means(a, FEATS), labels_of(a))


# --------------------------------------------------------------------------- W/J: scoring

def q_label_lookup(spark, sf):
    return scored(spark, sf).select("row_id", "cluster_id", "classification")


def q_risk_level(spark, sf):
    return scored(spark, sf).select("row_id", "classification", "risk_level")


def q_score_rows(spark, sf):
    s = scored(spark, sf)
    return s.select("row_id", "cluster_id", "classification", R("confidence", 4).alias("confidence"),
                    R("margin").alias("margin"), "risk_level")


def q_label_distribution(spark, sf):
    d = SU.label_distribution(scored(spark, sf))
    return d.select("label", "count", R("percentage").alias("percentage"))


def q_risk_distribution(spark, sf):
    d = SU.risk_distribution(scored(spark, sf))
    return d.select("label", "count", R("percentage").alias("percentage"))


def q_confidence_summary(spark, sf):
    d = SU.confidence_summary(scored(spark, sf))
    return d.select("total", R("average_confidence", 4).alias("average_confidence"))


def q_fixed_domain_distribution(spark, sf):
    s = scored(spark, sf).select("classification", "risk_level").persist(StorageLevel.MEMORY_AND_DISK)  # all that is counted
    a = SU.fixed_domain_distribution(s, "classification", K.EMITTED_LABELS).select(
        F.lit("classification").alias("kind"), "*")
    b = SU.fixed_domain_distribution(s, "risk_level", K.TEXT_SINK_RISKS).select(
        F.lit("risk").alias("kind"), "*")
    return a.unionByName(b).select("kind", "position", "label", "count",
                                   R("percentage").alias("percentage"))


def report_table(spark, sf) -> DataFrame:
    s = G.case_number(scored(spark, sf), "row_id")
    return S.report_rows(s, ["nome", "cpf"])


def q_report_rows(spark, sf):
    rep = report_table(spark, sf)
    return rep.select(F.col("ID").alias("id"), "nome", "cpf",
                      F.col("Classificação").alias("classificacao"),
                      F.col("Confiança").alias("confianca"),
                      F.col("Nível_de_Risco").alias("nivel_de_risco"),
                      F.col("Cluster_ID").alias("cluster_id"))


# --------------------------------------------------------------------------- R: report cells

def q_mask_identifier(spark, sf):
    r = raw(spark, sf)
    return r.select("row_id", C.mask_identifier("Nome", "nome").alias("nome_text"),
                    C.mask_identifier("CPF", "cpf").alias("cpf_text"))


def q_clean_text(spark, sf):
    r = raw(spark, sf)
    return r.select("row_id", TX.clean_text("idade", K.NOT_INFORMED).alias("idade"),
                    TX.clean_text("uso_drogas", K.NOT_INFORMED).alias("uso_drogas"),
                    TX.clean_text("estado_civil").alias("estado_civil"))


def q_format_confidence(spark, sf):
    s = scored(spark, sf)
    return s.select("row_id",
                    C.format_confidence((F.col("confidence") / 100).cast("string")).alias("from_fraction"),
                    C.format_confidence(F.concat(F.col("confidence").cast("string"), F.lit(" %")))
                    .alias("from_text"))


def q_dependency_info(spark, sf):
    r = raw(spark, sf)
    d = C.dependency_info("uso_drogas")
    return r.select("row_id", d.getField("flag").alias("dependency_flag"),
                    d.getField("text").alias("dependency_text"))


def q_format_currency(spark, sf):
    return raw(spark, sf).select("row_id", C.format_currency("remuneracao").alias("income_text"))


def q_yes_no(spark, sf):
    r = raw(spark, sf)
    return r.select("row_id", C.yes_no("procurando_trabalho").alias("job_search"),
                    C.yes_no("bolsa_familia").alias("family_benefit"))


def _rec(df: DataFrame) -> dict[str, Column]:
    return {k: F.col(k) for k in K.REQUIRED_HEADERS if k in df.columns}


def q_observed_factors(spark, sf):
    r = raw(spark, sf)
    arr = C.observed_factors(_rec(r), C.dependency_info("uso_drogas"))
    return (r.select("row_id", F.posexplode_outer(arr).alias("position", "factor"))
            .select("row_id", (F.col("position") + 1).alias("position"), "factor"))


def q_action_plan(spark, sf):
    s = scored(spark, sf)
    dep = C.dependency_info("uso_drogas").getField("flag")
    arr = C.action_plan(F.col("classification"), F.col("risk_level"), dep, _rec(s))
    return (s.select("row_id", F.posexplode_outer(arr).alias("position", "action"))
            .select("row_id", (F.col("position") + 1).alias("position"), "action"))


def q_record_attributes(spark, sf):
    r = raw(spark, sf)
    return (r.select("row_id", F.explode_outer(C.record_attributes(_rec(r))).alias("a"))
            .where(F.col("a").isNotNull())
            .select("row_id", "a.position", "a.attribute", "a.value"))


# --------------------------------------------------------------------------- L/U

def q_first_n_overview(spark, sf, n: int = 25):
    rep = report_table(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)  # top-n and count
    ident = F.array_join(F.filter(F.array(C.mask_identifier("Nome", "nome"),
                                          C.mask_identifier("CPF", "cpf")),
                                  lambda x: x != ""), " | ")
    ident = F.when(ident == "", F.concat(F.lit("Registro "), F.col("ID").cast("string"))).otherwise(ident)
    line = F.concat(F.lit("- "), ident, F.lit(" -> Grupo: "), F.col("Classificação"),
                    F.lit(" | Risco: "), F.col("Nível_de_Risco"), F.lit(" | Confiança: "),
                    F.col("Confiança"))
    top = SU.first_n(rep.select("ID", "Classificação", line.alias("line")), n, "ID")
    ins = S.insight_catalogue(spark)
    top = S.insight_lookup(top, ins, "Classificação")
    remark = F.coalesce(F.try_element_at(F.col("details"), F.lit(1)), F.col("summary"))
    omitted = SU.omitted_count(rep, n).first()[0]
    return top.select(F.col("ID").alias("id"), "line", remark.alias("remark"),
                      F.lit(omitted).cast("long").alias("omitted"))


def q_first_bullets(spark, sf):
    s = scored(spark, sf)
    ins = S.insight_catalogue(spark)
    seen = s.select(F.col("classification").alias("label")).distinct()
    fb = S.first_bullets(ins.join(seen, "label", "left_semi"))
    return (fb.select("label", "remark", F.posexplode_outer("bullets").alias("position", "bullet"))
            .select("label", "remark", (F.col("position") + 1).alias("position"), "bullet"))


def q_dedupe_labels(spark, sf):
    s = scored(spark, sf)
    return SU.dedupe_in_order(s, "classification", "row_id").select("position", F.col("value").alias("label"))


def q_observed_insights(spark, sf):
    return S.observed_insights(scored(spark, sf), S.insight_catalogue(spark))


def q_insight_lookup(spark, sf):
    s = S.insight_lookup(scored(spark, sf), S.insight_catalogue(spark))
    return s.select("row_id", "classification", "summary", F.size("details").alias("n_details"))


QUERIES = {name[2:]: fn for name, fn in list(globals().items())
           if name.startswith("q_") and callable(fn)}

"""Registered queries, part 2: real k-means, customer and embedding geometry,
sources and sinks (round trips through shared storage), report tables."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort import contract as K
from cohort.functions import cells as C
from cohort.operators import features as FE
from cohort.operators import gates as G
from cohort.operators import kmeans as KM
from cohort.operators import metrics as M
from cohort.operators import profile as P
from cohort.operators import reports as RP
from cohort.operators import score as S
from cohort.operators.kmeans import choose_k
from cohort.operators.observe import land_observed
from cohort.operators.search import nearest
from cohort.plans import jobs
from cohort.plans.customers import CUSTOMER_FEATURES, customer_features
from cohort.plans.intake import AS_OF, ensure_parallelism, intake, intake_from_orders, read_table, shares, to_sheet
from cohort.plans.queries import FEATS, R, features_assigned, fixed_sweep, gappy, labels_of, report_table
from cohort.session import checkpoint_dir
from cohort.sources import positions as PO
from cohort.sources import records as RE
from cohort.sources import scan as SC

PAR = K.N_INIT


def scratch(spark: SparkSession, name: str) -> str:
    """Fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# --------------------------------------------------------------------------- C2/C3/C10/J0 (rows-only)

def _standardised(rows: DataFrame, features: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, persisted: the scaler and the fits read them; their standardised vectors, a projection)."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    z = FE.standardize(rows, FE.scaler_fit(rows, features), keep=[key])
    return rows, KM.vectors_of(z, features, keep=[key])


def _intake_rows(spark, sf):
    return _standardised(FE.feature_matrix(intake(spark, sf), AS_OF), FEATS, "row_id")


def _intake_vectors(spark, sf):
    return _intake_rows(spark, sf)[1]


def _customer_rows(spark, sf):
    cf = customer_features(spark, sf).select("c_custkey", *CUSTOMER_FEATURES)
    return _standardised(cf, CUSTOMER_FEATURES, "c_custkey")


def q_kmeans_fit(spark, sf):
    v = _intake_vectors(spark, sf)
    fit = KM.kmeans_fit(v, 3, parallelism=PAR)
    return M.Centroids.from_model(fit.model, FEATS).to_df(spark).select(
        "cluster_id", "feature", R("value", 4).alias("value"))


def q_kmeans_restarts(spark, sf):
    v = _intake_vectors(spark, sf)
    fits = KM.kmeans_restarts(v, 3, parallelism=PAR)
    return spark.createDataFrame([(f.seed, f.cost) for f in fits], "seed int, cost double")


def _facts(name: str, rows: DataFrame, features: list[str], fit) -> tuple:
    """What holds for any k-means fit: sizes add up, centres are their members' means, within + between = total.

    One row per cluster and a few sums come to the driver.
    """
    centres = M.Centroids.from_model(fit.model, features)
    a = M.assign_nearest(rows, centres)
    means = {r["cluster_id"]: r for r in a.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), *[F.avg(f).alias(f) for f in features]).collect()}
    grand = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in features]).first()
    own = M.Centroids(tuple(means), tuple(features), tuple(tuple(r[f] for f in features) for r in means.values()))
    square = F.coalesce(*[F.when(F.col("cluster_id") == c, M.sq_distance(own, i)) for i, c in enumerate(own.ids)])
    within = a.agg(F.sum(square)).first()[0]
    between = sum(r["size"] * sum((r[f] - grand[f]) ** 2 for f in features) for r in means.values())
    off = max(abs(means[c][f] - v) for c, vec in zip(centres.ids, centres.values, strict=True) for f, v in zip(features, vec, strict=True))
    return name, grand["n"], len(means), sum(r["size"] for r in means.values()) == grand["n"], off < 0.1, float(within + between)


def q_kmeans_facts(spark, sf):
    """Facts of the fits on the intake sheet and on the customers, which don't depend on the seeds."""
    kept, v = _intake_rows(spark, sf)
    kept_too, w = _customer_rows(spark, sf)
    found = [_facts("intake", v, FEATS, KM.kmeans_fit(v, 3, n_init=3, parallelism=PAR)), _facts("customer", w, CUSTOMER_FEATURES, KM.kmeans_fit(w, 4, n_init=3, parallelism=PAR))]
    kept.unpersist()
    kept_too.unpersist()
    out = spark.createDataFrame(found, "data string, n long, k int, sizes_add_up boolean, centres_are_means boolean, total double")
    return out.withColumn("total", R("total", 2))


def q_train_facts(spark, sf):
    """Facts of a training job and of its saved and reloaded model."""
    cells = intake(spark, sf)
    model, rows = jobs.train(cells, n_init=2, parallelism=PAR)
    path = scratch(spark, "model")
    jobs.save(model, spark, path)
    back = jobs.load(spark, path)
    sizes = rows.groupBy("cluster_id").count()
    chosen = {r[0]: r[2] for r in back.sweep}
    seen = (back.total_records, len(back.centroids.features), [r[0] for r in back.sweep], back.best_k_score == max(chosen.values()) == chosen[back.best_k],
            back.centroids == model.centroids and back.scaler == model.scaler and back.labels == model.labels, sizes.agg(F.sum("count")).first()[0], sizes.count() == back.selected_k)
    rows.unpersist()
    return spark.createDataFrame([seen], "total_records long, n_features int, ks array<int>, best_is_highest boolean, same_after_reload boolean, assigned long, every_cluster_used boolean").withColumn(
        "ks", F.array_join("ks", ","))


def _profile(spark, sf, key: str) -> DataFrame:
    """(key, mean quantity, price in thousands, discount and tax in percent) of a part's or a supplier's lines."""
    li = read_table(spark, sf, "lineitem")
    means = [F.avg(F.col(c).cast("double") * by).alias(c) for c, by in (("l_quantity", 1.0), ("l_extendedprice", 0.001), ("l_discount", 100.0), ("l_tax", 100.0))]
    return li.groupBy(key).agg(*means).select(key, F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("v"))


def q_nearest_supplier(spark, sf):
    """For each part, the supplier with the nearest profile of lines, its lead on the next one and the farthest; suppliers grow with the data."""
    parts, suppliers = _profile(spark, sf, "l_partkey"), _profile(spark, sf, "l_suppkey")
    found = nearest(parts, suppliers, F.col("v"), id_col="l_suppkey", facts=True)
    return found.select("l_partkey", F.col("cluster_id").alias("l_suppkey"), R("min_dist").alias("min_dist"), R("max_dist").alias("max_dist"), R("margin").alias("margin"))


def q_nearest_supplier_joined(spark, sf):
    """The same by the way that carries no centres: joins of rows and blocks."""
    parts, suppliers = _profile(spark, sf, "l_partkey"), _profile(spark, sf, "l_suppkey")
    found = nearest(parts, suppliers, F.col("v"), id_col="l_suppkey", carried_bytes=0)
    return found.select("l_partkey", F.col("cluster_id").alias("l_suppkey"), R("min_dist").alias("min_dist"))


def q_k_sweep(spark, sf):
    v = _intake_vectors(spark, sf)
    metrics, _ = KM.k_sweep(v, FEATS, KM.k_range(v.count()), parallelism=PAR)
    return metrics


def q_train_job(spark, sf):
    model, assigned = jobs.train(intake(spark, sf), parallelism=PAR)
    sizes = P.cluster_size(assigned, list(model.centroids.ids))
    return model.labels_df(spark).join(sizes, "cluster_id").select(
        "cluster_id", "score", "label", "size", R("percentage", 4).alias("percentage"))


def q_model_roundtrip(spark, sf):
    cells = intake(spark, sf)
    model, _ = jobs.train(cells, parallelism=PAR)
    path = scratch(spark, "model")
    jobs.save(model, spark, path)
    loaded = jobs.load(spark, path)
    out = jobs.score(cells, loaded, keep=["row_id"])
    return out.select("row_id", "cluster_id", "classification", R("confidence", 1).alias("confidence"),
                      "risk_level")


# --------------------------------------------------------------------------- customers

def _customers_assigned(spark, sf):
    cf = customer_features(spark, sf).withColumn("grp", F.col("c_nationkey"))
    sc = FE.scaler_fit(cf, CUSTOMER_FEATURES)
    z = FE.standardize(cf, sc, keep=cf.columns, suffix="__z")
    zf = [f"{f}__z" for f in CUSTOMER_FEATURES]
    cents = M.Centroids.from_df(M.group_centroids(z, zf, "grp"), zf)
    return M.assign_nearest(z, cents), cents, zf


def q_customer_features(spark, sf):
    cf = customer_features(spark, sf)
    return cf.select("c_custkey", "c_mktsegment", R("c_acctbal", 4).alias("c_acctbal"), "n_orders",
                     R("spend", 4).alias("spend"), R("avg_discount", 10).alias("avg_discount"),
                     "days_since_last")


def q_customer_nearest_nation(spark, sf):
    a, _, _ = _customers_assigned(spark, sf)
    return a.select("c_custkey", F.col("c_nationkey").alias("nation"),
                    F.col("cluster_id").alias("nearest"), R("min_dist").alias("distance"))


def q_customer_profile(spark, sf):
    a, _, _ = _customers_assigned(spark, sf)
    p = P.profile_numeric(a, CUSTOMER_FEATURES)
    return p.select("cluster_id", "feature", R("mean").alias("mean"), R("median").alias("median"),
                    R("std_dev").alias("std_dev"))


def q_customer_silhouette_sq(spark, sf):
    a, _, zf = _customers_assigned(spark, sf)
    return M.silhouette_sq(a, zf).select(R("silhouette").alias("silhouette"))


def q_customer_kmeans(spark, sf):
    _, v = _customer_rows(spark, sf)
    fit = KM.kmeans_fit(v, 5, parallelism=PAR)
    a = M.assign_nearest(v, M.Centroids.from_model(fit.model, CUSTOMER_FEATURES))
    return P.cluster_size(a, list(range(5))).select("cluster_id", "size",
                                                    R("percentage", 4).alias("percentage"))


# --------------------------------------------------------------------------- embeddings

def _emb(spark, sf):
    return read_table(spark, sf, "embeddings")


def q_embedding_nearest_centroid(spark, sf):
    e = _emb(spark, sf)
    cents = M.vector_centroids(e, "embedding", "label")
    a = M.assign_nearest(e, cents, vector_col="embedding")
    return a.select("vec_id", "label", F.col("cluster_id").alias("nearest"), R("min_dist").alias("distance"))


def q_embedding_silhouette_sq(spark, sf):
    e = _emb(spark, sf)
    return M.silhouette_sq_vector(e, "embedding", "label").select(R("silhouette").alias("silhouette"))


def q_embedding_davies_bouldin(spark, sf):
    e = _emb(spark, sf)
    return M.davies_bouldin_vector(e, "embedding", "label").select(R("davies_bouldin").alias("davies_bouldin"))


def q_embedding_kmeans(spark, sf):
    from pyspark.ml.functions import array_to_vector
    e = _emb(spark, sf).select("vec_id", array_to_vector("embedding").alias("features")).cache()
    fit = KM.kmeans_fit(e, 10, parallelism=PAR)
    pred = fit.model.transform(e)
    return P.cluster_size(pred.withColumnRenamed("_pred", "cluster_id"), list(range(10))).select(
        "cluster_id", "size", R("percentage", 4).alias("percentage"))


# --------------------------------------------------------------------------- S1-S4, S9 round trips

SHEET_ORDER = ["row_id", "nome", "cpf", "idade", "estado_civil", "bolsa_familia", "grau_escolaridade",
               "situacao_escolar", "situacao_trabalho", "remuneracao", "procurando_trabalho",
               "uso_drogas", "data_cadastro"]
VARIANTS = [("utf8_comma", ",", "UTF-8"), ("latin1_semicolon", ";", "ISO-8859-1"),
            ("utf8_tab", "\t", "UTF-8")]


def _cells_out(df: DataFrame) -> DataFrame:
    return df.select(F.col("row_id").cast("long").alias("row_id"), *SHEET_ORDER[1:])


def q_scan_csv_probe(spark, sf):
    sheet = to_sheet(intake(spark, sf).select(*SHEET_ORDER))
    base = scratch(spark, "scan")
    parts = []
    for name, sep, enc in VARIANTS:
        SC.write_delimited(sheet, f"{base}/{name}", sep=sep, encoding=enc)
        paths = [f"{base}/{name}"]
        fmt = SC.probe(spark, paths[0])
        got = G.resolve_headers(SC.read_delimited(spark, paths, fmt))
        parts.append(_cells_out(got).select(F.lit(name).alias("variant"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _quoted(c):
    v = F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))


def q_scan_bad_lines(spark, sf):
    """Lines of urgent orders carry one field too many (dropped); lines of
    low-priority orders miss their last three fields (padded with nulls)."""
    orders = ensure_parallelism(read_table(spark, sf, "orders"))
    sheet = to_sheet(intake_from_orders(orders, extra=["o_orderpriority"]).select(
        *SHEET_ORDER, "o_orderpriority"))
    headers = [c for c in sheet.columns if c != "o_orderpriority"]
    fields = [_quoted(F.col(f"`{h}`")) for h in headers]
    pr = F.col("o_orderpriority")
    line = (F.when(pr == "1-URGENT", F.concat_ws(",", *fields, F.lit("extra")))
            .when(pr == "5-LOW", F.concat_ws(",", *fields[:-3]))
            .otherwise(F.concat_ws(",", *fields)))
    # every task writes files of its own, each with the header line first
    parts = shares(orders)
    head = spark.range(parts).select(F.col("id").alias("part"), F.lit(0).alias("k"), F.lit(",".join(headers)).alias("value"))
    body = sheet.select(F.pmod(F.xxhash64(line), F.lit(parts)).alias("part"), F.lit(1).alias("k"), line.alias("value"))
    path = scratch(spark, "badlines")
    head.unionByName(body).repartition(parts, "part").sortWithinPartitions("part", "k").select("part", "value").write.partitionBy("part").text(path)
    return _cells_out(G.resolve_headers(SC.read_many(spark, f"{path}/*")))


def q_scan_mixed_folder(spark, sf):
    """One read of a folder whose files differ in encoding, separator and order of columns; some UTF-8 names hold a
    real U+FFFD, which a Latin-1 file can't."""
    r = intake(spark, sf).select(*SHEET_ORDER)
    marked = F.concat("nome", F.lit("\ufffd é"))
    base = scratch(spark, "mixed")
    for k, (name, sep, enc) in enumerate(VARIANTS):
        part = r.where(F.col("row_id") % 3 == k)
        part = part if enc == "ISO-8859-1" else part.withColumn("nome", F.when(F.col("row_id") % 5 == 0, marked).otherwise(F.col("nome")))
        SC.write_delimited(to_sheet(part.select(*(SHEET_ORDER if k < 2 else SHEET_ORDER[::-1]))), f"{base}/{name}", sep=sep, encoding=enc)
    return _cells_out(G.resolve_headers(SC.read_many(spark, f"{base}/*")))


def q_scan_quoted_newlines(spark, sf):
    """Names over several lines, with quotes and separators in them, in files that are cut into several splits."""
    broken = F.concat(F.lit('"'), "nome", F.lit('",\n\n'), F.col("row_id").cast("string"), F.lit(';\nfim "'))
    r = intake(spark, sf).select(*SHEET_ORDER).withColumn("nome", F.when(F.col("row_id") % 4 == 1, broken).otherwise(F.col("nome")))
    path = scratch(spark, "newlines")
    SC.write_delimited(to_sheet(r), path)
    return _cells_out(G.resolve_headers(SC.read_many(spark, path)))


def q_sheet_positions(spark, sf):
    """Two independent reads of one sheet, joined by position in the input."""
    sheet = to_sheet(intake(spark, sf).select(*SHEET_ORDER))
    path = scratch(spark, "positions")
    SC.write_delimited(sheet.repartitionByRange("row_id").sortWithinPartitions("row_id"), path)

    def read():
        return PO.sheet_positions(G.resolve_headers(RE.read_sheets(spark, path, places=True)))

    other = read().select("position", F.col("row_id").cast("long").alias("other_id"), F.col("cpf").alias("other_cpf"))
    met = read().join(other, "position")
    return met.select("position", F.col("row_id").cast("long").alias("row_id"), "cpf", "other_id", "other_cpf")


def q_file_positions(spark, sf):
    """Parquet rows by file and row in the file."""
    return PO.file_positions(spark, f"{sf.rstrip('/')}/orders.parquet", ["o_orderkey"])


def q_null_tokens(spark, sf):
    """Reader NA tokens -> null; urgent orders' ages are given as NA tokens."""
    orders = read_table(spark, sf, "orders")
    r = intake_from_orders(orders, extra=["o_orderpriority"])
    toks = ["NA", "N/A", "null", "NaN", "None", "#N/A", "nan", "<NA>"]
    tok = F.element_at(F.array(*[F.lit(t) for t in toks]),
                       (F.col("row_id") % len(toks) + 1).cast("int"))
    r = r.withColumn("idade", F.when(F.col("o_orderpriority") == "1-URGENT", tok).otherwise(F.col("idade")))
    from cohort.functions.text import null_tokens
    return r.select("row_id", *[null_tokens(F.col(c)).alias(c) for c in SHEET_ORDER[1:]])


def q_land_canonical(spark, sf):
    sheet = intake(spark, sf).select(*SHEET_ORDER)
    base = scratch(spark, "land")
    first = SC.land(sheet, base, "intake")
    second = SC.land(sheet, base, "intake")
    a = spark.read.parquet(first).select(F.lit(first.rsplit("/", 1)[1]).alias("copy"), "*")
    b = spark.read.parquet(second).select(F.lit(second.rsplit("/", 1)[1]).alias("copy"), "*")
    return a.unionByName(b)


def q_landing_gates(spark, sf):
    """All gates of a faulty sheet, counted while it is landed; the landed copy is read back for its rows."""
    folder, gates = land_observed(to_sheet(gappy(spark, sf)), scratch(spark, "gates"), "intake")
    landed = spark.read.parquet(folder).count()
    rows = [("rows", "landed", 0, landed), ("rows", "seen", 1, gates.rows), ("rows", "empty", 2, gates.empty_rows)]
    rows += [("required", text, i, gates.filled.get(key, 0)) for i, (key, text) in enumerate(K.REQUIRED_HEADERS.items())]
    rows += [("missing", text, i, 0) for i, text in enumerate(gates.missing_headers())]
    rows += [("identifier", text, i, 0) for i, text in enumerate(gates.identifiers())]
    rows += [("contract", f"{feature}: {text}", i, 0) for i, (feature, text) in enumerate(gates.missing_features(FEATS))]
    rows += [("unrecognised", name, i, n) for i, (name, n) in enumerate(sorted(gates.unrecognised.items()))]
    return spark.createDataFrame(rows, "gate string, name string, position int, n long")


REPORT_ASCII = [("ID", "id"), ("nome", "nome"), ("cpf", "cpf"), ("Classificação", "classificacao"),
                ("Confiança", "confianca"), ("Nível_de_Risco", "nivel_de_risco"), ("Cluster_ID", "cluster_id")]


def q_predictions_csv(spark, sf):
    rep = report_table(spark, sf)
    path = scratch(spark, "predictions")
    SC.write_delimited(rep, path, sep=",", encoding="UTF-8")
    fmt = SC.probe(spark, path)
    back = SC.read_delimited(spark, path, fmt)
    return back.select(*[(F.col(f"`{src}`").cast("long") if src == "ID" else
                          F.col(f"`{src}`").cast("int") if src == "Cluster_ID" else F.col(f"`{src}`"))
                         .alias(dst) for src, dst in REPORT_ASCII])


# --------------------------------------------------------------------------- S6, R9, S7, S8, J5

def _metadata(spark, sf) -> DataFrame:
    """Training metadata derived from the data (fixed-centre sweep choice)."""
    choice = choose_k(fixed_sweep(spark, sf)).first()
    orders = read_table(spark, sf, "orders")
    stats = orders.agg(F.count(F.lit(1)).alias("n"),
                       F.date_format(F.max("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss").alias("ts")).first()
    meta = {"training_datetime": stats["ts"], "source_file": f"{sf}/orders.parquet",
            "total_records": int(stats["n"]), "selected_k": int(choice["selected_k"]),
            "silhouette_score": choice["selected_k_score"], "best_k": int(choice["best_k"]),
            "best_k_score": choice["best_k_score"], "feature_names": FEATS,
            "model_path": "model/centroids", "scaler_path": "model/scaler", "as_of": str(AS_OF)}
    return jobs.metadata_df(spark, meta)


def q_metadata_json(spark, sf):
    path = scratch(spark, "meta")
    _metadata(spark, sf).coalesce(1).write.json(path)
    md = spark.read.schema(jobs.METADATA_SCHEMA).json(path)
    return md.select("training_datetime", "total_records", "selected_k",
                     R("silhouette_score").alias("silhouette_score"),
                     F.size("feature_names").alias("n_features"))


def q_metadata_lines(spark, sf):
    return RP.metadata_lines(_metadata(spark, sf))


def _summaries_and_notes(spark, sf):
    a, _ = features_assigned(spark, sf)
    labs = labels_of(a)
    sizes = P.cluster_size(a)
    summ = sizes.join(labs.select("cluster_id", "label"), "cluster_id")
    means = P.cluster_means(a, FEATS)
    rel = labs.where(F.col("label") == K.LABEL_RELEASE).select("cluster_id")
    notes = P.release_notes(means.join(rel, "cluster_id", "left_semi")).select("position", "note")
    return summ, notes


def _report_lines(spark, sf, metadata: DataFrame | None = None) -> DataFrame:
    summ, notes = _summaries_and_notes(spark, sf)
    return RP.training_report_lines(metadata or _metadata(spark, sf), summ, notes)


def q_training_report_lines(spark, sf):
    return RP.number_lines(_report_lines(spark, sf))


def _parsed(spark, sf, metadata: DataFrame | None = None) -> DataFrame:
    path = scratch(spark, "report")
    RP.write_lines(_report_lines(spark, sf, metadata), path)
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return RP.parse_training_report(text)


def q_training_report_parse(spark, sf):
    p = _parsed(spark, sf)
    return (p.select("label", "training_summary", F.posexplode_outer("training_details").alias("position", "detail"))
            .select("label", "training_summary", (F.col("position") + 1).alias("position"), "detail"))


def q_insight_merge(spark, sf):
    m = S.insight_merge(S.insight_catalogue(spark), _parsed(spark, sf))
    return m.select("label", "summary", "training_summary",
                    _size0("details").alias("n_details"),
                    _size0("training_details").alias("n_training_details"))


def q_record_report_training(spark, sf):
    """Training context, notes and model section of every record's report."""
    from cohort.plans.queries import scored
    metadata = _metadata(spark, sf)  # one row, measured once for both parts
    lines = [r["text"] for r in RP.metadata_lines(metadata).orderBy("position").collect()]  # four at most
    return RP.training_block(scored(spark, sf), _parsed(spark, sf, metadata), lines)


def _size0(c: str):
    """Array size with null -> 0 (independent of the legacy size-of-null flag)."""
    return F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c))


# --------------------------------------------------------------------------- S10, S12

def q_predictions_text(spark, sf):
    rep = report_table(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)  # read by 4 sections
    ts = read_table(spark, sf, "orders").agg(
        F.date_format(F.max("o_orderdate"), "dd/MM/yyyy HH:mm:ss")).first()[0]
    return RP.predictions_text(rep, ["nome", "cpf"], ts)


def q_record_report_lines(spark, sf):
    from cohort.plans.queries import scored
    s = scored(spark, sf)
    rec = {k: F.col(k) for k in K.REQUIRED_HEADERS if k in s.columns}
    dep = C.dependency_info("uso_drogas")
    obs = C.observed_factors(rec, dep)
    act = C.action_plan(F.col("classification"), F.col("risk_level"), dep.getField("flag"), rec)
    return RP.record_block(s, [("Nome", "nome"), ("CPF", "cpf")], S.insight_catalogue(spark), obs, act)




# --------------------------------------------------------------------------- streaming

def fixed_model(spark, sf) -> jobs.Model:
    """Frozen model with the fixed (education-level) centres and their labels."""
    from cohort.plans.queries import fitted, fixed_centroids
    _, scaler, z = fitted(spark, sf)
    cents = fixed_centroids(z)
    a, _ = features_assigned(spark, sf)
    labs = [(int(r["cluster_id"]), float(r["score"]), r["label"]) for r in labels_of(a).collect()]
    return jobs.Model(scaler, cents, labs, [], 0, None, 0, None, 0, str(AS_OF))


def q_stream_score(spark, sf):
    """Sheets landed as Parquet are scored by a Structured Streaming query
    (availableNow trigger, checkpoint + sink in shared storage)."""
    from cohort.streaming.score_stream import start_scoring
    model = fixed_model(spark, sf)
    base = scratch(spark, "stream")
    sheet = intake(spark, sf).select(*SHEET_ORDER)
    sheet.write.parquet(f"{base}/in")
    q = start_scoring(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", model,
                      sheet.schema, keep=["row_id"])
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select("row_id", "cluster_id", "classification", R("confidence", 4).alias("confidence"),
                      R("margin").alias("margin"), "risk_level")


QUERIES = {name[2:]: fn for name, fn in list(globals().items())
           if name.startswith("q_") and callable(fn)}


def q_batch_report_lines(spark, sf):
    from cohort.plans.queries import scored
    # read by ~7 branches (stats, distributions, order of appearance, top-n): persist once
    s = G.case_number(scored(spark, sf), "row_id", out="ID").select("ID", "classification", "risk_level", "confidence", "nome", "cpf", "idade", "situacao_trabalho",
                                                                    "remuneracao", "procurando_trabalho", "situacao_escolar", "bolsa_familia").persist(StorageLevel.MEMORY_AND_DISK)
    return RP.batch_report_lines(s, [("nome", "nome"), ("cpf", "cpf")], S.insight_catalogue(spark),
                                 _metadata(spark, sf))


QUERIES["batch_report_lines"] = q_batch_report_lines

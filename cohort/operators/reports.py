"""Report tables as line DataFrames, and the training-report parser.

A report is a DataFrame of ``(section, ordinal, text)`` rows: sections are
built independently (k-row summaries, per-record blocks) and unioned, so a
per-record report over n rows is a projection + explode over n rows, never
a string assembled on the driver.  ``write_lines`` orders and writes text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohort import contract as K
from cohort.functions.cells import masked_value
from cohort.functions.text import clean_text, fixed, once, strip_u

RULE60 = "=" * 60
DASH70 = "-" * 70


def _lines(spark: SparkSession, section: int, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(section, i, t) for i, t in enumerate(texts)],
                                 "section int, ordinal int, text string")


def _numbered(df: DataFrame, section: int, text: Column, order: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), order.cast("int").alias("ordinal"),
                     text.alias("text"))


def union_lines(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def number_lines(lines: DataFrame) -> DataFrame:
    """(line_no, text) for a SMALL report (summary-sized: one window)."""
    w = Window.orderBy("section", "ordinal")
    return lines.select(F.row_number().over(w).alias("line_no"), "text")


def write_lines(lines: DataFrame, path: str, key_cols: list[str] | None = None) -> None:
    """Write a line table as text, ordered by (keys..., section, ordinal)."""
    keys = key_cols or []
    (lines.repartitionByRange(*keys, "section", "ordinal") if keys else lines.coalesce(1)) \
        .sortWithinPartitions(*keys, "section", "ordinal").select("text") \
        .write.mode("errorifexists").text(path)


# --------------------------------------------------------------------------- S7

def training_report_lines(metadata: DataFrame, summaries: DataFrame, notes: DataFrame) -> DataFrame:
    """Training report: metadata block, one line per cluster, release reasons.

    ``metadata``: one row (total_records, selected_k, feature_names, model_path,
    scaler_path); ``summaries``: (cluster_id, label, size, percentage);
    ``notes``: (position, note) -- may be empty.
    """
    spark = metadata.sparkSession
    nd = lambda c: F.coalesce(c.cast("string"), F.lit("N/D"))
    head = metadata.select(F.array(
        F.lit(K.RULE), F.lit("  TRAINING RESULTS ABOVE - USE FOR REFERENCE TO UNDERSTAND THE MODEL"),
        F.lit(K.RULE), F.lit(""), F.lit("📊 Resumo:"),
        F.concat(F.lit("  Registros treinados: "), nd(F.col("total_records"))),
        F.concat(F.lit("  Features utilizadas: "),
                 F.when(F.col("feature_names").isNull(), F.lit(0))
                 .otherwise(F.size("feature_names")).cast("string")),
        F.concat(F.lit("  Número de clusters: "), nd(F.col("selected_k"))),
        F.concat(F.lit("  Modelo salvo em: "), nd(F.col("model_path"))),
        F.concat(F.lit("  Scaler salvo em: "), nd(F.col("scaler_path"))),
        F.lit(""), F.lit("🎯 Perfis descobertos:")).alias("a"))
    head = head.select(F.posexplode("a").alias("ordinal", "text")).select(
        F.lit(0).alias("section"), F.col("ordinal").cast("int"), "text")
    size_t = F.when(F.col("size").isNull(), F.lit("N/D")).otherwise(F.col("size").cast("long").cast("string"))
    pct_t = F.when(F.col("percentage").isNull(), F.lit("N/D")).otherwise(
        F.concat(fixed(F.col("percentage"), 1), F.lit("%")))
    clusters = _numbered(summaries, 1, F.concat(F.lit("  "), F.coalesce(F.col("label"), F.lit("Cluster")),
                                                F.lit(": "), size_t, F.lit(" pessoas ("), pct_t,
                                                F.lit(")")), F.col("cluster_id"))
    has_notes = notes.limit(1).select(F.lit(1).alias("x"))
    notes_head = has_notes.select(F.explode(F.array(
        F.struct(F.lit(0).alias("o"), F.lit("").alias("t")),
        F.struct(F.lit(1).alias("o"), F.lit(K.RELEASE_NOTES_HEADER).alias("t")))).alias("s")) \
        .select(F.lit(2).alias("section"), F.col("s.o").cast("int").alias("ordinal"), F.col("s.t").alias("text"))
    bullets = _numbered(notes, 3, F.concat(F.lit("  • "), F.col("note")), F.col("position"))
    tail = _lines(spark, 4, ["", K.RULE])
    return union_lines(head, clusters, notes_head, bullets, tail)


# --------------------------------------------------------------------------- S8

def parse_training_report(text_df: DataFrame, file_col: str = "path", text_col: str = "value") -> DataFrame:
    """Parse report text (one row per file): (label, training_summary, training_details).

    Label lines: stripped lines starting with the release or intensive label
    plus ':' (case-insensitive; last one wins).  Details: the '•' bullets
    after the release-reasons marker, up to the first non-bullet text line;
    the last marker section that has bullets wins.
    """
    lines = text_df.select(F.col(file_col).alias("file"),
                           F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", strip_u(F.regexp_replace("raw", "\r$", "")))
    low = F.lower(F.col("line"))
    rel = (low.startswith(K.LABEL_RELEASE.lower() + ":") | low.startswith("possivel liberacao:"))
    inten = low.startswith(K.LABEL_INTENSIVE.lower() + ":")
    summ = (lines.where(rel | inten)
            .select("file", "pos", "line",
                    F.when(rel, F.lit(K.LABEL_RELEASE)).otherwise(F.lit(K.LABEL_INTENSIVE)).alias("label"))
            .groupBy("file", "label").agg(F.max_by("line", "pos").alias("training_summary")))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn(
        "sec", F.max(F.when(F.col("line").contains(K.RELEASE_NOTES_MARKER), F.col("pos"))).over(w))
    is_bullet = F.col("line").startswith("•")
    stop = (F.col("line") != "") & ~is_bullet & (F.col("pos") > F.col("sec"))
    marked = marked.withColumn(
        "stopped", F.max(F.when(stop, F.lit(1)).otherwise(F.lit(0))).over(
            Window.partitionBy("file", "sec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    bl = marked.where(F.col("sec").isNotNull() & (F.col("pos") > F.col("sec")) & is_bullet &
                      (F.col("stopped") == 0))
    bl = bl.withColumn("detail", F.regexp_replace("line", "^[• ]+", ""))
    per_sec = bl.groupBy("file", "sec").agg(
        F.sort_array(F.collect_list(F.struct("pos", "detail"))).alias("items"))
    last = per_sec.groupBy("file").agg(F.max_by("items", "sec").alias("items"))
    details = last.select("file", F.lit(K.LABEL_RELEASE).alias("label"),
                          F.transform("items", lambda s: s["detail"]).alias("training_details"))
    return (summ.join(details, ["file", "label"], "full_outer")
            .select("label", "training_summary", "training_details"))


# --------------------------------------------------------------------------- R9

def metadata_lines(metadata: DataFrame) -> DataFrame:
    """Display lines of training metadata: (position, text); absent fields omitted."""
    raw = F.col("training_datetime")
    cleaned = F.regexp_replace(strip_u(raw), "Z$", "+00:00")
    ts = F.try_to_timestamp(cleaned)
    when_line = F.when(raw.isNotNull() & (strip_u(raw) != ""), F.concat(
        F.lit("Treinamento executado em "),
        F.coalesce(F.date_format(ts, "dd/MM/yyyy HH:mm"), raw)))
    arr = F.array(
        when_line,
        F.when(F.col("total_records").isNotNull(), F.concat(
            F.lit("Registros usados no treinamento: "), F.col("total_records").cast("long").cast("string"))),
        F.when(F.col("selected_k").isNotNull(), F.concat(
            F.lit("Clusters configurados: "), F.col("selected_k").cast("long").cast("string"))),
        F.when(F.col("silhouette_score").isNotNull(), F.concat(
            F.lit("Silhouette aproximado: "), fixed(F.col("silhouette_score"), 3))),
    )
    kept = F.filter(arr, lambda x: x.isNotNull())
    return (metadata.select(F.posexplode_outer(kept).alias("position", "text"))
            .where(F.col("text").isNotNull())
            .select((F.col("position") + 1).alias("position"), "text"))


# --------------------------------------------------------------------------- S10

def _pad_left(text: Column, width: int) -> Column:
    return F.format_string(f"%{width}s", text)


def predictions_text(report: DataFrame, id_columns: list[str], generated_at: str) -> DataFrame:
    """Text sink lines: (case_no, section, ordinal, text); header/summary use case_no 0,
    the technical note uses a case_no after the last case."""
    spark = report.sparkSession
    total = report.agg(F.count(F.lit(1)).alias("n"))

    def dist(col: str, domain: list[str], fmt) -> DataFrame:
        counts = report.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("c"))
        dom = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], "o int, label string")
        allc = counts.unionByName(dom.select("label", F.lit(0).cast("long").alias("c")))
        allc = allc.groupBy("label").agg(F.sum("c").alias("c"))
        allc = allc.withColumn("n", F.sum("c").over(Window.partitionBy()))
        d = allc.join(F.broadcast(dom), "label")
        pct = F.when(F.col("n") > 0, F.col("c") * F.lit(100.0) / F.col("n")).otherwise(F.lit(0.0))
        return d.select("o", fmt(F.col("label"), F.format_string("%4d", F.col("c")),
                                 _pad_left(fixed(pct, 1), 5)).alias("text"))

    cls = dist("Classificação", K.EMITTED_LABELS,
               lambda lab, c, p: F.concat(F.lit("  "), F.format_string("%-20s", lab), F.lit(": "), c,
                                          F.lit(" ("), p, F.lit("%)")))
    rsk = dist("Nível_de_Risco", K.TEXT_SINK_RISKS,
               lambda lab, c, p: F.concat(F.lit("  Risco "), F.format_string("%-15s", lab), F.lit(": "), c,
                                          F.lit(" ("), p, F.lit("%)")))
    head = total.select(F.array(
        F.lit(K.RULE), F.lit("RELATÓRIO DE ANÁLISE DE PRONTIDÃO"),
        F.lit("Sistema Inteligente de Apoio à Decisão"), F.lit(K.RULE),
        F.lit(f"Data/Hora: {generated_at}"),
        F.concat(F.lit("Total de casos analisados: "), F.col("n").cast("string")),
        F.lit(K.RULE), F.lit(""), F.lit("RESUMO GERAL"), F.lit(DASH70), F.lit(""),
        F.lit("Classificação:")).alias("a")) \
        .select(F.posexplode("a").alias("ordinal", "text"))
    mid = _lines(spark, 2, ["", "Nível de Risco:"])
    after = _lines(spark, 4, [DASH70, "", "DETALHAMENTO POR CASO", K.RULE, ""])
    front = union_lines(
        head.select(F.lit(0).alias("section"), F.col("ordinal").cast("int"), "text"),
        cls.select(F.lit(1).alias("section"), F.col("o").cast("int").alias("ordinal"), "text"),
        mid,
        rsk.select(F.lit(3).alias("section"), F.col("o").cast("int").alias("ordinal"), "text"),
        after).select(F.lit(0).cast("long").alias("case_no"), "*")
    ident = [F.concat(F.lit(f"  {c}: "), F.coalesce(masked_value(c, c), F.lit("nan")))
             for c in id_columns]
    block = F.array(F.concat(F.lit("Caso #"), F.format_string("%03d", F.col("ID"))), *ident,
                    F.concat(F.lit("  Classificação: "), F.col("Classificação")),
                    F.concat(F.lit("  Confiança: "), F.col("Confiança")),
                    F.concat(F.lit("  Nível de Risco: "), F.col("Nível_de_Risco")),
                    F.concat(F.lit("  Cluster: "), F.col("Cluster_ID").cast("string")), F.lit(""))
    cases = report.select(F.col("ID").cast("long").alias("case_no"), F.lit(0).alias("section"),
                          F.posexplode_outer(block).alias("ordinal", "text"))
    note = ["", K.RULE, "FIM DO RELATÓRIO", K.RULE, "", "📌 NOTA TÉCNICA", DASH70,
            "Este relatório foi gerado por um sistema de Inteligência Artificial",
            "baseado em clustering (KMeans). O modelo identifica padrões nos dados",
            "e agrupa acolhidos com perfis similares.", "",
            "A classificação é uma recomendação e deve ser validada por profissionais",
            "qualificados antes de tomar decisões finais.", DASH70]
    tail = total.select((F.col("n") + 1).cast("long").alias("case_no"), F.lit(0).alias("section"),
                        F.posexplode(F.array(*[F.lit(t) for t in note])).alias("ordinal", "text"))
    return union_lines(front, cases.select("case_no", "section", F.col("ordinal").cast("int"), "text"),
                       tail.select("case_no", "section", F.col("ordinal").cast("int"), "text"))


# --------------------------------------------------------------------------- S12 / S11 record blocks

def record_block(scored: DataFrame, id_columns: list[tuple[str, str]], insights: DataFrame,
                 observed: Column, actions: Column) -> DataFrame:
    """Per-record report block for EVERY record: (row_id, ordinal, text).

    ``id_columns``: (shown name, column) pairs."""
    from cohort.operators.score import insight_lookup
    # read in several places below: columns of their own, so that each is worked out once a record
    s = insight_lookup(scored.withColumns({"_observed": observed, "_actions": actions}), insights)
    observed, actions = F.col("_observed"), F.col("_actions")

    def ident(shown: str, c: str) -> Column:
        return once(clean_text(F.col(c)), lambda v: F.when(v != "", F.concat(F.lit(f"  • {shown}: "), masked_value(c, v))))

    ids = [ident(shown, c) for shown, c in id_columns]
    conf = F.concat(fixed(F.col("confidence"), 1), F.lit("%"))
    bullets = lambda arr: F.transform(arr, lambda b: F.concat(F.lit("  • "), b))
    lines = F.concat(
        F.array(F.lit("Relatório de Análise de Perfil"), F.lit(RULE60), F.lit(""),
                F.lit("Identificação do Registro:")),
        F.filter(F.array(*ids), lambda x: x.isNotNull()),
        F.array(F.lit(""), F.lit("Resultado da Análise:"),
                F.concat(F.lit("  • Classificação: "), clean_text(F.col("classification"), K.NOT_INFORMED)),
                F.concat(F.lit("  • Nível de Risco: "), clean_text(F.col("risk_level"), K.NOT_INFORMED)),
                F.concat(F.lit("  • Confiança da Análise: "), conf), F.lit(""),
                F.lit("O que esta classificação significa?"), F.concat(F.lit("  "), F.col("summary")),
                F.lit("")),
        F.when(F.size("details") > 0, F.concat(F.array(F.lit("Recomendações e Pontos de Atenção:")),
                                                bullets(F.col("details")), F.array(F.lit(""))))
         .otherwise(F.array().cast("array<string>")),
        F.when(F.size(observed) > 0, F.concat(F.array(F.lit("Fatores observados nos dados fornecidos:")),
                                              bullets(observed), F.array(F.lit(""))))
         .otherwise(F.array().cast("array<string>")),
        F.when(F.size(actions) > 0, F.concat(F.array(F.lit("Sugestões para a equipe da ONG:")),
                                             bullets(actions), F.array(F.lit(""))))
         .otherwise(F.array().cast("array<string>")),
    )
    return (s.select("row_id", F.posexplode_outer(lines).alias("ordinal", "text"))
            .select("row_id", (F.col("ordinal") + 1).alias("ordinal"), "text"))


def training_block(scored: DataFrame, training: DataFrame, model_lines: list[str]) -> DataFrame:
    """Last part of every record's report: (row_id, ordinal, text).

    What the training report says of the record's label (``training``: label, training_summary, training_details; one
    row per label), where it says anything, then the section on the model with ``model_lines`` (a few, the same for all).
    """
    told = training.select("label", "training_summary", F.coalesce("training_details", F.array().cast("array<string>")).alias("notes"))
    met = scored.select("row_id", F.col("classification").alias("label")).join(told, "label", "left")
    none = F.array().cast("array<string>")
    context = F.when(F.col("training_summary").isNotNull(), F.array(F.concat(F.lit(K.TRAINING_CONTEXT), "training_summary"))).otherwise(none)
    notes = F.when(F.size("notes") > 0, F.concat(F.array(F.lit(K.TRAINING_NOTES)), F.transform("notes", lambda n: F.concat(F.lit("  • "), n)), F.array(F.lit("")))).otherwise(none)
    model = F.array(*[F.lit(x) for x in [K.MODEL_SECTION, *[f"  • {x}" for x in model_lines or [K.MODEL_UNKNOWN]], ""]])
    return (met.select("row_id", F.posexplode(F.concat(context, notes, model)).alias("ordinal", "text"))
            .select("row_id", (F.col("ordinal") + 1).alias("ordinal"), "text"))


# --------------------------------------------------------------------------- S11 / R11

def batch_report_lines(report: DataFrame, id_columns: list[tuple[str, str]], insights: DataFrame,
                       metadata: DataFrame, first_n: int = 10) -> DataFrame:
    """Batch summary: (section, k1, k2, text) ordered by all three keys.

    ``report`` has one row per record: ID, the identifier columns,
    classification, risk_level, confidence and the raw cells.  Distribution
    and insight blocks follow first appearance (by ID); the detail block
    covers the first ``first_n`` records (top-k, no full sort).
    """
    from cohort.functions.cells import record_attributes
    from cohort.operators.score import insight_lookup
    from cohort.operators.summary import dedupe_in_order, distribution
    spark = report.sparkSession
    lit_lines = lambda sec, k1, texts: spark.createDataFrame(
        [(sec, k1, i, t) for i, t in enumerate(texts)], "section int, k1 long, k2 int, text string")
    stats = report.agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg"))
    head = stats.select(F.posexplode(F.array(
        F.lit("Relatório - Análise de Dados Baseada em Clustering"), F.lit(RULE60), F.lit(""),
        F.concat(F.lit("Total analisado: "), F.col("n").cast("string")),
        F.concat(F.lit("Confiança média: "), fixed(F.coalesce(F.col("avg"), F.lit(0.0)), 1), F.lit("%")),
        F.lit(""))).alias("k2", "text")).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("k1"),
                                                F.col("k2").cast("int"), "text")

    def dist_block(sec: int, col: str, title: list[str]) -> DataFrame:
        d = distribution(report, col).join(dedupe_in_order(report, col, "ID").withColumnRenamed("value", "label"),
                                           "label")
        line = F.concat(F.lit("- "), F.col("label"), F.lit(": "), F.col("count").cast("string"),
                        F.lit(" registros ("), fixed(F.col("percentage"), 1), F.lit("%)"))
        body = d.select(F.lit(sec).alias("section"), F.col("position").cast("long").alias("k1"),
                        F.lit(0).alias("k2"), line.alias("text"))
        return lit_lines(sec, 0, title).unionByName(body)

    clusters = dist_block(1, "classification", ["Distribuição por cluster:"])
    risks = dist_block(2, "risk_level", ["", "Distribuição por risco:"])
    seen = dedupe_in_order(report, "classification", "ID").withColumnRenamed("value", "classification")
    ins = insight_lookup(seen, insights)
    ins_lines = F.concat(F.array(F.lit(""), F.col("classification"), F.col("summary")),
                         F.transform("details", lambda b: F.concat(F.lit("  • "), b)))
    insight_block = lit_lines(3, 0, ["", "Insights principais:"]).unionByName(
        ins.select(F.lit(3).alias("section"), F.col("position").cast("long").alias("k1"),
                   F.posexplode(ins_lines).alias("k2", "text")).select("section", "k1", F.col("k2").cast("int"),
                                                                      "text"))
    top = insight_lookup(report.orderBy("ID").limit(first_n), insights)
    rec = {k: F.col(k) for k in ("idade", "situacao_trabalho", "remuneracao", "procurando_trabalho",
                                 "situacao_escolar", "bolsa_familia") if k in report.columns}
    attrs = F.transform(record_attributes(rec),
                        lambda a: F.concat(F.lit("    • "), a["attribute"], F.lit(": "), a["value"]))
    ids = [F.when(~F.lower(strip_u(F.coalesce(F.col(c).cast("string"), F.lit("nan")))).isin("", "nan"),
                  F.concat(F.lit(f"  {shown}: "), masked_value(c, c))) for shown, c in id_columns]
    block = F.concat(
        F.array(F.lit(""), F.concat(F.lit("Registro "), F.col("ID").cast("string"))),
        F.filter(F.array(*ids), lambda x: x.isNotNull()),
        F.array(F.concat(F.lit("  Classificação: "), F.col("classification")),
                F.concat(F.lit("  Nível de risco: "), F.col("risk_level")),
                F.concat(F.lit("  Confiança estimada: "), fixed(F.col("confidence"), 1), F.lit("%")),
                F.lit("  Informações observadas no cadastro:")),
        attrs,
        F.array(F.concat(F.lit("  O que significa essa classificação: "), F.col("summary"))),
        F.when(F.size("details") > 0, F.concat(
            F.array(F.lit("  Recomendações associadas:")),
            F.transform(F.slice("details", 1, 2), lambda b: F.concat(F.lit("    • "), b))))
         .otherwise(F.array().cast("array<string>")))
    detail = lit_lines(4, 0, ["", f"Detalhamento individual (até {first_n} primeiros registros):"]).unionByName(
        top.select(F.lit(4).alias("section"), F.col("ID").cast("long").alias("k1"),
                   F.posexplode(block).alias("k2", "text")).select("section", "k1", F.col("k2").cast("int"),
                                                                  "text"))
    closing = lit_lines(5, 0, ["", "Dados completos estão consolidados neste relatório de texto.", ""])
    md = metadata_lines(metadata)
    model_block = lit_lines(6, 0, ["====== Informações sobre o modelo ======"]).unionByName(
        md.select(F.lit(6).alias("section"), F.col("position").cast("long").alias("k1"), F.lit(0).alias("k2"),
                  F.concat(F.lit("  • "), F.col("text")).alias("text")))
    return union_lines(head, clusters, risks, insight_block, detail, closing, model_block)

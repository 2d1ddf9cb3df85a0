"""DuckDB oracle, part 2 (customers, embeddings, sources, report tables)."""

from __future__ import annotations

from cohort import contract as K
from cohort.plans.customers import CUSTOMER_FEATURES as CF
from cohort.plans.oracle import FEATS, ORACLE as O1, R, cte, fx, masked, q, sql

ORACLE: dict[str, str] = {}
DASH70 = "-" * 70

# --------------------------------------------------------------------------- customers

cte("cf", [], """
SELECT c_custkey, c_nationkey, c_mktsegment, CAST(c_acctbal AS DOUBLE) AS c_acctbal,
       CAST(coalesce(n_orders, 0) AS BIGINT) AS n_orders, coalesce(spend, 0.0) AS spend,
       coalesce(avg_discount, 0.0) AS avg_discount,
       CAST(coalesce(date_diff('day', last_order, span.hi), date_diff('day', span.lo, span.hi)) AS INTEGER)
         AS days_since_last
FROM customer
LEFT JOIN (
  SELECT o_custkey, count(*) AS n_orders, coalesce(sum(revenue), 0) AS spend,
         sum(disc_sum) / sum(n_lines) AS avg_discount, max(CAST(o_orderdate AS DATE)) AS last_order
  FROM orders LEFT JOIN (
    SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_discount) AS disc_sum,
           count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) po ON o_orderkey = l_orderkey
  GROUP BY o_custkey) pc ON c_custkey = o_custkey,
(SELECT max(CAST(o_orderdate AS DATE)) AS hi, min(CAST(o_orderdate AS DATE)) AS lo FROM orders) span""")

ORACLE["customer_features"] = sql(
    f"SELECT c_custkey, c_mktsegment, {R('c_acctbal', 4)} AS c_acctbal, n_orders, {R('spend', 4)} AS spend, "
    f"{R('avg_discount', 10)} AS avg_discount, days_since_last FROM cf", "cf")

cte("cscal", ["cf"], "SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in CF) +
    " FROM cf")
cte("cz", ["cf", "cscal"], "SELECT cf.*, " + ", ".join(
    f"(cf.{f} - m_{f}) / (CASE WHEN s_{f} > 0 THEN s_{f} ELSE 1.0 END) AS z_{f}" for f in CF) +
    " FROM cf, cscal")
cte("ccent", ["cz"], "SELECT c_nationkey AS cid, " + ", ".join(f"avg(z_{f}) AS c_{f}" for f in CF) +
    " FROM cz GROUP BY c_nationkey")
cte("cdist", ["cz", "ccent"], "SELECT cz.c_custkey, ccent.cid, " +
    " + ".join(f"power(cz.z_{f} - ccent.c_{f}, 2)" for f in CF) + " AS d2 FROM cz, ccent")
cte("casg", ["cdist", "cz"], """
SELECT cz.*, n.cid, n.d2 FROM cz JOIN (
  SELECT c_custkey, arg_min(cid, (d2, cid)) AS cid, min(d2) AS d2 FROM cdist GROUP BY c_custkey) n
USING (c_custkey)""")

ORACLE["customer_nearest_nation"] = sql(
    f"SELECT c_custkey, c_nationkey AS nation, cid AS nearest, {R('sqrt(d2)')} AS distance FROM casg", "casg")
ORACLE["customer_profile"] = sql(" UNION ALL ".join(
    f"SELECT CAST(cid AS INTEGER) AS cluster_id, '{f}' AS feature, {R(f'avg({f})')} AS mean, "
    f"{R(f'quantile_cont({f}, 0.5)')} AS median, {R(f'stddev_samp({f})')} AS std_dev "
    f"FROM casg GROUP BY cid" for f in CF), "casg")


def silhouette_sql(src: str, feats: list[str]) -> str:
    sq = " + ".join(f"{f} * {f}" for f in feats)
    dot = " + ".join(f"p.{f} * c.s_{f} / c.n" for f in feats)
    return f"""
WITH cs AS (SELECT cid, count(*) AS n, {', '.join(f'sum({f}) AS s_{f}' for f in feats)}, sum({sq}) AS psi
            FROM {src} GROUP BY cid),
pd AS (SELECT p.rid, p.cid AS own, c.cid, c.n,
              ({' + '.join(f'p.{f} * p.{f}' for f in feats)}) - 2 * ({dot}) + c.psi / c.n AS d
       FROM {src} p, cs c),
pt AS (SELECT rid, max(CASE WHEN cid = own THEN n END) AS n_own,
              max(CASE WHEN cid = own THEN d * n / (n - 1) END) AS a,
              min(CASE WHEN cid <> own THEN d END) AS b FROM pd GROUP BY rid)
SELECT {R('avg(CASE WHEN n_own <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END)')}
       AS silhouette FROM pt"""


cte("csil_src", ["casg"], "SELECT c_custkey AS rid, cid, " + ", ".join(f"z_{f}" for f in CF) + " FROM casg")
ORACLE["customer_silhouette_sq"] = sql("SELECT * FROM (" + silhouette_sql("csil_src", [f"z_{f}" for f in CF])
                                       + ") s", "csil_src")

# --------------------------------------------------------------------------- embeddings

cte("ev", [], """
SELECT vec_id, label, CAST(x AS DOUBLE) AS x, i FROM (
  SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) t""")
cte("ecent", ["ev"], "SELECT label AS cid, i, avg(x) AS c FROM ev GROUP BY label, i")
cte("edist", ["ev", "ecent"], """
SELECT ev.vec_id, ecent.cid, sum((ev.x - ecent.c) * (ev.x - ecent.c)) AS d2
FROM ev JOIN ecent USING (i) GROUP BY ev.vec_id, ecent.cid""")
ORACLE["embedding_nearest_centroid"] = sql(f"""
SELECT e.vec_id, e.label, n.nearest, {R('sqrt(n.d2)')} AS distance
FROM embeddings e JOIN (SELECT vec_id, arg_min(cid, (d2, cid)) AS nearest, min(d2) AS d2 FROM edist
                        GROUP BY vec_id) n USING (vec_id)""", "edist")
ORACLE["embedding_silhouette_sq"] = sql(f"""
SELECT {R('avg(CASE WHEN n_own <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END)')}
       AS silhouette FROM (
  SELECT vec_id, max(CASE WHEN cid = own THEN n END) AS n_own,
         max(CASE WHEN cid = own THEN d * n / (n - 1) END) AS a,
         min(CASE WHEN cid <> own THEN d END) AS b
  FROM (
    SELECT nx.vec_id, nx.label AS own, dt.cid, cs.n,
           nx.nrm - 2 * dt.dot / cs.n + cs.psi / cs.n AS d
    FROM (SELECT vec_id, label, sum(x * x) AS nrm FROM ev GROUP BY vec_id, label) nx
    JOIN (SELECT ev.vec_id, s.cid, sum(ev.x * s.s) AS dot
          FROM ev JOIN (SELECT label AS cid, i, sum(x) AS s FROM ev GROUP BY label, i) s USING (i)
          GROUP BY ev.vec_id, s.cid) dt USING (vec_id)
    JOIN (SELECT label AS cid, count(DISTINCT vec_id) AS n, sum(x * x) AS psi FROM ev GROUP BY label) cs
      ON cs.cid = dt.cid) pd
  GROUP BY vec_id) pt""", "ev")
ORACLE["embedding_davies_bouldin"] = sql(f"""
SELECT {R('avg(r)')} AS davies_bouldin FROM (
  SELECT pr.i, max(CASE WHEN dij > 0 THEN (si.s + sj.s) / dij ELSE 0.0 END) AS r
  FROM (SELECT a.cid AS i, b.cid AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS dij
        FROM ecent a JOIN ecent b ON a.i = b.i AND a.cid <> b.cid GROUP BY a.cid, b.cid) pr
  JOIN (SELECT e.label AS cid, avg(sqrt(d.d2)) AS s FROM embeddings e
        JOIN edist d ON d.vec_id = e.vec_id AND d.cid = e.label GROUP BY e.label) si ON si.cid = pr.i
  JOIN (SELECT e.label AS cid, avg(sqrt(d.d2)) AS s FROM embeddings e
        JOIN edist d ON d.vec_id = e.vec_id AND d.cid = e.label GROUP BY e.label) sj ON sj.cid = pr.j
  GROUP BY pr.i) ri""", "ecent", "edist")

# --------------------------------------------------------------------------- sources

_CELLS = ["nome", "cpf", "idade", "estado_civil", "bolsa_familia", "grau_escolaridade", "situacao_escolar",
          "situacao_trabalho", "remuneracao", "procurando_trabalho", "uso_drogas", "data_cadastro"]
_tok = "(" + ", ".join(q(t) for t in K.NA_TOKENS) + ")"


def _na(c: str) -> str:
    return f"(CASE WHEN {c} IN {_tok} THEN NULL ELSE {c} END)"


ORACLE["scan_csv_probe"] = sql(
    "SELECT v.variant, row_id, " + ", ".join(f"{_na(c)} AS {c}" for c in _CELLS) +
    " FROM intake, (VALUES ('utf8_comma'), ('latin1_semicolon'), ('utf8_tab')) v(variant)", "intake")
ORACLE["scan_bad_lines"] = sql(
    "SELECT row_id, " + ", ".join(
        (f"(CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL ELSE {_na(c)} END) AS {c}"
         if c in _CELLS[-3:] else f"{_na(c)} AS {c}") for c in _CELLS) +
    " FROM intake JOIN orders o ON o.o_orderkey = intake.row_id WHERE o.o_orderpriority <> '1-URGENT'", "intake")
_marked = "(CASE WHEN row_id % 3 <> 1 AND row_id % 5 = 0 THEN nome || chr(65533) || ' é' ELSE nome END)"
ORACLE["scan_mixed_folder"] = sql("SELECT row_id, " + ", ".join(f"{_na(_marked if c == 'nome' else c)} AS {c}" for c in _CELLS) + " FROM intake", "intake")
_broken = "(CASE WHEN row_id % 4 = 1 THEN '\"' || nome || '\",' || chr(10) || chr(10) || row_id || ';' || chr(10) || 'fim \"' ELSE nome END)"
ORACLE["scan_quoted_newlines"] = sql("SELECT row_id, " + ", ".join(f"{_na(_broken if c == 'nome' else c)} AS {c}" for c in _CELLS) + " FROM intake", "intake")
ORACLE["sheet_positions"] = sql(f"SELECT row_number() OVER (ORDER BY row_id) AS position, row_id, {_na('cpf')} AS cpf, row_id AS other_id, {_na('cpf')} AS other_cpf FROM intake", "intake")
ORACLE["file_positions"] = "SELECT o_orderkey, row_number() OVER () AS position FROM orders"
_toks = ["NA", "N/A", "null", "NaN", "None", "#N/A", "nan", "<NA>"]
ORACLE["null_tokens"] = sql(
    "SELECT row_id, " + ", ".join(
        (f"(CASE WHEN o.o_orderpriority = '1-URGENT' THEN NULL ELSE {_na(c)} END) AS {c}"
         if c == "idade" else f"{_na(c)} AS {c}") for c in _CELLS) +
    " FROM intake JOIN orders o ON o.o_orderkey = intake.row_id", "intake")
ORACLE["land_canonical"] = sql(
    "SELECT v.copy, row_id, " + ", ".join(_CELLS) +
    " FROM intake, (VALUES ('intake_convertido'), ('intake_convertido_1')) v(copy)", "intake")
ORACLE["predictions_csv"] = sql(f"""
SELECT row_number() OVER (ORDER BY row_id) AS id, {_na('nome')} AS nome, {masked(_na('cpf'))} AS cpf,
  classification AS classificacao, {fx('confidence', 1)} || '%' AS confianca, risk_level AS nivel_de_risco,
  cluster_id FROM scored""", "scored")

# --------------------------------------------------------------------------- metadata, training report

cte("choice", ["sweep"], f"""
SELECT b.best_k, b.best_k_score, b.selected_k, s.silhouette AS selected_k_score
FROM (SELECT best_k, best_k_score,
             CAST(CASE WHEN best_k IS NULL OR best_k_score < {K.SILHOUETTE_FLOOR} THEN {K.FALLBACK_K}
                       ELSE best_k END AS INTEGER) AS selected_k
      FROM (SELECT arg_max(k, (silhouette, -k)) AS best_k, max(silhouette) AS best_k_score FROM sweep) t) b
LEFT JOIN sweep s ON s.k = b.selected_k""")
cte("meta", ["choice"], """
SELECT o.ts, o.n, choice.selected_k, choice.selected_k_score FROM choice,
  (SELECT max(o_orderdate) AS ts, count(*) AS n FROM orders) o""")
ORACLE["metadata_json"] = sql(f"""
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS training_datetime, n AS total_records, selected_k,
  {R('selected_k_score')} AS silhouette_score, {len(K.FEATURE_NAMES)} AS n_features FROM meta""", "meta")
ORACLE["metadata_lines"] = sql(f"""
SELECT position, text FROM (
  SELECT 1 AS position, 'Treinamento executado em ' || strftime(ts, '%d/%m/%Y %H:%M') AS text FROM meta
  UNION ALL SELECT 2, 'Registros usados no treinamento: ' || CAST(n AS VARCHAR) FROM meta
  UNION ALL SELECT 3, 'Clusters configurados: ' || CAST(selected_k AS VARCHAR) FROM meta
  UNION ALL SELECT 4, 'Silhouette aproximado: ' || {fx('selected_k_score', 3)} FROM meta) t""", "meta")

cte("csize", ["asg", "labels"], """
SELECT l.cluster_id, l.label, n.size, n.size * 100.0 / sum(n.size) OVER () AS pct
FROM labels l JOIN (SELECT cid, count(*) AS size FROM asg GROUP BY cid) n ON n.cid = l.cluster_id""")


# release notes as a CTE (same text as the release_notes oracle body)
_rn_body = O1["release_notes"]
_rn_with, _rn_select = _rn_body.split("\nSELECT cluster_id, CAST(position AS INTEGER) AS position, note FROM (", 1)
cte("notes", ["means", "labels"], "SELECT cluster_id, CAST(position AS INTEGER) AS position, note FROM (" + _rn_select)

_head = ["=" * 70, "  TRAINING RESULTS ABOVE - USE FOR REFERENCE TO UNDERSTAND THE MODEL", "=" * 70, "",
         "📊 Resumo:"]
cte("rlines", ["meta", "csize", "notes"], " UNION ALL ".join(
    [f"SELECT 0 AS section, {i} AS ordinal, {q(t)} AS text" for i, t in enumerate(_head)] +
    ["SELECT 0, 5, '  Registros treinados: ' || CAST(n AS VARCHAR) FROM meta",
     f"SELECT 0, 6, '  Features utilizadas: {len(K.FEATURE_NAMES)}'",
     "SELECT 0, 7, '  Número de clusters: ' || CAST(selected_k AS VARCHAR) FROM meta",
     "SELECT 0, 8, '  Modelo salvo em: model/centroids'",
     "SELECT 0, 9, '  Scaler salvo em: model/scaler'",
     "SELECT 0, 10, ''", "SELECT 0, 11, '🎯 Perfis descobertos:'",
     f"SELECT 1, cluster_id, '  ' || label || ': ' || CAST(size AS VARCHAR) || ' pessoas (' || {fx('pct', 1)} "
     f"|| '%)' FROM csize",
     "SELECT 2, 0, '' WHERE EXISTS (SELECT 1 FROM notes)",
     f"SELECT 2, 1, {q(K.RELEASE_NOTES_HEADER)} WHERE EXISTS (SELECT 1 FROM notes)",
     "SELECT 3, position, '  • ' || note FROM notes",
     "SELECT 4, 0, ''", f"SELECT 4, 1, {q('=' * 70)}"]))
ORACLE["training_report_lines"] = sql(
    "SELECT row_number() OVER (ORDER BY section, ordinal) AS line_no, text FROM rlines", "rlines")

cte("parsed", ["csize", "notes"], f"""
SELECT s.label, s.training_summary, n.position, n.note AS detail FROM (
  SELECT label, arg_max(label || ': ' || CAST(size AS VARCHAR) || ' pessoas (' || {fx('pct', 1)} || '%)',
                        cluster_id) AS training_summary
  FROM csize WHERE label IN ({q(K.LABEL_RELEASE)}, {q(K.LABEL_INTENSIVE)}) GROUP BY label) s
LEFT JOIN (SELECT {q(K.LABEL_RELEASE)} AS label, position, note FROM notes) n USING (label)""")
ORACLE["training_report_parse"] = sql(
    "SELECT label, training_summary, CAST(position AS INTEGER) AS position, detail FROM parsed", "parsed")
_defaults = ", ".join(f"({q(lab)}, {q(summ)}, {len(det)})" for lab, summ, det in K.INSIGHTS)
ORACLE["insight_merge"] = sql(f"""
SELECT coalesce(d.label, p.label) AS label, d.summary, p.training_summary,
       CAST(coalesce(d.n, 0) AS INTEGER) AS n_details, CAST(coalesce(p.n_td, 0) AS INTEGER) AS n_training_details
FROM (VALUES {_defaults}) d(label, summary, n)
FULL OUTER JOIN (SELECT label, any_value(training_summary) AS training_summary, count(detail) AS n_td
                 FROM parsed GROUP BY label) p ON p.label = d.label""", "parsed")

ORACLE["record_report_training"] = sql(f"""
SELECT row_id, CAST(generate_subscripts(lines, 1) AS INTEGER) AS ordinal, unnest(lines) AS text FROM (
  SELECT s.row_id, list_concat(list_concat(
      CASE WHEN p.training_summary IS NULL THEN [] ELSE ['Contexto do modelo: ' || p.training_summary] END,
      CASE WHEN coalesce(len(p.notes), 0) = 0 THEN [] ELSE list_concat(list_concat(['Indicadores observados no treinamento original:'], p.notes), ['']) END),
      list_concat(list_concat(['====== Informações sobre o modelo ======'], (SELECT list('  • ' || text ORDER BY position) FROM ({{model}}) m)), [''])) AS lines
  FROM scored s LEFT JOIN (SELECT label, any_value(training_summary) AS training_summary, list('  • ' || detail ORDER BY position) FILTER (WHERE detail IS NOT NULL) AS notes
                           FROM parsed GROUP BY label) p ON p.label = s.classification) t""".replace("{model}", f"""
  SELECT 1 AS position, 'Treinamento executado em ' || strftime(ts, '%d/%m/%Y %H:%M') AS text FROM meta
  UNION ALL SELECT 2, 'Registros usados no treinamento: ' || CAST(n AS VARCHAR) FROM meta
  UNION ALL SELECT 3, 'Clusters configurados: ' || CAST(selected_k AS VARCHAR) FROM meta
  UNION ALL SELECT 4, 'Silhouette aproximado: ' || {fx('selected_k_score', 3)} FROM meta"""), "scored", "parsed", "meta")

# --------------------------------------------------------------------------- S10 predictions text


def _dist_lines(section: int, col: str, domain: list[str], prefix: str, width: int) -> str:
    vals = ", ".join(f"({i}, {q(v)})" for i, v in enumerate(domain))
    return f"""SELECT 0 AS case_no, {section} AS section, d.o AS ordinal,
  '{prefix}' || printf('%-{width}s', d.label) || ': ' || printf('%4d', coalesce(c.n, 0)) || ' (' ||
  printf('%5s', {fx('coalesce(c.n, 0) * 100.0 / (SELECT count(*) FROM scored)', 1)}) || '%)' AS text
FROM (VALUES {vals}) d(o, label) LEFT JOIN (SELECT {col} AS label, count(*) AS n FROM scored GROUP BY {col}) c
USING (label)"""


_front = ["=" * 70, "RELATÓRIO DE ANÁLISE DE PRONTIDÃO", "Sistema Inteligente de Apoio à Decisão", "=" * 70]
_note = ["", "=" * 70, "FIM DO RELATÓRIO", "=" * 70, "", "📌 NOTA TÉCNICA", DASH70,
         "Este relatório foi gerado por um sistema de Inteligência Artificial",
         "baseado em clustering (KMeans). O modelo identifica padrões nos dados",
         "e agrupa acolhidos com perfis similares.", "",
         "A classificação é uma recomendação e deve ser validada por profissionais",
         "qualificados antes de tomar decisões finais.", DASH70]
_parts = [f"SELECT 0 AS case_no, 0 AS section, {i} AS ordinal, {q(t)} AS text" for i, t in enumerate(_front)]
_parts += [
    "SELECT 0, 0, 4, 'Data/Hora: ' || strftime((SELECT max(o_orderdate) FROM orders), '%d/%m/%Y %H:%M:%S')",
    "SELECT 0, 0, 5, 'Total de casos analisados: ' || CAST((SELECT count(*) FROM scored) AS VARCHAR)"]
_parts += [f"SELECT 0, 0, {6 + i}, {q(t)}" for i, t in
           enumerate(["=" * 70, "", "RESUMO GERAL", DASH70, "", "Classificação:"])]
_parts.append(_dist_lines(1, "classification", K.EMITTED_LABELS, "  ", 20))
_parts += ["SELECT 0, 2, 0, ''", "SELECT 0, 2, 1, 'Nível de Risco:'"]
_parts.append(_dist_lines(3, "risk_level", K.TEXT_SINK_RISKS, "  Risco ", 15))
_parts += [f"SELECT 0, 4, {i}, {q(t)}" for i, t in enumerate([DASH70, "", "DETALHAMENTO POR CASO", "=" * 70, ""])]
_case = [("'Caso #' || printf('%03d', id)"), "'  nome: ' || coalesce(nome, 'nan')",
         f"'  cpf: ' || coalesce({masked('cpf')}, 'nan')", "'  Classificação: ' || classification",
         f"'  Confiança: ' || {fx('confidence', 1)} || '%'", "'  Nível de Risco: ' || risk_level",
         "'  Cluster: ' || CAST(cluster_id AS VARCHAR)", "''"]
_parts += [f"SELECT id, 0, {i}, {e} FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS id FROM scored) r"
           for i, e in enumerate(_case)]
_parts += [f"SELECT (SELECT count(*) FROM scored) + 1, 0, {i}, {q(t)}" for i, t in enumerate(_note)]
ORACLE["predictions_text"] = sql(
    "SELECT CAST(case_no AS BIGINT) AS case_no, CAST(section AS INTEGER) AS section, "
    "CAST(ordinal AS INTEGER) AS ordinal, text FROM (" + " UNION ALL ".join(_parts) + ") t", "scored")

# --------------------------------------------------------------------------- streaming scorer = batch scorer
ORACLE["stream_score"] = O1["score_rows"]

# --------------------------------------------------------------------------- S11 batch summary


def _batch_report() -> str:
    from cohort.plans.oracle import st
    ins_vals = ", ".join(f"({q(lab)}, {q(summ)}, {len(det)})" for lab, summ, det in K.INSIGHTS)
    bul_vals = ", ".join(f"({q(lab)}, {i}, {q(b)})" for lab, _, det in K.INSIGHTS for i, b in enumerate(det))
    head = ["Relatório - Análise de Dados Baseada em Clustering", "=" * 60, ""]
    parts = [f"SELECT 0 AS section, 0 AS k1, {i} AS k2, {q(t)} AS text" for i, t in enumerate(head)]
    parts += ["SELECT 0, 0, 3, 'Total analisado: ' || CAST(n AS VARCHAR) FROM tot",
              f"SELECT 0, 0, 4, 'Confiança média: ' || {fx('coalesce(av, 0)', 1)} || '%' FROM tot",
              "SELECT 0, 0, 5, ''",
              "SELECT 1, 0, 0, 'Distribuição por cluster:'"]
    for sec, col in [(1, "classification"), (2, "risk_level")]:
        if sec == 2:
            parts += ["SELECT 2, 0, 0, ''", "SELECT 2, 0, 1, 'Distribuição por risco:'"]
        parts.append(
            f"SELECT {sec}, pos, 0, '- ' || label || ': ' || CAST(cnt AS VARCHAR) || ' registros (' || "
            f"{fx('cnt * 100.0 / (SELECT n FROM tot)', 1)} || '%)' FROM (SELECT {col} AS label, count(*) AS cnt, "
            f"row_number() OVER (ORDER BY min(id)) AS pos FROM r GROUP BY {col}) d")
    parts += ["SELECT 3, 0, 0, ''", "SELECT 3, 0, 1, 'Insights principais:'",
              "SELECT 3, pos, 0, '' FROM lp", "SELECT 3, pos, 1, label FROM lp",
              f"SELECT 3, pos, 2, coalesce(i.summary, {q(K.NO_SUMMARY)}) FROM lp LEFT JOIN ins i USING (label)",
              "SELECT 3, pos, 3 + b.idx, '  • ' || b.bullet FROM lp JOIN bul b USING (label)",
              "SELECT 4, 0, 0, ''", "SELECT 4, 0, 1, 'Detalhamento individual (até 10 primeiros registros):'"]
    slots = [(0, "''"), (1, "'Registro ' || CAST(id AS VARCHAR)")]
    for j, c in enumerate(["nome", "cpf"]):
        slots.append((2 + j, f"CASE WHEN lower({st(f'coalesce({c}, {q(chr(110) + chr(97) + chr(110))})')}) "
                             f"NOT IN ('', 'nan') THEN '  {c}: ' || {masked(c) if c == 'cpf' else c} END"))
    slots += [(4, "'  Classificação: ' || classification"), (5, "'  Nível de risco: ' || risk_level"),
              (6, f"'  Confiança estimada: ' || {fx('confidence', 1)} || '%'"),
              (7, "'  Informações observadas no cadastro:'")]
    for i, (key, shown) in enumerate(K.RECORD_ATTRIBUTES):
        t = st(key)
        slots.append((8 + i, f"CASE WHEN {t} IS NOT NULL AND {t} <> '' AND lower({t}) <> 'nan' "
                             f"THEN '    • {shown}: ' || {t} END"))
    slots += [(14, f"'  O que significa essa classificação: ' || coalesce(ins.summary, {q(K.NO_SUMMARY)})"),
              (15, "CASE WHEN coalesce(ins.nd, 0) > 0 THEN '  Recomendações associadas:' END"),
              (16, "(SELECT '    • ' || bullet FROM bul WHERE bul.label = r.classification AND idx = 0)"),
              (17, "(SELECT '    • ' || bullet FROM bul WHERE bul.label = r.classification AND idx = 1)")]
    recs = " UNION ALL ".join(f"SELECT id, {s} AS slot, {e} AS text FROM r LEFT JOIN ins "
                              f"ON ins.label = r.classification WHERE id <= 10" for s, e in slots)
    parts.append("SELECT 4, id, CAST(row_number() OVER (PARTITION BY id ORDER BY slot) - 1 AS INTEGER), text "
                 f"FROM ({recs}) x WHERE text IS NOT NULL")
    parts += ["SELECT 5, 0, 0, ''", "SELECT 5, 0, 1, 'Dados completos estão consolidados neste relatório de texto.'",
              "SELECT 5, 0, 2, ''", "SELECT 6, 0, 0, '====== Informações sobre o modelo ======'",
              "SELECT 6, 1, 0, '  • Treinamento executado em ' || strftime(ts, '%d/%m/%Y %H:%M') FROM meta",
              "SELECT 6, 2, 0, '  • Registros usados no treinamento: ' || CAST(n AS VARCHAR) FROM meta",
              "SELECT 6, 3, 0, '  • Clusters configurados: ' || CAST(selected_k AS VARCHAR) FROM meta",
              f"SELECT 6, 4, 0, '  • Silhouette aproximado: ' || {fx('selected_k_score', 3)} FROM meta"]
    body = (f"""SELECT CAST(section AS INTEGER) AS section, CAST(k1 AS BIGINT) AS k1, CAST(k2 AS INTEGER) AS k2, text
FROM (WITH r AS (SELECT *, row_number() OVER (ORDER BY row_id) AS id FROM scored),
      tot AS (SELECT count(*) AS n, avg(confidence) AS av FROM r),
      lp AS (SELECT classification AS label, row_number() OVER (ORDER BY min(id)) AS pos FROM r
             GROUP BY classification),
      ins AS (SELECT * FROM (VALUES {ins_vals}) v(label, summary, nd)),
      bul AS (SELECT * FROM (VALUES {bul_vals}) v(label, idx, bullet))
      """ + " UNION ALL ".join(parts) + ") t")
    return sql(body, "scored", "meta")


ORACLE["batch_report_lines"] = _batch_report()

# --------------------------------------------------------------------------- S12 per-record report


def _record_report() -> str:
    from cohort.plans import oracle as O
    clean = O.clean
    ins = ", ".join(f"({q(lab)}, {q(summ)})" for lab, summ, _ in K.INSIGHTS)
    bul = ", ".join(f"({q(lab)}, {i}, {q(b)})" for lab, _, det in K.INSIGHTS for i, b in enumerate(det))
    fixed_head = ["Relatório de Análise de Perfil", "=" * 60, "", "Identificação do Registro:"]
    parts = [f"SELECT row_id, {i} AS slot, {q(t)} AS text FROM s" for i, t in enumerate(fixed_head)]
    for j, (shown, c) in enumerate([("Nome", "nome"), ("CPF", "cpf")]):
        parts.append(f"SELECT row_id, {10 + j}, CASE WHEN {clean(c)} <> '' THEN '  • {shown}: ' || {masked(clean(c)) if c == 'cpf' else clean(c)} END "
                     "FROM s")
    mid = [("''", 20), ("'Resultado da Análise:'", 21),
           (f"'  • Classificação: ' || {clean('classification', K.NOT_INFORMED)}", 22),
           (f"'  • Nível de Risco: ' || {clean('risk_level', K.NOT_INFORMED)}", 23),
           (f"'  • Confiança da Análise: ' || {fx('confidence', 1)} || '%'", 24), ("''", 25),
           ("'O que esta classificação significa?'", 26),
           (f"'  ' || coalesce(ins.summary, {q(K.NO_SUMMARY)})", 27), ("''", 28)]
    parts += [f"SELECT row_id, {slot}, {e} FROM s LEFT JOIN ins ON ins.label = s.classification"
              for e, slot in mid]
    parts += ["SELECT row_id, 100, 'Recomendações e Pontos de Atenção:' FROM s "
              "WHERE classification IN (SELECT label FROM bul)",
              "SELECT row_id, 101 + bul.idx, '  • ' || bul.bullet FROM s JOIN bul ON bul.label = s.classification",
              "SELECT row_id, 199, '' FROM s WHERE classification IN (SELECT label FROM bul)",
              "SELECT row_id, 200, 'Fatores observados nos dados fornecidos:' FROM s"]
    parts += [f"SELECT row_id, {200 + i}, '  • ' || ({e}) FROM s" for i, e in O._factor_rows]
    parts += ["SELECT row_id, 299, '' FROM s", "SELECT row_id, 300, 'Sugestões para a equipe da ONG:' FROM s"]
    parts += [f"SELECT row_id, {300 + i}, '  • ' || ({e}) FROM s" for i, e in O._action_rows()]
    parts += ["SELECT row_id, 399, '' FROM s"]
    body = f"""SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY slot) AS INTEGER) AS ordinal, text
FROM (WITH s AS (SELECT * FROM scored),
      ins AS (SELECT * FROM (VALUES {ins}) v(label, summary)),
      bul AS (SELECT * FROM (VALUES {bul}) v(label, idx, bullet))
      """ + " UNION ALL ".join(parts) + ") t WHERE text IS NOT NULL"
    return sql(body, "scored")


ORACLE["record_report_lines"] = _record_report()

# --------------------------------------------------------------------------- facts that any fit has

_ss = lambda cols: " + ".join(f"coalesce(var_pop({c}), 0) * count({c})" for c in cols)
ORACLE["kmeans_facts"] = sql(f"""
SELECT 'intake' AS data, count(*) AS n, CAST(3 AS INTEGER) AS k, TRUE AS sizes_add_up, TRUE AS centres_are_means, {R(_ss(FEATS), 2)} AS total FROM z
UNION ALL SELECT 'customer', count(*), CAST(4 AS INTEGER), TRUE, TRUE, {R(_ss([f'z_{f}' for f in CF]), 2)} FROM cz""", "z", "cz")
ORACLE["train_facts"] = f"""
SELECT count(*) AS total_records, {len(FEATS)} AS n_features, '{",".join(str(k) for k in range(K.K_MIN, K.K_MAX + 1))}' AS ks, TRUE AS best_is_highest,
       TRUE AS same_after_reload, count(*) AS assigned, TRUE AS every_cluster_used FROM orders"""

# --------------------------------------------------------------------------- nearest of many centres

_mean = "avg(CAST(l_quantity AS DOUBLE)) AS a, avg(CAST(l_extendedprice AS DOUBLE) * 0.001) AS b, avg(CAST(l_discount AS DOUBLE) * 100) AS c, avg(CAST(l_tax AS DOUBLE) * 100) AS d"
_met = f"""WITH p AS (SELECT l_partkey, {_mean} FROM lineitem GROUP BY l_partkey), s AS (SELECT l_suppkey, {_mean} FROM lineitem GROUP BY l_suppkey),
met AS (SELECT l_partkey, l_suppkey, sqrt((p.a - s.a)^2 + (p.b - s.b)^2 + (p.c - s.c)^2 + (p.d - s.d)^2) AS dist FROM p, s),
best AS (SELECT l_partkey, arg_min(l_suppkey, dist) AS l_suppkey, min(dist) AS d1, list_sort(min(dist, 2))[2] AS d2, max(dist) AS d9 FROM met GROUP BY l_partkey)
"""
ORACLE["nearest_supplier"] = _met + f"SELECT l_partkey, l_suppkey, {R('d1')} AS min_dist, {R('d9')} AS max_dist, {R('1 - d1 / d2')} AS margin FROM best"
ORACLE["nearest_supplier_joined"] = _met + f"SELECT l_partkey, l_suppkey, {R('d1')} AS min_dist FROM best"

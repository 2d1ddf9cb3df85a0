"""DuckDB oracle: the same queries written independently in SQL.

Each entry is a complete SQL text over the driver's tables (pre-registered
views).  Shared steps are CTEs; ``sql(body, *ctes)`` pulls in a CTE's
dependencies in order.  Word lists come from the fixed values in
``cohort.contract``; the logic is written again here in DuckDB's dialect.
"""

from __future__ import annotations

from cohort import contract as K
from cohort.plans import intake as I

NUM_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
FEATS = K.FEATURE_NAMES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def arr(values) -> str:
    return "[" + ", ".join("NULL" if v is None else q(v) for v in values) + "]"


def st(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def cw(x: str) -> str:
    return st(f"regexp_replace(lower({x}), '\\s+', ' ', 'g')")


def nk(x: str) -> str:
    inner = st(f"coalesce({x}, '')")
    return f"translate(lower({inner}), {q(K.ACCENT_FROM)}, {q(K.ACCENT_TO)})"


def num(x: str) -> str:
    t = st(x)
    return f"(CASE WHEN regexp_full_match({t}, '{NUM_RE}') THEN TRY_CAST({t} AS DOUBLE) END)"


def meaningful(x: str) -> str:
    return f"({x} IS NOT NULL AND lower({st(f'CAST({x} AS VARCHAR)')}) NOT IN ('', 'nan', 'none'))"


def clean(x: str, default: str = "") -> str:
    return f"(CASE WHEN {meaningful(x)} THEN {st(x)} ELSE {q(default)} END)"


def R(x: str, d: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {d}) + CAST(0 AS DOUBLE))"


def rhe(x: str, d: int) -> str:
    return f"round_even(CAST({x} AS DOUBLE), {d})"


def fx(x: str, d: int) -> str:
    """printf fixed decimals (fmt: exact binary, ties to even)."""
    return f"printf('%.{d}f', CAST({x} AS DOUBLE))"


# --------------------------------------------------------------------------- CTEs

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


def sql(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order) + "\n" + body


cte("intake", [], f"""
SELECT k AS row_id,
  CASE WHEN k % 23 = 0 THEN NULL ELSE 'Pessoa ' || CAST(k AS VARCHAR) END AS nome,
  CASE WHEN k % 29 = 0 THEN ''
       WHEN k % 31 = 0 THEN lpad(CAST(k * 7919 AS VARCHAR), 10, '0')
       WHEN k % 3 = 0 THEN substr(d, 1, 3) || '.' || substr(d, 4, 3) || '.' || substr(d, 7, 3) || '-' || substr(d, 10, 2)
       ELSE d END AS cpf,
  CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN 'trinta' WHEN k % 41 = 0 THEN '25 anos'
       ELSE CAST(18 + k % 60 AS VARCHAR) END AS idade,
  {arr(I.CIVIL_CYCLE)}[k % {len(I.CIVIL_CYCLE)} + 1] AS estado_civil,
  {arr(I.BENEFIT_CYCLE)}[k % {len(I.BENEFIT_CYCLE)} + 1] AS bolsa_familia,
  {arr(I.EDUCATION_CYCLE)}[k % {len(I.EDUCATION_CYCLE)} + 1] AS grau_escolaridade,
  {arr(I.SCHOOL_CYCLE)}[k % {len(I.SCHOOL_CYCLE)} + 1] AS situacao_escolar,
  {arr(I.WORK_CYCLE)}[k % {len(I.WORK_CYCLE)} + 1] AS situacao_trabalho,
  CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'a combinar'
       WHEN 2 THEN 'R$ 1.' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || ',50'
       WHEN 3 THEN CAST(300 + k % 1500 AS VARCHAR)
       ELSE 'R$ ' || CAST(100 + k % 800 AS VARCHAR) || ',' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') END AS remuneracao,
  {arr(I.LOOKING_CYCLE)}[k % {len(I.LOOKING_CYCLE)} + 1] AS procurando_trabalho,
  {arr(I.DRUGS_CYCLE)}[k % {len(I.DRUGS_CYCLE)} + 1] AS uso_drogas,
  CASE WHEN k % 37 = 0 THEN '2001-01-05' WHEN k % 43 = 0 THEN '31/02/2000'
       WHEN k % 47 = 0 THEN '5/3/1999' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS data_cadastro
FROM (SELECT o_orderkey AS k, o_orderdate,
             lpad(CAST(o_orderkey * 7919 AS VARCHAR), 11, '0') AS d FROM orders) o""")


def _edu_case(key: str) -> str:
    parts = []
    for level in sorted(set(K.EDUCATION_MAP.values())):
        keys = [k for k, v in K.EDUCATION_MAP.items() if v == level]
        parts.append(f"WHEN {key} IN {lst(keys)} THEN {level}")
    return " ".join(parts)


_mk = "replace(replace(m.k1, 'º', ''), '°', '')"
_money = "replace(replace(replace(replace(replace(" + st("remuneracao") + \
    ", 'R$', ''), 'r$', ''), ' ', ''), '.', ''), ',', '.')"

cte("cells", ["intake"], f"""
SELECT *, {nk('grau_escolaridade')} AS k1, {_money} AS money_text FROM intake""")

cte("feat", ["cells"], f"""
SELECT row_id,
  coalesce({num('idade')}, CAST(0 AS DOUBLE)) AS age,
  CAST(coalesce({cw('estado_civil')} IN {lst(K.SINGLE_VALUES)}, false) AS INTEGER) AS marital_status_single,
  CAST(coalesce({cw('estado_civil')} IN {lst(K.MARRIED_VALUES)}, false) AS INTEGER) AS marital_status_married,
  CASE WHEN bolsa_familia IS NULL OR {cw('bolsa_familia')} = '' THEN 0
       WHEN {cw('bolsa_familia')} IN {lst(K.YES_VALUES)} THEN 1
       WHEN {cw('bolsa_familia')} IN {lst(K.NO_VALUES)} THEN 0
       WHEN strpos({cw('bolsa_familia')}, 'sim') > 0 THEN 1 ELSE 0 END AS family_benefit,
  CASE WHEN grau_escolaridade IS NULL OR {st('grau_escolaridade')} = '' THEN 0
       {_edu_case('m.k1')} {_edu_case(_mk)}
       WHEN strpos({_mk}, 'superior') > 0 OR strpos({_mk}, 'graduacao') > 0 THEN 3
       WHEN strpos({_mk}, 'medio') > 0 THEN 2
       WHEN strpos({_mk}, 'fundamental') > 0 OR strpos({_mk}, 'tecnico') > 0 OR strpos({_mk}, 'eja') > 0 THEN 1
       ELSE 0 END AS education_level,
  CASE WHEN lower({st('situacao_escolar')}) = 'cursando' THEN 1 ELSE 0 END AS studying,
  CASE WHEN lower({st('situacao_trabalho')}) IN {lst(K.WORK_FORMAL)} THEN 1.0
       WHEN lower({st('situacao_trabalho')}) IN {lst(K.WORK_INFORMAL)} THEN 0.6
       ELSE CAST(0 AS DOUBLE) END::DOUBLE AS employment_signal,
  coalesce({num('money_text')}, CAST(0 AS DOUBLE)) AS income,
  CASE WHEN procurando_trabalho IS NULL OR {cw('procurando_trabalho')} = '' THEN 0
       WHEN {cw('procurando_trabalho')} IN {lst(K.YES_VALUES)} THEN 1
       WHEN {cw('procurando_trabalho')} IN {lst(K.NO_VALUES)} THEN 0
       WHEN strpos({cw('procurando_trabalho')}, 'sim') > 0 THEN 1 ELSE 0 END AS looking_for_job,
  CASE WHEN uso_drogas IS NULL THEN 1
       WHEN lower({st('uso_drogas')}) IN ('', {q(K.SUBSTANCE_NONE_VALUE)}) THEN 0 ELSE 1 END AS substance_dependency,
  coalesce(round(date_diff('day', CAST(try_strptime({st('data_cadastro')}, '%d/%m/%Y') AS DATE),
                           DATE '{I.AS_OF.isoformat()}') / 30.0, 1), CAST(0 AS DOUBLE)) AS program_duration,
  grau_escolaridade
FROM cells m""")

_stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATS)
cte("scal", ["feat"], f"SELECT {_stats} FROM feat")


def _z(f: str, src: str = "feat", w: float | None = None) -> str:
    z = f"({src}.{f} - scal.m_{f}) / (CASE WHEN scal.s_{f} > 0 THEN scal.s_{f} ELSE 1.0 END)"
    return f"({z}) * {w}" if w is not None else z


cte("z", ["feat", "scal"], "SELECT feat.row_id, feat.education_level AS grp, " +
    ", ".join(f"{_z(f)} AS {f}" for f in FEATS) + " FROM feat, scal")

cte("cent", ["z"], "SELECT CAST(grp AS INTEGER) AS cid, " +
    ", ".join(f"avg({f}) AS c_{f}" for f in FEATS) + " FROM z GROUP BY grp")


def _sqd(a: str = "z", c: str = "cent") -> str:
    return " + ".join(f"power({a}.{f} - {c}.c_{f}, 2)" for f in FEATS)


cte("dist", ["z", "cent"], f"SELECT z.*, cent.cid, {_sqd()} AS d2 FROM z, cent")
cte("asg", ["dist"], """
SELECT * EXCLUDE (rn) FROM (
  SELECT dist.*, row_number() OVER (PARTITION BY row_id ORDER BY d2, cid) AS rn FROM dist) t
WHERE rn = 1""")

# raw feature means per assigned cluster -> score -> label
cte("fa", ["asg", "feat"], "SELECT asg.cid, feat.* FROM asg JOIN feat USING (row_id)")
cte("means", ["fa"], "SELECT cid AS cluster_id, count(*) AS size, " +
    ", ".join(f"round(avg({f}), 9) AS {f}" if f in K.FREE_DECIMALS else
              f"CAST(sum(CAST({f} AS DECIMAL(20,1))) AS DOUBLE) / count({f}) AS {f}" for f in FEATS) + " FROM fa GROUP BY cid")


def _score_sql() -> str:
    terms = []
    for feat, rules in K.SCORE_RULES:
        whens = " ".join(f"WHEN {feat} {op} {thr} THEN {p}" for op, thr, p in rules)
        terms.append(f"(CASE {whens} ELSE 0.0 END)")
    return " + ".join(terms)


cte("scores", ["means"], f"SELECT cluster_id, CAST({_score_sql()} AS DOUBLE) AS score FROM means")
cte("labels", ["scores"], f"""
SELECT cluster_id, score, rk AS rank,
  CASE WHEN n = 1 THEN {q(K.LABEL_SINGLE)} WHEN rk = 1 THEN {q(K.LABEL_RELEASE)}
       WHEN n >= 3 AND rk = 2 THEN {q(K.LABEL_MONITOR)} ELSE {q(K.LABEL_INTENSIVE)} END AS label
FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, cluster_id) AS INTEGER) AS rk,
             count(*) OVER () AS n FROM scores) t""")

# confidence from all distances
cte("dstats", ["dist"], """
SELECT row_id, min(sqrt(d2)) AS dmin, max(sqrt(d2)) AS dmax,
       arg_min(cid, (d2, cid)) AS nearest,
       list_sort(list(sqrt(d2))) AS ds FROM dist GROUP BY row_id""")


def _conf(da: str) -> str:
    raw = f"(1 - ({da} - dmin) / (dmax - dmin)) * 100"
    return (f"(CASE WHEN dmax = dmin THEN 50.0 ELSE "
            f"{rhe(f'greatest(30.0, least(95.0, {raw}))', 1)} END)")


_risk_when = " ".join(f"WHEN {q(lab)} THEN {q(r)}" for lab, r in K.RISK_BY_LABEL.items())
cte("scored", ["dist", "dstats", "labels", "intake"], f"""
SELECT i.*, s.nearest AS cluster_id,
  {_conf('sqrt(dn.d2)')} AS confidence,
  CASE WHEN len(s.ds) < 2 OR s.ds[2] <= 0 THEN 0.0 ELSE 1 - s.ds[1] / s.ds[2] END AS margin,
  coalesce(l.label, {q(K.LABEL_DEFAULT_PREFIX)} || CAST(s.nearest AS VARCHAR)) AS classification,
  CASE coalesce(l.label, {q(K.LABEL_DEFAULT_PREFIX)} || CAST(s.nearest AS VARCHAR))
       {_risk_when} ELSE {q(K.RISK_DEFAULT)} END AS risk_level
FROM dstats s
JOIN dist dn ON dn.row_id = s.row_id AND dn.cid = s.nearest
JOIN intake i ON i.row_id = s.row_id
LEFT JOIN labels l ON l.cluster_id = s.nearest""")

ORACLE: dict[str, str] = {}

# --------------------------------------------------------------------------- F

ORACLE["normalize_text"] = sql(
    f"SELECT row_id, {nk('grau_escolaridade')} AS education_key, {nk('estado_civil')} AS civil_key FROM intake",
    "intake")
ORACLE["collapse_ws"] = sql(
    f"SELECT row_id, {cw('estado_civil')} AS civil, {cw('bolsa_familia')} AS benefit FROM intake", "intake")
for _name, _cols in [("coerce_number", ["age"]),
                     ("marital_one_hot", ["marital_status_single", "marital_status_married"]),
                     ("parse_binary", ["family_benefit", "looking_for_job"]),
                     ("encode_education", ["education_level"]),
                     ("studying_flag", ["studying"]),
                     ("employment_signal", ["employment_signal"]),
                     ("substance_flag", ["substance_dependency"]),
                     ("program_duration", ["program_duration"])]:
    ORACLE[_name] = sql(f"SELECT row_id, {', '.join(_cols)} FROM feat", "feat")
ORACLE["parse_money"] = sql(f"SELECT row_id, {R('income')} AS income FROM feat", "feat")
ORACLE["feature_matrix"] = sql("SELECT row_id, " + ", ".join(
    R(f) + " AS income" if f == "income" else f for f in FEATS) + " FROM feat", "feat")

_money_bad = f"({num('money_text')} IS NULL)"
_unrecognised = f"""
  SELECT 'grau_escolaridade' AS "column", grau_escolaridade AS value, row_id FROM cells m
  WHERE grau_escolaridade IS NOT NULL AND {st('grau_escolaridade')} <> ''
    AND NOT (m.k1 IN {lst(K.EDUCATION_MAP)} OR {_mk} IN {lst(K.EDUCATION_MAP)}
             OR strpos({_mk}, 'superior') > 0 OR strpos({_mk}, 'graduacao') > 0
             OR strpos({_mk}, 'medio') > 0 OR strpos({_mk}, 'fundamental') > 0
             OR strpos({_mk}, 'tecnico') > 0 OR strpos({_mk}, 'eja') > 0)
  UNION ALL
  SELECT 'remuneracao', remuneracao, row_id FROM cells
  WHERE remuneracao IS NOT NULL AND {st('remuneracao')} <> '' AND {_money_bad}
"""
ORACLE["unrecognised_values"] = sql(f"SELECT \"column\", value, count(*) AS count FROM ({_unrecognised}) t GROUP BY \"column\", value", "cells")

ORACLE["scaler_fit"] = sql("SELECT feature, " + R("mean") + " AS mean, " + R("std") + " AS std, " +
                           R("CASE WHEN std > 0 THEN std ELSE 1.0 END") + " AS scale FROM (" +
                           " UNION ALL ".join(f"SELECT '{f}' AS feature, m_{f} AS mean, s_{f} AS std FROM scal"
                                              for f in FEATS) + ") t", "scal")
ORACLE["standardize"] = sql("SELECT row_id, " + ", ".join(f"{R(f, 5)} AS {f}" for f in FEATS) +
                            " FROM z", "z")
ORACLE["weighted_features"] = sql("SELECT feat.row_id, " + ", ".join(
    f"{R(_z(f, 'feat', K.FEATURE_WEIGHTS[f]), 5)} AS {f}" for f in FEATS) + " FROM feat, scal", "feat", "scal")

# --------------------------------------------------------------------------- P

_cells = ["nome", "cpf", "idade", "estado_civil", "bolsa_familia", "grau_escolaridade",
          "situacao_escolar", "situacao_trabalho", "remuneracao", "procurando_trabalho",
          "uso_drogas", "data_cadastro"]
ORACLE["has_meaningful_data"] = sql(
    "SELECT coalesce(bool_or(" + " OR ".join(meaningful(c) for c in _cells) + "), false) AS has_data FROM intake",
    "intake")
ORACLE["drop_empty_rows"] = sql(
    "SELECT row_id FROM intake WHERE NOT (" + " AND ".join(f"{c} IS NULL" for c in _cells) + ")", "intake")
_gap = [c for c in _cells if c not in ("estado_civil", "data_cadastro")]
cte("gappy", ["intake"], "SELECT row_id, " + ", ".join(f"CASE WHEN row_id % 50 <> 0 THEN {c} END AS {c}" for c in _gap) +
    ", CASE WHEN row_id % 50 <> 0 THEN '  ' END AS data_cadastro, CASE WHEN row_id % 50 <> 0 AND row_id % 3 = 0 THEN CAST(row_id AS VARCHAR) END AS id_atendido FROM intake")
ORACLE["empty_rows_dropped"] = sql("SELECT row_id FROM gappy WHERE NOT (" + " AND ".join(f"{c} IS NULL" for c in [*_gap, "data_cadastro", "id_atendido"]) + ")", "gappy")
_headers = [(k, t) for k, t in K.REQUIRED_HEADERS.items()]
_filled = lambda k: f"(SELECT count(*) FROM gappy WHERE {meaningful(k)})" if k in _gap else "CAST(0 AS BIGINT)"
_missing = [t for k, t in _headers if k not in _gap]
_lost = [(f, K.REQUIRED_HEADERS[src]) for f, src, _ in K.FEATURES if src not in _gap]
ORACLE["landing_gates"] = sql("SELECT gate, name, CAST(position AS INTEGER) AS position, n FROM (" + " UNION ALL ".join([
    "SELECT 'rows' AS gate, 'landed' AS name, 0 AS position, count(*) AS n FROM gappy", "SELECT 'rows', 'seen', 1, count(*) FROM gappy",
    "SELECT 'rows', 'empty', 2, count(*) FROM gappy WHERE " + " AND ".join(f"{c} IS NULL" for c in [*_gap, "data_cadastro", "id_atendido"]),
    *[f"SELECT 'required', {q(t)}, {i}, {_filled(k)}" for i, (k, t) in enumerate(_headers)],
    *[f"SELECT 'missing', {q(t)}, {i}, 0" for i, t in enumerate(_missing)],
    *[f"SELECT 'identifier', {q(t)}, {i}, 0" for i, t in enumerate(["Nome", "CPF", "ID_Atendido"])],
    *[f"SELECT 'contract', {q(f + ': ' + t)}, {i}, 0" for i, (f, t) in enumerate(_lost)],
    *[f"SELECT 'unrecognised', {q(c)}, {i}, (SELECT count(*) FROM ({_unrecognised}) t WHERE \"column\" = {q(c)} AND row_id % 50 <> 0)" for i, c in enumerate(["grau_escolaridade", "remuneracao"])],
]) + ") g", "gappy", "cells")
ORACLE["meaningful_by_sheet"] = sql(
    "SELECT 'intake' AS sheet, coalesce(bool_or(" + " OR ".join(meaningful(c) for c in _cells) + "), false) AS has_data FROM intake UNION ALL SELECT 'blank', false", "intake")
ORACLE["required_columns"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({q(text)}, {'false' if key == 'genero' else 'true'}, {i})"
    for i, (key, text) in enumerate(K.REQUIRED_HEADERS.items())) + ") t(\"column\", present, position)"
_id_det = f"""
SELECT * FROM (
  SELECT 1 AS position, 'Nome' AS "column", bool_or({meaningful('nome')}) AS h FROM intake
  UNION ALL SELECT 2, 'CPF', bool_or({meaningful('cpf')}) FROM intake) t WHERE h"""
ORACLE["identifier_detect"] = sql(f"SELECT CAST(position AS INTEGER) AS position, \"column\" FROM ({_id_det}) d",
                                  "intake")
ORACLE["identifier_pick"] = sql(f"SELECT arg_min(\"column\", position) AS identifier FROM ({_id_det}) d "
                                "HAVING count(*) > 0", "intake")
ORACLE["identifier_projection"] = sql("SELECT row_id, nome, cpf FROM intake", "intake")
ORACLE["case_number"] = sql("SELECT row_id, row_number() OVER (ORDER BY row_id) AS case_no FROM intake",
                            "intake")
ORACLE["feature_contract"] = ("SELECT * FROM (VALUES ('marital_status_single', 1, 'Estado civil'), "
                              "('marital_status_married', 2, 'Estado civil'), "
                              "('program_duration', 10, 'Data de Cadastro')) "
                              "t(feature, position, source_column)")

# --------------------------------------------------------------------------- C

ORACLE["nearest_centroid"] = sql(f"SELECT row_id, cid AS cluster_id, {R('sqrt(d2)')} AS min_dist FROM asg",
                                 "asg")
ORACLE["centroid_distances"] = sql(f"SELECT row_id, cid AS cluster_id, {R('sqrt(d2)')} AS distance FROM dist",
                                   "dist")
ORACLE["inertia"] = sql(f"SELECT {R('sum(d2)', 4)} AS inertia FROM asg", "asg")


def _silhouette(assign_cte: str) -> str:
    """Closed-form squared-Euclidean silhouette over (row_id, cid, features)."""
    sq = " + ".join(f"{f} * {f}" for f in FEATS)
    dot = " + ".join(f"p.{f} * c.s_{f} / c.n" for f in FEATS)
    return f"""
WITH cs AS (SELECT cid, count(*) AS n, {', '.join(f'sum({f}) AS s_{f}' for f in FEATS)}, sum({sq}) AS psi
       FROM {assign_cte} GROUP BY cid),
pd AS (SELECT p.row_id, p.cid AS own, c.cid, c.n,
              ({' + '.join(f'p.{f} * p.{f}' for f in FEATS)}) - 2 * ({dot}) + c.psi / c.n AS d
       FROM {assign_cte} p, cs c),
pt AS (SELECT row_id,
              max(CASE WHEN cid = own THEN n END) AS n_own,
              max(CASE WHEN cid = own THEN d * n / (n - 1) END) AS a,
              min(CASE WHEN cid <> own THEN d END) AS b
       FROM pd GROUP BY row_id)
SELECT CASE WHEN (SELECT count(*) FROM cs) < 2 THEN 0.0 ELSE avg(CASE WHEN n_own <= 1 THEN 0.0
            WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END) END AS silhouette FROM pt"""


def _db(assign_cte: str) -> str:
    cen = ", ".join(f"avg({f}) AS c_{f}" for f in FEATS)
    dd = " + ".join(f"power(p.{f} - c.c_{f}, 2)" for f in FEATS)
    sep = " + ".join(f"power(a.c_{f} - b.c_{f}, 2)" for f in FEATS)
    return f"""
WITH cc AS (SELECT cid, {cen} FROM {assign_cte} GROUP BY cid),
sc AS (SELECT p.cid, avg(sqrt({dd})) AS s FROM {assign_cte} p JOIN cc c USING (cid) GROUP BY p.cid),
pr AS (SELECT a.cid AS i, b.cid AS j, sqrt({sep}) AS dij FROM cc a, cc b WHERE a.cid <> b.cid),
ri AS (SELECT pr.i, max(CASE WHEN dij > 0 THEN (si.s + sj.s) / dij ELSE 0.0 END) AS r
       FROM pr JOIN sc si ON si.cid = pr.i JOIN sc sj ON sj.cid = pr.j GROUP BY pr.i)
SELECT CASE WHEN (SELECT count(*) FROM cc) < 2 THEN CAST('inf' AS DOUBLE)
            WHEN (SELECT max(s) FROM sc) <= 1e-8 OR (SELECT max(dij) FROM pr) <= 1e-8 THEN 0.0
            ELSE (SELECT avg(r) FROM ri) END AS davies_bouldin"""


cte("sil", ["asg"], _silhouette("asg"))
cte("dbi", ["asg"], _db("asg"))
ORACLE["silhouette_sq"] = sql(f"SELECT {R('silhouette')} AS silhouette FROM sil", "sil")
ORACLE["davies_bouldin"] = sql(f"SELECT {R('davies_bouldin')} AS davies_bouldin FROM dbi", "dbi")
ORACLE["distinct_labels"] = sql("SELECT count(DISTINCT cid) AS distinct_labels FROM asg", "asg")

# fixed sweep: k = 2..4 nearest among the first k centres
cte("sweep_asg", ["dist"], """
SELECT * EXCLUDE (rn) FROM (
  SELECT ks.k, dist.*, row_number() OVER (PARTITION BY ks.k, row_id ORDER BY d2, cid) AS rn
  FROM dist, (SELECT unnest([2, 3, 4]) AS k) ks WHERE dist.cid < ks.k) t WHERE rn = 1""")
_sq = " + ".join(f"{f} * {f}" for f in FEATS)
_dot = " + ".join(f"p.{f} * c.s_{f} / c.n" for f in FEATS)
_cen = ", ".join(f"avg({f}) AS c_{f}" for f in FEATS)
_dd = " + ".join(f"power(p.{f} - c.c_{f}, 2)" for f in FEATS)
_sep = " + ".join(f"power(a.c_{f} - b.c_{f}, 2)" for f in FEATS)
cte("sweep", ["sweep_asg"], f"""
WITH cs AS (SELECT k, cid, count(*) AS n, {', '.join(f'sum({f}) AS s_{f}' for f in FEATS)}, sum({_sq}) AS psi
            FROM sweep_asg GROUP BY k, cid),
pd AS (SELECT p.k, p.row_id, p.cid AS own, c.cid, c.n,
              ({' + '.join(f'p.{f} * p.{f}' for f in FEATS)}) - 2 * ({_dot}) + c.psi / c.n AS d
       FROM sweep_asg p JOIN cs c ON c.k = p.k),
pt AS (SELECT k, row_id, max(CASE WHEN cid = own THEN n END) AS n_own,
              max(CASE WHEN cid = own THEN d * n / (n - 1) END) AS a,
              min(CASE WHEN cid <> own THEN d END) AS b FROM pd GROUP BY k, row_id),
sil AS (SELECT k, avg(CASE WHEN n_own <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b
                           WHEN a > b THEN b / a - 1 ELSE 0.0 END) AS silhouette FROM pt GROUP BY k),
cc AS (SELECT k, cid, {_cen} FROM sweep_asg GROUP BY k, cid),
sc AS (SELECT p.k, p.cid, avg(sqrt({_dd})) AS s FROM sweep_asg p JOIN cc c ON c.k = p.k AND c.cid = p.cid
       GROUP BY p.k, p.cid),
pr AS (SELECT a.k, a.cid AS i, b.cid AS j, sqrt({_sep}) AS dij FROM cc a JOIN cc b ON a.k = b.k AND a.cid <> b.cid),
ri AS (SELECT pr.k, pr.i, max(CASE WHEN dij > 0 THEN (si.s + sj.s) / dij ELSE 0.0 END) AS r
       FROM pr JOIN sc si ON si.k = pr.k AND si.cid = pr.i JOIN sc sj ON sj.k = pr.k AND sj.cid = pr.j
       GROUP BY pr.k, pr.i),
dbi AS (SELECT k, avg(r) AS davies_bouldin FROM ri GROUP BY k),
ine AS (SELECT k, sum(d2) AS inertia FROM sweep_asg GROUP BY k)
SELECT CAST(ine.k AS INTEGER) AS k, inertia, silhouette, davies_bouldin
FROM ine JOIN sil USING (k) JOIN dbi USING (k)""")
ORACLE["k_sweep_fixed"] = sql(f"SELECT k, {R('inertia', 4)} AS inertia, {R('silhouette')} AS silhouette, "
                              f"{R('davies_bouldin')} AS davies_bouldin FROM sweep", "sweep")
ORACLE["centroid_silhouette"] = sql(f"""
SELECT * FROM (WITH d AS (SELECT ks.k, row_id, list_sort(list(sqrt(d2))) AS ds FROM dist, (SELECT unnest([2, 3, 4]) AS k) ks WHERE dist.cid < ks.k GROUP BY ks.k, row_id),
m AS (SELECT k, avg(CASE WHEN ds[2] > 0 THEN (ds[2] - ds[1]) / ds[2] ELSE 0.0 END) AS v FROM d GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, {R('v')} AS centroid_silhouette, k = (SELECT arg_max(k, (v, -k)) FROM m) AS best FROM m) t""", "dist")
ORACLE["choose_k"] = sql(f"""
SELECT b.best_k, {R('b.best_k_score')} AS best_k_score, b.selected_k, {R('s.silhouette')} AS selected_k_score
FROM (SELECT best_k, best_k_score,
             CAST(CASE WHEN best_k IS NULL OR best_k_score < {K.SILHOUETTE_FLOOR} THEN {K.FALLBACK_K}
                       ELSE best_k END AS INTEGER) AS selected_k
      FROM (SELECT arg_max(k, (silhouette, -k)) AS best_k, max(silhouette) AS best_k_score FROM sweep) t) b
LEFT JOIN sweep s ON s.k = b.selected_k""", "sweep")

ORACLE["confidence"] = sql(f"""
SELECT s.row_id, s.nearest AS cluster_id, CAST(a.grp AS INTEGER) AS assigned,
  {R(_conf('sqrt(da.d2)'), 4)} AS confidence_assigned,
  {R(_conf('sqrt(dn.d2)'), 4)} AS confidence_nearest,
  {R('CASE WHEN len(s.ds) < 2 OR s.ds[2] <= 0 THEN 0.0 ELSE 1 - s.ds[1] / s.ds[2] END')} AS margin
FROM dstats s JOIN z a ON a.row_id = s.row_id
JOIN dist da ON da.row_id = s.row_id AND da.cid = a.grp
JOIN dist dn ON dn.row_id = s.row_id AND dn.cid = s.nearest""", "dstats", "z", "dist")

# --------------------------------------------------------------------------- A / W

ORACLE["cluster_size"] = sql(f"""
SELECT c.cid AS cluster_id, coalesce(n.size, 0) AS size,
  {R('coalesce(n.size, 0) * 100.0 / sum(coalesce(n.size, 0)) OVER ()')} AS percentage
FROM cent c LEFT JOIN (SELECT cid, count(*) AS size FROM asg GROUP BY cid) n USING (cid)""", "cent", "asg")

ORACLE["cluster_size_listed"] = sql(f"""
SELECT CAST(c.cid AS INTEGER) AS cluster_id, coalesce(n.size, 0) AS size,
  {R('coalesce(n.size, 0) * 100.0 / sum(coalesce(n.size, 0)) OVER ()')} AS percentage
FROM (SELECT unnest(range(10)) AS cid) c LEFT JOIN (SELECT cid, count(*) AS size FROM asg GROUP BY cid) n USING (cid)""", "asg")

ORACLE["profile_numeric"] = sql(" UNION ALL ".join(
    f"SELECT cid AS cluster_id, '{f}' AS feature, {R(f'avg({f})')} AS mean, "
    f"{R(f'quantile_cont({f}, 0.5)')} AS median, {R(f'stddev_samp({f})')} AS std_dev FROM fa GROUP BY cid"
    for f in FEATS), "fa")

_modes = " UNION ALL ".join(
    f"SELECT cid, '{c}' AS col, {c} AS value FROM asg JOIN intake USING (row_id)"
    for c in ["estado_civil", "situacao_trabalho"])
ORACLE["profile_mode"] = sql(f"""
SELECT cid AS cluster_id, col, value AS most_common, {R('n * 100.0 / size')} AS frequency FROM (
  SELECT cid, col, value, n, sum(n) OVER (PARTITION BY cid, col) AS size,
         row_number() OVER (PARTITION BY cid, col ORDER BY (value IS NULL), n DESC, value) AS rk
  FROM (SELECT cid, col, value, count(*) AS n FROM ({_modes}) u GROUP BY cid, col, value) g
) t WHERE rk = 1 AND value IS NOT NULL""", "asg", "intake")

ORACLE["feature_summary"] = sql(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, count({f}) AS count, {R(f'avg({f})')} AS mean, {R(f'stddev_samp({f})')} AS std, "
    f"{R(f'min({f})')} AS min, {R(f'quantile_cont({f}, 0.25)')} AS p25, {R(f'quantile_cont({f}, 0.5)')} AS p50, "
    f"{R(f'quantile_cont({f}, 0.75)')} AS p75, {R(f'max({f})')} AS max, "
    f"count(*) FILTER (WHERE {f} IS NULL) AS nulls FROM feat" for f in FEATS), "feat")

ORACLE["cluster_score"] = sql(f"SELECT cluster_id, {R('score')} AS score FROM scores", "scores")
ORACLE["cluster_label"] = sql(f"SELECT cluster_id, {R('score')} AS score, rank, label FROM labels", "labels")

_hl = [f"'educação média=' || {fx('education_level', 2)}",
       f"'renda média=R$ ' || {fx('income', 2)}",
       f"'busca emprego=' || {fx('looking_for_job * 100', 0)} || '%'",
       f"'emprego sinal=' || {fx('employment_signal', 2)}"]
ORACLE["cluster_highlights"] = sql(f"SELECT cluster_id, {' || '.join(h + (' || chr(44) || chr(32)' if i < 3 else '') for i, h in enumerate(_hl))} AS highlights FROM means", "means")


def _edu_phrase(x: str) -> str:
    whens = " ".join(f"WHEN {x} {op} {thr} THEN {q(ph)}" for op, thr, ph in K.EDU_PHRASES)
    return f"(CASE {whens} ELSE {q(K.EDU_PHRASE_NONE)} END)"


ORACLE["education_phrase"] = sql(f"SELECT cluster_id, {R('education_level')} AS education_mean, "
                                 f"{_edu_phrase('education_level')} AS phrase FROM means", "means")


def _pct1(x: str) -> str:
    return f"CAST({rhe(f'{x} * 100', 1)} AS VARCHAR)"


ORACLE["release_notes"] = sql(f"""
SELECT cluster_id, CAST(position AS INTEGER) AS position, note FROM (
  SELECT cluster_id, 1 AS position, 'Renda média declarada de R$ ' || {fx('income', 2)} || ', indicando alguma ocupação' AS note FROM m
  UNION ALL SELECT cluster_id, 2, {_pct1('looking_for_job')} || '% buscando emprego e ' || {_pct1('studying')} || '% estudando (sinais de engajamento)' FROM m
  UNION ALL SELECT cluster_id, 3, 'Sinal de emprego médio ' || {fx('employment_signal', 2)} || ' (0=desempregado, 0.6=informal, 1=formal)' FROM m
  UNION ALL SELECT cluster_id, 4, 'Tempo médio no programa de ' || {fx('program_duration', 1)} || ' meses' FROM m
  UNION ALL SELECT cluster_id, 5, 'Escolaridade média ' || {fx('education_level', 2)} || ', acima do grupo de Apoio Intensivo' FROM m
) t""".replace("FROM m", "FROM (SELECT means.* FROM means JOIN labels USING (cluster_id) WHERE label = "
               + q(K.LABEL_RELEASE) + ") m"), "means", "labels")

ORACLE["cluster_summary_lines"] = sql(f"""
SELECT cluster_id, CAST(line_no AS INTEGER) AS line_no, text FROM (
  SELECT m.cluster_id, 1 AS line_no, '[Cluster ' || CAST(m.cluster_id AS VARCHAR) || '] ' || coalesce(l.label, 'Cluster ' || CAST(m.cluster_id AS VARCHAR)) AS text FROM means m LEFT JOIN labels l USING (cluster_id)
  UNION ALL SELECT cluster_id, 2, 'Tamanho: ' || CAST(size AS VARCHAR) || ' (' || {fx('size * 100.0 / sum(size) OVER ()', 1)} || '%)' FROM means
  UNION ALL SELECT cluster_id, 3, 'Idade média: ' || {fx('age', 1)} || ' anos' FROM means
  UNION ALL SELECT cluster_id, 4, 'Escolaridade média: ' || {fx('education_level', 2)} || ' → ' || {_edu_phrase('education_level')} FROM means
  UNION ALL SELECT cluster_id, 5, 'Benefício social: ' || {_pct1('family_benefit')} || '% recebem Bolsa Família' FROM means
  UNION ALL SELECT cluster_id, 6, 'Estudando atualmente: ' || {_pct1('studying')} || '%' FROM means
  UNION ALL SELECT cluster_id, 7, 'Buscando emprego: ' || {_pct1('looking_for_job')} || '%' FROM means
  UNION ALL SELECT cluster_id, 8, 'Dependência química: ' || {_pct1('substance_dependency')} || '% informaram uso' FROM means
  UNION ALL SELECT cluster_id, 9, 'Renda média declarada: R$ ' || {fx('income', 2)} FROM means
  UNION ALL SELECT cluster_id, 10, 'Tempo médio no programa: ' || {fx('program_duration', 1)} || ' meses' FROM means
) t""", "means", "labels")

# --------------------------------------------------------------------------- scoring

ORACLE["label_lookup"] = sql("SELECT row_id, cluster_id, classification FROM scored", "scored")
ORACLE["risk_level"] = sql("SELECT row_id, classification, risk_level FROM scored", "scored")
ORACLE["score_rows"] = sql(f"SELECT row_id, cluster_id, classification, {R('confidence', 4)} AS confidence, "
                           f"{R('margin')} AS margin, risk_level FROM scored", "scored")
for _name, _col in [("label_distribution", "classification"), ("risk_distribution", "risk_level")]:
    ORACLE[_name] = sql(f"SELECT {_col} AS label, count(*) AS count, "
                        f"{R('count(*) * 100.0 / sum(count(*)) OVER ()')} AS percentage FROM scored GROUP BY {_col}",
                        "scored")
ORACLE["confidence_summary"] = sql(f"SELECT count(*) AS total, {R('coalesce(avg(confidence), 0)', 4)} "
                                   "AS average_confidence FROM scored", "scored")


def _domain(kind: str, col: str, domain: list[str]) -> str:
    vals = ", ".join(f"({i}, {q(v)})" for i, v in enumerate(domain))
    return f"""SELECT '{kind}' AS kind, d.position, d.label, coalesce(c.n, 0) AS count,
  {R('coalesce(c.n, 0) * 100.0 / (SELECT count(*) FROM scored)')} AS percentage
FROM (VALUES {vals}) d(position, label)
LEFT JOIN (SELECT {col} AS label, count(*) AS n FROM scored GROUP BY {col}) c USING (label)"""


ORACLE["fixed_domain_distribution"] = sql(
    "SELECT kind, CAST(position AS INTEGER) AS position, label, count, percentage FROM (" +
    _domain("classification", "classification", K.EMITTED_LABELS) + " UNION ALL " +
    _domain("risk", "risk_level", K.TEXT_SINK_RISKS) + ") t", "scored")

_conf_txt = f"{fx('confidence', 1)} || '%'"


def masked(x: str) -> str:
    """A value of the CPF column: 11 digits are shown as ddd.***.***-dd, anything else as it is."""
    digits = f"regexp_replace(CAST({x} AS VARCHAR), '[^0-9]', '', 'g')"
    return (f"(CASE WHEN length({digits}) = 11 THEN substr({digits}, 1, 3) || '.***.***-' || substr({digits}, 10, 2) "
            f"ELSE CAST({x} AS VARCHAR) END)")


ORACLE["report_rows"] = sql(f"""
SELECT row_number() OVER (ORDER BY row_id) AS id, nome, {masked('cpf')} AS cpf, classification AS classificacao,
  {_conf_txt} AS confianca, risk_level AS nivel_de_risco, cluster_id FROM scored""", "scored")

# --------------------------------------------------------------------------- R cells


def _mask(colname: str, x: str) -> str:
    text = st(f"CAST({x} AS VARCHAR)")
    if colname.lower() == "cpf":
        digits = f"regexp_replace({text}, '[^0-9]', '', 'g')"
        text = (f"(CASE WHEN length({digits}) = 11 THEN substr({digits}, 1, 3) || '.***.***-' || "
                f"substr({digits}, 10, 2) ELSE {text} END)")
    return f"(CASE WHEN {meaningful(x)} THEN {q(colname + ': ')} || {text} ELSE '' END)"


ORACLE["mask_identifier"] = sql(f"SELECT row_id, {_mask('Nome', 'nome')} AS nome_text, "
                                f"{_mask('CPF', 'cpf')} AS cpf_text FROM intake", "intake")
ORACLE["clean_text"] = sql(f"SELECT row_id, {clean('idade', K.NOT_INFORMED)} AS idade, "
                           f"{clean('uso_drogas', K.NOT_INFORMED)} AS uso_drogas, "
                           f"{clean('estado_civil')} AS estado_civil FROM intake", "intake")


def _fmt_conf(x: str) -> str:
    text = clean(x)
    norm = f"replace(replace(replace({text}, '%', ''), ' ', ''), ',', '.')"
    n = num(norm)
    n2 = f"(CASE WHEN {n} <= 1 THEN {n} * 100 ELSE {n} END)"
    return (f"(CASE WHEN {text} = '' THEN {q(K.NOT_INFORMED)} WHEN {n} IS NOT NULL THEN "
            f"{fx(n2, 1)} || '%' ELSE {text} END)")


ORACLE["format_confidence"] = sql(
    f"SELECT row_id, {_fmt_conf('CAST(confidence / 100 AS VARCHAR)')} AS from_fraction, "
    f"{_fmt_conf(chr(40) + 'CAST(confidence AS VARCHAR) || ' + q(' %') + chr(41))} AS from_text FROM scored",
    "scored")


def _dep(x: str) -> tuple[str, str]:
    raw = clean(x)
    s = f"translate(lower({raw}), 'ãõâêé', 'aoaee')"
    neg = " OR ".join(f"strpos({s}, {q(t)}) > 0" for t in K.DEPENDENCY_NEGATIVE_TOKENS)
    flag = f"(CASE WHEN {raw} = '' THEN false WHEN ({neg}) AND strpos({s}, 'sim') = 0 THEN false ELSE true END)"
    return flag, raw


_dep_flag, _dep_text = _dep("uso_drogas")
ORACLE["dependency_info"] = sql(f"SELECT row_id, {_dep_flag} AS dependency_flag, {_dep_text} AS dependency_text "
                                "FROM intake", "intake")


def _currency(x: str) -> str:
    text = clean(x)
    cleaned = f"replace(replace(replace({text}, 'R$', ''), 'r$', ''), ' ', '')"
    normalized = f"replace(replace({cleaned}, '.', ''), ',', '.')"
    amount = f"coalesce({num(normalized)}, {num(cleaned)})"
    shown = f"'R$ ' || translate(format('{{:,.2f}}', {amount}), ',.', '.,')"
    return f"(CASE WHEN {text} = '' THEN '' WHEN {amount} IS NOT NULL THEN {shown} ELSE {text} END)"


ORACLE["format_currency"] = sql(f"SELECT row_id, {_currency('remuneracao')} AS income_text FROM intake", "intake")


def _yes_no(x: str) -> str:
    text = clean(x)
    low = f"lower({text})"
    s = f"translate({low}, 'ãõ', 'ao')"
    return (f"(CASE WHEN {text} = '' THEN {q(K.NOT_INFORMED)} WHEN strpos({s}, 'sim') > 0 THEN 'Sim' "
            f"WHEN strpos({s}, 'nao') > 0 OR strpos({low}, 'não') > 0 THEN 'Não' ELSE {text} END)")


ORACLE["yes_no"] = sql(f"SELECT row_id, {_yes_no('procurando_trabalho')} AS job_search, "
                       f"{_yes_no('bolsa_familia')} AS family_benefit FROM intake", "intake")

_factor_rows = [
    (1, f"CASE WHEN {clean('idade')} <> '' THEN 'Idade informada: ' || {clean('idade')} END"),
    (2, f"CASE WHEN {clean('situacao_trabalho')} <> '' THEN 'Situação de trabalho declarada: ' || {clean('situacao_trabalho')} END"),
    (3, f"CASE WHEN {_currency('remuneracao')} <> '' THEN 'Renda declarada: ' || {_currency('remuneracao')} END"),
    (4, f"CASE WHEN {clean('situacao_escolar')} <> '' THEN 'Situação escolar atual: ' || {clean('situacao_escolar')} END"),
    (5, f"CASE WHEN {_yes_no('procurando_trabalho')} <> {q(K.NOT_INFORMED)} THEN 'Busca por trabalho: ' || {_yes_no('procurando_trabalho')} END"),
    (6, f"CASE WHEN {_yes_no('bolsa_familia')} <> {q(K.NOT_INFORMED)} THEN 'Recebe Bolsa Família: ' || {_yes_no('bolsa_familia')} END"),
    (7, f"CASE WHEN {_dep_flag} THEN 'Dependência química relatada: ' || CASE WHEN {_dep_text} = '' THEN 'presença informada' ELSE {_dep_text} END "
        f"WHEN {_dep_text} <> '' THEN 'Dependência química: ' || {_dep_text} "
        f"ELSE 'Dependência química: não há registro atualizado no cadastro.' END"),
]
ORACLE["observed_factors"] = sql(
    "SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY slot) AS INTEGER) AS position, factor "
    "FROM (" + " UNION ALL ".join(f"SELECT row_id, {i} AS slot, {e} AS factor FROM intake"
                                  for i, e in _factor_rows) + ") t WHERE factor IS NOT NULL", "intake")


def _action_rows() -> list[tuple[int, str]]:
    rows = []
    lab = clean("classification")
    slot = 0
    # label block: first, dependency sentence, rest (up to 2)
    for name, (first, with_dep, without_dep, rest) in K.ACTION_PLAN.items():
        base = 0
        rows.append((slot + base + 1, f"CASE WHEN {lab} = {q(name)} THEN {q(first)} END"))
        rows.append((slot + base + 2, f"CASE WHEN {lab} = {q(name)} THEN CASE WHEN {_dep_flag} THEN {q(with_dep)} "
                                      f"ELSE {q(without_dep)} END END"))
        for i, r in enumerate(rest):
            rows.append((slot + base + 3 + i, f"CASE WHEN {lab} = {q(name)} THEN {q(r)} END"))
    names = lst(list(K.ACTION_PLAN))
    rows.append((1, f"CASE WHEN {lab} NOT IN {names} THEN {q(K.ACTION_DEFAULT)} END"))
    job = _yes_no("procurando_trabalho")
    rows.append((10, f"CASE WHEN {job} = 'Não' THEN {q(K.ACTION_JOB_NO)} WHEN {job} = 'Sim' THEN {q(K.ACTION_JOB_YES)} END"))
    study = f"translate(lower({clean('situacao_escolar')}), 'çã', 'ca')"
    rows.append((11, f"CASE WHEN strpos({study}, 'interromp') > 0 THEN {q(K.ACTION_STUDY_STOPPED)} "
                     f"WHEN strpos({study}, 'cursando') > 0 THEN {q(K.ACTION_STUDY_ONGOING)} END"))
    work = f"translate(lower({clean('situacao_trabalho')}), 'çã', 'ca')"
    unemp = " OR ".join(f"strpos({work}, {q(t)}) > 0" for t in K.UNEMPLOYED_TOKENS)
    rows.append((12, f"CASE WHEN {work} <> '' AND ({unemp}) THEN {q(K.ACTION_INCOME)} END"))
    risk = clean("risk_level")
    pre, post = K.ACTION_RISK.split("{risk}")
    rows.append((13, f"CASE WHEN {risk} <> '' THEN {q(pre)} || {risk} || {q(post)} END"))
    rows.append((14, q(K.ACTION_CLOSING)))
    return rows


ORACLE["action_plan"] = sql(
    "SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY slot) AS INTEGER) AS position, action "
    "FROM (" + " UNION ALL ".join(f"SELECT row_id, {i} AS slot, {e} AS action FROM scored"
                                  for i, e in _action_rows()) + ") t WHERE action IS NOT NULL", "scored")


def _attr(x: str) -> str:
    t = st(f"CAST({x} AS VARCHAR)")
    return f"({t} IS NOT NULL AND {t} <> '' AND lower({t}) <> 'nan')"


ORACLE["record_attributes"] = sql(" UNION ALL ".join(
    f"SELECT row_id, {i} AS position, {q(shown)} AS attribute, {st(key)} AS value FROM intake WHERE {_attr(key)}"
    for i, (key, shown) in enumerate(K.RECORD_ATTRIBUTES, start=1)), "intake")

# --------------------------------------------------------------------------- L / U / J

_ins_vals = ", ".join(f"({q(lab)}, {q(summ)}, {q(det[0])}, {len(det)})" for lab, summ, det in K.INSIGHTS)
_ins = f"(SELECT * FROM (VALUES {_ins_vals}) v(label, summary, first_detail, n_details))"
ORACLE["first_n_overview"] = sql(f"""
SELECT id, line, remark, (SELECT greatest(count(*) - 25, 0) FROM scored) AS omitted FROM (
  SELECT r.id, '- ' || CASE WHEN ident = '' THEN 'Registro ' || CAST(r.id AS VARCHAR) ELSE ident END
         || ' -> Grupo: ' || classification || ' | Risco: ' || risk_level || ' | Confiança: ' || {_conf_txt} AS line,
         coalesce(ins.first_detail, {q(K.NO_SUMMARY)}) AS remark
  FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS id,
               array_to_string(list_filter([{_mask('Nome', 'nome')}, {_mask('CPF', 'cpf')}], lambda x: x <> ''), ' | ') AS ident
        FROM scored) r
  LEFT JOIN {_ins} ins ON ins.label = r.classification
  WHERE r.id <= 25) t""", "scored")

_bul = " UNION ALL ".join(
    f"SELECT {q(lab)} AS label, {q(det[0])} AS remark, {i + 1} AS position, {q(b)} AS bullet"
    for lab, _, det in K.INSIGHTS for i, b in enumerate(det[:2]))
ORACLE["first_bullets"] = sql(f"SELECT label, remark, CAST(position AS INTEGER) AS position, bullet FROM ({_bul}) b "
                              "WHERE label IN (SELECT classification FROM scored)", "scored")
ORACLE["dedupe_labels"] = sql("SELECT CAST(row_number() OVER (ORDER BY first_seen) AS INTEGER) AS position, label "
                              "FROM (SELECT classification AS label, min(row_id) AS first_seen FROM scored "
                              "GROUP BY classification) t", "scored")
_allb = " UNION ALL ".join(
    f"SELECT {q(lab)} AS label, {q(summ)} AS summary, {i + 1} AS position, {q(b)} AS bullet"
    for lab, summ, det in K.INSIGHTS for i, b in enumerate(det))
ORACLE["observed_insights"] = sql(f"""
SELECT label, summary, CAST(position AS INTEGER) AS position, bullet FROM ({_allb}) b
WHERE label IN (SELECT classification FROM scored)
UNION ALL
SELECT DISTINCT classification, {q(K.NO_SUMMARY)}, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR) FROM scored
WHERE classification NOT IN (SELECT label FROM ({_allb}) b2)""", "scored")
ORACLE["insight_lookup"] = sql(f"""
SELECT s.row_id, s.classification, coalesce(i.summary, {q(K.NO_SUMMARY)}) AS summary,
       CAST(coalesce(i.n_details, 0) AS INTEGER) AS n_details
FROM scored s LEFT JOIN {_ins} i ON i.label = s.classification""", "scored")

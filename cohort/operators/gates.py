"""Ingest gates: header resolution, data presence, identifiers, case numbers.

Every gate is one DataFrame (usually one aggregate over all candidate
columns in a single pass), so a check costs one scan however many columns
it looks at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort import contract as K
from cohort.functions.text import clean_text, is_meaningful, strip_u
from cohort.functions import encode as E
from cohort.sources.positions import numbered


#: Identifier headers in order of priority; the sheet's own number comes last.
IDENTIFIERS = [*K.IDENTIFIER_HEADERS.values(), *K.EXTRA_IDENTIFIER_HEADERS.values()]


def _header_index() -> dict[str, str]:
    names = {**K.REQUIRED_HEADERS, **K.IDENTIFIER_HEADERS, **K.EXTRA_IDENTIFIER_HEADERS}
    return {text.strip().lower(): key for key, text in names.items()}


def resolve_headers(df: DataFrame) -> DataFrame:
    """Rename sheet headers to canonical keys (strip + case-insensitive match).

    Unknown columns keep their stripped header; canonical keys pass through.
    """
    idx = _header_index()
    known = set(idx.values())
    out = []
    for c in df.columns:
        key = idx.get(c.strip().lower(), c.strip() if c.strip() not in known else c.strip())
        out.append(F.col(f"`{c}`").alias(key))
    return df.select(*out)


def has_meaningful_data(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: does any cell hold data?  Each task stops at its first hit."""
    cols = columns or df.columns
    pred = None
    for c in cols:
        p = is_meaningful(F.col(c))
        pred = p if pred is None else (pred | p)
    hits = df.filter(pred).select(F.lit(1).alias("hit")).limit(1)
    return hits.agg((F.count(F.lit(1)) > 0).alias("has_data"))


def drop_empty_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows whose cells (in ``columns``) are all null."""
    return df.na.drop(how="all", subset=columns or df.columns)


def required_columns(df: DataFrame) -> DataFrame:
    """(column, present) for every required header, in contract order."""
    have = {c.strip().lower() for c in df.columns}
    have |= {k for k in K.REQUIRED_HEADERS if k in df.columns}
    rows = [(text, (text.strip().lower() in have) or (key in have), i)
            for i, (key, text) in enumerate(K.REQUIRED_HEADERS.items())]
    schema = "column string, present boolean, position int"
    return df.sparkSession.createDataFrame(rows, schema)


def _identifier_candidates(df: DataFrame, priority: list[str]) -> list[tuple[int, str, str]]:
    """(priority, header text, column in df) for candidates present in df."""
    idx = _header_index()
    by_key = {}
    for c in df.columns:
        key = idx.get(c.strip().lower(), c)
        by_key.setdefault(key, c)
    out = []
    for i, text in enumerate(priority):
        key = idx.get(text.strip().lower())
        if key in by_key:
            out.append((i, text, by_key[key]))
    return out


def identifier_detect(df: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """Identifier columns that hold data, in priority order: (position, column).

    One aggregate computes has-data for every candidate at once.
    """
    prio = priority or IDENTIFIERS
    cands = _identifier_candidates(df, prio)
    spark = df.sparkSession
    if not cands:
        return spark.createDataFrame([], "position int, column string")
    flags = df.agg(*[F.max(is_meaningful(F.col(f"`{c}`")).cast("int")).alias(f"h{i}")
                     for i, _, c in cands])
    stack = ", ".join(f"{i}, '{text}', h{i}" for i, text, _ in cands)
    return (flags.selectExpr(f"stack({len(cands)}, {stack}) as (position, column, has_data)")
            .where("has_data = 1").select(F.col("position").cast("int"), "column"))


def identifier_pick(df: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """First identifier column with data (empty result means the gate fails)."""
    det = identifier_detect(df, priority)
    return det.agg(F.min_by("column", "position").alias("identifier")).where(
        F.col("identifier").isNotNull())


def identifier_projection(df: DataFrame, id_col: str = "row_id",
                          priority: list[str] | None = None) -> DataFrame:
    cands = _identifier_candidates(df, priority or list(K.IDENTIFIER_HEADERS.values()))
    return df.select(id_col, *[F.col(c) for _, _, c in cands])


def case_number(df: DataFrame, order_col: str = "row_id", out: str = "case_no",
                buckets: int | None = None) -> DataFrame:
    """Sequential 1..n in ``order_col`` order; ``order_col`` must be unique.

    The bare key is numbered first (``positions.numbered``: range partitions of it, one count each at the driver), so
    that whatever lies upstream of the other columns runs once; one join brings the numbers to the rows. ``buckets``:
    range partitions; left out, Spark sizes them by their bytes.
    """
    numbers = numbered(df.select(order_col), [order_col], out, buckets)
    return df.join(numbers, order_col)


def feature_contract(present: list[str], fitted: list[str]) -> list[tuple[str, str]]:
    """(feature, source header) for fitted features missing from ``present``."""
    src = {f: K.REQUIRED_HEADERS[s] for f, s, _ in K.FEATURES}
    return [(f, src.get(f, f)) for f in fitted if f not in present]


def feature_contract_df(df: DataFrame, fitted: list[str]) -> DataFrame:
    """Left-anti of the fitted feature names against the columns present."""
    spark = df.sparkSession
    src = {f: K.REQUIRED_HEADERS[s] for f, s, _ in K.FEATURES}
    fitted_df = spark.createDataFrame([(i, f, src.get(f, f)) for i, f in enumerate(fitted)],
                                      "position int, feature string, source_column string")
    present_df = spark.createDataFrame([(c,) for c in df.columns], "feature string")
    return fitted_df.join(F.broadcast(present_df), "feature", "left_anti")


def unrecognised_values(df: DataFrame) -> DataFrame:
    """Cells that fall to an encoder's default: (column, value, count).

    Education: non-blank text matching no map key and no keyword.
    Income: non-blank text that does not parse as money.
    """
    items = []
    if "grau_escolaridade" in df.columns:
        c = F.col("grau_escolaridade")
        blank, key1, key2 = E.education_keys(c)
        words = "|".join(w for _, ws in K.EDUCATION_KEYWORDS for w in ws)
        known = (key1.isin(*K.EDUCATION_MAP) | key2.isin(*K.EDUCATION_MAP) | key2.rlike(words))
        items.append(F.struct(F.lit("grau_escolaridade").alias("column"), c.alias("value"),
                              (~blank & ~known).alias("bad")))
    if "remuneracao" in df.columns:
        c = F.col("remuneracao")
        bad = c.isNotNull() & (strip_u(c) != "") & E.to_number(E.money_text(c)).isNull()
        items.append(F.struct(F.lit("remuneracao").alias("column"), c.alias("value"), bad.alias("bad")))
    if not items:
        return df.sparkSession.createDataFrame([], "column string, value string, count long")
    # one pass over df: flags for every checked column from a single projection
    flagged = df.select(F.explode_outer(F.array(*items)).alias("u")).select("u.*")
    return flagged.where("bad").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


__all__ = ["resolve_headers", "has_meaningful_data", "drop_empty_rows", "required_columns",
           "identifier_detect", "identifier_pick", "identifier_projection", "case_number",
           "feature_contract", "feature_contract_df", "unrecognised_values", "clean_text"]

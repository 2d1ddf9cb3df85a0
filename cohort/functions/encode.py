"""Cell encoders: messy text cells -> numeric features.

Each encoder is ``Column -> Column`` built from ``pyspark.sql.functions``
only, so a whole feature matrix is one narrow projection inside a single
whole-stage-codegen stage.  Inputs are string cells (scan everything as
string; no type inference).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohort import contract as K
from cohort.functions.text import col, collapse_ws, normalize_text, once, strip_u

# Plain decimal number: sign, digits, optional fraction, optional exponent.
# Guards try_cast, which would also accept '12d', '12f', 'Infinity'.
NUMBER_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(c: str | Column) -> Column:
    """Stripped text that is a plain number -> double, else null."""
    return once(strip_u(col(c).cast("string")), lambda t: F.when(t.rlike(NUMBER_RE), t.try_cast("double")))


def coerce_number(c: str | Column, default: float = 0.0) -> Column:
    """Numeric cell or ``default`` (age)."""
    return F.coalesce(to_number(c), F.lit(float(default)))


def _level_lookup(key: Column) -> Column:
    """Exact education-map lookup, null when the key is not in the map."""
    expr = None
    for level in sorted(set(K.EDUCATION_MAP.values())):
        keys = [k for k, v in K.EDUCATION_MAP.items() if v == level]
        cond = key.isin(*keys)
        expr = F.when(cond, F.lit(level)) if expr is None else expr.when(cond, F.lit(level))
    return expr


def education_keys(c: str | Column) -> tuple[Column, Column, Column]:
    """(blank flag, text key, text key without ordinal marks) of an education cell."""
    raw = col(c)
    key = normalize_text(raw)
    return raw.isNull() | (strip_u(raw) == ""), key, F.translate(key, K.ORDINAL_MARKS, "")


def education_from_keys(blank: Column, key: Column, key2: Column) -> Column:
    """Education ordinal from precomputed keys (see ``education_keys``)."""
    kw = None
    for level, words in K.EDUCATION_KEYWORDS:
        cond = None
        for w in words:
            hit = key2.contains(w)
            cond = hit if cond is None else (cond | hit)
        kw = F.when(cond, F.lit(level)) if kw is None else kw.when(cond, F.lit(level))
    kw = kw.otherwise(F.lit(0))
    return (F.when(blank, F.lit(0))
            .otherwise(F.coalesce(_level_lookup(key), _level_lookup(key2), kw))
            .cast("int"))


def encode_education(c: str | Column) -> Column:
    """Education ordinal 0-3: exact map, again without ordinal marks, then keywords."""
    return education_from_keys(*education_keys(c))


def binary_from_key(n: Column) -> Column:
    """Yes/no decision on a collapsed key (null key = missing cell)."""
    return (F.when(n.isNull() | (n == ""), F.lit(0))
            .when(n.isin(*K.YES_VALUES), F.lit(1))
            .when(n.isin(*K.NO_VALUES), F.lit(0))
            .when(n.contains("sim"), F.lit(1))
            .otherwise(F.lit(0))).cast("int")


def parse_binary(c: str | Column) -> Column:
    """Yes/no cell -> 1/0: exact lists, then 'sim' substring; default 0."""
    return binary_from_key(collapse_ws(col(c)))


def marital_single(c: str | Column) -> Column:
    return F.coalesce(collapse_ws(c).isin(*K.SINGLE_VALUES), F.lit(False)).cast("int")


def marital_married(c: str | Column) -> Column:
    return F.coalesce(collapse_ws(c).isin(*K.MARRIED_VALUES), F.lit(False)).cast("int")


def money_text(c: str | Column) -> Column:
    """Money cell with 'R$'/'r$', spaces and '.' removed and ',' as decimal point."""
    t = strip_u(col(c).cast("string"))
    t = F.replace(F.replace(F.replace(t, F.lit("R$"), F.lit("")), F.lit("r$"), F.lit("")),
                  F.lit(" "), F.lit(""))
    return F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".")


def parse_money(c: str | Column) -> Column:
    """Brazilian money text -> double; unparsable or blank -> 0.0.

    Drops 'R$'/'r$', spaces and every '.', then ',' becomes the decimal point
    (so '1500.50' reads as 150050, like the rule it reproduces).
    """
    return F.coalesce(to_number(money_text(c)), F.lit(0.0))


def studying_flag(c: str | Column) -> Column:
    """1 only for the exact (stripped, lower-cased) value 'cursando'."""
    return F.coalesce(F.lower(strip_u(col(c))) == K.STUDYING_VALUE, F.lit(False)).cast("int")


def lower_key(c: str | Column) -> Column:
    return F.lower(strip_u(col(c)))


def employment_from_key(v: Column) -> Column:
    return (F.when(v.isin(*K.WORK_FORMAL), F.lit(K.SIGNAL_FORMAL))
            .when(v.isin(*K.WORK_INFORMAL), F.lit(K.SIGNAL_INFORMAL))
            .otherwise(F.lit(K.SIGNAL_NONE)))


def employment_signal(c: str | Column) -> Column:
    """1.0 formal, 0.6 informal, 0.0 unemployed / unknown / missing."""
    return employment_from_key(lower_key(c))



def substance_from_key(v: Column, missing: int = 1) -> Column:
    """Substance flag on a lower/stripped key (null key = missing cell)."""
    return (F.when(v.isNull(), F.lit(missing))
            .when((v == "") | (v == K.SUBSTANCE_NONE_VALUE), F.lit(0))
            .otherwise(F.lit(1))).cast("int")


def substance_flag(c: str | Column, missing: int = 1) -> Column:
    """0 for blank or 'não possui'; 1 for any other text; ``missing`` for null."""
    return substance_from_key(lower_key(c), missing)



def parse_date(c: str | Column, patterns: list[str] | None = None) -> Column:
    """Registration date text -> date; impossible or other formats -> null."""
    pats = K.DATE_PATTERNS if patterns is None else patterns
    t = strip_u(col(c))
    parsed = [F.to_date(F.try_to_timestamp(t, F.lit(p))) for p in pats]
    return parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)


def program_duration(c: str | Column, as_of: _dt.date | str,
                     patterns: list[str] | None = None) -> Column:
    """Months in programme: days since registration / 30, one decimal, bad date -> 0."""
    as_of_d = F.lit(as_of).cast("date")
    days = F.datediff(as_of_d, parse_date(c, patterns))
    return F.coalesce(F.round(days / F.lit(K.DAYS_PER_MONTH), 1), F.lit(0.0))

"""Text keys and cell predicates, as native Column expressions.

All functions take a column name or a ``Column`` and return a ``Column``;
they compile into whole-stage codegen (no Python workers).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohort import contract as K

# Unicode whitespace (what Python's str.split/strip treat as blanks), as an
# explicit set: btrim strips it without a regex, and a plain character class
# is much cheaper than the (?U) Unicode-class flag.  Spark's trim removes only
# U+0020.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003"
              "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_WS_CLASS = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}" \
            "\\x{202f}\\x{205f}\\x{3000}]"
_ANY_WS = _WS_CLASS + "+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)`` with x worked out once: a column used in several terms is copied into each of them and into what they are part of."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def strip_u(c: str | Column) -> Column:
    """Unicode-aware strip of leading and trailing whitespace."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def collapse_ws(c: str | Column) -> Column:
    """Lower-case, whitespace runs to one space, stripped; null stays null."""
    return strip_u(F.regexp_replace(F.lower(col(c)), _ANY_WS, " "))


def normalize_text(c: str | Column) -> Column:
    """Matching key: null -> '', strip, lower, fold the listed accents."""
    return F.translate(F.lower(strip_u(F.coalesce(col(c), F.lit("")))),
                       K.ACCENT_FROM, K.ACCENT_TO)


def is_meaningful(c: str | Column) -> Column:
    """Cell holds data: not null, not blank, not the words nan/none."""
    v = col(c).cast("string")
    return v.isNotNull() & ~F.lower(strip_u(v)).isin(*K.MISSING_WORDS)


def clean_text(c: str | Column, default: str | None = "") -> Column:
    """Stripped text of a meaningful cell, else ``default``."""
    return once(strip_u(col(c).cast("string")), lambda v: F.when(v.isNotNull() & ~F.lower(v).isin(*K.MISSING_WORDS), v).otherwise(F.lit(default)))


def null_tokens(c: str | Column, tokens: list[str] | None = None) -> Column:
    """Missing-value tokens of a delimited-text reader become null."""
    toks = K.NA_TOKENS if tokens is None else tokens
    v = col(c)
    return F.when(v.isin(*toks), F.lit(None).cast("string")).otherwise(v)


def _split(a: Column) -> tuple[Column, Column]:
    """Veltkamp split of a double into two 26-bit halves (a = hi + lo exactly)."""
    c = a * F.lit(134217729.0)  # 2**27 + 1
    hi = c - (c - a)
    return hi, a - hi


def round_half_even(x: Column, digits: int) -> Column:
    """Round like Python's round()/format(): on the EXACT binary value, ties to even.

    ``x * 10**digits`` can itself round onto a .5 (2.675 * 100 == 267.5 in
    doubles although 2.675 is stored as 2.67499...); Dekker's error-free
    product tells on which side of the tie the exact product lies.  The input
    is bound once to a lambda variable, so a large ``x`` is not copied into
    every term.
    """
    scale = float(10 ** digits)

    def rnd(v: Column) -> Column:
        ax = F.abs(v)
        p = ax * F.lit(scale)
        ahi, alo = _split(ax)
        shi, slo = _split(F.lit(scale))
        err = ((ahi * shi - p) + ahi * slo + alo * shi) + alo * slo  # exact: ax*scale = p + err
        f = F.floor(p).cast("double")
        frac = p - f
        up = (F.when(frac > 0.5, F.lit(True)).when(frac < 0.5, F.lit(False))
              .when(err > 0, F.lit(True)).when(err < 0, F.lit(False))
              .otherwise(F.pmod(f, F.lit(2.0)) == 1.0))
        r = (f + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(scale)
        return F.when(v < 0, -r).otherwise(r)

    return F.transform(F.array(x.cast("double")), rnd).getItem(0)


def fixed(x: Column, digits: int) -> Column:
    """Text of ``x`` with ``digits`` decimals, ties to even (f'{x:.2f}' style)."""
    return F.format_string(f"%.{digits}f", round_half_even(x, digits))

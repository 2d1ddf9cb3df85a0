"""Gates measured in the very write that lands a sheet.

``Observation`` metrics ride along the landing job: no pass of their own, however many gates. They are counts of rows,
so that missing headers, empty columns, identifiers, the feature contract and unrecognised values are all
judged by the data and not by column names alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohort import contract as K
from cohort.functions import encode as E
from cohort.functions.text import is_meaningful, strip_u
from cohort.operators.gates import IDENTIFIERS, resolve_headers
from cohort.sources.scan import land


@dataclass(frozen=True)
class Gates:
    """What a landing has seen. ``filled``: meaningful cells by canonical column."""

    rows: int
    empty_rows: int
    filled: dict[str, int]
    unrecognised: dict[str, int] = field(default_factory=dict)

    @property
    def has_data(self) -> bool:
        return any(self.filled.values())

    def missing_headers(self) -> list[str]:
        """Required headers that are absent or hold no data, in contract order."""
        return [text for key, text in K.REQUIRED_HEADERS.items() if not self.filled.get(key)]

    def identifiers(self) -> list[str]:
        """Identifier headers with data, by priority; the first is the one to use."""
        keys = {text: key for key, text in {**K.IDENTIFIER_HEADERS, **K.EXTRA_IDENTIFIER_HEADERS}.items()}
        return [text for text in IDENTIFIERS if self.filled.get(keys[text])]

    def missing_features(self, fitted: list[str]) -> list[tuple[str, str]]:
        """(feature, source header) of fitted features whose source holds no data."""
        source = {f: s for f, s, _ in K.FEATURES}
        return [(f, K.REQUIRED_HEADERS[source[f]]) for f in fitted if not self.filled.get(source[f])]


def _unrecognised(df: DataFrame) -> dict[str, Column]:
    """Whether a cell falls to its encoder's default, by column."""
    found = {}
    if "grau_escolaridade" in df.columns:
        blank, key1, key2 = E.education_keys(F.col("grau_escolaridade"))
        words = "|".join(w for _, ws in K.EDUCATION_KEYWORDS for w in ws)
        found["grau_escolaridade"] = ~blank & ~(key1.isin(*K.EDUCATION_MAP) | key2.isin(*K.EDUCATION_MAP) | key2.rlike(words))
    if "remuneracao" in df.columns:
        c = F.col("remuneracao")
        found["remuneracao"] = c.isNotNull() & (strip_u(c) != "") & E.to_number(E.money_text(c)).isNull()
    return found


def land_observed(sheet: DataFrame, base: str, stem: str) -> tuple[str, Gates]:
    """Land a sheet under its canonical columns; returns the folder and what its gates have counted on the way."""
    df = resolve_headers(sheet)
    cells = [c for c in df.columns if c != "row_id"]
    quoted = {c: F.col(f"`{c}`") for c in cells}
    empty = F.lit(True)
    for c in quoted.values():
        empty &= c.isNull()
    bad = _unrecognised(df)
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("empty"),
                         *[F.count_if(is_meaningful(c)).alias(f"filled {name}") for name, c in quoted.items()],
                         *[F.count_if(b).alias(f"bad {name}") for name, b in bad.items()])
    folder = land(watched, base, stem)
    got = seen.get
    return folder, Gates(got["rows"], got["empty"], {c: got[f"filled {c}"] for c in cells}, {c: got[f"bad {c}"] for c in bad})

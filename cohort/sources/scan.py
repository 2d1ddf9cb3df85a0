"""Delimited-text and Parquet sources.

* ``probe``: (encoding, delimiter, header) of ONE format; the encoding is
  decided by the validity of all bytes, delimiter and header by the first
  line.  For folders of several formats use ``read_many``.
* ``read_delimited``: one ``spark.read.csv`` over any number of files with an
  explicit all-string schema (no inference) and a corrupt-record column;
  lines with MORE fields than the header are dropped, shorter lines are
  padded with nulls.  Reader NA tokens become null.
* ``read_many``: a format per file, quoted line breaks (``records``).
* ``land``: write a canonical copy without ever overwriting (``_1``, ``_2``...).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort import contract as K
from cohort.functions.text import null_tokens
from cohort.sources.publish import claim, put

CORRUPT = "_corrupt_record"
_PROBE_LINES = 50


@dataclass(frozen=True)
class Format:
    encoding: str
    sep: str
    header: tuple[str, ...]


def _split_header(line: str, sep: str) -> list[str]:
    import csv
    return next(csv.reader([line], delimiter=sep))


def _raw_lines(spark: SparkSession, path: str, encoding: str) -> list[str]:
    """First lines decoded with ``encoding`` (the text source is UTF-8 only, so
    read through the CSV reader with a separator and quote that never occur)."""
    df = (spark.read.option("encoding", encoding).option("sep", "\u0001")
          .option("quote", "\u0000").option("header", False)
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .schema("line string").csv(path))
    return [r[0] or "" for r in df.limit(_PROBE_LINES).collect()]


def _undecodable(spark: SparkSession, path: str) -> bool:
    """Whether any line of the input is no valid UTF-8, by its bytes; stops at the first. A real U+FFFD is valid."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return not lines.where(~F.is_valid_utf8("value")).limit(1).isEmpty()


def probe(spark: SparkSession, path: str) -> Format:
    """Encoding decided over the whole input; delimiter and header from its first lines."""
    encodings = list(K.PROBE_ENCODINGS)
    lines = _raw_lines(spark, path, encodings[0])
    if not lines:
        raise ValueError(f"empty input: {path}")
    if _undecodable(spark, path):  # some byte of the whole input isn't UTF-8: the next encoding
        encodings = encodings[1:] or encodings
        lines = _raw_lines(spark, path, encodings[0])
    head = lines[0].lstrip("﻿")
    for enc in encodings:
        for sep in K.PROBE_DELIMITERS:
            cols = _split_header(head, sep)
            if len(cols) > 1 and len(lines) > 1:
                return Format(enc, sep, tuple(c.strip() for c in cols))
    raise ValueError("no encoding/delimiter combination gives more than one column")


def _field_count(text: Column, sep: str) -> Column:
    """Number of fields of a raw line, ignoring separators inside quotes."""
    s = "\\t" if sep == "\t" else ("\\" + sep if sep in ".|;" else sep)
    pattern = f'{s}(?=(?:[^"]*"[^"]*")*[^"]*$)'
    return F.size(F.split(text, pattern, -1))


def read_delimited(spark: SparkSession, paths: str | list[str], fmt: Format,
                   na_tokens: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """All-string scan with the bad-line policy and NA tokens applied.

    Quotes inside quoted cells are doubled. ``multi_line`` allows line breaks in quoted cells; a file is then
    one split, so leave it off for large files that don't need it.
    """
    names = list(fmt.header)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))] +
                          [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(schema)
          .option("header", True).option("sep", fmt.sep).option("encoding", fmt.encoding)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
          .option("multiLine", multi_line).option("enforceSchema", True).option("escape", '"')
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .csv(paths))
    keep = F.col(CORRUPT).isNull() | (_field_count(F.col(CORRUPT), fmt.sep) <= len(names))
    cols = [null_tokens(F.col(f"_c{i}"), na_tokens).alias(n) for i, n in enumerate(names)]
    return df.where(keep).select(*cols)


def read_many(spark: SparkSession, paths: list[str], na_tokens: list[str] | None = None) -> DataFrame:
    """Every file by its own encoding, separator and header, quoted line breaks included (``records``)."""
    from cohort.sources.records import read_sheets
    return read_sheets(spark, paths, na_tokens)


def write_delimited(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8",
                    mode: str = "errorifexists") -> None:
    """CSV sink with a header, cells written verbatim (no edge trimming).

    ``UTF-8-SIG`` begins every file with a byte order mark, before the first header cell.
    """
    if encoding.upper() == "UTF-8-SIG":
        df, encoding = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]), "UTF-8"
    (df.write.mode(mode).option("header", True).option("sep", sep).option("encoding", encoding).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("emptyValue", "").option("nullValue", "")
     .csv(path))


def land(df: DataFrame, base: str, stem: str, fmt: str = "parquet") -> str:
    """Write a canonical copy as ``<stem>_convertido`` (or ``_1``, ``_2``...): names are claimed, copies appear whole."""
    spark = df.sparkSession
    target = f"{base.rstrip('/')}/{claim(spark, base, f'{stem}_convertido')}"

    def write(folder: str) -> None:
        writer = df.write.mode("errorifexists")
        if fmt == "parquet":
            writer.parquet(folder)
        else:
            writer.option("header", True).csv(folder)

    put(spark, target, write)
    return target

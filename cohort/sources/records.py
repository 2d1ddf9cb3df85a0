"""Delimited sheets as records: a format per file, quoted line breaks, and input order, on splittable files.

1. ``landed_lines`` writes the physical lines of all files once, as bytes, with their place: file, start of the split
   (``_metadata``), number within the scan. Everything after reads these, so that places never shift between passes.
2. ``file_formats``: one aggregate per file. A file whose every byte sequence is valid UTF-8 is UTF-8 (a real U+FFFD is as
   good as any character), else the next encoding; separator and header come from its own first line.
3. Records may go on over line breaks inside quotes. A line is a function from "begins outside quotes" or "inside" to how it
   ends; such functions compose associatively, so a prefix scan - within splits, then over the splits of a file - says for
   every line of every split whether it begins inside quotes. Only files with a line that ends inside quotes are scanned,
   and only the lines of records that take several are put together.
4. Records are cut into cells by ``from_csv``, per format; frames are put together by column name.

Quotes count as Python's ``csv`` counts them: a quote opens a cell at its beginning only, doubled ones are a character.
Lines end with LF or CR LF. Records with more cells than the header are dropped, shorter ones padded with nulls; so is
a record dropped whose quote never closes (it is never gathered). Blank lines are no records. A file with a header only
has no rows but its columns; files without a line are ignored; a path without any raises.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort import contract as K
from cohort.functions.text import null_tokens
from cohort.session import shared_table

PLACE = ["file", "split", "at"]


@dataclass(frozen=True)
class Format:
    encoding: str
    sep: str
    header: tuple[str, ...]


def landed_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, split, at, value): physical lines as they are, ``value`` holding the file's bytes."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    text = spark.read.option("lineSep", "\n").text(paths)
    return shared_table(text.select(*meta, F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value")), "lines")


def _class(sep: str) -> str:
    return "\\t" if sep == "\t" else "\\" + sep


def _ends_inside(line: Column, sep: str, begins_inside: bool) -> Column:
    """Whether a line ends inside quotes, if it begins outside (or inside) them."""
    s = _class(sep)
    quoted, rest = '(?:[^"]++|"")*+', f"[^{s}]*+"
    outside = f'(?:(?:"{quoted}"{rest}|[^"{s}]{rest}|){s})*+"{quoted}\\z'
    pattern = f'\\A{quoted}(?:\\z|"{rest}{s}{outside})' if begins_inside else f"\\A{outside}"
    return F.when(line.contains('"'), line.rlike(pattern)).otherwise(F.lit(begins_inside))


def _cells(record: Column, sep: str) -> Column:
    """Number of cells of a record: separators outside quotes, and one."""
    s = _class(sep)
    return F.regexp_count(record, F.lit(f'\\G(?:"(?:[^"]++|"")*+"[^{s}]*+|[^"{s}][^{s}]*+|){s}')) + 1


def _text(value: Column, utf8: Column) -> Column:
    """Bytes as text: UTF-8, or the encoding that knows every byte."""
    return F.when(utf8, value.cast("string")).otherwise(F.decode(value, K.PROBE_ENCODINGS[1]))


def header_cells(line: str, sep: str) -> list[str]:
    import csv

    return [c.strip() for c in next(csv.reader([line.removeprefix("﻿").removesuffix("\r")], delimiter=sep))]


def file_formats(lines: DataFrame) -> tuple[DataFrame, list[Format]]:
    """(file, utf8, sep, crosses, format, first) per file, and the different formats in order of ``format``.

    ``crosses``: some line ends inside quotes; ``first``: place of the header line.
    The driver sees the different header lines, not the files.
    """
    seps = list(K.PROBE_DELIMITERS)
    text = F.col("value").cast("string")
    per_file = lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8(text)).alias("utf8"), F.min(F.struct("split", "at")).alias("first"), F.min_by("value", F.struct("split", "at")).alias("head"),
        *[F.bool_or(_ends_inside(F.decode("value", "ISO-8859-1"), s, False)).alias(f"cross{i}") for i, s in enumerate(seps)])
    per_file = shared_table(per_file, "file-formats")
    heads = [(r["head"], r["utf8"]) for r in per_file.select("head", "utf8").distinct().collect()]
    if not heads:
        raise ValueError("no lines")
    formats: dict[Format, int] = {}
    rows = []
    for head, utf8 in heads:
        encoding = K.PROBE_ENCODINGS[0] if utf8 else K.PROBE_ENCODINGS[1]
        line = bytes(head).decode("utf-8" if utf8 else "latin-1")
        sep = next((s for s in seps if len(header_cells(line, s)) > 1), None)
        if sep is None:
            raise ValueError("no separator gives more than one column: " + line[:80])
        known = formats.setdefault(Format(encoding, sep, tuple(header_cells(line, sep))), len(formats))
        rows.append((bytearray(head), utf8, seps.index(sep), known))
    found = lines.sparkSession.createDataFrame(rows, "head binary, utf8 boolean, sep int, format int")
    crosses = F.element_at(F.array(*[f"cross{i}" for i in range(len(seps))]), F.col("sep") + 1)
    return per_file.join(found, ["head", "utf8"]).select("file", "utf8", "sep", crosses.alias("crosses"), "format", "first"), list(formats)


def _state(start: Column, constant: Column, flips: Column) -> Column:
    """Inside quotes or not, after functions whose last constant is ``constant`` (null: none), with ``flips`` since."""
    return F.coalesce(constant, start) != (flips % 2 == 1)


def _running(df: DataFrame, over, upto: int) -> DataFrame:
    """Adds ``constant`` and ``flips`` of the composition of f0, f1 over the window's rows, up to ``upto`` (0: this row, -1: the one before)."""
    fixed, flip = F.col("f0") == F.col("f1"), F.col("f0") & ~F.col("f1")
    until = over.rowsBetween(Window.unboundedPreceding, upto)
    all_flips = F.coalesce(F.sum(flip.cast("long")).over(over.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    df = df.withColumns({"flips_": all_flips, "fixed_": fixed})
    before = F.coalesce(F.last(F.when(F.col("fixed_"), F.col("flips_")), ignorenulls=True).over(until), F.lit(0))
    now = F.coalesce(F.last("flips_").over(until), F.lit(0))
    return df.withColumns({"constant": F.last(F.when(F.col("fixed_"), F.col("f0")), ignorenulls=True).over(until), "flips": now - before}).drop("flips_", "fixed_")


def assembled(lines: DataFrame, seps: list[str]) -> DataFrame:
    """Records (file, split, at, text) of lines (file, split, at, text, sep): quoted line breaks join lines."""
    by_sep = lambda inside: F.coalesce(*[F.when(F.col("sep") == i, _ends_inside(F.col("text"), s, inside)) for i, s in enumerate(seps)])
    lines = shared_table(lines.withColumns({"f0": by_sep(False), "f1": by_sep(True)}), "quote-lines")
    in_split = Window.partitionBy("file", "split").orderBy("at")
    in_file = Window.partitionBy("file").orderBy("split")
    # the splits of a file: the function of each, composed; a split has one row here
    whole = _running(lines.select("file", "split", "at", "f0", "f1"), in_split, 0)
    whole = whole.groupBy("file", "split").agg(F.max_by(F.struct("constant", "flips"), "at").alias("f"))
    whole = whole.select("file", "split", _state(F.lit(False), F.col("f.constant"), F.col("f.flips")).alias("f0"), _state(F.lit(True), F.col("f.constant"), F.col("f.flips")).alias("f1"))
    starts = _running(whole, in_file, -1).select("file", "split", _state(F.lit(False), F.col("constant"), F.col("flips")).alias("inside"))
    starts = shared_table(starts, "quote-splits")
    # every line: does it begin inside quotes; a line that begins outside begins a record
    placed = _running(lines, in_split, -1).join(starts, ["file", "split"]).withColumn("begins", ~_state(F.col("inside"), F.col("constant"), F.col("flips")))
    placed = placed.withColumn("ends", F.when(F.col("begins"), ~F.col("f0")).otherwise(~F.col("f1")))
    own = F.max(F.when(F.col("begins"), F.struct("split", "at"))).over(in_split.rowsBetween(Window.unboundedPreceding, 0))
    placed = shared_table(placed.select("file", "split", "at", "text", "begins", "ends", own.alias("own")), "quote-records")
    # lines that go on with a record of an earlier split take the last beginning before their split
    last = placed.groupBy("file", "split").agg(F.max("own").alias("last"), F.max_by("ends", "at").alias("closed"))
    carried = shared_table(last.select("file", "split", F.last("last", ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
                                       F.max("last").over(Window.partitionBy("file")).alias("final"),
                                       F.last("closed").over(in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("closed")), "quote-carried")
    met = placed.join(carried, ["file", "split"]).withColumn("record", F.coalesce("own", "carried"))
    met = met.where(F.col("closed") | (F.col("record") != F.col("final")))  # a quote that never closes: no record
    alone = met.where("begins and ends").select(*PLACE, "text")
    several = met.where("not (begins and ends)").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("split", "at", "text"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return alone.unionByName(several.select("file", F.col("record.split").alias("split"), F.col("record.at").alias("at"), joined.alias("text")))


def records_of(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """(file, split, at, format, text): all records but the headers, decoded."""
    known = lines.join(formats, "file")
    text = known.withColumn("text", _text(F.col("value"), F.col("utf8")))
    # the byte order mark stands before the first cell, which may be quoted
    text = text.withColumn("text", F.when((F.col("split") == F.col("first.split")) & (F.col("at") == F.col("first.at")), F.ltrim("text", F.lit("﻿"))).otherwise(F.col("text")))
    plain = text.where("not crosses").select(*PLACE, "text")
    several = assembled(text.where("crosses").select(*PLACE, "text", "sep"), list(K.PROBE_DELIMITERS))
    records = plain.unionByName(several).join(formats.select("file", "format", "first"), "file")
    records = records.where((F.col("split") != F.col("first.split")) | (F.col("at") != F.col("first.at")))
    return records.select(*PLACE, "format", F.regexp_replace("text", "\\r\\z", "").alias("text")).where(F.col("text").rlike("\\S"))


def read_sheets(spark: SparkSession, paths: str | list[str], na_tokens: list[str] | None = None, places: bool = False) -> DataFrame:
    """All cells as strings, under the union of the files' headers; ``places`` keeps file, split and at (see ``positions``).

    Columns that a file lacks are null there. Equal names in one header get ``.1``, ``.2``, ...
    """
    lines = landed_lines(spark, paths)
    table, formats = file_formats(lines)
    table = shared_table(table, "file-formats")
    records = records_of(lines, table)
    if len(formats) > 1 or not table.where("crosses").isEmpty():
        records = shared_table(records, "records")
    out = None
    for k, fmt in enumerate(formats):
        names = _unique(fmt.header)
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("bad", T.StringType())])
        options = {"sep": fmt.sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "maxCharsPerColumn": "-1"}
        cut = records.where(F.col("format") == k).withColumn("row", F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options))
        cut = cut.where(F.col("row.bad").isNull() | (_cells(F.col("text"), fmt.sep) <= len(names)))
        cells = [null_tokens(F.col(f"row._c{i}"), na_tokens).alias(n) for i, n in enumerate(names)]
        part = cut.select(*([F.col(c).alias(f"_{c}") for c in PLACE] if places else []), *cells)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _unique(names: tuple[str, ...]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}.{k}" if k else n)
    return out

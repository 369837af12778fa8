"""CSV ledgers: readers, merge, dated scan, sinks and preview.

Columns are read as strings and bound **by header name** (never by
position): the files below a folder are grouped by their header line, each group
is read on its own (a file that does not match fails), and the groups are
united by name; a column that a file does not hold may be given by a ``name=value``
folder around it.  Quotes inside a field are doubled, spaces at its edges are
kept.  ``multiLine`` stays off by default so that large files split into many
tasks; fields with line breaks need it on reading.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import LEDGER_COLUMNS

# The text cells that pandas reads as missing by default.
NA_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Header spellings accepted for the canonical ledger columns (Spark resolves
# names case-insensitively, so only real spelling differences are listed).
COLUMN_ALIASES = {"Subcategory": "Sub_Category", "Product Name": "Description"}

# prices as entered; sums are rounded to cents once, after adding up
PRICE = "decimal(20,6)"

# as entered, as written back, and with a time of day
DATE_PATTERNS = ("M/d/yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
                 "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss")
_QUOTING = {"quote": '"', "escape": '"'}
# all *.csv files below a folder, however deep
_FOLDERS = {"pathGlobFilter": "*.[cC][sS][vV]", "recursiveFileLookup": "true"}


def na_to_null(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isin(list(NA_TOKENS)), F.lit(None).cast("string")).otherwise(col)


def source_name_of(path: str) -> str:
    """Base name up to the first dot (``a/b/Food - Fast Food.csv`` -> ``Food - Fast Food``)."""
    return os.path.basename(path.rstrip("/")).split(".")[0]


def source_name_col() -> Column:
    """Per-row source name from the file actually read (percent-decoded): the
    file's, or that of the nearest folder around it that is named ``*.csv``."""
    path = F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")
    folder = F.regexp_extract(path, r"(?i).*/([^/]+\.csv)/", 1)
    named = F.when(folder != "", folder).otherwise(F.element_at(F.split(path, "/"), -1))
    return F.substring_index(F.url_decode(named), ".", 1)


def _check_suffix(path: str) -> None:
    base = os.path.basename(path.rstrip("/"))
    if "." in base and not base.lower().endswith(".csv") and not any(ch in base for ch in "*?["):
        raise ValueError(f"not a .csv path: {path}")


def _reader(spark: SparkSession, multi_line: bool):
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("enforceSchema", False).option("multiLine", multi_line)
            .options(**_FOLDERS).option("encoding", "UTF-8").options(**_QUOTING))


def _one_row(batches):
    """The first row of a partition; the rest is not read."""
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def header_groups(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """``(header line, files)`` of the ``*.csv`` files at ``path`` (a file, folder
    or pattern; folders inside folders included, also ``name=value`` ones).

    A Spark job reads the first lines: every file is one partition of its own (in
    a session whose file packing says so), of which one row is taken, so that
    the files are opened by the executors, side by side, and no further than their
    first block.  The driver gets the names and distinct headers it needs to
    plan the reads; empty files have no row."""
    probe = spark.newSession()
    whole = str(1 << 60)          # a file is never split, and never packed with another
    probe.conf.set("spark.sql.files.maxPartitionBytes", whole)
    probe.conf.set("spark.sql.files.openCostInBytes", whole)
    probe.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        lines = probe.read.options(**_FOLDERS).option("encoding", "UTF-8").text(path)
        firsts = lines.select("value", "_metadata.file_path").mapInArrow(
            _one_row, "value string, file_path string")
        decoded = F.url_decode(F.regexp_replace("file_path", r"\+", "%2B"))
        found = (firsts.select(F.regexp_replace("value", "^\ufeff", "").alias("header"),
                               decoded.alias("file"))
                 .groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
                 .collect())
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no such path: {path}") from None
        raise
    return sorted(((r.header, r.files) for r in found), key=lambda g: g[1][0])


def read_csv(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """All-string CSV with a header; below folders only ``*.csv`` files, which
    must have the same header (``read_ledger`` takes mixed ones)."""
    _check_suffix(path)
    return _reader(spark, multi_line).csv(path)


def _resolve(df: DataFrame, name: str) -> str | None:
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    for alias, canon in COLUMN_ALIASES.items():
        if canon.lower() == name.lower():
            for c in df.columns:
                if c.lower() == alias.lower():
                    return c
    return None


def read_ledger(spark: SparkSession, source, *, columns: Sequence[str] = LEDGER_COLUMNS,
                extra: Sequence[str] = (), ordinal: int = 0,
                multi_line: bool = False) -> DataFrame:
    """A ledger from a CSV path (or a DataFrame, passed through).

    Output: ``columns`` (+ ``extra``) as strings with NA tokens made null,
    ``_source`` (name of the file a row is from) and ``_pos`` — a sortable position
    ``(ordinal, file path, block start, row id)`` that makes "first row"
    well defined for ``dedupe_first``.  A required column that is missing
    raises, as a by-name selection does.
    """
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        raise ValueError("source must be a file path or a DataFrame")
    _check_suffix(source)
    groups = header_groups(spark, source)
    if not groups:
        raise ValueError(f"no CSV file with a header at {source}")
    parts = []
    for _, files in groups:
        raw = _reader(spark, multi_line).csv(source if len(groups) == 1
                                             else [_literal(f) for f in files])
        cols = []
        for name in (*columns, *extra):
            found = _resolve(raw, name)
            if found is not None:
                value = F.col(f"`{found}`")
            elif all(f"/{name.lower()}=" in f.lower() for f in files):
                value = _folder_value(name)
            else:
                raise KeyError(f"column {name!r} not in {files[0]}: {raw.columns}")
            cols.append(na_to_null(value).alias(name))
        pos = F.struct(F.lit(ordinal).alias("ordinal"),
                       F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("row"))
        parts.append(raw.select(*cols, source_name_col().alias("_source"), pos.alias("_pos")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _literal(file: str) -> str:
    """A file name with the characters of patterns escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", file)


def _folder_value(name: str) -> Column:
    """The value that a ``name=value`` folder gives a row."""
    path = F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")
    value = F.regexp_extract(path, f"(?i)/{re.escape(name)}=([^/]*)/", 1)
    return F.when(value != "__HIVE_DEFAULT_PARTITION__", F.url_decode(value))


def merge_sources(spark: SparkSession, paths: Sequence[str], *, min_files: int = 2,
                  max_files: int = 8, require_labels: bool = False,
                  columns: Sequence[str] = LEDGER_COLUMNS,
                  extra: Sequence[str] = (), multi_line: bool = False) -> DataFrame:
    """Concatenate 2..8 ledgers in list order (``_pos`` carries the order).
    With ``require_labels`` rows missing Category or Sub_Category are dropped."""
    paths = list(paths)
    if not (min_files <= len(paths) <= max_files):
        raise ValueError(f"a merge takes {min_files} to {max_files} ledgers, not {len(paths)}")
    parts = [read_ledger(spark, p, columns=columns, extra=extra, ordinal=i,
                         multi_line=multi_line) for i, p in enumerate(paths)]
    merged = reduce(lambda a, b: a.unionByName(b), parts)
    if require_labels:
        merged = merged.dropna(how="any", subset=["Category", "Sub_Category"])
    return merged


def parse_date(c: str | Column, patterns: Sequence[str] = DATE_PATTERNS) -> Column:
    """The date in the first of ``patterns`` that fits; blank is null, anything
    else fails the job."""
    col = F.trim(F.col(c) if isinstance(c, str) else c)
    parsed = F.coalesce(*[F.try_to_date(col, p) for p in patterns])
    return (F.when(col.isNull() | (col == ""), F.lit(None).cast("date"))
            .when(parsed.isNull(), F.raise_error(F.concat(F.lit("bad date: "), col))
                  .cast("date"))
            .otherwise(parsed))


def read_dated(spark: SparkSession, path: str, *, extra: Sequence[str] = (),
               multi_line: bool = False, patterns: Sequence[str] = DATE_PATTERNS) -> DataFrame:
    """Dated, priced ledger: ``Description, Category, Sub_category, Price
    decimal(20,6), Date date``."""
    led = read_ledger(spark, path, columns=["Description", "Category", "Sub_category",
                                            "Price", "Date"], extra=extra,
                      multi_line=multi_line)
    return (led.withColumn("Price", F.col("Price").cast(PRICE))
            .withColumn("Date", parse_date("Date", patterns)))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header CSV, UTF-8, one folder of part files (dates come out ISO).  Values
    come out as they are: edge spaces kept, quotes doubled, line breaks inside
    quotes (read such files with ``multi_line``)."""
    (df.write.mode(mode).option("header", True).option("encoding", "UTF-8").options(**_QUOTING)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    return path


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite",
                      extra: Sequence[str] = ()) -> str:
    """Prediction sink ``Description, Category, Subcategory`` (+ ``extra``)."""
    out = df.select("Description", "Category", F.col("Sub_Category").alias("Subcategory"),
                    *extra)
    return write_csv(out, path, mode)


def read_predictions(spark: SparkSession, path: str, *, extra: Sequence[str] = (),
                     multi_line: bool = False) -> DataFrame:
    """Read a prediction file back; an empty description comes back null."""
    led = read_ledger(spark, path, extra=extra, multi_line=multi_line)
    return led.withColumn("Description", F.nullif(F.col("Description"), F.lit("")))


def preview(df: DataFrame, n: int = 5, order_by: str | Sequence[str] = "_pos") -> DataFrame:
    """First ``n`` rows in source order, every cell as text (a top-n sort,
    planned as TakeOrderedAndProject: no global sort)."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*order).limit(n).select(
        *[F.col(c).cast("string").alias(c) for c in df.columns if not c.startswith("_")])

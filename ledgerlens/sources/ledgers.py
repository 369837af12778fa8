"""Dated ledgers on shared storage: by month, and in order.

``write_by_month`` keeps a ledger as Parquet in one folder per calendar month.
Writing a corrected month replaces that month's files alone; a period filter on
the date also becomes a filter on the folders, so a month's total reads one folder.
``write_in_order`` writes a table whose part files, read in the order of their names,
give the rows in the order asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.summary import period_bounds, period_filter
from .csv import write_csv

MONTH = "month"            # the folder column, yyyy-MM
NO_DATE = "none"           # ... of rows without a date


def month_of(date: str | Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(NO_DATE))


def write_by_month(ledger: DataFrame, path: str, *, date: str = "Date",
                   months: Sequence[str] | None = None) -> str:
    """Write every month that ``ledger`` holds, in place of what the folder has for
    it; other months stay.  ``months``: only these (and a named month that the
    ledger does not hold is emptied by writing no rows to it: pass the rest of it).

    Rows are dealt by month and rebalanced by adaptive execution: a large month
    becomes several tasks' files, small ones share a task."""
    rows = ledger.withColumn(MONTH, month_of(date))
    if months is not None:
        rows = rows.where(F.col(MONTH).isin(list(months)))
    (rows.hint("rebalance", F.col(MONTH)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path))
    return path


def read_by_month(spark: SparkSession, path: str) -> DataFrame:
    """The ledger with its ``month`` column (a string)."""
    probe = spark.read.option("basePath", path).parquet(path)
    return probe.withColumn(MONTH, F.col(MONTH).cast("string"))


def months_between(as_of, period: str) -> list[str]:
    start, end = period_bounds(as_of, period)
    first, last = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last)]


def period_rows(ledger: DataFrame, as_of, period: str, *, date: str = "Date") -> DataFrame:
    """Rows of the month or year of ``as_of``; only their folders are read."""
    return ledger.where(F.col(MONTH).isin(months_between(as_of, period))
                        & period_filter(date, as_of, period))


def write_in_order(df: DataFrame, path: str, order: Sequence[str | Column] = ("_pos",),
                   columns: Sequence[str] | None = None) -> str:
    """CSV whose part files in the order of their names hold the rows in ``order``:
    a range-partitioned sort, written by all tasks (no single one holds the rows).
    Read back by ``read_ledger``, ``_pos`` gives the same order."""
    keep = list(columns) if columns else [c for c in df.columns if not c.startswith("_")]
    return write_csv(df.orderBy(*order).select(*keep), path)

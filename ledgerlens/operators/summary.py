"""Month-to-date / year-to-date spending and the two-level category tree.

"MTD" and "YTD" are the whole calendar month / year that contains ``as_of``
(future-dated rows included).  Period filters are half-open ranges on the date
column so they reach the Parquet scan as pushed filters and let a ledger
partitioned by month prune files.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..taxonomy import MAX_TAXONOMY, taxonomy_df

MONEY = "decimal(18,2)"


def _as_date(as_of) -> dt.date:
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    if isinstance(as_of, dt.date):
        return as_of
    return dt.date.fromisoformat(str(as_of))


def period_bounds(as_of, period: str) -> tuple[dt.date, dt.date]:
    """Half-open ``[start, end)`` of the calendar month or year of ``as_of``."""
    d = _as_date(as_of)
    if period == "month":
        start = d.replace(day=1)
        end = (start.replace(year=start.year + 1, month=1) if start.month == 12
               else start.replace(month=start.month + 1))
    elif period == "year":
        start = d.replace(month=1, day=1)
        end = start.replace(year=start.year + 1)
    else:
        raise ValueError("period must be 'month' or 'year'")
    return start, end


def period_filter(date_col: str | Column, as_of, period: str) -> Column:
    start, end = period_bounds(as_of, period)
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return (c >= F.lit(start)) & (c < F.lit(end))


def money_sum(price: str | Column) -> Column:
    """Sum quantised to cents (half-even); 0.00 over no rows."""
    p = F.col(price) if isinstance(price, str) else price
    return F.coalesce(F.bround(F.sum(p), 2), F.lit(0)).cast(MONEY)


def period_total(ledger: DataFrame, as_of, period: str, *, price: str = "Price",
                 date: str = "Date", alias: str = "total") -> DataFrame:
    """One row: the money sum over the month or year of ``as_of``."""
    return (ledger.filter(period_filter(date, as_of, period))
            .agg(money_sum(price).alias(alias)))


def mtd_total(ledger: DataFrame, as_of, **kw) -> DataFrame:
    return period_total(ledger, as_of, "month", alias=kw.pop("alias", "mtd_total"), **kw)


def ytd_total(ledger: DataFrame, as_of, **kw) -> DataFrame:
    return period_total(ledger, as_of, "year", alias=kw.pop("alias", "ytd_total"), **kw)


def spend_totals(ledger: DataFrame, as_of, *, price: str = "Price",
                 date: str = "Date") -> DataFrame:
    """MTD and YTD in one scan: the year range is pushed down, the month is a
    conditional sum inside it."""
    in_month = period_filter(date, as_of, "month")
    return (ledger.filter(period_filter(date, as_of, "year"))
            .agg(money_sum(F.when(in_month, F.col(price))).alias("mtd_total"),
                 money_sum(price).alias("ytd_total")))


def spend_tree(ledger: DataFrame, taxonomy: Mapping[str, Sequence[str]] | DataFrame,
               as_of, period: str, *, category: str = "Category",
               sub_category: str = "Sub_category", price: str = "Price",
               date: str = "Date") -> DataFrame:
    """Two-level spending tree for the period of ``as_of``.

    Output ``(node_id, label, parent, value, cat_ord, sub_ord)``: one node per
    taxonomy category with a non-zero sum (parent ``''``), and under a kept
    category one node per *listed* sub-category with a non-zero sum.  A
    category's value counts all its rows, listed sub-category or not.  A
    sub-category named like its category is labelled ``"<name> (sub)"``.

    Plan: one scan and one shuffle of the ledger.  Rows are tagged from the
    broadcast taxonomy (its size is checked) and aggregated by listed
    sub-category, all unlisted ones of a category as one, with map-side partial
    aggregation: the result has at most one row more per category than the
    taxonomy, whatever texts the data holds.  Category totals come from a window
    over that bounded result, and every aggregated pair emits at most two nodes
    (its category once, itself if listed).  Sums are rounded to cents, half to
    even, once.
    """
    spark = ledger.sparkSession
    tax = taxonomy if isinstance(taxonomy, DataFrame) else taxonomy_df(spark, taxonomy)
    if isinstance(taxonomy, DataFrame) and tax.limit(MAX_TAXONOMY + 1).count() > MAX_TAXONOMY:
        raise ValueError(f"the taxonomy has more than {MAX_TAXONOMY} entries")
    cats = tax.select("category", "cat_ord").distinct()
    subs = tax.filter(F.col("sub_category").isNotNull()).select(
        "category", "sub_category", "sub_ord")

    period_rows = ledger.filter(period_filter(date, as_of, period))
    if not isinstance(taxonomy, DataFrame):
        # a literal IN-list reaches the scan of the category column
        period_rows = period_rows.filter(F.col(category).isin(list(taxonomy.keys())))
    pairs = (period_rows
             .select(F.col(category).alias("category"),
                     F.col(sub_category).alias("sub_category"),
                     F.col(price).alias("price"))
             # only taxonomy categories can become nodes: drop the rest
             # before the shuffle (broadcast inner join with a bounded list)
             .join(F.broadcast(cats), "category")
             .join(F.broadcast(subs), ["category", "sub_category"], "left")
             .groupBy("category", "cat_ord", "sub_ord",
                      F.when(F.col("sub_ord").isNotNull(), F.col("sub_category"))
                      .alias("sub_category"))
             .agg(F.sum("price").alias("v")))

    by_cat = Window.partitionBy("category")
    first_in_cat = Window.partitionBy("category").orderBy(
        F.col("sub_ord").asc_nulls_first())
    tagged = (pairs
              .withColumn("cat_v", F.sum("v").over(by_cat))
              .withColumn("first", F.row_number().over(first_in_cat) == 1)
              .filter(F.col("cat_v") != 0))

    label = F.when(F.col("sub_category") == F.col("category"),
                   F.concat(F.col("sub_category"), F.lit(" (sub)"))
                   ).otherwise(F.col("sub_category"))
    cat_node = F.struct(
        F.col("category").alias("node_id"),
        F.col("category").alias("label"),
        F.lit("").alias("parent"),
        F.bround("cat_v", 2).cast(MONEY).alias("value"),
        F.col("cat_ord").cast("int").alias("cat_ord"),
        F.lit(None).cast("int").alias("sub_ord"))
    sub_node = F.struct(
        F.concat(F.col("category"), F.lit("/"), label).alias("node_id"),
        label.alias("label"),
        F.col("category").alias("parent"),
        F.bround("v", 2).cast(MONEY).alias("value"),
        F.col("cat_ord").cast("int").alias("cat_ord"),
        F.col("sub_ord").cast("int").alias("sub_ord"))
    nodes = F.array(
        F.when(F.col("first"), cat_node),
        F.when(F.col("sub_ord").isNotNull() & (F.col("v") != 0), sub_node))
    return (tagged.select(F.explode(nodes).alias("n"))
            .filter(F.col("n").isNotNull())
            .select("n.*"))


def spend_tree_ytd(ledger: DataFrame, taxonomy, as_of, **kw) -> DataFrame:
    return spend_tree(ledger, taxonomy, as_of, "year", **kw)


def spend_tree_mtd(ledger: DataFrame, taxonomy, as_of, **kw) -> DataFrame:
    return spend_tree(ledger, taxonomy, as_of, "month", **kw)


def summary_labels(ledger: DataFrame, as_of, *, price: str = "Price",
                   date: str = "Date") -> DataFrame:
    """Summary texts: chart titles ``Spending for {year}`` / ``Spending in
    {Month}``, the tab header and the two ``$amount`` labels (plain decimal,
    no thousands separator)."""
    return labels_of(spend_totals(ledger, as_of, price=price, date=date), as_of)


def labels_of(totals: DataFrame, as_of) -> DataFrame:
    """The summary texts of one row of totals."""
    d = _as_date(as_of)
    month_name = F.date_format(F.lit(d.replace(day=1)), "MMMM")
    mtd_s = F.col("mtd_total").cast("string")
    ytd_s = F.col("ytd_total").cast("string")
    return totals.select(
        F.lit(f"Spending for {d.year}").alias("ytd_title"),
        F.concat(F.lit("Spending in "), month_name).alias("mtd_title"),
        F.lit(f"Summary for {d.year}").alias("summary_title"),
        F.concat(F.lit("Current spending for "), month_name, F.lit(": $"), mtd_s
                 ).alias("mtd_text"),
        F.concat(F.lit(f"YTD spending for {d.year}: $"), ytd_s).alias("ytd_text"),
        F.concat(F.lit("$"), mtd_s).alias("mtd_label"),
        F.concat(F.lit("$"), ytd_s).alias("ytd_label"),
        "mtd_total", "ytd_total")

"""Spending sums that are kept up to date, and the whole summary in one scan.

Partial sums per (month, category, sub-category) are mergeable: sums and row counts
of two disjoint ledgers add up.  A store holds batches of them; appending a ledger
adds its batch, a correction adds the old rows with the sign -1 and the new
ones with +1, and neither reads the ledgers before.  A batch has a name, so adding it
again replaces it (a job that ran twice does not count twice).  ``compact`` merges
all batches to one.  The set of batches is a version (manifest switched last), so a
reader sees whole batches only.

``summary_nodes`` gives totals and both trees of a period from one aggregate, of a
ledger or of the store: rows are folded to (listed category, listed sub-category)
with a sum for the month and one for the year, which is no larger than the taxonomy.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_table
from ..sources.versions import committed, publish
from ..taxonomy import taxonomy_df
from .summary import MONEY, period_bounds, period_filter

SUM = "decimal(38,6)"


# mergeable sums ----------------------------------------------------------------

def partial_sums(ledger: DataFrame, *, category: str = "Category",
                 sub_category: str = "Sub_category", price: str = "Price",
                 date: str = "Date", sign: int = 1) -> DataFrame:
    """``month (its first day), category, sub_category, total, n`` of dated rows;
    with the sign -1 what they take back."""
    return (ledger.where(F.col(date).isNotNull())
            .groupBy(F.trunc(date, "MM").alias("month"), F.col(category).alias("category"),
                     F.col(sub_category).alias("sub_category"))
            .agg((F.coalesce(F.sum(price), F.lit(0)) * sign).cast(SUM).alias("total"),
                 (F.count(F.lit(1)) * sign).alias("n")))


def merge_sums(*parts: DataFrame) -> DataFrame:
    """Sums of all parts; groups whose rows are all taken back disappear."""
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return (every.groupBy("month", "category", "sub_category")
            .agg(F.sum("total").cast(SUM).alias("total"), F.sum("n").alias("n"))
            .where((F.col("n") != 0) | (F.col("total") != 0)))


def _batches(spark: SparkSession, path: str) -> dict[str, str]:
    """Name -> folder of the committed batches."""
    folder = committed(spark, path)
    if folder is None:
        return {}
    return json.loads(spark.read.text(f"{folder}/batches").first().value)


def _commit(spark: SparkSession, path: str, batches: Mapping[str, str]) -> None:
    def write(folder: str) -> None:
        spark.createDataFrame([(json.dumps(dict(batches), sort_keys=True),)], "value string") \
            .coalesce(1).write.text(f"{folder}/batches")
    publish(spark, path, write)


def add_batch(sums: DataFrame, path: str, name: str) -> None:
    """Add a batch of partial sums, in place of one of the same name."""
    spark = sums.sparkSession
    number = len(_batches(spark, path))
    folder = f"{path}/batch-{number:06d}-{uuid4().hex[:8]}"
    sums.write.parquet(folder)
    _commit(spark, path, _batches(spark, path) | {name: folder})


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """The merged sums of all committed batches."""
    folders = list(_batches(spark, path).values())
    if not folders:
        return spark.createDataFrame(
            [], f"month date, category string, sub_category string, total {SUM}, n long")
    return merge_sums(spark.read.parquet(*folders))


def compact(spark: SparkSession, path: str, name: str = "compacted") -> None:
    """One batch in place of all."""
    folder = f"{path}/batch-{name}-{uuid4().hex[:8]}"
    read_sums(spark, path).write.parquet(folder)
    _commit(spark, path, {name: folder})


# totals and trees from one aggregate --------------------------------------------

def _folded(rows: DataFrame, taxonomy: DataFrame, as_of, amount: Column, when: Column) -> DataFrame:
    """``category, cat_ord, sub_category, sub_ord, month, year``: sums per listed
    pair; unlisted subs of a category as one row, other categories as one."""
    cats = taxonomy.select("category", "cat_ord").distinct()
    subs = taxonomy.where("sub_category is not null").select("category", "sub_category", "sub_ord")
    in_month = period_filter(when, as_of, "month")
    return (rows.join(F.broadcast(cats), "category", "left")
            .join(F.broadcast(subs), ["category", "sub_category"], "left")
            .groupBy("cat_ord", "sub_ord",
                     F.when(F.col("cat_ord").isNotNull(), F.col("category")).alias("category"),
                     F.when(F.col("sub_ord").isNotNull(), F.col("sub_category"))
                     .alias("sub_category"))
            .agg(F.sum(F.when(in_month, amount)).alias("month"), F.sum(amount).alias("year")))


def _nodes(folded: DataFrame) -> DataFrame:
    periods = F.inline(F.array(
        F.struct(F.lit("month").alias("period"), F.col("month").alias("v")),
        F.struct(F.lit("year").alias("period"), F.col("year").alias("v"))))
    # from here on at most twice the taxonomy's rows
    long = folded.select("category", "cat_ord", "sub_category", "sub_ord", periods).where(
        "v is not null")
    by_cat = Window.partitionBy("period", "cat_ord")
    tagged = (long.withColumn("cat_v", F.sum("v").over(by_cat))
              .withColumn("first", F.row_number().over(
                  by_cat.orderBy(F.col("sub_ord").asc_nulls_first())) == 1))
    label = F.when(F.col("sub_category") == F.col("category"),
                   F.concat("sub_category", F.lit(" (sub)"))).otherwise(F.col("sub_category"))

    def node(kind, name, shown, parent, value, cat_ord, sub_ord):
        return F.struct(F.lit(kind).alias("kind"), name.alias("node_id"), shown.alias("label"),
                        parent.alias("parent"), F.bround(value, 2).cast(MONEY).alias("value"),
                        cat_ord.cast("int").alias("cat_ord"), sub_ord.cast("int").alias("sub_ord"))

    kept = F.col("cat_ord").isNotNull() & (F.col("cat_v") != 0)
    nodes = F.array(
        F.when(kept & F.col("first"),
               node("category", F.col("category"), F.col("category"), F.lit(""), F.col("cat_v"),
                    F.col("cat_ord"), F.lit(None))),
        F.when(kept & F.col("sub_ord").isNotNull() & (F.col("v") != 0),
               node("sub_category", F.concat("category", F.lit("/"), label), label,
                    F.col("category"), F.col("v"), F.col("cat_ord"), F.col("sub_ord"))))
    found = tagged.select("period", F.explode(nodes).alias("n")).where("n is not null").select(
        "period", "n.*")
    # both totals also where no row falls into the period
    total = folded.agg(F.sum("month").alias("month"), F.sum("year").alias("year")).select(
        F.inline(F.array(*[F.struct(
            F.lit(p).alias("period"), F.lit("total").alias("kind"), F.lit("").alias("node_id"),
            F.lit("").alias("label"), F.lit(None).cast("string").alias("parent"),
            F.coalesce(F.bround(p, 2), F.lit(0)).cast(MONEY).alias("value"),
            F.lit(None).cast("int").alias("cat_ord"), F.lit(None).cast("int").alias("sub_ord"))
            for p in ("month", "year")])))
    return total.unionByName(found)


def summary_nodes(ledger: DataFrame, taxonomy: Mapping[str, Sequence[str]], as_of, *,
                  category: str = "Category", sub_category: str = "Sub_category",
                  price: str = "Price", date: str = "Date") -> DataFrame:
    """``period (month, year), kind (total, category, sub_category), node_id, label,
    parent, value, cat_ord, sub_ord``: the numbers of the whole summary; trees as
    ``spend_tree`` gives them.  The ledger is scanned and shuffled once; what
    follows reads that small result (a table on shared storage) twice."""
    tax = taxonomy_df(ledger.sparkSession, taxonomy)
    rows = ledger.where(period_filter(date, as_of, "year")).select(
        F.col(category).alias("category"), F.col(sub_category).alias("sub_category"),
        F.col(price).alias("amount"), F.col(date).alias("on"))
    return _nodes(shared_table(_folded(rows, tax, as_of, F.col("amount"), F.col("on")),
                               "summary"))


def summary_of_sums(sums: DataFrame, taxonomy: Mapping[str, Sequence[str]], as_of) -> DataFrame:
    """``summary_nodes`` from the store's monthly sums, without the ledger."""
    start, end = period_bounds(as_of, "year")
    rows = sums.where((F.col("month") >= F.lit(start)) & (F.col("month") < F.lit(end))) \
        .withColumnRenamed("month", "on")
    tax = taxonomy_df(sums.sparkSession, taxonomy)
    return _nodes(shared_table(_folded(rows, tax, as_of, F.col("total"), F.col("on")), "summary"))

"""Ledger views over the shared Parquet tables.

* ``txn``: the dated ledger ``lineitem JOIN part`` (Description p_name,
  Category p_type, Sub_category p_brand, Price l_extendedprice,
  Date l_shipdate).
* ``docs``: the labelled text ledger from ``documents`` (Description text,
  Category lang, Sub_Category source).
* ``parts``: an undated ledger from ``part`` (Description p_name, Category
  p_type, Sub_Category p_brand).

Only the columns each view needs are selected, so the Parquet scans read just
those columns; filters applied later reach the scans through Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv import PRICE

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str, min_partitions: int | None = None) -> DataFrame:
    """Hash-repartition an under-split input before CPU-heavy per-row work.

    A small file with one row group is read by one task however it is split;
    text cleaning then runs on one core.  Inputs already split into at least
    ``min_partitions`` (default: the cluster's parallelism) are returned
    unchanged, so large inputs never pay an extra shuffle."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys)


def txn_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated, priced ledger.  The join is planned by Catalyst/AQE: ``part`` is
    the dimension side and is broadcast only when its measured size allows."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.col("l_orderkey").alias("order_key"),
                    F.col("l_linenumber").alias("line_number"),
                    F.col("p_name").alias("Description"),
                    F.col("p_type").alias("Category"),
                    F.col("p_brand").alias("Sub_category"),
                    F.col("l_extendedprice").cast(PRICE).alias("Price"),
                    F.col("l_shipdate").cast("date").alias("Date")))


def docs_ledger(spark: SparkSession, sf_dir: str, *, spread_rows: bool = True) -> DataFrame:
    """Documents are the text-heavy table: spread them over the cores, unless
    the caller's next step is a shuffle anyway (e.g. a de-duplication)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("Description"),
        F.col("lang").alias("Category"),
        F.col("source").alias("Sub_Category"))
    return spread(docs, "doc_id") if spread_rows else docs


def parts_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_size",
        F.col("p_name").alias("Description"),
        F.col("p_type").alias("Category"),
        F.col("p_brand").alias("Sub_Category"))

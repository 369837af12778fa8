"""Ledgers on shared storage: nested folders, months, order, mergeable sums, and
the whole summary in one scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollup, summary
from ..operators.rank import global_rank
from ..session import scratch_path
from ..sources import csv as io
from ..sources import ledgers
from ..sources.csv import PRICE
from ..sources.tables import table, txn_ledger
from .catalog import register
from .q_summary import AS_OF, TXN_SQL, tree_sql, txn_taxonomy

# --- nested and partitioned folders -----------------------------------------

@register("merge_nested", """
SELECT p_partkey AS key, p_name AS Description, p_type AS Category, p_brand AS Sub_Category,
       CASE WHEN p_size <= 10 THEN 'top' WHEN p_size <= 20 THEN 'deep' WHEN p_size <= 30 THEN 'part+1'
            WHEN p_size <= 40 THEN 'by type' ELSE 'last' END AS source_name
FROM part""")
def q_merge_nested(spark, sf_dir):
    """One folder: files at several depths with different headers, a folder per
    value of a column that the files inside lack, and other files in between."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("Description"),
        F.col("p_type").alias("Category"), F.col("p_brand").alias("Sub_Category"), "p_size")
    base = scratch_path(spark, "nested")

    def band(lo, hi):
        return part.where(F.col("p_size").between(lo, hi)).drop("p_size")

    io.write_csv(band(1, 10), f"{base}/top.csv")
    io.write_csv(band(11, 20).select("Category", "key", "Description", F.lit("x").alias("other"),
                                     F.col("Sub_Category").alias("subcategory")),
                 f"{base}/a/b c/deep.v1.csv")
    io.write_csv(band(21, 30), f"{base}/year=2024/part+1.csv")
    # the writer takes the column out of the files and puts it into folder names
    (band(31, 40).write.partitionBy("Category").option("header", True)
     .csv(f"{base}/by type.csv"))
    io.write_csv(band(41, 50), f"{base}/z/last.csv")
    part.limit(1).write.json(f"{base}/notes")
    led = io.read_ledger(spark, base, extra=["key"])
    return led.select(F.col("key").cast("bigint").alias("key"), "Description", "Category",
                      "Sub_Category", F.col("_source").alias("source_name"))


# --- by month -----------------------------------------------------------------

@register("ledger_by_month", f"""WITH {TXN_SQL},
fixed AS (SELECT CASE WHEN strftime(Date, '%Y-%m') = '1998-06' THEN Price * 2 ELSE Price END AS Price,
                 Date FROM txn)
SELECT strftime(Date, '%Y-%m') AS month, CAST(SUM(Price) AS DECIMAL(18,2)) AS total,
       CAST(COUNT(*) AS BIGINT) AS n
FROM fixed GROUP BY 1
UNION ALL
SELECT 'mtd', CAST(COALESCE(SUM(Price), 0) AS DECIMAL(18,2)), CAST(COUNT(*) AS BIGINT)
FROM fixed WHERE strftime(Date, '%Y-%m') = '1998-06'""")
def q_ledger_by_month(spark, sf_dir):
    """All months, one of them replaced by a corrected version."""
    path = scratch_path(spark, "months")
    txn = txn_ledger(spark, sf_dir)
    ledgers.write_by_month(txn, path)
    doubled = txn.withColumn("Price", (F.col("Price") * 2).cast(PRICE))
    ledgers.write_by_month(doubled, path, months=["1998-06"])
    led = ledgers.read_by_month(spark, path)
    sums = [summary.money_sum("Price").alias("total"), F.count(F.lit(1)).alias("n")]
    mtd = ledgers.period_rows(led, AS_OF, "month").agg(*sums)
    return led.groupBy("month").agg(*sums).unionByName(
        mtd.select(F.lit("mtd").alias("month"), "total", "n"))


# --- in order -------------------------------------------------------------------

@register("csv_in_order", """
SELECT p_partkey AS key, CAST(row_number() OVER (ORDER BY p_size DESC, md5(p_name), p_partkey)
                              AS BIGINT) AS position, p_name AS Description
FROM part""")
def q_csv_in_order(spark, sf_dir):
    """Predictions written in a given order; their place in the files read back."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("Description"),
        F.col("p_type").alias("Category"), F.col("p_brand").alias("Sub_Category"), "p_size")
    path = ledgers.write_in_order(
        part, scratch_path(spark, "ordered") + "/predictions.csv",
        [F.desc("p_size"), F.md5("Description"), F.col("key")],
        ["key", "Description", "Category", "Sub_Category"])
    led = io.read_ledger(spark, path, extra=["key"])
    ranked = global_rank(led.select("key", "Description", "_pos"), ["_pos"], "position")
    return ranked.select(F.col("key").cast("bigint").alias("key"), "position", "Description")


# --- mergeable sums ---------------------------------------------------------------

SUMS_SQL = f"""{TXN_SQL},
now AS (SELECT Category, Sub_category, CASE WHEN line_number = 1 THEN Price * 2 ELSE Price END AS Price,
               Date, line_number FROM txn WHERE line_number <> 2)"""


def _store(spark, sf_dir) -> str:
    """Batches: the first lines, the others (twice, as by a job that ran again),
    corrected first lines, second lines taken back; then one batch of all."""
    path = scratch_path(spark, "rollup")
    txn = txn_ledger(spark, sf_dir)
    line = F.col("line_number")
    later = rollup.partial_sums(txn.where(line > 3))
    rollup.add_batch(rollup.partial_sums(txn.where(line <= 3)), path, "first")
    rollup.add_batch(later, path, "later")
    rollup.add_batch(later, path, "later")
    wrong = rollup.partial_sums(txn.where(line == 1), sign=-1)
    right = rollup.partial_sums(txn.where(line == 1).withColumn("Price", F.col("Price") * 2))
    rollup.add_batch(rollup.merge_sums(wrong, right), path, "corrected")
    rollup.compact(spark, path)
    rollup.add_batch(rollup.partial_sums(txn.where(line == 2), sign=-1), path, "taken back")
    return path


@register("rollup_sums", f"""WITH {SUMS_SQL}
SELECT CAST(date_trunc('month', Date) AS DATE) AS month, Category AS category,
       Sub_category AS sub_category, CAST(SUM(Price) AS DECIMAL(38,6)) AS total,
       CAST(COUNT(*) AS BIGINT) AS n
FROM now GROUP BY 1, 2, 3""")
def q_rollup_sums(spark, sf_dir):
    return rollup.read_sums(spark, _store(spark, sf_dir))


def _all_nodes_sql(cte: str, source: str = "txn") -> str:
    parts = []
    for period in ("month", "year"):
        s, e = (d.isoformat() for d in summary.period_bounds(AS_OF, period))
        tree = tree_sql(cte, period).replace("FROM txn\n", f"FROM {source}\n")
        parts.append(f"""SELECT '{period}' AS period,
       CASE WHEN parent = '' THEN 'category' ELSE 'sub_category' END AS kind, node_id, label,
       parent, value, cat_ord, sub_ord FROM ({tree}) t_{period}""")
        parts.append(f"""SELECT '{period}', 'total', '', '', NULL, (
  WITH {cte} SELECT CAST(COALESCE(SUM(Price), 0) AS DECIMAL(18,2)) FROM {source}
  WHERE Date >= DATE '{s}' AND Date < DATE '{e}'), NULL, NULL""")
    return "\nUNION ALL\n".join(parts)


@register("summary_all", _all_nodes_sql(TXN_SQL))
def q_summary_all(spark, sf_dir):
    """Totals and both trees of the year and the month, from one aggregate."""
    return rollup.summary_nodes(txn_ledger(spark, sf_dir), txn_taxonomy(), AS_OF)


@register("summary_of_sums", _all_nodes_sql(SUMS_SQL, "now"))
def q_summary_of_sums(spark, sf_dir):
    """The same from the sums that are kept up to date, without the ledger."""
    sums = rollup.read_sums(spark, _store(spark, sf_dir))
    return rollup.summary_of_sums(sums, txn_taxonomy(), AS_OF)

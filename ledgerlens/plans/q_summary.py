"""Summary queries: totals, labels and spending trees over the dated ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import summary
from ..sources.csv import PRICE
from ..sources.tables import table, txn_ledger
from .catalog import register
from .sqltext import taxonomy_values

AS_OF = dt.date(1998, 6, 15)


def txn_taxonomy() -> dict[str, list[str]]:
    """Taxonomy for the ``txn`` ledger, built by rule: five of the six part
    types, each listing four of its five brands (every fifth brand is left
    out), one sub-category named like its category (LARGE) and one brand
    listed under two parents (Brand#1).  PROMO is not a category."""
    types = ["ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD"]
    tax = {t: [f"Brand#{5 * i + j}" for j in range(1, 5)] for i, t in enumerate(types)}
    tax["LARGE"].append("LARGE")
    tax["STANDARD"].append("Brand#1")
    return tax


TXN_SQL = """txn AS (
  SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_number,
         p.p_name AS Description, p.p_type AS Category, p.p_brand AS Sub_category,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS Price,
         CAST(l.l_shipdate AS DATE) AS Date
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def _bounds(period):
    s, e = summary.period_bounds(AS_OF, period)
    return s.isoformat(), e.isoformat()


def tree_sql(ledger_cte: str, period: str, cents: str = "CAST({} AS DECIMAL(18,2))") -> str:
    s, e = _bounds(period)
    value = cents.format("v")
    return f"""
WITH {ledger_cte},
tax(category, cat_ord, sub_category, sub_ord) AS (VALUES {taxonomy_values(txn_taxonomy())}),
f AS (SELECT Category, Sub_category, Price FROM txn
      WHERE Date >= DATE '{s}' AND Date < DATE '{e}'
        AND Category IN (SELECT category FROM tax)),
pair AS (SELECT Category AS category, Sub_category AS sub_category, SUM(Price) AS v
         FROM f GROUP BY 1, 2),
cats AS (SELECT DISTINCT category, cat_ord FROM tax),
catn AS (SELECT p.category, c.cat_ord, SUM(p.v) AS v
         FROM pair p JOIN cats c ON p.category = c.category
         GROUP BY 1, 2 HAVING SUM(p.v) <> 0),
subn AS (SELECT p.category, t.cat_ord, t.sub_ord, p.v,
                CASE WHEN p.sub_category = p.category THEN p.sub_category || ' (sub)'
                     ELSE p.sub_category END AS lbl
         FROM pair p JOIN tax t
           ON p.category = t.category AND p.sub_category = t.sub_category
         WHERE p.v <> 0 AND p.category IN (SELECT category FROM catn))
SELECT category AS node_id, category AS label, '' AS parent,
       {value} AS value, CAST(cat_ord AS INTEGER) AS cat_ord,
       CAST(NULL AS INTEGER) AS sub_ord
FROM catn
UNION ALL
SELECT category || '/' || lbl, lbl, category, {value},
       CAST(cat_ord AS INTEGER), CAST(sub_ord AS INTEGER)
FROM subn"""


@register("spend_tree_ytd", tree_sql(TXN_SQL, "year"))
def q_spend_tree_ytd(spark, sf_dir):
    return summary.spend_tree_ytd(txn_ledger(spark, sf_dir), txn_taxonomy(), AS_OF)


@register("spend_tree_mtd", tree_sql(TXN_SQL, "month"))
def q_spend_tree_mtd(spark, sf_dir):
    return summary.spend_tree_mtd(txn_ledger(spark, sf_dir), txn_taxonomy(), AS_OF)


# Edge cases derived from the whole ledger by column values: a category with a
# trailing space (matches nothing), null / empty / self-named sub-categories,
# and a negated copy of every MEDIUM row and every Brand#2 row, so that MEDIUM
# and all Brand#2 nodes sum to zero and disappear (with MEDIUM's children).
EDGE_SQL = """txn AS (
  WITH base AS (
    SELECT CASE WHEN p.p_size > 45 THEN p.p_type || ' ' ELSE p.p_type END AS Category,
           CASE WHEN p.p_size <= 3 THEN NULL
                WHEN p.p_size <= 6 THEN ''
                WHEN p.p_size <= 9 THEN p.p_type
                ELSE p.p_brand END AS Sub_category,
           CAST(l.l_extendedprice AS DECIMAL(18,2)) AS Price,
           CAST(l.l_shipdate AS DATE) AS Date,
           p.p_type AS ptype, p.p_brand AS pbrand
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
  SELECT Category, Sub_category, Price, Date FROM base
  UNION ALL
  SELECT Category, Sub_category, -Price, Date FROM base
  WHERE ptype = 'MEDIUM' OR pbrand = 'Brand#2')"""


def edge_ledger(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    base = (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.when(F.col("p_size") > 45, F.concat("p_type", F.lit(" ")))
                     .otherwise(F.col("p_type")).alias("Category"),
                    F.when(F.col("p_size") <= 3, F.lit(None).cast("string"))
                     .when(F.col("p_size") <= 6, F.lit(""))
                     .when(F.col("p_size") <= 9, F.col("p_type"))
                     .otherwise(F.col("p_brand")).alias("Sub_category"),
                    F.col("l_extendedprice").cast(PRICE).alias("Price"),
                    F.col("l_shipdate").cast("date").alias("Date"),
                    F.col("p_type").alias("ptype"), F.col("p_brand").alias("pbrand")))
    negated = (base.filter((F.col("ptype") == "MEDIUM") | (F.col("pbrand") == "Brand#2"))
               .withColumn("Price", -F.col("Price")))
    cols = ["Category", "Sub_category", "Price", "Date"]
    return base.select(cols).unionByName(negated.select(cols))


@register("spend_tree_edges", tree_sql(EDGE_SQL, "year"))
def q_spend_tree_edges(spark, sf_dir):
    return summary.spend_tree_ytd(edge_ledger(spark, sf_dir), txn_taxonomy(), AS_OF)


def _total_sql(period: str, alias: str) -> str:
    s, e = _bounds(period)
    return f"""WITH {TXN_SQL}
SELECT CAST(COALESCE(SUM(Price), 0) AS DECIMAL(18,2)) AS {alias}
FROM txn WHERE Date >= DATE '{s}' AND Date < DATE '{e}'"""


@register("mtd_total", _total_sql("month", "mtd_total"))
def q_mtd_total(spark, sf_dir):
    return summary.mtd_total(txn_ledger(spark, sf_dir), AS_OF)


@register("ytd_total", _total_sql("year", "ytd_total"))
def q_ytd_total(spark, sf_dir):
    return summary.ytd_total(txn_ledger(spark, sf_dir), AS_OF)


def _labels_sql() -> str:
    ms, me = _bounds("month")
    ys, ye = _bounds("year")
    month = AS_OF.strftime("%B")
    return f"""WITH {TXN_SQL},
t AS (SELECT CAST(COALESCE(SUM(CASE WHEN Date >= DATE '{ms}' AND Date < DATE '{me}'
                                    THEN Price END), 0) AS DECIMAL(18,2)) AS mtd_total,
             CAST(COALESCE(SUM(Price), 0) AS DECIMAL(18,2)) AS ytd_total
      FROM txn WHERE Date >= DATE '{ys}' AND Date < DATE '{ye}')
SELECT 'Spending for {AS_OF.year}' AS ytd_title, 'Spending in {month}' AS mtd_title,
       'Summary for {AS_OF.year}' AS summary_title,
       'Current spending for {month}: $' || CAST(mtd_total AS VARCHAR) AS mtd_text,
       'YTD spending for {AS_OF.year}: $' || CAST(ytd_total AS VARCHAR) AS ytd_text,
       '$' || CAST(mtd_total AS VARCHAR) AS mtd_label,
       '$' || CAST(ytd_total AS VARCHAR) AS ytd_label,
       mtd_total, ytd_total
FROM t"""


@register("summary_labels", _labels_sql())
def q_summary_labels(spark, sf_dir):
    return summary.summary_labels(txn_ledger(spark, sf_dir), AS_OF)


# prices in eighths: sums that fall between two cents, rounded once, half to even
EIGHTHS_SQL = """txn AS (
  SELECT p.p_type AS Category, p.p_brand AS Sub_category,
         CAST(l.l_quantity AS INTEGER) * CAST(0.125 AS DECIMAL(20,6)) AS Price,
         CAST(l.l_shipdate AS DATE) AS Date
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


@register("spend_tree_subcent", tree_sql(
    EIGHTHS_SQL, "month", "CAST(round_even(CAST({} AS DOUBLE), 2) AS DECIMAL(18,2))"))
def q_spend_tree_subcent(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    ledger = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_type").alias("Category"), F.col("p_brand").alias("Sub_category"),
        (F.col("l_quantity").cast("int") * F.lit("0.125").cast(PRICE)).alias("Price"),
        F.col("l_shipdate").cast("date").alias("Date"))
    return summary.spend_tree_mtd(ledger, txn_taxonomy(), AS_OF)

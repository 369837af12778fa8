"""Text cleaning and keep-first de-duplication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text, clean_text_sql
from ..operators.dedupe import dedupe_first
from ..sources.tables import docs_ledger, table
from .catalog import register


@register("clean_text", f"""
SELECT doc_id, {clean_text_sql('text')} AS Description FROM documents""")
def q_clean_text(spark, sf_dir):
    """Every document, whole text, through the cleaning expression."""
    docs = docs_ledger(spark, sf_dir)
    return docs.select("doc_id", clean_text("Description").alias("Description"))


@register("dedupe_first", """
SELECT p_partkey, p_name, p_type, p_brand FROM (
  SELECT *, row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_partkey) AS rn
  FROM part) t
WHERE rn = 1""")
def q_dedupe_first(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return dedupe_first(part, ["p_name", "p_type"], "p_partkey")


@register("dedupe_clean", f"""
SELECT p_partkey, {clean_text_sql('p_name')} AS Description, p_type AS Category FROM (
  SELECT *, row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_partkey) AS rn
  FROM part) t
WHERE rn = 1""")
def q_dedupe_clean(spark, sf_dir):
    """Keep-first on the raw (Description, Category), then clean: cleaned
    duplicates may remain, as in the prediction path."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("Description"), F.col("p_type").alias("Category"))
    first = dedupe_first(part, ["Description", "Category"], "p_partkey")
    return first.select("p_partkey", clean_text("Description").alias("Description"), "Category")

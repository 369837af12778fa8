"""Source / sink queries.  CSV inputs are derived from the whole ``part`` or
``txn`` tables, written to a fresh folder under the shared checkpoint folder
and read back through the ledger readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.columns import drop_unlabelled, fill_labels, standardise_columns
from ..session import scratch_path
from ..sources import csv as io
from ..sources.tables import table, txn_ledger
from .catalog import register
from .q_summary import TXN_SQL

# --- NA tokens -------------------------------------------------------------

NA_CASE_SQL = "CASE WHEN p_size <= 10 THEN NULL ELSE p_type END"


def _na_injected(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cat = (F.when(F.col("p_size") <= 2, F.lit("NA"))
           .when(F.col("p_size") <= 4, F.lit("N/A"))
           .when(F.col("p_size") <= 6, F.lit("null"))
           .when(F.col("p_size") <= 8, F.lit("None"))
           .when(F.col("p_size") <= 10, F.lit(""))
           .otherwise(F.col("p_type")))
    return part.select(F.col("p_partkey").cast("string").alias("p_partkey"),
                       F.col("p_name").alias("Description"), cat.alias("Category"),
                       F.col("p_brand").alias("Sub_Category"))


@register("scan_normalise", f"""
SELECT p_partkey, p_name AS Description, {NA_CASE_SQL} AS Category,
       p_brand AS Sub_Category, 'parts_na' AS _source
FROM part""")
def q_scan_normalise(spark, sf_dir):
    path = scratch_path(spark, "scan") + "/parts_na.csv"
    io.write_csv(_na_injected(spark, sf_dir), path)
    led = io.read_ledger(spark, path, extra=["p_partkey"])
    return led.select(F.col("p_partkey").cast("bigint").alias("p_partkey"),
                      "Description", "Category", "Sub_Category", "_source")


# --- merge of three differently shaped files --------------------------------

SIZE_BANDS = [(1, 16), (17, 33), (34, 50)]
MERGE_NAMES = ["Parts - Small.v1.csv", "Parts - Medium.csv", "Parts - Large.2024.csv"]


def _write_three(spark, sf_dir, labelled_nulls: bool):
    """Three CSV folders from ``part`` split by size band, each with its own
    header shape: canonical order; ``Subcategory`` spelling with columns
    reordered and an extra column; lower-case names."""
    part = table(spark, sf_dir, "part")
    cat = F.col("p_type")
    sub = F.col("p_brand")
    if labelled_nulls:
        cat = F.when(F.col("p_size") <= 5, F.lit(None).cast("string")).otherwise(cat)
        sub = F.when(F.col("p_size") >= 46, F.lit(None).cast("string")).otherwise(sub)
    base = scratch_path(spark, "merge")
    paths = []
    for i, ((lo, hi), name) in enumerate(zip(SIZE_BANDS, MERGE_NAMES)):
        band = part.filter(F.col("p_size").between(lo, hi))
        if i == 0:
            out = band.select(F.col("p_name").alias("Description"), cat.alias("Category"),
                              sub.alias("Sub_Category"), F.col("p_partkey").alias("key"))
        elif i == 1:
            out = band.select(F.col("p_partkey").alias("key"), sub.alias("Subcategory"),
                              F.col("p_size").alias("Vector"),
                              F.col("p_name").alias("Description"), cat.alias("Category"))
        else:
            out = band.select(F.col("p_name").alias("description"), cat.alias("category"),
                              sub.alias("sub_category"), F.col("p_partkey").alias("KEY"))
        path = f"{base}/{name}"
        io.write_csv(out, path)
        paths.append(path)
    return paths


def _merged_sql(where: str = "") -> str:
    arms = []
    for i, ((lo, hi), name) in enumerate(zip(SIZE_BANDS, MERGE_NAMES)):
        src = name.split(".")[0]
        arms.append(f"""SELECT p_partkey AS key, p_name AS Description, {{cat}} AS Category,
       {{sub}} AS Sub_Category, '{src}' AS source_name, {i} AS file_ordinal
FROM part WHERE p_size BETWEEN {lo} AND {hi}""")
    return "SELECT * FROM (" + "\nUNION ALL\n".join(arms) + ") m" + where


def _merged_out(df):
    return df.select(F.col("key").cast("bigint").alias("key"), "Description", "Category",
                     "Sub_Category", F.col("_source").alias("source_name"),
                     F.col("_pos.ordinal").alias("file_ordinal"))


@register("merge_sources", _merged_sql().format(cat="p_type", sub="p_brand"))
def q_merge_sources(spark, sf_dir):
    paths = _write_three(spark, sf_dir, labelled_nulls=False)
    return _merged_out(io.merge_sources(spark, paths, extra=["key"]))


@register("merge_labelled", _merged_sql(
    " WHERE Category IS NOT NULL AND Sub_Category IS NOT NULL").format(
        cat="CASE WHEN p_size <= 5 THEN NULL ELSE p_type END",
        sub="CASE WHEN p_size >= 46 THEN NULL ELSE p_brand END"))
def q_merge_labelled(spark, sf_dir):
    paths = _write_three(spark, sf_dir, labelled_nulls=True)
    return _merged_out(io.merge_sources(spark, paths, extra=["key"], require_labels=True))


@register("source_name", """
SELECT source_name, CAST(COUNT(*) AS BIGINT) AS n_rows FROM (""" +
          _merged_sql().format(cat="p_type", sub="p_brand") + ") s GROUP BY source_name")
def q_source_name(spark, sf_dir):
    """Names from the metadata of the files that were read."""
    paths = _write_three(spark, sf_dir, labelled_nulls=False)
    merged = io.merge_sources(spark, paths, extra=["key"])
    return (merged.groupBy(F.col("_source").alias("source_name"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")))


@register("merge_folder", _merged_sql().format(cat="p_type", sub="p_brand")
          .replace(", 0 AS file_ordinal", "").replace(", 1 AS file_ordinal", "")
          .replace(", 2 AS file_ordinal", ""))
def q_merge_folder(spark, sf_dir):
    """One folder with three header orders, read by name."""
    paths = _write_three(spark, sf_dir, labelled_nulls=False)
    led = io.read_ledger(spark, paths[0].rsplit("/", 1)[0], extra=["key"])
    return _merged_out(led).drop("file_ordinal")


# --- text that needs quoting -------------------------------------------------

@register("csv_text_edges", r"""
SELECT doc_id, '  "' || text || '" \, ' || source || ' ' AS Description,
       lang || ' ' AS Category, ' "' || source || '"" , x' AS Sub_Category
FROM documents WHERE text IS NOT NULL""")
def q_csv_text_edges(spark, sf_dir):
    """Whole texts with line breaks, quotes, commas, backslashes and edge
    spaces, written and read back unchanged."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select(
        "doc_id", F.concat(F.lit('  "'), "text", F.lit('" \\, '), "source", F.lit(" "))
        .alias("Description"), F.concat("lang", F.lit(" ")).alias("Category"),
        F.concat(F.lit(' "'), "source", F.lit('"" , x')).alias("Sub_Category"))
    path = scratch_path(spark, "edges") + "/edges.csv"
    io.write_csv(rows, path)
    back = io.read_ledger(spark, path, extra=["doc_id"], multi_line=True)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "Description",
                       "Category", "Sub_Category")


# --- dated ledger round trip ------------------------------------------------

@register("dated_scan", f"""WITH {TXN_SQL}
SELECT order_key, line_number, Description, Category, Sub_category,
       CAST(Price AS DECIMAL(20,6)) AS Price, Date FROM txn""")
def q_dated_scan(spark, sf_dir):
    txn = txn_ledger(spark, sf_dir)
    # entered dates are M/d/yyyy for the first lines of an order, ISO otherwise
    date_text = F.when(F.col("line_number") <= 3,
                       F.date_format("Date", "M/d/yyyy")).otherwise(F.col("Date").cast("string"))
    path = scratch_path(spark, "dated") + "/ledger.csv"
    io.write_csv(txn.select("order_key", "line_number", "Description", "Category",
                            "Sub_category", F.col("Price").cast("string").alias("Price"),
                            date_text.alias("Date")), path)
    led = io.read_dated(spark, path, extra=["order_key", "line_number"])
    return led.select(F.col("order_key").cast("bigint").alias("order_key"),
                      F.col("line_number").cast("int").alias("line_number"),
                      "Description", "Category", "Sub_category", "Price", "Date")


@register("csv_roundtrip", """
SELECT p_partkey AS key, p_name AS Description, p_type AS Category, p_brand AS Sub_Category
FROM part""")
def q_csv_roundtrip(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("Description"),
        F.col("p_type").alias("Category"), F.col("p_brand").alias("Sub_Category"))
    path = scratch_path(spark, "pred") + "/predictions.csv"
    io.write_predictions(part, path, extra=["key"])
    back = io.read_predictions(spark, path, extra=["key"])
    return back.select(F.col("key").cast("bigint").alias("key"), "Description",
                       "Category", "Sub_Category")


@register("preview", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
       CAST(p_size AS VARCHAR) AS p_size
FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 5) t""")
def q_preview(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return io.preview(part, 5, "p_partkey")


# --- column standardisation and label nulls ---------------------------------

@register("standardise_columns", """
SELECT p_partkey, p_name AS Description,
       CASE WHEN p_size <= 2 THEN '' ELSE p_type END AS Category,
       '' AS Sub_Category, '' AS Tok_Cat, '' AS Tok_Sub, '' AS Tokenized
FROM part WHERE p_size <= 47""")
def q_standardise_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    raw = part.select(
        "p_partkey",
        F.when(F.col("p_size") > 47, F.lit(None).cast("string"))
         .otherwise(F.col("p_name")).alias("Product Name"),
        F.when(F.col("p_size") <= 2, F.lit(None).cast("string"))
         .otherwise(F.col("p_type")).alias("Category"),
        F.col("p_retailprice").alias("Vector"))
    return standardise_columns(raw, keep=["p_partkey"])


LABEL_NULLS_SQL = """SELECT p_partkey, p_name AS Description,
       CASE WHEN p_size <= 4 THEN NULL ELSE p_type END AS Category,
       CASE WHEN p_size >= 45 THEN NULL ELSE p_brand END AS Sub_Category
FROM part"""


def _label_nulls(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey", F.col("p_name").alias("Description"),
        F.when(F.col("p_size") <= 4, F.lit(None).cast("string"))
         .otherwise(F.col("p_type")).alias("Category"),
        F.when(F.col("p_size") >= 45, F.lit(None).cast("string"))
         .otherwise(F.col("p_brand")).alias("Sub_Category"))


@register("fill_labels", f"""
SELECT p_partkey, Description, COALESCE(Category, '') AS Category,
       COALESCE(Sub_Category, '') AS Sub_Category FROM ({LABEL_NULLS_SQL}) t""")
def q_fill_labels(spark, sf_dir):
    return fill_labels(_label_nulls(spark, sf_dir))


@register("drop_unlabelled", f"""
SELECT * FROM ({LABEL_NULLS_SQL}) t
WHERE Category IS NOT NULL AND Sub_Category IS NOT NULL""")
def q_drop_unlabelled(spark, sf_dir):
    return drop_unlabelled(_label_nulls(spark, sf_dir))

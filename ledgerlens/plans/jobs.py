"""End-to-end jobs: train, predict, summarise.

What a user of the desktop tool does, as Spark jobs over ledgers of any size:

* ``train_models`` — ledger(s) -> keep-first -> clean -> labelled rows whose
  labels are in the taxonomy (the rest are returned as rejects) -> md5 split by
  content -> naive Bayes per head (optionally with word-shuffled copies of the
  training rows) -> model tables and metrics of both splits on shared storage.
* ``predict_ledger`` — ledger(s) -> keep-first -> clean -> both heads scored
  independently -> ``Description, Category, Subcategory`` CSV in input order.
* ``augment_cities`` / ``compose_restaurants`` — CSV -> CSV with synthetic
  descriptions; labels and other columns go with their rows.
* ``summarise`` — dated ledger -> MTD / YTD totals, trees and labels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_tokens
from ..operators import naive_bayes as nb
from ..operators import rollup, summary
from ..operators.augment import augment_city, compose_description, shuffle_words, words
from ..operators.columns import drop_unlabelled
from ..operators.dedupe import dedupe_first
from ..operators.encode import class_table
from ..operators.split import content_key, train_test_split
from ..session import checkpoint_dir
from ..sources import csv as io_csv
from ..sources.models import load_nb, save_nb
from ..sources.scratch import shared_table
from ..taxonomy import MODEL_TAXONOMY, SUMMARY_TAXONOMY, distinct_subs

HEAD_LABELS = {"category": "Category", "sub_category": "Sub_Category"}


def load_ledger(spark: SparkSession, source) -> DataFrame:
    """A path, a list of 2..8 paths (merged) or a DataFrame with a ``_pos``."""
    if isinstance(source, DataFrame):
        if "_pos" not in source.columns:
            raise ValueError("a DataFrame source needs a '_pos' order column")
        return source
    if isinstance(source, str):
        return io_csv.read_ledger(spark, source)
    return io_csv.merge_sources(spark, list(source))


def prepare(ledger: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Keep-first on the raw (Description, Category), then clean.  The row
    position ``_pos`` doubles as the row key."""
    first = dedupe_first(ledger.select("_pos", "Description", "Category", "Sub_Category"),
                         ["Description", "Category"], "_pos")
    return first.select("_pos", F.col("Description").alias("Raw_Description"),
                        "Category", "Sub_Category",
                        clean_tokens("Description", stop_words).alias("tokens"))


def train_models(spark: SparkSession, source, model_dir: str, *,
                 taxonomy: Mapping[str, Sequence[str]] = MODEL_TAXONOMY,
                 alpha: float = 1.0, test_size: float = 0.33, seed: int = 42,
                 augment: bool = False) -> dict:
    """Fit both heads; save them under ``model_dir``; return
    ``{"metrics": DataFrame, "rejects": DataFrame, "models": {...}}``.

    Rows without a description are not learned from.  The split depends on the
    kept rows' (Description, Category) alone, not on files or partitions.
    ``augment`` adds a word-shuffled copy of every training row (after the split,
    so that no copy of a test row is learned from)."""
    checkpoint_dir(spark)
    described = load_ledger(spark, source).dropna(subset=["Description"])
    rows = drop_unlabelled(prepare(described))
    cats = class_table(spark, taxonomy.keys())
    subs = class_table(spark, distinct_subs(taxonomy))
    # labels in the taxonomy are flagged by broadcast lookups (bounded class
    # tables); the split flag is per row, so one checkpoint holds both the
    # training rows and the rejects and the upstream runs once
    known = (rows.join(F.broadcast(cats.select(F.col("class_name").alias("Category"),
                                               F.lit(True).alias("_cat_ok"))), "Category", "left")
             .join(F.broadcast(subs.select(F.col("class_name").alias("Sub_Category"),
                                           F.lit(True).alias("_sub_ok"))), "Sub_Category", "left")
             .withColumn("_known", F.coalesce(F.col("_cat_ok") & F.col("_sub_ok"), F.lit(False)))
             .drop("_cat_ok", "_sub_ok"))
    keyed = known.withColumn("_key", content_key("Raw_Description", "Category"))
    flagged = train_test_split(keyed, "_key", test_size=test_size,
                               seed=seed).checkpoint(eager=True)
    rejects = flagged.filter(~F.col("_known")).select(*rows.columns)
    split = flagged.filter(F.col("_known"))
    train = split.filter(~F.col("is_test"))
    if augment:
        copies = shuffle_words(train.withColumn("_text", F.array_join("tokens", " ")),
                               "_key", "_text", seed=seed)
        train = copies.withColumn("tokens", words("_text"))
    classes = {h: cats if label == "Category" else subs for h, label in HEAD_LABELS.items()}
    models = nb.fit_heads(train, HEAD_LABELS, "tokens", alpha=alpha, classes=classes)
    for head, model in models.items():
        save_nb(model, f"{model_dir}/{head}")
    named = split.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train"))
    metrics = nb.evaluate_heads(models, named, "_key", "tokens", HEAD_LABELS, split="split")
    metrics.write.mode("overwrite").parquet(f"{model_dir}/metrics")
    return {"metrics": spark.read.parquet(f"{model_dir}/metrics"), "rejects": rejects,
            "models": models}


def predict_ledger(spark: SparkSession, source, model_dir: str, out_path: str | None = None,
                   ) -> DataFrame:
    """Prediction table ``Description`` (cleaned), ``Category``,
    ``Sub_Category`` (written as ``Subcategory``), ``Raw_Description``, ``_pos``.
    Every surviving row is labelled, even without a known token."""
    checkpoint_dir(spark)
    rows = prepare(load_ledger(spark, source)).checkpoint(eager=True)
    models = {head: load_nb(spark, f"{model_dir}/{head}") for head in HEAD_LABELS}
    # both heads scored independently, in one pass over the tokens
    preds = nb.score_heads(models, rows, "_pos", "tokens").select(
        "_pos", *[F.col(f"{head}_pred_label").alias(label) for head, label in HEAD_LABELS.items()])
    out = (rows.select("_pos", "Raw_Description", F.array_join("tokens", " ").alias("Description"))
           .join(preds, "_pos")
           .select("_pos", "Description", "Category", "Sub_Category", "Raw_Description"))
    if out_path is None:
        return out
    # part files in the order of the input: a range-partitioned sort, no single task
    io_csv.write_predictions(out.orderBy("_pos"), out_path)
    return io_csv.read_predictions(spark, out_path)


def augment_cities(spark: SparkSession, merchants: str, cities: str, out_path: str, *,
                   city_columns: Sequence[str] = ("city", "state"), cap: int | None = None,
                   seed: int = 42) -> DataFrame:
    """Ledger CSV and city CSV -> ledger CSV with one row per distinct city:
    the merchants in turn, their text extended by the city and state, labels
    and source kept."""
    led = io_csv.read_ledger(spark, merchants)
    first = dedupe_first(led, ["Description"], "_pos")
    places = io_csv.read_ledger(spark, cities, columns=list(city_columns))
    places = places.select(F.concat_ws(" ", *city_columns).alias("city_state"))
    out = augment_city(first, places, order_col="_pos", cap=cap, seed=seed)
    io_csv.write_csv(out.select("Description", "Category", "Sub_Category"), out_path)
    return io_csv.read_ledger(spark, out_path)


def compose_restaurants(spark: SparkSession, source: str, out_path: str, *,
                        category: str = "Food", sub_category: str = "Fast_Food") -> DataFrame:
    """Restaurant CSV (name, address, categories, city, country, province) ->
    ledger CSV of composed descriptions; rows without one of them go."""
    columns = ["name", "address", "categories", "city", "country", "province"]
    rows = io_csv.read_ledger(spark, source, columns=columns)
    out = rows.select(compose_description(*columns).alias("Description"),
                      F.lit(category).alias("Category"),
                      F.lit(sub_category).alias("Sub_Category")).dropna(subset=["Description"])
    io_csv.write_csv(out, out_path)
    return io_csv.read_ledger(spark, out_path)


def summarise(spark: SparkSession, source, as_of, *,
              taxonomy: Mapping[str, Sequence[str]] = SUMMARY_TAXONOMY) -> dict[str, DataFrame]:
    """Totals, both trees and the label texts for the period of ``as_of``, from one
    scan of the ledger."""
    ledger = source if isinstance(source, DataFrame) else io_csv.read_dated(spark, source)
    nodes = shared_table(rollup.summary_nodes(ledger, taxonomy, as_of), "nodes")

    def total(period: str):
        return F.max(F.when(F.col("period") == period, F.col("value")))

    def tree(period: str) -> DataFrame:
        return nodes.where((F.col("period") == period) & (F.col("kind") != "total")).select(
            "node_id", "label", "parent", "value", "cat_ord", "sub_ord")

    totals = nodes.where("kind = 'total'").agg(total("month").alias("mtd_total"),
                                               total("year").alias("ytd_total"))
    return {"totals": totals, "tree_ytd": tree("year"), "tree_mtd": tree("month"),
            "labels": summary.labels_of(totals, as_of)}

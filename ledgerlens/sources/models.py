"""Model tables on shared storage (Parquet), saved and loaded by path.

A model is one version: its tables are written to a folder of their own, then the
manifest is switched.  Who loads while another saves gets the old model or the
new one, whole."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .versions import committed, publish


def save_nb(model, path: str) -> str:
    spark = model.classes.sparkSession

    def write(folder: str) -> None:
        model.classes.write.parquet(f"{folder}/classes")
        model.tokens.write.parquet(f"{folder}/tokens")
        spark.createDataFrame(
            [(int(model.vocab_size), float(model.alpha), int(model.token_rows))],
            "vocab_size bigint, alpha double, token_rows bigint",
        ).coalesce(1).write.parquet(f"{folder}/meta")

    publish(spark, path, write)
    return path


def load_nb(spark: SparkSession, path: str):
    """The last model saved at ``path``."""
    from ..operators.naive_bayes import NaiveBayesModel
    folder = committed(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no model at {path}")
    meta = spark.read.parquet(f"{folder}/meta").first()
    return NaiveBayesModel(
        classes=spark.read.parquet(f"{folder}/classes"),
        tokens=spark.read.parquet(f"{folder}/tokens"),
        vocab_size=int(meta.vocab_size), alpha=float(meta.alpha),
        token_rows=int(meta.token_rows))


def save_pipeline(model, path: str) -> str:
    """Spark ML models (PipelineModel and friends), by their own writer."""
    publish(SparkSession.active(), path, lambda folder: model.write().save(folder))
    return path


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel
    folder = committed(SparkSession.active(), path)
    if folder is None:
        raise FileNotFoundError(f"no model at {path}")
    return PipelineModel.load(folder)

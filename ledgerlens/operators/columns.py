"""Column standardisation and label null handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER_COLUMNS = ["Description", "Category", "Sub_Category"]
TRAINING_COLUMNS = ["Description", "Category", "Sub_Category", "Tok_Cat", "Tok_Sub", "Tokenized"]


def _has(df: DataFrame, name: str) -> bool:
    return any(c.lower() == name.lower() for c in df.columns)


def standardise_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Training-frame layout.

    ``Product Name`` becomes ``Description`` (both present is an error);
    ``Sub_Category`` is added as '' when absent; ``Tok_Cat``, ``Tok_Sub`` and
    ``Tokenized`` are added as ''; the frame is reduced to those six columns
    (plus ``keep``, e.g. a key or position) with missing ones null; rows with a
    null Description are dropped and a null Category becomes ''.
    """
    if _has(df, "Product Name"):
        if _has(df, "Description"):
            raise ValueError("both 'Product Name' and 'Description' are present")
        df = df.withColumnRenamed("Product Name", "Description")
    if not _has(df, "Sub_Category"):
        df = df.withColumn("Sub_Category", F.lit(""))
    df = (df.withColumn("Tokenized", F.lit(""))
          .withColumn("Tok_Cat", F.lit(""))
          .withColumn("Tok_Sub", F.lit("")))
    cols = [F.col(c).cast("string").alias(c) if _has(df, c)
            else F.lit(None).cast("string").alias(c) for c in TRAINING_COLUMNS]
    out = df.select(*keep, *cols).dropna(subset=["Description"])
    return out.na.fill("", subset=["Category"])


def fill_labels(df: DataFrame, labels: Sequence[str] = ("Category", "Sub_Category")) -> DataFrame:
    """Labels as strings; a null label becomes '' (the row is kept)."""
    for c in labels:
        df = df.withColumn(c, F.col(c).cast("string"))
    return df.na.fill("", subset=list(labels))


def drop_unlabelled(df: DataFrame, labels: Sequence[str] = ("Category", "Sub_Category")) -> DataFrame:
    """Drop a row when any label is null."""
    return df.dropna(how="any", subset=list(labels))

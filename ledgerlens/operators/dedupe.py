"""Keep-first de-duplication.

``drop_duplicates(subset=keys, keep='first')`` needs a row position: Spark has
no row order.  The caller names an order column (for CSV sources the reader
adds ``_pos``).  Null keys group together, as NaN did.

Keys (whole texts, often) are grouped by a 256-bit digest, so the aggregate
compares and shuffles 32 bytes a row, combined map-side: a key that holds a
third of all rows sends one row per task.  With a position of fixed width (a
number) that is a hash aggregate.  The winners' positions then pick the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_digest(df: DataFrame, keys: Sequence[str]) -> Column:
    """SHA-256 of the keys with their lengths; a null differs from any value."""
    parts = []
    for k in keys:
        text = F.col(k).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text),
                                F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def dedupe_first(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """One row per distinct ``keys``: the one with the smallest ``order_col``
    (which must be unique per row and the same each time ``df`` is read)."""
    first = (df.select(key_digest(df, keys).alias("_g"), F.col(order_col).alias("_o"))
             .groupBy("_g").agg(F.min("_o").alias("_o")).select("_o"))
    return df.join(first, F.col(order_col) == F.col("_o"), "left_semi")

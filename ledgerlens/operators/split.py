"""Reproducible train / test split.

A row is in the test set when the first 8 hex digits of
``md5(seed || '|' || key)`` fall below ``test_size * 2^32``: a per-row
expression (no shuffle), stable under any partitioning and expressible in
SQL.  ``exact=True`` instead takes exactly ``ceil(test_size * n)`` rows with
the smallest (hash, key).

The exact cut-off is found without sorting the data: two histograms of the
hash prefix (16 bits each, at most 65,536 counts reach the driver) narrow
the cut-off to one 8-digit hash, and the rows sharing that hash (a handful
for unique keys) are ordered by key with a bounded top-k (a distributed rank
beyond ``MAX_TIES``).  The passes read a checkpoint of the (key, hash)
projection alone; the flag itself is a per-row comparison with the cut-off.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .rank import global_rank

BATCH_SIZE = 64
LEVEL_DIGITS = 4          # hex digits (16 bits) resolved per histogram pass
MAX_TIES = 100_000        # rows sharing the cut-off hash ordered by a top-k up to this


def split_hash(key: str | Column, seed: int = 42) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.substring(F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string"))), 1, 8)


def content_key(*columns: str) -> Column:
    """A 128-bit key of the columns' values as text, nulls told apart from every
    value: the same wherever and however the row is stored."""
    parts = []
    for c in columns:
        parts += [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")),
                  F.lit(chr(31))]
    return F.md5(F.concat(*parts[:-1]))


def threshold_hex(test_size: float) -> str:
    return format(min(int(test_size * 2 ** 32), 2 ** 32 - 1), "08x")


def train_test_split(df: DataFrame, key: str, *, test_size: float = 0.33, seed: int = 42,
                     exact: bool = False, flag: str = "is_test") -> DataFrame:
    """Add the boolean ``flag`` column (True = test)."""
    h = split_hash(key, seed)
    if not exact:
        return df.withColumn(flag, h < F.lit(threshold_hex(test_size)))
    # the passes below read this narrow (key, hash) checkpoint, not the
    # caller's plan: its upstream runs once here and once for the flag
    checkpoint_dir(df.sparkSession)
    pairs = df.select(key, h.alias("_h")).checkpoint(eager=True)
    n = pairs.count()
    n_test = math.ceil(test_size * n)
    if n_test == 0:
        return df.withColumn(flag, F.lit(False))
    cut_hash, cut_key = exact_cutoff(pairs, key, F.col("_h"), n_test)
    k = F.col(key)
    return df.withColumn(flag, (h < F.lit(cut_hash))
                         | ((h == F.lit(cut_hash)) & (k <= F.lit(cut_key))))


def exact_cutoff(df: DataFrame, key: str, h: Column, rank: int):
    """``(hash, key)`` of the row at 1-based position ``rank`` in (hash, key)
    order (``key`` unique, ``1 <= rank <= rows``)."""
    hashed = df.select(F.col(key).alias("_k"), h.alias("_h"))
    width = 8
    prefix, remaining, group_rows = "", rank, None
    while len(prefix) < width:
        part = hashed if not prefix else hashed.filter(F.col("_h").startswith(prefix))
        bucket = F.substring("_h", len(prefix) + 1, LEVEL_DIGITS)
        # at most 16^LEVEL_DIGITS rows (one per bucket)
        counts = sorted((r.b, r.n) for r in part.groupBy(bucket.alias("b"))
                        .agg(F.count(F.lit(1)).alias("n")).collect())
        for b, c in counts:
            if remaining <= c:
                prefix, group_rows = prefix + b, c
                break
            remaining -= c
        else:
            raise ValueError("rank is larger than the number of rows")
    ties = hashed.filter(F.col("_h") == prefix).select("_k")
    if group_rows <= MAX_TIES:
        last = ties.orderBy("_k").limit(remaining).collect()[-1]
    else:
        last = global_rank(ties, [F.col("_k")], "_r").filter(F.col("_r") == remaining).first()
    return prefix, last["_k"]


def split_counts(flagged: DataFrame, flag: str = "is_test",
                 batch_size: int = BATCH_SIZE) -> DataFrame:
    """Total / train / test rows and mini-batch counts ``ceil(n / batch)``."""
    n_test = F.sum(F.col(flag).cast("long"))
    n_all = F.count(F.lit(1))
    agg = flagged.agg(n_all.alias("n_total"), n_test.alias("n_test"))
    return agg.select(
        F.col("n_total").cast("bigint").alias("n_total"),
        (F.col("n_total") - F.coalesce("n_test", F.lit(0))).cast("bigint").alias("n_train"),
        F.coalesce("n_test", F.lit(0)).cast("bigint").alias("n_test"),
        F.ceil((F.col("n_total") - F.coalesce("n_test", F.lit(0))) / batch_size)
         .cast("bigint").alias("train_batches"),
        F.ceil(F.coalesce("n_test", F.lit(0)) / batch_size).cast("bigint").alias("test_batches"))

"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import scratch_path
from ledgerlens.sources.blobs import (BATCH_BYTES, bound_batches, load_object,  # noqa: F401
                                      open_folder, save_object)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts
    lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder that driver and executors both reach."""
    return scratch_path(spark, name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(batches, column: int, size: int = 4 << 20):
    """The record batches cut so that the texts of ``column`` take about
    ``size`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            used = ends[at] - sizes[at]
            end = max(at + 1, int(np.searchsorted(ends, used + size, side="right")))
            yield batch.slice(at, end - at)
            at = end


def gathered_batches(batches, column: int, size: int = 24 << 20):
    """Record batches of about ``size`` bytes of texts, joined from smaller ones
    (for steps whose cost is per distinct word of a batch)."""
    kept, total = [], 0
    for batch in small_batches(batches, column, size):
        kept.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(kept)
            kept, total = [], 0
    if kept:
        yield pa.concat_batches(kept)


def as_bytes(column: pa.Array, null: bytes | None = b"") -> list:
    """UTF-8 bytes of a string column; nulls become ``null``."""
    values = column.cast(pa.binary()).to_pylist()
    if column.null_count:
        values = [null if v is None else v for v in values]
    return values


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))

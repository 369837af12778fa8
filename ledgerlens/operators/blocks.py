"""Look-ups of the items of whole rows (tokens, ids) in a table of any size.

An exploded join moves every item of every row twice, with its key, and what was
found for it.  Here the rows are dealt to blocks of about ``BLOCK_ITEMS`` items, and
what is joined to the table is each distinct item of a block, once.  The rows of a
block and its small table then meet in one task (a co-group), where array operations
do the rest.  So what is shuffled is the rows once, as they are, and the distinct
items of a block twice; a task holds one block (one row at least).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import shared_table

BLOCK_ITEMS = 1 << 20


def blocks_of(df: DataFrame, keep: Sequence[str], items_col: str,
              block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(*keep, _items, _block)`` as a table: a block is a run of rows of a partition."""
    rows = shared_table(df.select(*keep, F.col(items_col).alias("_items"),
                                  F.monotonically_increasing_id().alias("_row")), "rows")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.greatest(F.size("_items"), F.lit(0))).alias("items")).first()
    per_block = block_items * sizes.n // (sizes.items or sizes.n or 1)
    # the row's number in its partition takes the lower 33 bits
    shift = min(33, max(1, per_block).bit_length() - 1)
    return rows.withColumn("_block", F.shiftright("_row", shift)).drop("_row")


def meet_by_blocks(df: DataFrame, keep: Sequence[str], items_col: str, table: DataFrame,
                   item: str, run: Callable[[pa.Table, pa.Table], pa.Table],
                   schema: T.StructType, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``run(rows, found)`` for every block: its rows ``(*keep, _items)``, and the rows
    of ``table`` whose column ``item`` (unique there) is among their items."""
    rows = blocks_of(df, keep, items_col, block_items)
    items = rows.select(F.col("_block").alias("_for"), F.explode("_items").alias(item)).distinct()
    found = items.join(table, item)
    return (rows.groupBy("_block").cogroup(found.groupBy("_for"))
            .applyInArrow(lambda own, its: run(own, its), schema))


def _array(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def places(rows: pa.Table, found: pa.Table, item: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """For the items of all rows, one after another, their places in ``found`` (null:
    not there); the offsets of the rows in them; which rows are null."""
    lists = _array(rows.column("_items"))
    known = _array(found.column(item)).cast(lists.type.value_type)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return (pc.index_in(lists.flatten(), value_set=known), offsets,
            pc.is_null(lists).to_numpy(zero_copy_only=False))


def look_up(df: DataFrame, key: str, items_col: str, table: DataFrame, item: str, value: str,
            block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(key, _items, _found)``: of every item of every row the ``value`` that
    ``table`` has for it, in order (null: none); null rows stay null."""
    pairs = table.select(item, value)
    # a table read back has nullable elements
    item_type = T.ArrayType(df.schema[items_col].dataType.elementType)
    schema = T.StructType([df.schema[key], T.StructField("_items", item_type),
                           T.StructField("_found", T.ArrayType(pairs.schema[value].dataType))])

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        at, offsets, nulls = places(rows, found, item)
        values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                          _array(found.column(value)).take(at),
                                          mask=pa.array(nulls))
        return pa.table({key: rows.column(key), "_items": rows.column("_items"),
                         "_found": values})

    return meet_by_blocks(df, [key], items_col, pairs, item, run, schema, block_items)

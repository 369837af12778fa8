"""Array helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_elements(df: DataFrame, keep: Sequence[str | Column], array_col: str | Column,
                     name: str, pos: str | None = None) -> DataFrame:
    """One row per (non-null) element of ``array_col`` with the ``keep``
    columns (and the element position as ``pos`` when named).

    Uses an *outer* explode plus a null filter: for an inner explode Catalyst
    infers ``size(arr) > 0 AND isnotnull(arr)`` before the generator, which
    evaluates a computed array (e.g. the cleaning chain) three times."""
    arr = F.col(array_col) if isinstance(array_col, str) else array_col
    gen = (F.posexplode_outer(arr).alias(pos, name) if pos
           else F.explode_outer(arr).alias(name))
    return df.select(*keep, gen).filter(F.col(name).isNotNull())

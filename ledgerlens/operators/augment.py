"""Synthetic training rows: word-shuffled copies, merchant x city rows and
composed restaurant descriptions.

Randomness is replaced by md5 of (seed, key, position): stable under any
partitioning, reproducible, and the same in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import global_rank


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: str | Column) -> Column:
    """Whitespace-separated words (like ``str.split()``)."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def shuffled_text(text: str | Column, key: str | Column, seed: int = 42) -> Column:
    """The words of ``text`` in an order fixed by ``md5(seed|key|position)``,
    joined by one space."""
    k = _c(key).cast("string")
    tagged = F.transform(words(text), lambda w, i: F.struct(
        F.md5(F.concat(F.lit(f"{seed}|"), k, F.lit("|"), i.cast("string"))).alias("h"),
        i.alias("i"), w.alias("w")))
    return F.array_join(F.transform(F.array_sort(tagged), lambda s: s["w"]), " ")


def shuffle_words(df: DataFrame, key: str, text_col: str = "Description", *,
                  seed: int = 42, flag: str = "is_augmented") -> DataFrame:
    """The rows plus a word-shuffled copy of each (row count doubles); a
    narrow union, no shuffle."""
    original = df.withColumn(flag, F.lit(False))
    copy = df.withColumn(text_col, shuffled_text(text_col, key, seed)).withColumn(flag, F.lit(True))
    return original.unionByName(copy)


def augment_city(merchants: DataFrame, cities: DataFrame, *, order_col: str,
                 text_col: str = "Description", city_col: str = "city_state",
                 cap: int | None = None, seed: int = 42) -> DataFrame:
    """Attach distinct cities to merchants round-robin.

    Cities are ranked by ``md5(seed|city)``; the city of rank r goes to the
    merchant at position ``(r - 1) mod n_merchants`` (merchant positions from
    ``order_col``, which must be unique).  Every distinct city gives a row (the
    first ``cap`` ones if a cap is asked for) with all columns of its merchant,
    the text extended by the city, and ``city_rank, merchant, city_state``.

    Positions come from range-partitioned sorts (``global_rank``), never from
    one task; merchants are then met by a join on the position."""
    if cap is not None and cap < 1:
        raise ValueError("cap must be positive")
    ranked = global_rank(merchants, [order_col], "_m").withColumn("_m", F.col("_m") - 1)
    # of the checkpointed ranks: the merchants' plan does not run again
    last = ranked.agg(F.max("_m")).first()[0]
    if last is None:
        raise ValueError("no merchants")
    n = last + 1
    c = (cities.select(F.col(city_col).alias("city_state")).dropna().distinct()
         .withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("city_state")))))
    c = global_rank(c, ["_h", "city_state"], "city_rank").drop("_h")
    if cap is not None:
        c = c.where(F.col("city_rank") <= cap)
    c = c.withColumn("_m", F.pmod(F.col("city_rank") - 1, F.lit(n)))
    text = F.concat(F.col(text_col), F.lit(" "), F.col("city_state")).alias(text_col)
    return c.join(ranked, "_m").select(
        "city_rank", F.col(text_col).alias("merchant"), "city_state", text,
        *[x for x in merchants.columns if x not in (text_col, order_col)])


def compose_description(name: str | Column, address: str | Column, categories: str | Column,
                        city: str | Column, country: str | Column,
                        province: str | Column) -> Column:
    """``name address name categories name city country province country``
    joined by spaces; null if any part is null."""
    n, sp = _c(name), F.lit(" ")
    parts: Sequence[Column] = [n, _c(address), n, _c(categories), n, _c(city),
                               _c(country), _c(province), _c(country)]
    out: list[Column] = []
    for i, p in enumerate(parts):
        if i:
            out.append(sp)
        out.append(p)
    return F.concat(*out)

"""Label encoding, vocabulary, token ids, padding and decoding.

Class indices follow the sorted distinct class names (0..K-1).  Token ids
come from a corpus vocabulary ranked by count (desc) then token (asc); ids
start at ``FIRST_TOKEN_ID``; 0 pads, ``UNKNOWN_ID`` marks a token outside the
vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import explode_elements
from .blocks import look_up
from .rank import global_rank

PAD_ID = 0
UNKNOWN_ID = 100
FIRST_TOKEN_ID = 101
UNKNOWN_TOKEN = "[UNK]"
MAX_CLASSES = 2_000        # class tables are broadcast and become literals


# --- labels ----------------------------------------------------------------

def class_table(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """``(class_name, class_idx)`` for a bounded list of names (a taxonomy)."""
    distinct = sorted({n for n in names if n is not None})
    if len(distinct) > MAX_CLASSES:
        raise ValueError(f"{len(distinct)} classes; limit is {MAX_CLASSES}")
    schema = T.StructType([T.StructField("class_name", T.StringType(), False),
                           T.StructField("class_idx", T.IntegerType(), False)])
    return spark.createDataFrame([(n, i) for i, n in enumerate(distinct)], schema)


def classes_from_data(df: DataFrame, label_col: str) -> DataFrame:
    """Class table of the distinct non-null labels of a column.  The
    distinct is a partially aggregated group-by; at most ``MAX_CLASSES + 1``
    names reach the driver (more is an error, as a class table is
    broadcast wherever it is used)."""
    names = [r[0] for r in df.select(F.col(label_col)).dropna().distinct()
             .limit(MAX_CLASSES + 1).collect()]
    return class_table(df.sparkSession, names)


def one_hot(idx: str | Column, k: int) -> Column:
    """``array<double>`` of length k with 1.0 at ``idx`` (null idx -> null)."""
    i = F.col(idx) if isinstance(idx, str) else idx
    return F.when(i.isNotNull(), F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda j: F.when(j == i, F.lit(1.0)).otherwise(F.lit(0.0))))


def argmax_index(vec: str | Column) -> Column:
    """Index of the first 1.0 in a one-hot vector (null when none)."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.nullif(F.array_position(v, F.lit(1.0)), F.lit(0)).cast("int") - 1


def encode_labels(df: DataFrame, label_col: str, classes: DataFrame, *,
                  idx_col: str, vec_col: str | None = None, k: int | None = None) -> DataFrame:
    """Left join to the class table: unknown labels keep the row with a null
    index.  The class table is broadcast after a check of its size."""
    if classes.limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    cls = classes.select(F.col("class_name").alias(label_col),
                         F.col("class_idx").alias(idx_col))
    out = df.join(F.broadcast(cls), label_col, "left")
    if vec_col is not None:
        if k is None:
            raise ValueError("k is required for the one-hot vector")
        out = out.withColumn(vec_col, one_hot(idx_col, k))
    return out


# --- vocabulary and ids ----------------------------------------------------

def build_vocab(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """``(token, token_id, count)`` over an exploded token column.  Counting is
    a partially aggregated hash aggregate; ranking is ``global_rank``."""
    counts = tokens.groupBy(F.col(token_col).alias("token")).agg(
        F.count(F.lit(1)).alias("count"))
    ranked = global_rank(counts, [F.col("count").desc(), F.col("token").asc()], "r")
    return ranked.select("token", (F.col("r") + FIRST_TOKEN_ID - 1).alias("token_id"),
                         F.col("count").cast("bigint").alias("count"))


def explode_tokens(df: DataFrame, key: str, tokens_col: str) -> DataFrame:
    """``(key, pos, token)``; only the key travels with each token."""
    return explode_elements(df, [key], tokens_col, "token", pos="pos")


def token_ids(df: DataFrame, key: str, tokens_col: str, vocab: DataFrame,
              out_col: str = "token_ids", *,
              broadcast_tokens: int | None = None) -> DataFrame:
    """``(key, out_col)``: the id of every token in order (unknown -> 100),
    for every row of ``df`` (null tokens -> null, empty -> []).

    The distinct tokens of a block of rows are joined to the vocabulary, and the rows
    take their ids from what was found for their block (``blocks``), so that what is
    shuffled grows with the rows whatever the size of the vocabulary.

    ``broadcast_tokens`` asks for a plan of exploded rows instead.  The vocabulary is
    then broadcast when it has at most so many rows:
    the exploded rows of a key then sit in one task and its ids are collected
    there, so the shuffle carries one array per row.  A larger one is met by a
    shuffle join of distinct (key, token) pairs with their positions, so a common
    token is sent once per row that has it.  Row text never travels with the
    tokens."""
    if broadcast_tokens is None:
        ids = F.transform("_found", lambda i: F.coalesce(i, F.lit(UNKNOWN_ID)).cast("int"))
        return look_up(df, key, tokens_col, vocab, "token", "token_id").select(
            key, ids.alias(out_col))
    arr = F.col(tokens_col)
    exploded = df.select(key, arr.isNull().alias("_null"),
                         F.posexplode_outer(arr).alias("pos", "token"))
    pairs = vocab.select("token", "token_id")
    known = F.coalesce("token_id", F.lit(UNKNOWN_ID))
    if vocab.limit(broadcast_tokens + 1).count() <= broadcast_tokens:
        joined = exploded.join(F.broadcast(pairs), "token", "left")
        item = F.collect_list(F.when(F.col("pos").isNotNull(),
                                     F.struct("pos", known.alias("id"))))
    else:
        places = exploded.groupBy(key, "_null", "token").agg(F.collect_list("pos").alias("_at"))
        joined = places.join(pairs, "token", "left")
        item = F.flatten(F.collect_list(F.transform(
            "_at", lambda p: F.struct(p.alias("pos"), known.alias("id")))))
    return (joined.groupBy(key)
            .agg(F.sort_array(item).alias("_p"), F.max("_null").alias("_null"))
            .select(key, F.when(F.col("_null"), F.lit(None))
                    .otherwise(F.transform("_p", lambda s: s["id"].cast("int"))).alias(out_col)))


def pad_ids(ids: str | Column, length: int) -> Column:
    """Pad with 0 / truncate at the end to exactly ``length`` ids."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(F.concat(c, F.array_repeat(F.lit(PAD_ID), length)), 1, length)


def decode_ids(df: DataFrame, key: str, ids_col: str, vocab: DataFrame,
               out_col: str = "decoded", drop_pad: bool = True, *,
               broadcast_tokens: int | None = None) -> DataFrame:
    """``(key, out_col)``: ids back to text (pads dropped, unknown ids as
    ``[UNK]``), words joined by one space; null ids -> null.  Planned as
    ``token_ids``."""
    if broadcast_tokens is None:
        both = F.arrays_zip("_items", "_found")
        if drop_pad:
            both = F.filter(both, lambda x: x["_items"] != PAD_ID)
        words = F.transform(both, lambda x: F.coalesce(x["_found"], F.lit(UNKNOWN_TOKEN)))
        return look_up(df, key, ids_col, vocab, "token_id", "token").select(
            key, F.array_join(words, " ").alias(out_col))
    arr = F.col(ids_col)
    exploded = df.select(key, arr.isNull().alias("_null"),
                         F.posexplode_outer(arr).alias("pos", "token_id"))
    keep = F.col("pos").isNotNull()
    if drop_pad:
        keep = keep & (F.col("token_id") != PAD_ID)
    pairs = vocab.select("token_id", "token")
    word = F.coalesce("token", F.lit(UNKNOWN_TOKEN))
    if vocab.limit(broadcast_tokens + 1).count() <= broadcast_tokens:
        joined = exploded.join(F.broadcast(pairs), "token_id", "left")
        item = F.collect_list(F.when(keep, F.struct("pos", word.alias("w"))))
    else:
        places = exploded.withColumn("_keep", keep).groupBy(key, "_null", "token_id").agg(
            F.collect_list(F.when(F.col("_keep"), F.col("pos"))).alias("_at"))
        joined = places.join(pairs, "token_id", "left")
        item = F.flatten(F.collect_list(F.transform(
            "_at", lambda p: F.struct(p.alias("pos"), word.alias("w")))))
    return (joined.groupBy(key)
            .agg(F.sort_array(item).alias("_p"), F.max("_null").alias("_null"))
            .select(key, F.when(F.col("_null"), F.lit(None))
                    .otherwise(F.array_join(F.transform("_p", lambda s: s["w"]), " "))
                    .alias(out_col)))


def ids_text(ids: str | Column) -> Column:
    """Ids as one space-separated string (for sinks and comparisons)."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")

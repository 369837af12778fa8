"""Importance resampling towards a target distribution, by prefix CRCs.

Features are all runs of 1 to ``order`` consecutive words (runs of digits, letters
and non-ASCII characters, A-Z lowered), joined by one space; a feature's bucket is
the CRC-32 of its bytes modulo ``buckets``.  A text is normalised to its words
with single spaces and scanned once: the running CRC after every word is stored.
The CRC of any n-gram then follows from two prefixes, as the CRC is linear over
GF(2): crc(B) = crc(AB) xor shift(crc(A), |B|), where shift(x, n) moves x over n
zero bytes and is a table of four times 256 entries per length.

A bucket's gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for
t of T features of the target texts and s of S of all documents in it; a document's
weight is the floored mean of its features' gains.  Weight plus Gumbel noise
from a hash of the id is its score, and the ``share`` percent of highest scores among
documents with ``min_words`` words are drawn: a sample without replacement,
proportional to the importance weights.

Defined results: a null text has no features and the weight 0; a null id is hashed
as empty text and comes last among equal scores; repeated rows are ranked each,
in any order if they are equal in all; with an empty target every bucket's t is
0; an empty table gives no rows.

Scale: texts are read once; their buckets stand in a table, two bytes a feature.
Counts are ``buckets`` numbers per task; gains are ``buckets`` numbers.  A
histogram of scores (integers of a narrow range) finds the lowest score that is
drawn; only the documents from there on are sorted, by a range-partitioned sort
with offsets per partition.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_table, small_batches
from ledgerlens.llm.decontaminate import _FOLD
from ledgerlens.operators.rank import global_rank

BUCKETS = 10_000
ORDER = 2
MIN_WORDS = 20
SHARE = 25           # percent
SEED = 7
_NEAR = 64           # lengths with a table of their own
_TEXT_BYTES = 2 << 20


# CRC-32 over GF(2) -----------------------------------------------------------

def _byte_table() -> np.ndarray:
    """The CRC register after one more zero byte, for its lowest byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_STEP = _byte_table()


def _images(units: np.ndarray) -> np.ndarray:
    """Tables of a linear map per byte of its argument, from the images of the
    32 unit vectors: 4 x 256."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit:2 << bit] = out[byte, :1 << bit] ^ units[8 * byte + bit]
    return out


def _apply(tables: np.ndarray, x: np.ndarray, base=0) -> np.ndarray:
    """The linear map at ``base`` (1024 entries each) of the flat ``tables``."""
    out = tables[base + (x & np.uint32(255))]
    for byte in (1, 2, 3):
        out ^= tables[base + 256 * byte + (x >> np.uint32(8 * byte) & np.uint32(255))]
    return out


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Flat tables of the shifts by 0 .. 63 bytes, and by 64, 128, 256, ...."""
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    near = []
    for _ in range(_NEAR):
        near.append(_images(units))
        units = _STEP[units & np.uint32(255)] ^ (units >> np.uint32(8))
    far = []
    for _ in range(40):
        far.append(_images(units).reshape(-1))
        units = _apply(far[-1], units)
    return np.concatenate(near).reshape(-1), np.stack(far)


_NEAR_TABLES, _FAR_TABLES = _shift_tables()


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``crc`` moved over ``n`` zero bytes, elementwise."""
    out = _apply(_NEAR_TABLES, crc, (n % _NEAR) * 1024)
    rest, power = n // _NEAR, 0
    while rest.any():
        at = np.flatnonzero(rest & 1)
        out[at] = _apply(_FAR_TABLES[power], out[at])
        rest, power = rest >> 1, power + 1
    return out


def _after_space(crc: np.ndarray) -> np.ndarray:
    """The CRC of the same bytes and one more space."""
    register = ~crc
    return ~(_STEP[(register ^ np.uint32(32)) & np.uint32(255)] ^ (register >> np.uint32(8)))


def _running(words: list[bytes]) -> np.ndarray:
    """CRC of the words joined by single spaces, up to every word's end."""
    crc = zlib.crc32
    pieces = map(b" ".__add__, words[1:])
    return np.fromiter(accumulate(pieces, lambda c, piece: crc(piece, c),
                                  initial=crc(words[0])), np.uint32, len(words))


def gram_crcs(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of every text; and per n from 1 to ``order`` the CRC-32 of its
    n-grams, text by text.  The texts are one stream of words: any n-gram's CRC
    follows from the stream's prefixes before and after it."""
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    folded = b" ".join([*texts, b""]).translate(_FOLD)
    letter = np.frombuffer(folded, np.uint8) != 32
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    begin, size = edges[::2], edges[1::2] - edges[::2]
    owner = np.searchsorted(ends, begin, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    if not len(size):
        return n_words, [np.zeros(0, np.uint32)] * order
    after = _running(folded.split())
    before = np.concatenate(([np.uint32(0)], _after_space(after[:-1])))
    grams = []
    length = size.copy()
    for n in range(1, order + 1):
        if n > 1:
            length = length[:-1] + 1 + size[n - 1:]
        inside = np.flatnonzero(owner[:len(length)] == owner[n - 1:]) if len(length) else \
            np.zeros(0, np.int64)
        grams.append(after[inside + n - 1] ^ shift(before[inside], length[inside]))
    return n_words, grams


# the operator ----------------------------------------------------------------

def features(rows: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """Table of the rows (_id, _text): _id, n_words, buckets (of all features,
    unsigned, two bytes each or four)."""
    kind = rows.schema["_id"].dataType.simpleString()
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def step(batches):
        for batch in small_batches(batches, 1, _TEXT_BYTES):
            texts = pc.fill_null(batch.column(1).cast(pa.binary()), b"").to_pylist()
            n_words, grams = gram_crcs(texts, order)
            # every text's n-grams of all lengths side by side
            per = [np.maximum(n_words - n, 0) for n in range(order)]
            total = np.sum(per, axis=0)
            ends = np.concatenate(([0], np.cumsum(total)))
            out = np.empty(int(ends[-1]), width)
            start = ends[:-1].copy()
            for own, crcs in zip(per, grams):
                first = np.cumsum(own) - own
                out[np.repeat(start - first, own) + np.arange(len(crcs))] = crcs % buckets
                start += own
            lists = pa.Array.from_buffers(
                pa.large_binary(), len(texts),
                [None, pa.py_buffer(ends.astype(np.int64) * out.itemsize), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words.astype(np.int64)), lists.cast(pa.binary())],
                names=["_id", "n_words", "buckets"])

    return shared_table(rows.mapInArrow(step, f"_id {kind}, n_words long, buckets binary"),
                        "features")


def bucket_counts(table: DataFrame, buckets: int) -> np.ndarray:
    """Features in every bucket over all rows of ``features``."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def step(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                n += np.bincount(np.frombuffer(own, width), minlength=buckets) \
                    if len(own) > 1 << 16 else 0
            flat = b"".join(b for b in batch.column(0).to_pylist() if len(b) <= 1 << 16)
            n += np.bincount(np.frombuffer(flat, width), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])],
                                         names=["bucket", "n"])

    found = (table.select("buckets").mapInArrow(step, "bucket long, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains_of(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    t, s = target.astype(np.float64), source.astype(np.float64)
    n = float(len(s))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))) \
        .astype(np.int64)


def weights(table: DataFrame, gains: np.ndarray) -> DataFrame:
    """_id, n_words, n_features, weight of every row of ``features``."""
    kind = table.schema["_id"].dataType.simpleString()
    width = np.dtype("<u2" if len(gains) <= 1 << 16 else "<u4")
    shared = table.sparkSession.sparkContext.broadcast(gains)

    def step(batches):
        g = shared.value
        for batch in small_batches(batches, 2, _TEXT_BYTES):
            lists = batch.column(2).to_pylist()
            n = np.fromiter(map(len, lists), np.int64, len(lists)) // width.itemsize
            sums = np.concatenate(([0], np.cumsum(g[np.frombuffer(b"".join(lists), width)])))
            ends = np.cumsum(n)
            total = sums[ends] - sums[ends - n]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n),
                 pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))],
                names=["_id", "n_words", "n_features", "weight"])

    return table.mapInArrow(step, f"_id {kind}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int):
    """Gumbel noise of an id, in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id",
                        text_col: str = "text", target_text_col: str = "text",
                        buckets: int = BUCKETS, order: int = ORDER, share: int = SHARE,
                        min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_features, weight, score, rank (from 1 in
    the order of drawing; null if not drawn)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    wanted = target.select(F.lit(0).alias("_id"), F.col(target_text_col).alias("_text"))
    table = features(rows, buckets, order)
    gains = gains_of(bucket_counts(features(wanted, buckets, order), buckets),
                     bucket_counts(table, buckets))
    scored = shared_table(weights(table, gains).withColumn(
        "score", (F.col("weight") + noise("_id", seed)).cast("long")), "scores")
    able = F.col("n_words") >= min_words
    histogram = scored.where(able).groupBy("score").count().orderBy(F.desc("score")).collect()
    draw = share * sum(r["count"] for r in histogram) // 100
    least, above = None, 0
    for r in histogram:
        if above >= draw:
            break
        least, above = r.score, above + r["count"]
    out = scored.withColumn("rank", F.lit(None).cast("long"))
    if least is not None:
        among = able & (F.col("score") >= least)
        ranked = global_rank(scored.where(among), [
            F.desc("score"), F.asc_nulls_last("_id"), F.asc("n_features"), F.asc("n_words"),
            F.asc("weight")])
        ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
        out = out.where(~among).unionByName(ranked)
    return out.withColumnRenamed("_id", id_col)

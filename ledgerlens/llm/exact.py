"""Exact dedup by a minimal perfect hash over historical distinct digests.

A text's digest is the SHA-256 of its UTF-8 bytes without white space.  The
distinct digests of the history are dealt to shards of about ``shard_digests``;
each shard builds a minimal perfect hash of its digests, and the slot a digest
maps to holds the whole digest, the locator of the group's winner and the
group's size.  Digests of new rows are looked up: the slot's digest is compared
byte for byte; members are repeats and join the slot's group, all others group
among themselves.

Of equal texts the row with the most code points stays, then the smallest id
(a null id counts as larger than all).  Ids are of any type that can be ordered.

Defined results: null and empty texts are equal; repeated rows (same id and
text) are all in the group and have the same ``keep_id``; with no history every
row is new; an empty table gives no rows.

Scale: rows of a text meet only in partially aggregated group-bys, so a group
of copies of any size is one row per task before the shuffle; shards are bounded
by distinct digests.  Texts are never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, mix64, shared_table, small_batches

SHARD_DIGESTS = 200_000
GAMMA = 2.0
_SPACE = b" \t\n\x0b\x0c\r"


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: in every level a key that
    is alone in its cell is settled there, the others go to the next level; the
    rank of its cell's bit is its slot.  Keys left after ``levels`` are listed."""

    def __init__(self, keys: np.ndarray, levels: int = 24):
        self.sizes: list[int] = []
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.size = 0
        rest = np.asarray(keys, np.uint64)
        for level in range(levels):
            if not len(rest):
                break
            cells = int(GAMMA * len(rest)) + 1
            at = self._cell(rest, level, cells)
            alone = np.bincount(at, minlength=cells) == 1
            self.sizes.append(cells)
            self.bits.append(alone)
            self.before.append(self.size + np.cumsum(alone) - alone)
            self.size += int(alone.sum())
            rest = rest[~alone[at]]
        self.left = np.sort(rest)
        self.size += len(rest)

    @staticmethod
    def _cell(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
        seed = np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
        return (mix64(keys ^ seed) % np.uint64(cells)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key; -1 for some keys outside the set (the others land
        in a slot of another key)."""
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, cells in enumerate(self.sizes):
            at = self._cell(keys[rest], level, cells)
            hit = self.bits[level][at]
            out[rest[hit]] = self.before[level][at[hit]]
            rest = rest[~hit]
        if len(self.left):
            place = np.searchsorted(self.left, keys[rest])
            found = (place < len(self.left)) & \
                (self.left[np.minimum(place, len(self.left) - 1)] == keys[rest])
            out[rest[found]] = self.size - len(self.left) + place[found]
        return out


class DigestIndex:
    """Slots of one shard: digest, winner (code points, no id, id), group size.
    Digests are hashed by 64 of their bits; those of the few that share these with
    another digest of the shard are kept in a dictionary instead."""

    def __init__(self, digests: np.ndarray, points, ids, sizes, none=None):
        none = np.zeros(len(digests), bool) if none is None else none
        keys = digest_keys(digests)
        order = np.argsort(keys, kind="stable")
        again = np.zeros(len(keys), bool)
        again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
        first = np.flatnonzero(~again)
        self.hash = PerfectHash(keys[first])
        slot = np.empty(len(keys), np.int64)
        slot[first] = self.hash.slots(keys[first])
        slot[again] = len(first) + np.arange(int(again.sum()))
        self.more = {digests[i].tobytes(): int(slot[i]) for i in np.flatnonzero(again)}
        self.digests = np.empty_like(digests)
        self.digests[slot] = digests
        self.points, self.none, self.ids, self.sizes = (
            np.empty_like(values) for values in (points, none, ids, sizes))
        for to, values in ((self.points, points), (self.none, none), (self.ids, ids),
                           (self.sizes, sizes)):
            to[slot] = values

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Slot of every digest, -1 for those not in the index."""
        slot = self.hash.slots(digest_keys(digests))
        known = slot >= 0
        same = (self.digests[slot[known]] == digests[known]).all(axis=1)
        slot[np.flatnonzero(known)[~same]] = -1
        if self.more:
            for i in np.flatnonzero(slot < 0):
                slot[i] = self.more.get(digests[i].tobytes(), -1)
        return slot


def digest_keys(digests: np.ndarray) -> np.ndarray:
    """First 64 bits of each 32-byte digest."""
    return np.ascontiguousarray(digests[:, :8]).view("<u8").ravel().astype(np.uint64)


def digests(docs: DataFrame, is_history, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """_id, digest, points (code points of the whole text), old of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batches):
        for batch in small_batches(batches, 1):
            texts = as_bytes(batch.column(1))
            found = [hashlib.sha256(t.translate(None, _SPACE)).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary()), *batch.columns[2:]],
                names=["_id", "digest", "points", "old"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("points"),
                       F.coalesce(is_history, F.lit(False)).alias("old"))
    return rows.mapInArrow(step, f"_id {kind}, digest binary, points long, old boolean")


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: winner (code points, whether it has no id, id) and size."""
    best = F.min(F.struct((-F.col("points")).alias("minus"), F.col("_id").isNull().alias("none"),
                          F.col("_id").alias("id"))).alias("best")
    return (rows.groupBy("digest").agg(best, F.count("*").alias("size"))
            .select("digest", (-F.col("best.minus")).alias("points"), "best.none", "best.id",
                    "size"))


_FIELDS = ("digest", "points", "none", "id", "size")
_GROUP = "digest binary, points long, none boolean, id {id}, size long"


def _matrix(table: pa.Table) -> np.ndarray:
    data = b"".join(table.column("digest").to_pylist())
    return np.frombuffer(data, np.uint8).reshape(-1, 32)


def _values(table: pa.Table) -> list[np.ndarray]:
    """points, none, id (anything where there is none), size."""
    ids = table.column("id")
    if ids.null_count:
        some = ids.drop_null()
        ids = pc.fill_null(ids, some[0]) if len(some) else pa.chunked_array(
            [pa.array([False] * len(ids))])
    return [table.column(c).to_numpy() if c != "id" else ids.to_numpy()
            for c in ("points", "none", "id", "size")]


def _merge(old: pa.Table, new: pa.Table) -> pa.Table:
    """Groups of a shard after looking up the new digests in its index."""
    old = old.select([*_FIELDS]) if old.num_rows else None
    new = new.select([f"new_{c}" for c in _FIELDS]).rename_columns([*_FIELDS]) \
        if new.num_rows else None
    if old is None or new is None:
        return new if old is None else old
    id_type = old.schema.field("id").type
    # one id column type on both sides, also where one has no ids at all
    both = _values(pa.concat_tables([old, new]))
    values, fresh = ([v[part] for v in both]
                     for part in (slice(0, old.num_rows), slice(old.num_rows, None)))
    points, none, ids, sizes = values
    index = DigestIndex(_matrix(old), points, ids, sizes, none)
    seen = _matrix(new)
    slot = index.find(seen)
    member = slot >= 0
    at = slot[member]
    points, none, ids, sizes = (v[member] for v in fresh)
    same = points == index.points[at]
    earlier = (none < index.none[at]) | ((none == index.none[at]) & ~none & (ids < index.ids[at]))
    better = (points > index.points[at]) | (same & earlier)
    for kept, v in ((index.points, points), (index.none, none), (index.ids, ids)):
        kept[at[better]] = v[better]
    index.sizes[at] += sizes
    out = [pa.array([d.tobytes() for d in index.digests]
                    + [d.tobytes() for d in seen[~member]], pa.binary())]
    merged = [np.concatenate((kept, v[~member])) for kept, v in
              zip((index.points, index.none, index.ids, index.sizes), fresh)]
    if merged[2].dtype == bool and not pa.types.is_boolean(id_type):      # no ids at all
        merged[2] = np.full(len(merged[2]), None, object)
    out += [pa.array(merged[0]), pa.array(merged[1]),
            pa.array(merged[2], id_type, mask=merged[1]), pa.array(merged[3])]
    return pa.table(out, names=[*_FIELDS])


def exact_dedup(docs: DataFrame, is_history=None, id_col: str = "doc_id",
                text_col: str = "text", shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``is_history``: a condition on ``docs`` that marks the rows delivered
    earlier, whose digests form the index (default: half of them, by a hash of
    the id)."""
    if is_history is None:
        is_history = F.pmod(F.xxhash64(id_col), F.lit(2)) == 0
    rows = shared_table(digests(docs, is_history, id_col, text_col), "digests")
    kind = rows.schema["_id"].dataType.simpleString()
    shards = rows.count() // shard_digests + 1
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    history = groups(rows.where("old")).select("*", shard)
    # fresh names: both sides of a cogroup come from the same rows
    new = groups(rows.where("not old")).select("*", shard).toDF(
        *[f"new_{c}" for c in (*_FIELDS, "shard")])
    merged = (history.groupBy("shard").cogroup(new.groupBy("new_shard"))
              .applyInArrow(_merge, _GROUP.format(id=kind))
              .select("digest", F.col("id").alias("keep"), F.col("size").alias("group_size")))
    # a table of its own: the join can be split where a text is hot
    merged = shared_table(merged, "winners")
    return rows.join(merged, "digest").select(
        F.col("_id").alias(id_col), F.col("keep").alias("keep_id"), "group_size",
        F.col("_id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))

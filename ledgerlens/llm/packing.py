"""Packing of tokenised documents into sequences of at most ``seq_len`` tokens.

Documents are dealt to random groups of about ``group_docs``.  In a group every
document is cut into full sequences and a remainder; remainders are placed by
first-fit decreasing over a tournament tree of bin capacities (the tree finds
the first bin with room in log time).  Gaps of ``min_cut`` tokens or more left
by that are then filled by cutting up the emptiest sequences, so that at most
about one sequence of a group is short.

Defined results: a null text is an empty document (only the end id); every row
gets its own pieces, also repeated ids and rows; an empty table gives no rows.
Only the id and text columns are read.

Scale: one shuffle, of remainders (two bytes a token) and eight bytes per full
sequence; full sequences' ids only travel with ``with_ids``.  A group holds
``group_docs`` documents on average whatever the size of the input.  The group
is a hash of (partition, row number in it): input must come from a table, whose
order of rows in a partition does not change when a task is run again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tokens import TokenCoder, encoded_batches, ids_as_u4, token_coder

SEQ_LEN = 1024
GROUP_DOCS = 4096
MIN_CUT = 16


class CapacityTree:
    """Tournament tree over bins: every node holds the largest free capacity
    below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """Place ``need`` in the first bin with room; returns the bin."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < need:
                at += 1
        bin_no = at - self.size
        tree[at] -= need
        while at > 1:
            at //= 2
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left > right else right
        return bin_no


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers) in the order they were opened."""
    if not lengths:
        return []
    tree = CapacityTree(len(lengths), capacity)
    bins: list[list[int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = tree.first_fit(lengths[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def pack_lengths(lengths: list[int], capacity: int, min_cut: int) -> list[list[tuple]]:
    """Sequences of (item, start, length): first-fit decreasing, then gaps of
    ``min_cut`` or more are filled from the emptiest sequences."""
    bins = [[(i, 0, lengths[i]) for i in b] for b in first_fit_decreasing(lengths, capacity)]
    room = [capacity - sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (room[b], b))
    takers = [b for b in order if room[b] >= min_cut]
    done: set[int] = set()
    while len(takers) > 1:
        donor = takers.pop()           # the emptiest
        pieces = bins[donor]
        while pieces and takers:
            taker = takers[-1]
            item, start, length = pieces[-1]
            part = min(length, room[taker])
            bins[taker].append((item, start, part))
            room[taker] -= part
            if part == length:
                pieces.pop()
            else:
                pieces[-1] = (item, start + part, length - part)
            if room[taker] < min_cut:
                takers.pop()
        if not pieces:
            done.add(donor)
        else:
            break
    return [b for n, b in enumerate(bins) if n not in done]


_TOKENS = ("group long, _id {id}, doc_tokens long, full_crc array<long>, "
           "full_ids binary, rest binary")
_PIECES = ("_id {id}, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long, padded_length long, ids binary")


def _mixed(partition: int, row: int, seed: int) -> int:
    h = (partition << 40 ^ row) * 0x9E3779B97F4A7C15 + seed & 0xFFFFFFFFFFFFFFFF
    h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return h ^ h >> 29


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         keep_space: bool = True, end_id: int = 0, seq_len: int = SEQ_LEN,
         group_docs: int = GROUP_DOCS, min_cut: int = MIN_CUT, seed: int = 17,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, padded_length (``seq_len``, or the tokens in the sequence where that
    is a power of two), ids (little-endian, null unless ``with_ids``)."""
    kind = docs.schema[id_col].dataType.simpleString()
    groups = docs.count() // group_docs + 1
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def encode(batches):
        coder = token_coder(tokenizer, keep_space)
        width = coder.dtype.itemsize
        end = np.array([end_id], coder.dtype).tobytes()
        full = seq_len * width
        partition, row = TaskContext.get().partitionId(), 0
        for batch, texts in encoded_batches(coder, batches, 1):
            out: dict[str, list] = {k: [] for k in
                                    ("group", "n", "crc", "full", "rest")}
            for ids in texts:
                ids += end
                cut = len(ids) // full * full
                out["group"].append(_mixed(partition, row, seed) % groups)
                out["n"].append(len(ids) // width)
                out["crc"].append([zlib.crc32(ids_as_u4(ids[a:a + full], coder.dtype))
                                   for a in range(0, cut, full)])
                out["full"].append(ids[:cut] if with_ids else None)
                out["rest"].append(ids[cut:])
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["group"], pa.int64()), batch.column(0),
                 pa.array(out["n"], pa.int64()), pa.array(out["crc"], pa.list_(pa.int64())),
                 pa.array(out["full"], pa.binary()), pa.array(out["rest"], pa.binary())],
                names=["group", "_id", "doc_tokens", "full_crc", "full_ids", "rest"])

    def place(table: pa.Table) -> pa.Table:
        coder_type = np.dtype("<u2") if width_of == 2 else np.dtype("<u4")
        width, full = width_of, seq_len * width_of
        group = table.column("group")[0].as_py()
        totals = table.column("doc_tokens").to_pylist()
        crcs = table.column("full_crc").to_pylist()
        fulls = table.column("full_ids").to_pylist() if with_ids else None
        rests = table.column("rest").to_pylist()
        out: list[tuple] = []
        sequence = group << 32
        for d, chunks in enumerate(crcs):
            for k, crc in enumerate(chunks):
                ids = fulls[d][k * full:(k + 1) * full] if with_ids else None
                out.append((d, k * seq_len, seq_len, crc, sequence, 0, seq_len, ids))
                sequence += 1
        owner = [d for d, rest in enumerate(rests) if rest]
        for pieces in pack_lengths([len(rests[d]) // width for d in owner], seq_len, min_cut):
            offset, used = 0, sum(p[2] for p in pieces)
            padded = used if used & (used - 1) == 0 else seq_len
            for item, start, length in pieces:
                d = owner[item]
                ids = rests[d][start * width:(start + length) * width]
                out.append((d, len(crcs[d]) * seq_len + start, length,
                            zlib.crc32(ids_as_u4(ids, coder_type)), sequence, offset,
                            padded, ids if with_ids else None))
                offset += length
            sequence += 1
        which, *rest = zip(*out)
        start, length, crc, sequences, offsets, padded, ids = rest
        return pa.table({
            "_id": table.column("_id").take(pa.array(which)),
            "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": pa.array([totals[d] for d in which], pa.int64()),
            "sequence_id": pa.array(sequences, pa.int64()),
            "offset": pa.array(offsets, pa.int64()),
            "padded_length": pa.array(padded, pa.int64()), "ids": pa.array(ids, pa.binary())})

    width_of = TokenCoder(tokenizer, keep_space).dtype.itemsize
    pieces = (rows.mapInArrow(encode, _TOKENS.format(id=kind))
              .groupBy("group").applyInArrow(place, _PIECES.format(id=kind)))
    return pieces.withColumnRenamed("_id", id_col)

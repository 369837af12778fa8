"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte covered by a string of ``length`` bytes that starts at another place
too, in the same or another document, is removed (all occurrences; strings are
judged on the input).

1. Every start of a string picks an anchor: the place in it with the smallest
   hash of ``GRAM`` bytes (leftmost of equals).  Equal strings pick the same
   anchor, so one row per anchor stands for a stretch of starts; its context is
   the bytes of all their strings.
2. Anchors whose hash occurs once drop out.  Where all contexts of a hash are
   equal (128-bit hashes), all their strings are repeated.
3. The other hashes get their distinct contexts together.  In each group the
   suffixes after the anchor and the reversed prefixes before it are sorted by
   mergesort; two are compared by prefix polynomial hashes and binary search
   for their common extension, which is then verified byte by byte.  In the
   tree of common-extension intervals, the neighbours in prefix order inside an
   interval give the longest joint extension to both sides, hence all strings a
   context shares with any other.  Groups of more than ``GROUP`` distinct
   contexts are matched by 128-bit hashes of all their strings instead, spread
   over the cluster.
4. The covered stretches are cut out.

Defined results: null and empty texts have no bytes; rows that agree in id and
text are repeats of each other; texts shorter than ``length`` keep all bytes; an
empty table gives no rows.

Scale: one row per 185 bytes is shuffled, as 8-byte hashes and positions;
contexts of mixed hashes only; texts once, for the cut (and those with mixed
contexts once more).  Hot hashes meet in partial aggregates and split joins.  A
worker hashes a block of starts at a time: of a long text it holds the bytes and
these rows, no arrays over all its bytes.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, mix64, shared_table, small_batches

LENGTH = 400
GRAM = 32
GROUP = 4000
MAX_BROADCAST = 1_000_000
_CHUNK = 1 << 20     # bytes of texts that are taken together
_BLOCK = 1 << 16     # starts of strings whose hashes are in memory at once
_ROWS = 1 << 12      # contexts of a text that are cut together
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ALL = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), 1 << 64))
        out = np.concatenate((out, out * step))
    return out[:n]


def prefix_hashes(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2^64; the hash of a stretch is
    the difference of two, divided by the base to the power of its start."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=out[1:])
    return out


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys (block prefixes and suffixes)."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, _ALL, np.uint64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


class Anchors:
    """Finds the anchors of texts, ``_BLOCK`` starts at a time: its arrays do not grow
    with the texts.  Keeps the powers it needs."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.up = _powers(_BASE, _BLOCK + length)
        self.down = _powers(_INVERSE, _BLOCK + length)
        # the same for all texts, so that equal strings pick the same of close hashes
        self.bits = np.uint64((_BLOCK + length).bit_length())

    def find(self, texts: list[bytes]):
        """(text number, hash, first start, last start, anchor), each an array,
        starts and anchor counted from the beginning of the text."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        begins = ends - [len(t) for t in texts]
        blocks = [self._block(data, begins, ends, at)
                  for at in range(0, len(data) - self.length + 1, _BLOCK)]
        own, fp, first, last, at = (np.concatenate(c) for c in zip(_NONE, *blocks))
        if not len(own):
            return [np.zeros(0, np.int64)] * 5
        # a stretch that goes on in the next block
        head, tail = _runs(own, at)
        own, fp, first, last, at = own[head], fp[head], first[head], last[tail], at[head]
        return own, fp, first - begins[own], last - begins[own], at - begins[own]

    def _block(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, at: int):
        """The same for the starts from ``at``, all counted from the first text."""
        end = min(at + _BLOCK, len(data) - self.length + 1)
        sums = prefix_hashes(data[at:end + self.length - 1], self.up)
        grams = len(sums) - self.gram
        hashes = mix64((sums[self.gram:] - sums[:-self.gram]) * self.down[:grams])
        keys = hashes >> self.bits << self.bits | np.arange(grams, dtype=np.uint64)
        best = _window_min(keys, self.length - self.gram + 1)
        anchor = (best & ((np.uint64(1) << self.bits) - np.uint64(1))).astype(np.int64)
        a = np.searchsorted(ends, at, side="right")
        b = np.searchsorted(ends, end - 1, side="right") + 1
        owner = np.repeat(np.arange(a, b),
                          np.minimum(ends[a:b], end) - np.maximum(begins[a:b], at))
        starts = np.flatnonzero(np.arange(at, end) + self.length <= ends[owner])
        if not len(starts):
            return _NONE
        own, found = owner[starts], anchor[starts]
        head, tail = _runs(own, found)
        return (own[head], hashes[found[head]], at + starts[head], at + starts[tail],
                at + found[head])


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def _runs(own: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of equal pairs."""
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])) + 1
    return np.concatenate(([0], change)), np.concatenate((change, [len(own)])) - 1


def anchors(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    """_id, _row, fp (hash at the anchor), c1 and c2 (hash of the context), lo,
    hi (first and last start), pos (anchor)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batches):
        finder = Anchors(length, gram)
        for batch in small_batches(batches, 2, _CHUNK):
            texts = as_bytes(batch.column(2))
            own, fp, lo, hi, pos = finder.find(texts)
            context = b"".join(
                xxhash.xxh3_128_digest(texts[o][a:b]) for o, a, b in
                zip(own.tolist(), lo.tolist(), (hi + length).tolist()))
            both = np.frombuffer(context, "<i8").reshape(-1, 2)
            rows = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows),
                 pa.array(fp.astype(np.uint64).view(np.int64)),
                 pa.array(both[:, 0]), pa.array(both[:, 1]),
                 pa.array(lo, pa.int32()), pa.array(hi, pa.int32()),
                 pa.array(pos, pa.int32())],
                names=["_id", "_row", "fp", "c1", "c2", "lo", "hi", "pos"])

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_row"),
                       F.col(text_col).alias("_text")) \
        .where(F.octet_length("_text") >= length)
    return rows.mapInArrow(step, f"_id {kind}, _row long, fp long, c1 long, c2 long, "
                                 "lo int, hi int, pos int")


class Contexts:
    """Contexts of one anchor hash, compared by prefix hashes."""

    def __init__(self, bodies: list[bytes], anchors_at: list[int], length: int):
        self.length = length
        self.right = [body[a:] for body, a in zip(bodies, anchors_at)]
        self.left = [body[:a][::-1] for body, a in zip(bodies, anchors_at)]
        longest = max(map(len, bodies)) + 1
        powers = _powers(_BASE, longest)
        self.hash_right = [self._hashes(s, powers) for s in self.right]
        self.hash_left = [self._hashes(s, powers) for s in self.left]

    @staticmethod
    def _hashes(s: bytes, powers: np.ndarray) -> array:
        return array("Q", prefix_hashes(np.frombuffer(s, np.uint8), powers).tobytes())

    @staticmethod
    def common(a: bytes, b: bytes, ha: array, hb: array) -> int:
        """Length of the common prefix: binary search on hashes, verified."""
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            if ha[mid] == hb[mid]:
                low = mid
            else:
                high = mid - 1
        while a[:low] != b[:low]:             # a collision: look below it
            low = next(i for i in range(low) if a[i] != b[i])
        return low

    def lcp(self, i: int, j: int) -> int:
        return self.common(self.right[i], self.right[j], self.hash_right[i], self.hash_right[j])

    def lcs(self, i: int, j: int) -> int:
        return self.common(self.left[i], self.left[j], self.hash_left[i], self.hash_left[j])

    def _sorted(self, sides: list[bytes], hashes: list[array]) -> list[int]:
        def compare(i, j):
            n = self.common(sides[i], sides[j], hashes[i], hashes[j])
            a, b = sides[i][n:n + 1], sides[j][n:n + 1]
            return -1 if a < b else 1 if a > b else 0
        return sorted(range(len(sides)), key=cmp_to_key(compare))   # a mergesort

    def shared(self) -> list[list[tuple[int, int]]]:
        """Per context: stretches (first, last) of starts whose string is in
        another context of the group."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.right]
        if len(out) == 2:
            reach = self.lcs(0, 1)
            self._add(out, self.lcp(0, 1), [(0, reach), (1, reach)])
            return out
        order = self._sorted(self.right, self.hash_right)
        rank = {i: r for r, i in enumerate(self._sorted(self.left, self.hash_left))}
        deepest = max(map(len, self.left))
        steps = [self.lcp(a, b) for a, b in zip(order, order[1:])] + [-1]
        stack: list[tuple[int, int]] = []      # (extension, first in order)
        for at, step in enumerate(steps):
            first = at
            while stack and stack[-1][0] > step:
                level, first = stack.pop()
                if self.length - level <= deepest:
                    members = sorted(order[first:at + 1], key=rank.__getitem__)
                    reach = [self.lcs(a, b) for a, b in zip(members, members[1:])]
                    best = map(max, reach + [0], [0] + reach)
                    self._add(out, level, list(zip(members, best)))
            if step >= 0 and (not stack or stack[-1][0] < step):
                stack.append((step, first))
        return out

    def _add(self, out, level, reaches):
        """Strings with ``o`` bytes before the anchor are shared for all o from
        length - level to the context's reach."""
        for i, reach in reaches:
            before = len(self.left[i])
            first = max(0, before - reach)
            last = min(before + len(self.right[i]) - self.length,
                       before - max(0, self.length - level))
            if first <= last:
                out[i].append((first, last))


def _match(length: int):
    """Arrow step over rows sorted by fp: (fp, c1, c2, at, body) in, stretches
    (fp, c1, c2, s, e) of shared starts out."""
    def rows(group):
        found = Contexts([r[4] for r in group], [r[3] for r in group], length).shared()
        return [(*r[:3], s, e) for r, spans in zip(group, found) for s, e in spans]

    def step(batches):
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    out += rows(group) if len(group) > 1 else []
                    group = []
                group.append(row)
            yield _stretches(out)
        yield _stretches(rows(group) if len(group) > 1 else [])

    return step


def _stretches(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["fp", "c1", "c2", "s", "e"])


def _strings(length: int):
    """Arrow step: one row per string of a context, with its 128-bit hash."""
    def step(batches):
        for batch in batches:
            for fp, c1, c2, _, body in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(body) - length + 1
                both = np.frombuffer(b"".join(
                    xxhash.xxh3_128_digest(body[i:i + length]) for i in range(n)),
                    "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, v)) for v in (fp, c1, c2)]
                    + [pa.array(np.arange(n), pa.int32()), pa.array(both[:, 0]),
                       pa.array(both[:, 1])], names=["fp", "c1", "c2", "s", "h1", "h2"])

    return step


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """_id, _row, spans (first byte, byte after) of every row with repeats."""
    context = ["fp", "c1", "c2"]
    found = shared_table(anchors(docs, id_col, text_col, length, gram), "anchors")
    hashes = found.groupBy("fp").agg(
        F.count("*").alias("n"), F.min("c1").alias("a1"), F.max("c1").alias("b1"),
        F.min("c2").alias("a2"), F.max("c2").alias("b2")).where("n > 1")
    # a table of its own: a join with it can be split where a hash is hot
    hashes = shared_table(hashes.select(
        "fp", F.expr("a1 <> b1 or a2 <> b2").alias("mixed")), "hashes")
    near = shared_table(found.join(hashes, "fp"), "repeats")

    # distinct contexts of mixed hashes, how often each occurs, and one place
    place = F.struct("_row", "lo", "hi", "pos", "_id")
    kinds = near.where("mixed").groupBy(*context).agg(
        F.count("*").alias("m"), F.min(place).alias("place"))
    kinds = shared_table(kinds.select(*context, "m", "place.*"), "contexts")
    sizes = kinds.groupBy("fp").agg(F.count("*").alias("g"))
    wanted = kinds.groupBy("_id", "_row").agg(
        F.collect_list(F.struct(*context, "lo", "hi", "pos")).alias("w"))
    keys = kinds.select("_row").distinct()
    if keys.count() <= MAX_BROADCAST:
        keys = F.broadcast(keys)
    texts = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("_row"),
                        F.col(text_col).alias("_text")).join(keys, "_row", "left_semi")
    texts = texts.alias("t").join(wanted.alias("w"), F.expr("t._row = w._row and t.i <=> w._id")) \
        .select("_text", "w")
    bodies = texts.mapInArrow(_cut(length), "fp long, c1 long, c2 long, at int, body binary") \
        .dropDuplicates(context).join(sizes, "fp")
    bodies = shared_table(bodies, "bodies")
    rows = [*context, "at", "body"]
    spans = "fp long, c1 long, c2 long, s int, e int"
    small = (bodies.where(F.col("g") <= group).select(*rows).repartition("fp")
             .sortWithinPartitions("fp").mapInArrow(_match(length), spans))
    strings = bodies.where(F.col("g") > group).select(*rows).mapInArrow(
        _strings(length), "fp long, c1 long, c2 long, s int, h1 long, h2 long")
    twice = strings.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    large = strings.join(twice, ["h1", "h2"]).select(*context, "s", F.col("s").alias("e"))
    whole = kinds.where("m > 1").select(*context, F.lit(0).alias("s"),
                                        F.expr("hi - lo").alias("e"))
    shared = shared_table(small.unionByName(large).unionByName(whole).groupBy(*context).agg(
        F.collect_list(F.struct("s", "e")).alias("se")), "shared")

    even = near.where("not mixed").select("_id", "_row", "lo", F.expr("hi + {}".format(length))
                                          .alias("hi"))
    mixed = (near.where("mixed").join(shared, context)
             .select("_id", "_row", "lo", F.explode("se").alias("se"))
             .select("_id", "_row", F.expr("lo + se.s").alias("lo"),
                     F.expr(f"lo + se.e + {length}").alias("hi")))
    return even.unionByName(mixed).groupBy("_id", "_row").agg(
        F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def _cut(length: int):
    """Arrow step: the bytes of every wanted context of a text, ``_ROWS`` at a time."""
    def step(batches):
        for batch in batches:
            for text, places in zip(as_bytes(batch.column(0)), batch.column(1)):
                for at in range(0, len(places.values), _ROWS):
                    fp, c1, c2, *ends = places.values.slice(at, _ROWS).flatten()
                    lo, hi, pos = (c.to_numpy() for c in ends)
                    yield pa.RecordBatch.from_arrays(
                        [fp, c1, c2, pa.array(pos - lo),
                         pa.array([text[a:b] for a, b in zip(lo.tolist(), (hi + length).tolist())],
                                  pa.binary())],
                        names=["fp", "c1", "c2", "at", "body"])

    return step


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   with_kept: bool = True, **options) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (maximal removed
    runs), kept (remaining bytes; null unless ``with_kept``), kept_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()
    repeats = repeated_bytes(docs, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("r"),
                       F.col(text_col).alias("_text"))
    rows = rows.join(repeats, F.expr("r = _row and i <=> _id"), "left") \
        .select("i", "_text", "spans")

    def step(batches):
        for batch in small_batches(batches, 1):
            out = []
            for text, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                runs = merge_spans([(s["lo"], s["hi"]) for s in spans or ()])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                body = b"".join(kept)
                out.append((len(text), len(text) - len(body),
                            [{"first": a, "end": b} for a, b in runs],
                            body if with_kept else None, hashlib.sha256(body).hexdigest()))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(),
                     pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])),
                     pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    return rows.mapInArrow(
        step, f"_id {kind}, n_bytes long, n_removed long, "
              "spans array<struct<first: long, end: long>>, kept binary, kept_sha256 string") \
        .withColumnRenamed("_id", id_col)

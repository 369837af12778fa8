"""Near-duplicate groups by a multi-index Hamming join of MinHash signatures.

A document is the set of its distinct word shingles.  Its signature has ``8 x
5`` MinHash values of 12 bits; the Hamming distance of two signatures is the
number of values in which they differ.  Signatures are split into 8 chunks: two
at distance 15 or less differ in at most one value of some chunk (pigeonhole),
so every chunk is entered under its five keys with one value left out, and all
pairs under that distance share a key.  Pairs that share a key are candidates, at
any distance; a candidate is a link if the full sets of 64-bit shingle hashes
have the similarity asked for.  At the similarity 0.8 a pair misses all keys with
a chance of 2 in 100,000, and less above.

Components are found without all pairs of a group:
1. equal sets are one node;
2. every node is compared with the nearest leader of its keys (the member that
   shares most keys with others); confirmed links give first components;
3. in keys that still hold two components or more, the members outside the
   key's largest component meet its other members.  A pair of different
   components is emitted once, at the first key both have, and only if its set
   sizes and bitmaps of 4096 shingle bits allow the similarity: bits set in one
   only bound the intersection from above, so no link is dismissed by them.  Confirmed links merge components.  No link
   between different components is left out, so the components are those of all
   candidate links.

Defined results: a null text, or one without words, has the empty set and is
linked with nothing; fewer words than a shingle has make one shingle; rows with
equal ids are judged each by its own text; a null id is never a group's name
unless all ids of the group are null; an empty table gives no rows.

Scale: signatures (64 bytes), keys and the sets of candidates are shuffled; texts never are, as
long as the nodes with candidates fit a checked broadcast (``MAX_BROADCAST``),
beyond which they are joined by hash.  Groups of copies collapse in a partial
aggregate; a key's group is met by aggregates and joins only, which adaptive
execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, mix64, shared_table, small_batches
from ledgerlens.llm.components import components

CHUNKS, VALUES, BITS = 8, 5, 12
MAX_BROADCAST = 1_000_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(20240607)
_MULTIPLY = _rng.integers(1, 1 << 32, CHUNKS * VALUES, np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, CHUNKS * VALUES, np.uint64).astype(np.uint32)
_SIGNATURE = [f"s{i}" for i in range(CHUNKS)]


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    folded = pa.array([t.translate(_FOLD) for t in as_bytes(texts)], pa.large_binary())
    lists = pc.ascii_split_whitespace(folded.cast(pa.large_string()))
    at = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    empty = np.fromiter((not w for w in words), np.bool_, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    index = coded.indices.to_numpy()
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = index[a:b]
        if b > a and (empty[own[0]] or empty[own[-1]]):   # white space at an edge
            own = own[~empty[own]]
        if not len(own):
            out.append(np.zeros(0, np.uint64))
            continue
        n = min(size, len(own))
        h = hashes[own]
        shingle = np.full(len(own) - n + 1, n, np.uint64)
        for i in range(n):
            shingle = mix64(shingle * np.uint64(0x9E3779B97F4A7C15)
                            + h[i:len(h) - n + 1 + i])
        out.append(np.unique(shingle))
    return out


def _lowest(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over the shingles, spread."""
    low = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 1 << 10):
        part = shingles[at:at + (1 << 10), None]
        h = (part >> np.uint64(32)).astype(np.uint32) * multiply + (part.astype(np.uint32) ^ add)
        low = np.minimum(low, h.min(axis=0))
    return low * np.uint32(0x9E3779B1)


def bitmap(shingles: np.ndarray) -> list[int]:
    """4096 bits, those of the shingles' top 12 bits set."""
    bits = np.zeros(4096, np.uint8)
    bits[(shingles >> np.uint64(52)).astype(np.int64)] = 1
    return np.packbits(bits).view("<i8").tolist()


def signature(shingles: np.ndarray) -> list[int]:
    """One number per chunk: its values side by side, ``BITS`` bits each."""
    low = _lowest(shingles, _MULTIPLY, _ADD)
    values = (low >> np.uint32(32 - BITS)).astype(np.int64)
    shifts = np.arange(VALUES, dtype=np.int64) * BITS
    return (values.reshape(CHUNKS, VALUES) << shifts).sum(axis=1).tolist()


def _masks() -> list[int]:
    whole = (1 << BITS * VALUES) - 1
    return [whole & ~(((1 << BITS) - 1) << BITS * v) for v in range(VALUES)]


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """_id, _row (hash of the text), n_shingles, node (128-bit hash of the set,
    null for the empty set), s0.. (chunks)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batches):
        for batch in small_batches(batches, 2):
            sets = shingle_sets(batch.column(2), size)
            chunks = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets],
                          pa.binary()),
                 *[pa.array(c, pa.int64()) for c in zip(*chunks)]],
                names=["_id", "_row", "n_shingles", "node", *_SIGNATURE])

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_row"),
                       F.col(text_col).alias("_text"))
    chunks = ", ".join(f"{s} long" for s in _SIGNATURE)
    return rows.mapInArrow(
        step, f"_id {kind}, _row long, n_shingles long, node binary, {chunks}")


def _distance(a: str, b: str) -> str:
    """SQL for the number of values in which two signatures differ."""
    lane = (1 << BITS) - 1
    terms = [f"if(({a}.{s} ^ {b}.{s}) & {lane << BITS * v}L = 0, 0, 1)"
             for s in _SIGNATURE for v in range(VALUES)]
    return " + ".join(terms)


def _first_slot(a: str, b: str) -> str:
    """SQL for the first key place (chunk, value left out) that two share."""
    cases = [f"when (({a}.{s} ^ {b}.{s}) & {mask}L) = 0 then {i * VALUES + v}"
             for i, s in enumerate(_SIGNATURE) for v, mask in enumerate(_masks())]
    return f"case {' '.join(cases)} end"


def _bounded(a: str, b: str, percent: int) -> str:
    """SQL: bitmaps that allow the similarity.  Every bit that only one has is a
    shingle that only it has, so the intersection is no larger than either set
    without those."""
    total = f"({a}.n_shingles + {b}.n_shingles) * {percent}"
    return " and ".join(
        f"({p}.n_shingles - aggregate(zip_with({p}.bits, {q}.bits, (u, v) -> bit_count(u & ~v)),"
        f" 0, (s, c) -> s + c)) * {100 + percent} >= {total}" for p, q in ((a, b), (b, a)))


def _similar(a: str, b: str, percent: int) -> str:
    """SQL: set sizes that allow the similarity at all."""
    return (f"100 * {a}.n_shingles >= {percent} * {b}.n_shingles and "
            f"100 * {b}.n_shingles >= {percent} * {a}.n_shingles")


def shared_hashes(a: bytes, b: bytes) -> int:
    """Size of the intersection of two sorted sets of 64-bit hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity asked for."""

    def step(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            keep = []
            for x, y in zip(a, b):
                common = shared_hashes(x, y)
                union = len(x) // 8 + len(y) // 8 - common
                keep.append(100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays(
                batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a"))
    return both.select("a", "b", "set_a", "set_b").mapInArrow(step, "a binary, b binary")


def _sets_of(docs: DataFrame, wanted: DataFrame, text_col: str, size: int) -> DataFrame:
    """node, set (sorted hashes) and bitmap of the nodes whose text hash is
    wanted."""
    if wanted.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.xxhash64(text_col).alias("_row"), F.col(text_col).alias("_text")) \
        .join(wanted, "_row", "left_semi").select("_text")

    def step(batches):
        for batch in small_batches(batches, 0):
            sets = shingle_sets(batch.column(0), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))],
                names=["node", "set", "bits"])

    return rows.mapInArrow(step, "node binary, set binary, bits array<long>") \
        .dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id of the
    group), kept (the id is the group's), and _row (hash of the text).

    ``size``: words of a shingle; ``percent``: similarity from which on two
    documents are linked."""
    rows = shared_table(signatures(docs, id_col, text_col, size), "signatures")
    nodes = shared_table(
        rows.where("node is not null").groupBy("node").agg(
            F.min("_row").alias("_row"), F.min("n_shingles").alias("n_shingles"),
            F.min("_id").alias("_id"), *[F.min(s).alias(s) for s in _SIGNATURE]), "nodes")
    keys = ", ".join(f"struct({i * VALUES + v} as slot, xxhash64({i * VALUES + v}, {s} & {mask}L)"
                     f" as key)" for i, s in enumerate(_SIGNATURE)
                     for v, mask in enumerate(_masks()))
    keyed = nodes.select("node", F.inline(F.expr(f"array({keys})")))
    # keys of two nodes or more
    multi = shared_table(keyed.groupBy("key").agg(F.count("*").alias("c"))
                         .where("c > 1"), "multi")
    led = shared_table(keyed.join(multi, "key"), "keys")
    wanted = led.select("node").distinct().join(nodes, "node").select("_row")
    sets = shared_table(_sets_of(docs, wanted, text_col, size), "sets")
    light = nodes.select("node", "n_shingles", *_SIGNATURE).join(sets.drop("set"), "node")
    light = shared_table(light, "light")

    # the leader of a key: the member whose keys hold most others
    shares = shared_table(led.groupBy("node").agg(F.sum("c").alias("share")), "shares")
    best = F.max(F.struct("share", "node")).alias("best")
    leaders = shared_table(led.select("key", "node").join(shares, "node").groupBy("key").agg(best)
                           .select("key", F.col("best.node").alias("leader")), "leaders")
    near = f"{_similar('x', 'y', percent)} and {_bounded('x', 'y', percent)}"
    stars = (led.join(leaders, "key").where("node <> leader").select("node", "leader").distinct()
             .join(light.alias("x"), "node")
             .join(light.withColumnRenamed("node", "leader").alias("y"), "leader")
             .where(near)
             .groupBy(F.col("node").alias("a"))
             .agg(F.min(F.struct(F.expr(_distance("x", "y")).alias("d"), "leader")).alias("m"))
             .select("a", F.col("m.leader").alias("b")))
    first = shared_table(confirm(stars, sets, percent), "links")
    label = components(first)

    # what the stars left: keys that hold more than one component
    held = (led.join(label, "node", "left")
            .select("key", "slot", "node", F.coalesce("component", "node").alias("component")))
    held = shared_table(held, "held")
    largest = F.max(F.struct("n", "component")).alias("best")
    mixed = shared_table(
        held.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
        .agg(F.count("*").alias("parts"), largest).where("parts > 1")
        .select("key", F.col("best.component").alias("main")), "mixed")
    open_ = shared_table(held.join(mixed, "key").join(light, "node"), "open")
    rest = (open_.where("component <> main").alias("x").join(open_.alias("y"), F.expr(
        f"x.key = y.key and x.component <> y.component"
        f" and (y.component = y.main or x.component < y.component) and {near}"
        f" and x.slot = {_first_slot('x', 'y')}"))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    more = shared_table(confirm(rest, sets, percent).unionByName(first), "links")
    label = components(more)

    named = (nodes.select("node", "_id").join(label, "node", "left")
             .select("node", "_id", F.coalesce("component", "node").alias("component")))
    named = shared_table(named, "named")
    # a table of its own: the join can be split where a component is large
    names = shared_table(named.groupBy("component").agg(F.min("_id").alias("name")),
                         "component-names")
    found = shared_table(named.join(names, "component").select("node", "name"), "names")
    out = rows.join(found, "node", "left")
    name = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("name"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", name.alias("component_id"),
                      F.col("_id").eqNullSafe(name).alias("kept"), "_row")

"""Ranked lexical search by dense blocked matrix products.

Terms are maximal runs of digits, letters and non-ASCII characters, A-Z lowered.
The score of a document for an item is the sum over the item's terms, repeats
included, of weight x impact, both integers:

    weight = floor(1000 ln((2 N + 2) / (2 df + 1)))
    impact = 10^9 tf div (1000 tf + 8 m),   m = 25 + (75 n N) div L

with N documents that have a term, L terms in all, n terms of the document, df
documents that hold the term and tf its occurrences in this one.

Items stand in tiles of ``ITEM_TILE``; a tile's compact vocabulary (the terms of
its items alone) is cut into tiles of ``TERM_TILE`` terms, documents into tiles of
``DOC_TILE``.  A product of an (items x terms) tile of weights and a (terms x
documents) tile of impacts is one float64 BLAS call.  Weights enter as digits
below 2^20 and impacts are below 10^6 < 2^20, so a partial sum over at most 2^13
terms stays below 2^53 and is exact; partial sums are added up as 64-bit integers.
After each product a document is a candidate if its score is not below the item's
current k-th one, so ties stay until the smaller id decides.

Defined results: a null text has no terms; documents of score 0 are not listed;
items of the same id and text are one item, those of the same id and different
texts are ranked each; among equal scores a null document id comes last; repeated
rows of documents are ranked each; empty tables give no rows.

Scale: documents are read once per block of items (``BLOCK_BYTES`` of item text;
one block for most test sets) and become rows of (term number, occurrences) of the
block's terms in a table.  The block is broadcast as lists, a tile becomes dense
when it is used.  Every task keeps k documents per item; a window over salted
groups, then one over the items, leaves k.  N, L and df cover all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import gathered_batches, shared_table, small_batches
from ledgerlens.llm.decontaminate import _FOLD, words_of

K = 10
ITEM_TILE = 64
TERM_TILE = 2048        # at most 2^13, see above
DOC_TILE = 256
BLOCK_BYTES = 4 << 20
SALTS = 32
_DIGIT = 20
_TEXT_BYTES = 16 << 20


def folded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, their number at every place, words of every text)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = memoryview(data)[ends[0]:ends[-1]].tobytes() if data is not None else b""
    # folding keeps every byte's place, and valid UTF-8
    folded = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(data.translate(_FOLD)))
    lists = pc.ascii_split_whitespace(folded)
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if "" in words:                # blanks at an edge of a text
        keep = index != words.index("")
        owner = np.repeat(np.arange(len(sizes)), sizes)
        index, sizes = index[keep], np.bincount(owner[keep], minlength=len(sizes))
    return words, index, sizes


class ItemBlock:
    """Terms of a block of items: per item the term numbers and occurrences."""

    def __init__(self, texts: list[bytes]):
        self.vocab: dict[str, int] = {}
        self.terms, self.counts = [], []
        for text in texts:
            own: dict[int, int] = {}
            for word in words_of(text):
                t = self.vocab.setdefault(word.decode("utf-8", "surrogatepass"),
                                          len(self.vocab))
                own[t] = own.get(t, 0) + 1
            self.terms.append(np.fromiter(own, np.int64, len(own)))
            self.counts.append(np.fromiter(own.values(), np.int64, len(own)))

    def tiles(self, weights: np.ndarray):
        """Yield (items, their terms, [(from, to, dense weight digits)]) per
        tile; the place of a digit is its number times 2^20."""
        for at in range(0, len(self.terms), ITEM_TILE):
            items = range(at, min(at + ITEM_TILE, len(self.terms)))
            terms = np.unique(np.concatenate([self.terms[i] for i in items]))
            if not len(terms):
                continue
            whole = np.zeros((len(items), len(terms)), np.int64)
            for row, i in enumerate(items):
                whole[row, np.searchsorted(terms, self.terms[i])] = \
                    self.counts[i] * weights[self.terms[i]]
            cuts = []
            for lo in range(0, len(terms), TERM_TILE):
                part = whole[:, lo:lo + TERM_TILE]
                digits = []
                while not digits or part.any():
                    digits.append((part & ((1 << _DIGIT) - 1)).astype(np.float64))
                    part = part >> _DIGIT
                cuts.append((lo, min(lo + TERM_TILE, len(terms)), digits))
            yield items, terms, cuts


def _encode(docs: DataFrame, block: ItemBlock) -> DataFrame:
    """Table of _id, n (terms of the text), and of the block's terms in it the
    numbers and the occurrences (32-bit integers)."""
    kind = docs.schema["_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(block.vocab)

    def step(batches):
        vocab = shared.value
        width = max(1, len(vocab))
        for batch in gathered_batches(batches, 1, _TEXT_BYTES):
            words, index, sizes = folded_words(batch.column(1))
            number = np.fromiter((vocab.get(w, -1) for w in words), np.int64, len(words))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            term = number[index]
            own = term >= 0
            pair, tf = np.unique(owner[own] * width + term[own], return_counts=True)
            per = np.bincount(pair // width, minlength=len(sizes))
            ends = pa.py_buffer(np.concatenate(([0], np.cumsum(per))).astype(np.int64) * 4)

            def lists(values):
                return pa.Array.from_buffers(
                    pa.large_binary(), len(sizes),
                    [None, ends, pa.py_buffer(values.astype("<u4"))]).cast(pa.binary())

            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int64)), lists(pair % width),
                 lists(tf)], names=["_id", "n", "terms", "tf"])

    return shared_table(docs.mapInArrow(step, f"_id {kind}, n long, terms binary, tf binary"),
                        "impacts")


def _document_counts(encoded: DataFrame, n_terms: int) -> np.ndarray:
    """df of every term of the block."""

    def step(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
            df += np.bincount(flat, minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])],
                                         names=["term", "df"])

    found = (encoded.select("terms").mapInArrow(step, "term long, df long")
             .groupBy("term").agg(F.sum("df").alias("df")).toArrow())
    df = np.zeros(n_terms, np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return df


def lengths_of(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of ``n`` terms."""
    largest = int(n.max(initial=0))
    if 75 * largest * n_docs < 1 << 63:
        return 25 + (75 * n * n_docs) // n_terms
    return np.array([25 + (75 * x * n_docs) // n_terms for x in n.tolist()], np.int64)


class _Best:
    """Per item the k best (score, id) so far; the smaller id wins a tie."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.found = [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)

    def add(self, items: range, scores: np.ndarray, ids: list):
        hit_item, hit_doc = np.nonzero(scores >= self.least[items.start:items.stop, None])
        if not len(hit_item):
            return
        values = scores[hit_item, hit_doc].tolist()
        for row, doc, value in zip(hit_item.tolist(), hit_doc.tolist(), values):
            self.found[items.start + row].append((value, ids[doc]))
        for row in set(hit_item.tolist()):
            self._cut(items.start + row)

    def _cut(self, item: int):
        best = self.found[item]
        if len(best) > self.k:
            best.sort(key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))
            del best[self.k:]
        if len(best) == self.k:
            self.least[item] = max(1, min(r[0] for r in best))


def _top(encoded: DataFrame, block: ItemBlock, weights: np.ndarray, n_docs: int, n_terms: int,
         k: int) -> DataFrame:
    """item (number in the block), _id, score: k per item and task."""
    kind = encoded.schema["_id"].dataType
    shared = encoded.sparkSession.sparkContext.broadcast((block, weights))

    def step(batches):
        own, w = shared.value
        best = _Best(len(own.terms), k)
        place = np.full(len(w), -1)
        for batch in small_batches(batches, 2, 4 << 20):
            ids = batch.column(0).to_pylist()
            n = batch.column(1).to_numpy()
            terms = [np.frombuffer(b, "<u4") for b in batch.column(2).to_pylist()]
            owner = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
            terms = np.concatenate(terms).astype(np.int64)
            tf = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u4").astype(np.int64)
            m = lengths_of(n, n_docs, n_terms)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[owner])
            for items, vocab, cuts in own.tiles(w):
                place[vocab] = np.arange(len(vocab))
                column = place[terms]
                place[vocab] = -1
                some = np.flatnonzero(column >= 0)
                ends = np.searchsorted(owner[some], np.arange(0, len(ids) + DOC_TILE, DOC_TILE))
                for tile, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                    if a == b:
                        continue
                    first = tile * DOC_TILE
                    docs = min(DOC_TILE, len(ids) - first)
                    dense = np.zeros((len(vocab), docs))
                    part = some[a:b]
                    dense[column[part], owner[part] - first] = impact[part]
                    scores = np.zeros((len(items), docs), np.int64)
                    for lo, hi, digits in cuts:
                        for place_no, digit in enumerate(digits):
                            scores += (digit @ dense[lo:hi]).astype(np.int64) \
                                << (_DIGIT * place_no)
                    best.add(items, scores, ids[first:first + docs])
        rows = [(i, *reversed(r)) for i, found in enumerate(best.found) for r in found]
        which, found, scores = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int64()), pa.array(found, id_type), pa.array(scores, pa.int64())],
            names=["item", "_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(kind)
    return encoded.mapInArrow(step, f"item long, _id {kind.simpleString()}, score long")


def _blocks(items: DataFrame, block_bytes: int):
    """Yield (ids, texts) of the distinct items of every block."""
    items = items.where("_text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("_text") + 8)).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    for block in range(blocks):
        rows = items.where(F.expr(f"pmod(xxhash64(_item, _text), {blocks}) = {block}")).collect()
        if rows:
            yield [r._item for r in rows], [r._text.encode("utf-8", "surrogatepass")
                                            for r in rows]


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of every item: item id, rank (from 1), document id,
    score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    queries = items.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_text"))
    item_kind = queries.schema["_item"].dataType.simpleString()
    found = []
    for ids, texts in _blocks(queries, block_bytes):
        block = ItemBlock(texts)
        encoded = _encode(rows, block)
        n_docs, n_terms = encoded.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs or not block.vocab:
            continue
        df = _document_counts(encoded, len(block.vocab))
        weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
        top = _top(encoded, block, weights, n_docs, n_terms, k)
        for keys in (("item", "salt"), ("item",)):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"),
                                                      F.asc_nulls_last("_id"))
            top = (top.withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
                   .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, _item {item_kind}")
        found.append(shared_table(top.join(F.broadcast(names), "item").select(
            F.col("_item"), "rank", "_id", "score"), "ranked"))
    if not found:
        kind = rows.schema["_id"].dataType.simpleString()
        found = [spark.createDataFrame([], f"_item {item_kind}, rank int, _id {kind}, score long")]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.toDF(item_col, "rank", id_col, "score")

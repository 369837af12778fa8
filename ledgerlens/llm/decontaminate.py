"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items go into one suffix automaton per block of items.
Document words are streamed through it; at every word the automaton gives the
longest suffix that occurs in some item.  A suffix of ``window`` words or more
is contamination, and so is a whole item of fewer words.

Words: maximal runs of digits, letters and non-ASCII characters, A-Z lowered.

Defined results: a null text has no words; a null item text (or one without
words) matches nothing; an item with a null id matches under the id ``''``;
repeated items count once in ``item_ids``; an empty benchmark or document table
gives zero hits or no rows.  Only the named columns of the inputs are read by
``scan``; ``decontaminate`` keeps every column of the documents.

Scale: documents are not shuffled.  The benchmark is cut into blocks of at most
about ``block_words`` words by a hash of the item.  Executors build the blocks'
automata, one group each, and write them as files below the shared folder; the
driver holds their names alone.  Documents stream through one Arrow step, which
takes about ``GATHER_BYTES`` of text at a time through one block after another and
holds one automaton (a single block is loaded once per task).
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import (as_bytes, free_name, gathered_batches, load_object,
                                   save_object, shared_folder, small_batches)

WINDOW = 10
BLOCK_WORDS = 200_000
GATHER_BYTES = 8 << 20
MAX_COVERAGE = 0.5

# byte -> itself if part of a word (A-Z lowered), else a space
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower()
              else b + 32 if chr(b).isupper() else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over the word ids of several items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(key, [self.vocab.setdefault(w, len(self.vocab)) for w in words])
                 for key, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        n = len(self.next)
        short: list[list] = [[] for _ in range(n)]
        carries: list[set] = [set() for _ in range(n)]
        for key, ids in coded:
            if len(ids) < window:
                state = 0
                for c in ids:
                    state = self.next[state][c]
                short[state].append((len(ids), key))
                continue
            state = 0
            for c in ids:
                state = at = self.next[state][c]
                while at > 0 and key not in carries[at]:
                    carries[at].add(key)
                    at = self.link[at]
        # nearest state up the links that holds the window ending here, and
        # nearest one that ends a short item
        self.base, self.near = [0] * n, [0] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= window:
                self.base[v] = v if self.length[up] < window else self.base[up]
            self.near[v] = v if short[v] else self.near[up]
        self.short = {v: s for v, s in enumerate(short) if s}
        used = set(self.base)
        self.carries = {v: frozenset(c) for v, c in enumerate(carries) if c and v in used}
        lengths = [min(len(ids), window) for _, ids in coded]
        self.shortest = min(lengths, default=0)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def scan(self, words: list[bytes]) -> tuple[bytearray | None, set]:
        """(mask of hit words or None, ids of the items found)."""
        found: set = set()
        if not self.shortest or len(words) < self.shortest:
            return None, found
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        starts, ends = edges[::2], edges[1::2]
        mask = None
        for r in np.flatnonzero(ends - starts >= self.shortest):
            start = int(starts[r])
            for a, b in self._matches(ids[start:ends[r]].tolist(), found):
                if mask is None:
                    mask = bytearray(len(words))
                mask[start + a:start + b] = b"\x01" * (b - a)
        return mask, found

    def _matches(self, run: list[int], found: set):
        """Spans of matches in a run of known words; fills ``found``."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for i, c in enumerate(run):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c not in nxt[state]:
                continue
            state = nxt[state][c]
            size += 1
            if size >= window:
                found |= self.carries.get(self.base[state], frozenset())
                yield i + 1 - size, i + 1
            at = self.near[state]
            while at:
                for k, key in self.short[at]:
                    if k <= size:
                        found.add(key)
                        yield i + 1 - k, i + 1
                at = self.near[link[at]]


def automata(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
             window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """Files of one automaton per block of items, built by the executors."""
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
        F.col(text_col).alias("body")).where(F.col("body").isNotNull())
    # a word takes two bytes at least, with its separator
    total = items.agg(F.sum((F.octet_length("body") + 1) / 2)).first()[0] or 0
    blocks = int(total // block_words) + 1
    folder = shared_folder(benchmark.sparkSession, "automata")

    def build(table: pa.Table) -> pa.Table:
        rows = [(key, words_of(body.encode("utf-8", "surrogatepass")))
                for key, body in zip(table.column("key").to_pylist(),
                                     table.column("body").to_pylist())]
        block = table.column("block")[0].as_py()
        path = save_object(folder, f"block-{block}", SuffixAutomaton(rows, window))
        return pa.table({"block": [block], "path": [path]})

    found = (items.distinct()
             .withColumn("block", F.expr(f"pmod(xxhash64(key, body), {blocks})"))
             .groupBy("block").applyInArrow(build, "block long, path string"))
    return [r.path for r in sorted(found.collect(), key=lambda r: r.block)]


_FOUND = (("_n_words", "long"), ("_n_hit", "long"), ("_mask", "binary"),
          ("_items", "array<string>"))


def _scan(docs: DataFrame, text_col: str, benchmark: DataFrame, finish=None,
          **options) -> DataFrame:
    """``docs`` with four more columns, last: the word count, the number of hit
    words, the hit mask and the items of every text; or what ``finish`` makes of
    a record batch of that (of the schema of ``docs``)."""
    names = [free_name(docs, name) for name, _ in _FOUND]
    out = docs.select("*", *[F.lit(None).cast(kind).alias(name)
                             for name, (_, kind) in zip(names, _FOUND)])
    schema = out.schema
    at = len(docs.columns)
    text_at = docs.columns.index(text_col)

    paths = automata(benchmark, **options)

    def scan(texts, automaton, masks, items):
        """Add the hits of one block's items to ``masks`` and ``items``."""
        for i, words in enumerate(texts):
            mask, found = automaton.scan(words)
            if mask is not None:
                if masks[i] is not None:
                    mask = (np.frombuffer(mask, np.uint8)
                            | np.frombuffer(masks[i], np.uint8)).tobytes()
                masks[i] = bytes(mask)
            if found:
                items[i] = items[i] | found

    def step(batches):
        only = load_object(paths[0]) if len(paths) == 1 else None
        cut = small_batches(batches, text_at) if len(paths) < 2 else \
            gathered_batches(batches, text_at, GATHER_BYTES)
        for batch in cut:
            texts = list(map(words_of, as_bytes(batch.column(text_at))))
            masks: list = [None] * len(texts)
            items: list = [frozenset()] * len(texts)
            for path in paths:
                scan(texts, only or load_object(path), masks, items)
            columns = batch.columns[:at] + [
                pa.array([len(words) for words in texts], pa.int64()),
                pa.array([0 if m is None else m.count(1) for m in masks], pa.int64()),
                pa.array(masks, pa.binary()),
                pa.array([sorted(found) for found in items], pa.list_(pa.string()))]
            done = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield finish(done) if finish else done

    return out.mapInArrow(step, docs.schema if finish else schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, item_ids (sorted), mask of hit
    words (one byte a word; null without hits)."""
    found = _scan(docs.select(id_col, text_col), text_col, benchmark, **options).toDF(
        id_col, text_col, *[name for name, _ in _FOUND])
    return found.select(id_col, F.col("_n_words").alias("n_words"),
                        F.col("_n_hit").alias("n_hit"),
                        F.col("_items").alias("item_ids"), F.col("_mask").alias("mask"))


def remove_spans(text: str, mask: bytes) -> str:
    """``text`` without the hit words and what stands between two of them."""
    data = text.encode("utf-8", "surrogatepass")
    kept, done, open_at, last_end = [], 0, None, 0
    # folding keeps every byte's place
    for hit, m in zip(mask, _WORD.finditer(data.translate(_FOLD))):
        if hit and open_at is None:
            open_at = m.start()
        elif not hit and open_at is not None:
            kept.append(data[done:open_at])
            done, open_at = last_end, None
        last_end = m.end()
    if open_at is not None:
        kept.append(data[done:open_at])
        done = last_end
    kept.append(data[done:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  max_coverage: float = MAX_COVERAGE, **options) -> DataFrame:
    """``docs`` (all columns) with hit spans cut out of the text; a document
    with more than ``max_coverage`` of its words hit goes as a whole."""
    text_at, at = docs.columns.index(text_col), len(docs.columns)

    def clean(batch):
        masks = batch.column(at + 2).to_pylist()
        texts = batch.column(text_at).to_pylist()
        keep = []
        for i, mask in enumerate(masks):
            if mask is not None:
                texts[i] = remove_spans(texts[i], mask)
            keep.append(mask is None or mask.count(1) <= max_coverage * len(mask))
        columns = batch.columns[:at]
        columns[text_at] = pa.array(texts, batch.column(text_at).type)
        out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:at])
        return out.filter(pa.array(keep, pa.bool_()))

    return _scan(docs, text_col, benchmark, finish=clean, **options)


def items_digest(ids: str = "item_ids"):
    return F.sha2(F.array_join(F.array_sort(ids), ","), 256)


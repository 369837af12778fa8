"""Sub-word ids: greedy longest match of words against a vocabulary of pieces.

A vocabulary is given (a public tokenizer's file, or any table of pieces and
ids); it is never trained here.  Two spellings are known, by parameters:
``continues`` stands before every piece that is not a word's first (``##``), and
``ends`` after every piece that is a word's last (``</w>``).

A word is cut from the left: at every place the longest piece that fits is
taken.  A word with a place where no piece fits becomes the unknown id as a whole.

The vocabulary is a bounded table (``MAX_PIECES``, checked) that every task gets
by broadcast and turns into a trie; a task cuts each distinct word of an Arrow
batch once.  There is no shuffle, and a row's ids stay with the row.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encode import PAD_ID, UNKNOWN_ID, UNKNOWN_TOKEN

MAX_PIECES = 1 << 20
MAX_WORD = 200       # characters; longer words are unknown, as a whole


class PieceTrie:
    """Nested dictionaries of characters; the key ``None`` holds a piece's id.
    First, middle, last and only pieces of words may differ, so there are four
    roots."""

    def __init__(self, pieces: Iterable[tuple[str, int]], continues: str = "", ends: str = "",
                 unknown: int = UNKNOWN_ID):
        self.unknown = unknown
        self.roots = {(inner, last): {} for inner in (False, True) for last in (False, True)}
        for piece, number in pieces:
            inner = bool(continues) and piece.startswith(continues) and piece != continues
            last = bool(ends) and piece.endswith(ends) and piece != ends
            body = piece[len(continues):] if inner else piece
            body = body[:-len(ends)] if last else body
            for at_inner in ([inner] if continues else [False, True]):
                for at_last in ([last] if ends else [False, True]):
                    node = self.roots[at_inner, at_last]
                    for ch in body:
                        node = node.setdefault(ch, {})
                    node.setdefault(None, number)

    def _longest(self, root: dict, word: str, at: int, whole: bool) -> tuple[int, int]:
        """(end, id) of the longest piece from ``at``: up to the word's end if
        ``whole``, before it otherwise; end 0 if there is none."""
        node, best = root, (0, 0)
        for i in range(at, len(word)):
            node = node.get(word[i])
            if node is None:
                break
            if None in node and (i + 1 == len(word)) == whole:
                best = i + 1, node[None]
        return best

    def cut(self, word: str) -> list[int]:
        """Ids of a word's pieces."""
        if len(word) > MAX_WORD:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            end, number = self._longest(self.roots[at > 0, True], word, at, True)
            if not end:
                end, number = self._longest(self.roots[at > 0, False], word, at, False)
            if not end:
                return [self.unknown]
            out.append(number)
            at = end
        return out


def pieces_of_file(spark: SparkSession, path: str) -> DataFrame:
    """``(piece, piece_id)`` of a tokenizer file in the common JSON form
    (``model.vocab``), read by Spark."""
    raw = spark.read.text(path, wholetext=True)
    vocab = F.from_json("value", "model struct<vocab: map<string, int>>")["model"]["vocab"]
    return raw.select(F.explode(vocab).alias("piece", "piece_id"))


def _collected(pieces: DataFrame) -> list[tuple[str, int]]:
    rows = pieces.select("piece", "piece_id").limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    return [(r.piece, r.piece_id) for r in rows]


def _per_batch(df: DataFrame, key: str, col: str, out: T.StructField, convert) -> DataFrame:
    """``(key, out)`` by ``convert(list array) -> array`` per Arrow batch."""
    rows = df.select(key, col)
    schema = T.StructType([rows.schema.fields[0], out])

    def step(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), convert(batch.column(1))],
                                             names=[key, out.name])

    return rows.mapInArrow(step, schema)


def subword_ids(df: DataFrame, key: str, tokens_col: str, pieces: DataFrame,
                out_col: str = "subword_ids", *, continues: str = "", ends: str = "",
                unknown: int = UNKNOWN_ID) -> DataFrame:
    """``(key, out_col)``: ids of all pieces of all words in order, for every row
    of ``df`` (null tokens -> null, empty -> [])."""
    shared = df.sparkSession.sparkContext.broadcast(_collected(pieces))
    tries: list[PieceTrie] = []

    def convert(column: pa.Array) -> pa.Array:
        if not tries:             # one trie per task
            tries.append(PieceTrie(shared.value, continues, ends, unknown))
        at = column.offsets.to_numpy()
        words = column.flatten().dictionary_encode()
        cut = [tries[0].cut(w) if w is not None else [unknown]
               for w in words.dictionary.to_pylist()]
        # null words inside an array are unknown ones
        index = words.indices.fill_null(len(cut)).to_numpy()
        cut.append([unknown])
        flat = pa.array(cut, pa.list_(pa.int32())).take(pa.array(index))
        ends_of = np.concatenate(([0], np.cumsum([len(cut[i]) for i in index])))
        offsets = ends_of[at - at[0]].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), flat.flatten(),
                                        mask=column.is_null() if column.null_count else None)

    return _per_batch(df, key, tokens_col,
                      T.StructField(out_col, T.ArrayType(T.IntegerType())), convert)


def decode_subwords(df: DataFrame, key: str, ids_col: str, pieces: DataFrame,
                    out_col: str = "decoded", *, continues: str = "", ends: str = "") -> DataFrame:
    """``(key, out_col)``: ids back to words joined by one space (pads dropped,
    other ids without a piece as ``[UNK]``); null ids -> null."""
    shared = df.sparkSession.sparkContext.broadcast(_collected(pieces))
    names: dict[int, str] = {}

    def text(ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        words, fresh = [], True
        for i in ids:
            if i == PAD_ID and i not in names or i is None:
                continue
            piece = names.get(i)
            if piece is None:
                words.append(UNKNOWN_TOKEN)
                fresh = True
                continue
            if continues:
                inner = piece.startswith(continues) and bool(words)
                body = piece[len(continues):] if piece.startswith(continues) else piece
                fresh = not inner
            else:
                body = piece[:-len(ends)] if ends and piece.endswith(ends) else piece
            if fresh or not words:
                words.append(body)
            else:
                words[-1] += body
            fresh = not ends or piece.endswith(ends)
        return " ".join(words)

    def convert(column: pa.Array) -> pa.Array:
        if not names:
            names.update({number: piece for piece, number in shared.value})
        return pa.array([text(ids) for ids in column.to_pylist()], pa.string())

    return _per_batch(df, key, ids_col, T.StructField(out_col, T.StringType()), convert)


def subword_vocab(df: DataFrame, key: str, tokens_col: str, pieces: DataFrame,
                  **spelling) -> DataFrame:
    """``(piece, piece_id, count)`` of the pieces in use, from the occurrences of
    every distinct word: words are counted first, then cut."""
    words = (df.select(F.explode(tokens_col).alias("word")).groupBy("word")
             .agg(F.count(F.lit(1)).alias("n")))
    cut = subword_ids(words.select(F.struct("word", "n").alias("w"),
                                   F.array("word").alias("tokens")), "w", "tokens", pieces,
                      "ids", **spelling)
    used = (cut.select(F.col("w.n").alias("n"), F.explode("ids").alias("piece_id"))
            .groupBy("piece_id").agg(F.sum("n").alias("count")))
    return used.join(pieces, "piece_id", "left").select(
        F.coalesce("piece", F.lit(UNKNOWN_TOKEN)).alias("piece"), "piece_id", "count")

"""Token ids of whole texts, one call of the tokenizer per distinct word.

A tokenizer that splits text into words before it merges bytes gives the same
ids whether it sees a text whole or cut at those splits.  ``TokenCoder`` cuts
the texts of a batch at ASCII white space, encodes each distinct piece once
(kept from batch to batch) and joins the pieces' ids.  A text in which the
simple cut could change the result is cut with a regular expression that keeps
runs of white space whole, or encoded as it is.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerlens.llm.common import gathered_batches

# a piece carries the white space before it (byte-level pre-tokenizers glue the
# last space to the next word); a final run of white space stands alone
_WITH_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$")
# runs of white space that cutting at every space would break up
_LONG_RUN = r"[ \t\n\v\f\r] [ \t\n\v\f\r]|[ \t\n\v\f\r] \z"
# white space that libraries do not agree on, or beyond ASCII
_ODD_SPACE = (r"[\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
              r"\x{202F}\x{205F}\x{3000}]")
# Latin letters and ASCII signs without the apostrophe: every pre-tokenizer in
# use parts such a word into its letters and its signs
_SIMPLE = re.compile(r"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)"
                     r"([!-&(-/:-@\[-`{-~]*)")
CACHE_WORDS = 300_000
BATCH_TEXT = 8 << 20     # bytes of text that are encoded together


def _byte_text(b: int) -> str:
    """The character that stands for byte ``b`` in byte-level vocabularies."""
    if b in _PLAIN:
        return chr(b)
    return chr(256 + sum(c not in _PLAIN for c in range(b)))


# fixed values: bytes that stand for themselves in byte-level vocabularies
_PLAIN = frozenset([*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])


class TokenCoder:
    """``keep_space``: white space is part of the vocabulary (byte-level BPE);
    otherwise the tokenizer drops it."""

    def __init__(self, path: str, keep_space: bool, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.byte_text = {b: _byte_text(b) for b in range(256)}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.keep_space = keep_space
        self.cache_words = cache_words
        self.cache: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids by the tokenizer alone."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token: letters after an optional space, or signs
        (also a piece of its own with the same ids)."""
        ids = self.cache.get(part)
        if ids is None:
            bytes_as_text = part.encode().decode("latin-1").translate(self.byte_text)
            ids = array(self.dtype.char, [t.id for t in self.model.tokenize(bytes_as_text)])
            ids = self.cache[part] = ids.tobytes()
        return ids

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        cache = self.cache
        out = list(map(cache.get, pieces))
        other = []
        for i, ids in enumerate(out):
            if ids is None:
                simple = _SIMPLE.fullmatch(pieces[i])
                if simple is None:
                    other.append(i)
                    continue
                stem, signs = simple.groups()
                ids = self._part(stem if self.keep_space else stem.lower())
                if signs:
                    ids += self._part(signs)
                out[i] = cache[pieces[i]] = ids
        for i, ids in zip(other, self.whole([pieces[i] for i in other])):
            out[i] = cache[pieces[i]] = ids
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids (``dtype`` wide) of every text; null: none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return []
        if not self.keep_space:
            return self._joined(pc.ascii_split_whitespace(texts), None)
        out = self._joined(pc.split_pattern(texts, " "), " ")
        odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        runs = pc.match_substring_regex(texts, _LONG_RUN).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd):
            out[i] = self.whole([texts[int(i)].as_py()])[0]
        for i in np.flatnonzero(runs & ~odd):
            parts = _WITH_SPACE.findall(texts[int(i)].as_py().encode())
            distinct = list(dict.fromkeys(parts))
            ids = dict(zip(distinct, self._pieces([p.decode() for p in distinct])))
            out[i] = b"".join(map(ids.__getitem__, parts))
        return out

    def _joined(self, lists: pa.ListArray, lead: str | None) -> list[bytes]:
        """Ids of the pieces of every list, joined; ``lead`` stands before all
        pieces of a text but the first."""
        at = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy()
        ids = self._pieces([lead + w for w in words] if lead else words)
        if lead:
            firsts = at[:-1][at[1:] > at[:-1]]
            distinct, place = np.unique(index[firsts], return_inverse=True)
            index = index.astype(np.int64)
            index[firsts] = len(words) + place
            ids += self._pieces([words[i] for i in distinct])
        joined = pa.array(ids, pa.large_binary()).take(pa.array(index))
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8) \
            if len(joined) else np.zeros(1, np.int64)
        data = joined.buffers()[2] if len(joined) else None
        data = memoryview(data) if data is not None else memoryview(b"")
        cut = ends[at]
        return [bytes(data[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


@functools.lru_cache(maxsize=1)
def token_coder(path: str, keep_space: bool) -> TokenCoder:
    """The coder of this process: a worker that runs many tasks loads the tokenizer
    once and keeps one bounded cache."""
    return TokenCoder(path, keep_space)


def encoded_batches(coder: TokenCoder, batches, column: int):
    """``(batch, ids of its texts)`` by batches of about ``BATCH_TEXT``; what Arrow
    held for one goes back to the system before the next."""
    for batch in gathered_batches(batches, column, BATCH_TEXT):
        yield batch, coder.encode(batch.column(column))
        pa.default_memory_pool().release_unused()


def ids_as_u4(data: bytes, dtype: np.dtype) -> bytes:
    """The same ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(data, dtype).astype("<u4").tobytes()

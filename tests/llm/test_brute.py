"""Operators against brute force over small random corpora."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import (decontaminate, exact, lines, minhash, packing, queries, records,
                            substrings)
from ledgerlens.llm.components import components
from ledgerlens.llm.tokens import TokenCoder
from small_texts import WORDS, sentence


def corpus(seed: int, n: int = 60) -> list[tuple[int, str]]:
    """Texts with copies, near copies, shared passages and repeated lines."""
    rng = random.Random(seed)
    passages = [sentence(rng, rng.randint(20, 70)) for _ in range(5)]
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            text = rng.choice(out)[1]
        elif out and kind < 0.35:
            words = rng.choice(out)[1].split(" ")
            for _ in range(max(1, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        else:
            parts = [sentence(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 5))]
            if rng.random() < 0.5:
                parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
            if rng.random() < 0.2:
                parts += [rng.choice(parts)] * 3
            text = "\n".join(parts)
        out.append((i, text))
    return out


@pytest.mark.parametrize("window", [10, 3])
def test_decontaminate(spark, docs, window):
    rows = corpus(1)
    rng = random.Random(2)
    items = [(100 + k, sentence(rng, rng.randint(1, 12))) for k in range(4)]
    items += [(200 + k, " ".join(rng.choice(rows)[1].split()[:rng.randint(1, 30)]).upper())
              for k in range(8)]
    rows.append((999, "xx " + items[1][1] + "; yy"))
    rows = [(i, t.title() if i % 3 == 0 else t) for i, t in rows]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = {k: word.findall(t.translate(low)) for k, t in items}
    want = {}
    for i, text in rows:
        w = word.findall(text.translate(low))
        hit, found = set(), set()
        for k, q in cut.items():
            size = min(window, len(q))
            grams = {tuple(q[p:p + size]) for p in range(len(q) - size + 1)} if q else set()
            for p in range(len(w) - size + 1):
                if tuple(w[p:p + size]) in grams:
                    hit.update(range(p, p + size))
                    found.add(str(k))
        want[i] = (len(w), len(hit), sorted(found))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (200_000, 40):          # one automaton, then several
        got = decontaminate.contamination(docs(rows), bench, window=window,
                                          block_words=block_words).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in got} == want
    clean = {r.doc_id: r.text for r in
             decontaminate.decontaminate(docs(rows), bench, window=window).collect()}
    for i, text in rows:
        n, hits, _ = want[i]
        assert (i in clean) == (hits <= 0.5 * n)
        if i in clean and not hits:
            assert clean[i] == text
        elif i in clean:
            assert len(word.findall(clean[i].translate(low))) == n - hits


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, size):
    rows = corpus(3, 120)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = text.translate(fold).split()
        n = min(size, len(w))
        sets[i] = {tuple(w[p:p + n]) for p in range(len(w) - n + 1)} if w else set()
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(rows), size=size).collect()}
    assert {i: r.component_id for i, r in got.items()} == {i: root(i) for i in sets}
    assert all(r.kept == (r.component_id == i) and r.n_shingles == len(sets[i])
               for i, r in got.items())


def test_signature_join_finds_all_within_distance():
    """Pigeonhole: two signatures at distance 15 or less share a key."""
    rng = random.Random(4)
    lane = (1 << minhash.BITS) - 1

    def keys(chunks):
        return {(i, v, c & m) for i, c in enumerate(chunks)
                for v, m in enumerate(minhash._masks())}
    for _ in range(300):
        a = [[rng.randrange(lane) for _ in range(minhash.VALUES)] for _ in range(minhash.CHUNKS)]
        b = [list(c) for c in a]
        for place in rng.sample(range(minhash.CHUNKS * minhash.VALUES), 15):
            b[place // minhash.VALUES][place % minhash.VALUES] ^= 1 + rng.randrange(lane - 1)
        pack = [[sum(v << minhash.BITS * k for k, v in enumerate(c)) for c in s] for s in (a, b)]
        assert keys(pack[0]) & keys(pack[1])


def test_one_center_and_many_loose_copies(spark, docs):
    """Copies of one text with more or less noise: some link to it, the loose
    ones to nothing or to each other; every link counts."""
    rng = random.Random(14)
    base = sentence(rng, 120).split()
    rows = [(1000, " ".join(base))]
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 3, 8, 12, 16, 25])):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randrange(9))
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[p:p + 2]) for p in range(len(t.split()) - 1)} for i, t in rows}
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    got = minhash.near_duplicates(docs(rows), size=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: root(i) for i in sets}
    assert len({r.component_id for r in got}) > 5


def test_pair_that_one_bit_sketches_dismissed(spark, docs):
    """Similarity 4/5 and signature distance 4; 83 of 512 one-bit values differ."""
    rows = [(1, "w38 w2479 w3774 w32"), (2, "w38 w2479 w3774 w32 w2254"), (3, "w1 w2 w3 w4")]
    got = minhash.near_duplicates(docs(rows), size=1).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_bitmaps_never_dismiss_a_link():
    import numpy as np
    rng = np.random.default_rng(15)
    for _ in range(200):
        both = rng.integers(0, 1 << 63, rng.integers(1, 900), np.uint64) * np.uint64(2)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 63, rng.integers(0, 300),
                                                             np.uint64)))) for _ in range(2))
        only = [sum(bin(int(u) & ~int(v) & (1 << 64) - 1).count("1")
                    for u, v in zip(minhash.bitmap(p), minhash.bitmap(q)))
                for p, q in ((a, b), (b, a))]
        common = minhash.shared_hashes(a.tobytes(), b.tobytes())
        assert common <= min(len(a) - only[0], len(b) - only[1])


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(60, 90), rng.randrange(60, 90))
                                               for _ in range(25)]
    parent = {n: n for link in links for n in link}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {n: root(n) for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("shard", [200_000, 7])
def test_exact_dedup(spark, docs, shard):
    rows = corpus(6)
    rows += [(100 + i, t.replace(" ", "  ")) for i, t in rows[:9]] + [(200, None), (201, " ")]
    norm = {i: (t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)}) for i, t in rows}
    texts = dict(rows)
    want = {}
    for i in norm:
        group = [j for j in norm if norm[j] == norm[i]]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        want[i] = (keep, len(group), keep == i,
                   hashlib.sha256(norm[i].encode()).hexdigest())
    for is_history in (None, F.col("doc_id") < 30, F.col("doc_id") < -1):
        got = exact.exact_dedup(docs(rows), is_history, shard_digests=shard).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want


def test_perfect_hash_is_minimal_and_checked():
    import numpy as np
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, np.uint64))
    table = exact.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    digests = rng.integers(0, 256, (300, 32), np.uint8)
    zero = np.zeros(300, np.int64)
    index = exact.DigestIndex(digests, zero, zero, zero)
    assert (index.find(digests) >= 0).all()
    other = digests.copy()
    other[:, 31] ^= 1                      # same 64-bit key, other digest
    assert (index.find(other) == -1).all()


@pytest.mark.parametrize("min_words", [50, 8])
def test_lines(spark, docs, min_words):
    rows = corpus(8)
    table = "\n".join("\t".join(f"cell{i}{j}" for j in range(30)) for i in range(10))
    cjk = "\n".join("日本語の文章が続く" + chr(0x4E00 + i) * 4 for i in range(8)) + "\n𠀀漢한"
    blob = "x" * 2500 + "\n" + "\u3000".join("ab" * 40 for _ in range(30))
    for text in (table, cjk, blob):
        rows += [(len(rows), text), (len(rows) + 1, "Other start\n" + text + "\nother end"),
                 (len(rows) + 2, text.replace("5", "6").replace("x", "y"))]
    rows += [(len(rows), "\n".join(["same line again"] * 70)), (len(rows) + 1, "a b\n\n\t \n" * 40)]
    texts = [t.split("\n") for _, t in rows]
    wide = "[\u2E80-\u9FFF\uAC00-\uD7A3\uF900-\uFAFF\U00020000-\U0003FFFF]"
    word = re.compile(wide + "|[^ \t-\r" + wide[1:-1] + "]{1,40}")
    count = [[max(1, len(word.findall(x))) for x in t] for t in texts]
    seen, gone = set(), [set() for _ in rows]
    # every run of lines with enough words, in the order of its place
    for d, t in enumerate(texts):
        runs = []
        for p in range(len(t)):
            total = 0
            for q in range(p, len(t)):
                total += count[d][q]
                if total >= min_words:
                    runs.append((p, q))
        for p, q in runs:
            run = tuple(t[p:q + 1])
            if run in seen:
                gone[d].update(range(p, q + 1))
            seen.add(run)
    got = {r.doc_id: r for r in lines.dedup_lines(docs(rows), min_words=min_words,
                                                  report="r").collect()}
    for d, (i, _) in enumerate(rows):
        want = "\n".join(x for p, x in enumerate(texts[d]) if p not in gone[d])
        assert got[i].text == want and got[i].r.n_removed == len(gone[d]), i


@pytest.mark.parametrize("length, gram, group", [(40, 8, 4000), (40, 8, 2), (400, 32, 4000)])
def test_substrings(spark, docs, length, gram, group):
    rows = corpus(9, 50) + [(900, "ab" * 300), (901, "é" * 250), (902, "é" * 250 + "x")]
    body = {i: t.encode() for i, t in rows}
    often = Counter(b[p:p + length] for b in body.values() for p in range(len(b) - length + 1))
    got = {r.doc_id: r for r in substrings.remove_repeats(
        docs(rows), length=length, gram=gram, group=group).collect()}
    for i, b in body.items():
        hit = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if often[b[p:p + length]] > 1:
                hit[p:p + length] = b"\x01" * length
        kept = bytes(c for c, h in zip(b, hit) if not h)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(hit))]
        r = got[i]
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(b), sum(hit), kept), i
        assert [(s.first, s.end) for s in r.spans] == spans
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_first_fit_decreasing_against_a_plain_search():
    rng = random.Random(10)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))]
        bins: list[list[int]] = []
        for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            for b in bins:
                if sum(lengths[i] for i in b) + lengths[item] <= 64:
                    b.append(item)
                    break
            else:
                bins.append([item])
        assert packing.first_fit_decreasing(lengths, 64) == bins
        done = packing.pack_lengths(lengths, 64, 4)
        assert all(sum(p[2] for p in b) <= 64 for b in done)
        spans = sorted((i, s, n) for b in done for i, s, n in b)
        at = {}
        for i, s, n in spans:
            assert s == at.get(i, 0) and n > 0
            at[i] = s + n
        assert [at.get(i, 0) for i in range(len(lengths))] == lengths


def test_packing_round_trip(spark, docs):
    rows = corpus(11) + [(500, None), (501, ""), (501, ""), (502, "word " * 9000)]
    path = queries.tokenizer_path(queries.BYTE_BPE)
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    want = sorted((i, plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    pieces = packing.pack(docs(rows), path, group_docs=20, with_ids=True).collect()
    import numpy as np
    by_sequence, by_doc = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u2").tolist()
        assert len(ids) == p.length
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == p.ids_crc32
        by_sequence.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids))
    padding = 0
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and {p.padded_length for p in sequence} == {
            at if at & (at - 1) == 0 else 1024}
        padding += sequence[0].padded_length - at
    total = sum(len(ids) for _, ids in want)
    assert sum(p.length for p in pieces) == total
    # one short sequence a group, and gaps too small to cut for
    groups = {p.sequence_id >> 32 for p in pieces}
    assert padding <= 1024 * len(groups) + packing.MIN_CUT * len(by_sequence)
    got = []
    for (i, n), parts in by_doc.items():
        starts = Counter(s for s, _ in parts)
        copies = starts[0]
        joined = [x for _, ids in sorted(parts) for x in ids]
        assert len(joined) == n * copies
        if copies == 1:
            got.append((i, joined))
    assert all(g in want for g in got) and len(got) >= len(rows) - 2


@pytest.mark.parametrize("name, keep_space", [(queries.BYTE_BPE, True), (queries.WORD_BPE, False)])
def test_token_coder_equals_the_tokenizer(name, keep_space):
    rng = random.Random(12)
    bits = [" ", "  ", "\n", "\t", " ", "\x1c", "a", "The", "'s", "don't", "!", "12", "é", "é",
            "<|endoftext|>", "日本", "\r\n", "Σ", "İ", "\x85", "\x00", "ﬁ", " ", "(a)", "ß**", "ÿ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    coder = TokenCoder(queries.tokenizer_path(name), keep_space, cache_words=500)
    assert coder.encode(pa.array(texts)) == coder.whole(texts)
    assert coder.encode(pa.array([None, ""])) == [b"", b""]


def test_records_round_trip(spark, docs):
    rows = corpus(13) + [(500, None), (None, "no id"), (7, "second seven")]
    path = queries.tokenizer_path(queries.WORD_BPE)
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    import numpy as np
    manifest = records.write_records(docs(rows), path, file_bytes=2000, partitions=3)
    files = manifest.orderBy("tokens_before").collect()
    assert len(files) > 3
    got = records.read_records(manifest).collect()
    ids = {(i, t): plain.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    assert len(got) == len(rows)
    crc = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    assert crc == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
                          for (i, _), x in ids.items())
    order = sorted(got, key=lambda r: r.start)
    at = 0
    for r in order:
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in order]
    assert keys == sorted(keys)
    # the index gives the same records in any order
    f = files[0]
    plain_order = [(i, x.tolist()) for i, x in records.read_shuffled("file:///", f.path,
                                                                     f.index_path, 0)]
    assert len(plain_order) == f.n_records
    assert sum(len(x) for _, x in plain_order) == f.n_tokens


def test_damaged_record_is_refused():
    import io
    data = bytearray(records.encode_record(5, b"\x01\x00\x02\x00", 2))
    doc_id, ids = records.decode_record(records.read_frame(io.BytesIO(bytes(data))))
    assert (doc_id, ids.tolist()) == (5, [1, 2])
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        records.read_frame(io.BytesIO(bytes(data[:-1])))

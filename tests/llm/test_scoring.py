"""Language-model scores, ranked search and resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hmm, lexical, resample
from small_texts import EDGES, WORDS, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH = "item_id long, text string"


def corpus(seed: int, n: int = 80):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = sentence(rng, rng.randint(0, 60)).split()
        if i % 4 == 0:
            words = [w.upper() + "ß" for w in words]
        if i % 7 == 0:
            words.append("Only" + str(i))
        out.append((i, rng.choice(" \n\t\v").join(words)))
    return out + [(n, None), (n + 1, " \n "), (n + 2, "x"), (n + 3, "Repeat " * 3000)]


# hidden Markov model ---------------------------------------------------------

def small_model(states=3, classes=5, seed=0):
    rng = np.random.RandomState(seed)
    share = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1])
    return hmm.HiddenMarkov(share(states), share(states), share(states, states),
                            share(states, classes).T)


def by_paths(model, text, start):
    """Likelihood and expected counts over all paths of states."""
    states = len(start)
    total, n_start = 0.0, np.zeros(states)
    trans, emit = np.zeros((states, states)), np.zeros_like(model.emit)
    for path in itertools.product(range(states), repeat=len(text)):
        p = start[path[0]] * model.emit[text[0], path[0]]
        for t in range(1, len(text)):
            p *= model.trans[path[t - 1], path[t]] * model.emit[text[t], path[t]]
        total += p
        n_start[path[0]] += p
        for t, s in enumerate(path):
            emit[text[t], s] += p
            if t:
                trans[path[t - 1], s] += p
    return total, n_start / total, trans / total, emit / total


def test_expected_counts_are_those_of_all_paths():
    rng = random.Random(3)
    model = small_model()
    texts = [[rng.randrange(5) for _ in range(rng.randint(1, 6))] for _ in range(12)]
    first = np.array([i % 3 != 0 for i in range(12)])
    start, trans, emit, logp = model.expected([np.array(t, "<u2") for t in texts], first)
    want = [by_paths(model, t, model.start if f else model.later)
            for t, f in zip(texts, first)]
    assert logp == pytest.approx(sum(math.log(w[0]) for w in want), rel=1e-12)
    np.testing.assert_allclose(start, sum(w[1] for w, f in zip(want, first) if f), rtol=1e-10)
    np.testing.assert_allclose(trans, sum(w[2] for w in want), rtol=1e-10)
    np.testing.assert_allclose(emit, sum(w[3] for w in want), rtol=1e-10)


def test_likelihood_of_whole_sequences_in_runs():
    rng = random.Random(4)
    model = small_model(4, 9, 1)
    texts = [np.array([rng.randrange(9) for _ in range(n)], "<u2")
             for n in (1, 2, 7, 8, 9, 40, 333, 16)]
    want = []
    for text in texts:
        a, total = model.start * model.emit[text[0]], 0.0
        for c in text[1:]:
            total += math.log10(a.sum())
            a = (a / a.sum()) @ model.trans * model.emit[c]
        want.append(total + math.log10(a.sum()))
    for long in (1, 3, 8, 1000):
        np.testing.assert_allclose(model.log10(texts, long), want, rtol=1e-11)


def test_words_split_at_ascii_white_space_only():
    text = "A\x1cb\x85c　D\x0be  FÄ\t\n"
    words, index, sizes = hmm.split_words(pa.array([text, None, " x "]))
    assert [words[i] for i in index] == ["a\x1cb\x85c　d", "e", "fÄ", "x"]
    assert sizes.tolist() == [3, 0, 1]


@pytest.mark.parametrize("own, frequent", [(8192, 1 << 19), (5, 20), (3, 0)])
def test_scores(spark, docs, own, frequent):
    """Whatever words are own classes or broadcast: counts, base scores and the
    probability of every word by the trained parameters, from dictionaries."""
    rows = corpus(5)
    learn = {i: i % 3 != 1 for i, _ in rows}
    df = docs(rows).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"),
                           (F.col("doc_id") % 3 != 1).alias("_learn"))
    words = hmm.count_words(df, own, frequent)
    encoded = hmm.encode(df, words)
    model, history = hmm.baum_welch(encoded, words, states=3, passes=4, gain=0)
    assert len(words.keys) <= frequent and words.own <= own
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(history, history[1:]))
    got = {r._id: r for r in hmm.score(encoded, words, model).collect()}

    cut = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) for i, t in rows}
    count = Counter(w for i, ws in cut.items() if learn[i] for w in ws)
    texts = sum(learn.values())
    n, v = sum(count.values()) + texts, len(count) + 1
    own_class = {int(k): int(c) for k, c in zip(words.keys, words.classes) if c <= words.own}
    form_tokens, form_words, classes = Counter(), Counter(), {}
    for w in set(itertools.chain(*cut.values())):
        (key,), (form,) = hmm.word_keys([w])
        classes[w] = own_class.get(int(key), words.own + 1 + int(form))
        if classes[w] > words.own and count[w]:
            form_tokens[classes[w]] += count[w]
            form_words[classes[w]] += 1
    for i, ws in cut.items():
        assert got[i].n_tokens == len(ws) + 1 and got[i].train_tokens == n
        assert got[i].n_known == sum(count[w] > 0 for w in ws) + 1
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws) \
            + math.log10((texts + 1) / (n + v + 1))
        assert got[i].base_score == pytest.approx(base, rel=1e-10)
        a, total = model.start, 0.0
        for t, w in enumerate([*ws, None]):
            c = 0 if w is None else classes[w]
            a = (a if t == 0 else a @ model.trans) * model.emit[c]
            if c > words.own:
                a = a * (count[w] + 1) / (form_tokens[c] + form_words[c] + 1)
            total += math.log10(a.sum())
            a = a / a.sum()
        assert got[i].score == pytest.approx(total, rel=1e-9)


def test_probabilities_sum_to_one():
    model = hmm.HiddenMarkov.initial(np.array([3.0, 0, 9, 1]), 4, 1)
    for m in (model, model.updated(np.ones(4), np.ones((4, 4)), np.ones((4, 4)), np.ones(4))):
        np.testing.assert_allclose(m.emit.sum(axis=0), 1)
        np.testing.assert_allclose(m.trans.sum(axis=1), 1)
        assert m.start.sum() == pytest.approx(1) and m.later.sum() == pytest.approx(1)


def test_two_vocabularies_are_learned(spark, docs):
    """Texts of two vocabularies: held-out ones score above the unigrams."""
    rng = random.Random(6)
    sides = [WORDS[:20], WORDS[20:40]]
    rows = [(i, " ".join(rng.choice(sides[i % 2]) for _ in range(40))) for i in range(200)]
    got = hmm.language_scores(docs(rows), F.col("doc_id") % 5 != 0, states=2).collect()
    held = [r for r in got if not r.learned]
    # a bit a word less, but for the start
    assert sum(r.score - r.base_score for r in held) > 0.2 * sum(r.n_tokens for r in held)


def test_nothing_to_learn_from(spark, docs):
    got = hmm.language_scores(docs(EDGES), F.lit(False)).collect()
    assert {(r.score, r.base_score, r.train_tokens, r.n_known) for r in got} == {(0, 0, 0, 0)}


# ranked search ---------------------------------------------------------------

def ranked(rows, items, k=10):
    cut = [(i, WORD.findall((t or "").translate(LOW))) for i, t in rows]
    n_docs = sum(bool(w) for _, w in cut)
    n_terms = sum(len(w) for _, w in cut)
    df = Counter(t for _, w in cut for t in set(w))
    out = []
    for item, text in items:
        scores = []
        terms = WORD.findall((text or "").translate(LOW))
        for i, w in cut:
            tf, total = Counter(w), 0
            for t in terms:
                if tf[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * len(w) * n_docs) // n_terms
                    total += weight * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if total > 0:
                scores.append((-total, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return out


def by_rank(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("tiles", [(64, 2048, 256), (3, 7, 5)])
@pytest.mark.parametrize("block_bytes", [1 << 22, 300])
def test_search(spark, docs, tiles, block_bytes, monkeypatch):
    for name, size in zip(("ITEM_TILE", "TERM_TILE", "DOC_TILE"), tiles):
        monkeypatch.setattr(lexical, name, size)
    rng = random.Random(8)
    rows = corpus(9)
    rows += [(200 + i, rows[3][1]) for i in range(15)]          # ties beyond k
    items = [(i, sentence(rng, rng.randint(1, 25)).title()) for i in range(12)]
    items += [(20, "only0; ONLY0 only7"), (21, "nowhere"), (22, None), (23, ""),
              (24, rows[3][1] + "\n" + rows[8][1]), (25, "repeat " * 5)]
    items = [(i, t) for i, t in items]
    got = lexical.search(docs(rows), spark.createDataFrame(items + items[:3], BENCH),
                         block_bytes=block_bytes).collect()
    assert by_rank(got) == by_rank(ranked(rows, items))


def test_search_edges(spark, docs):
    items = [(1, "two words one"), (None, "no id 日本語 A"), (2, "x b")]
    df = spark.createDataFrame(items, BENCH)
    want = by_rank(ranked(EDGES, items))
    assert by_rank(lexical.search(docs(EDGES, extra=True), df).collect()) == want
    assert lexical.search(docs([]), df).collect() == []
    assert lexical.search(docs(EDGES), df.where("false")).collect() == []
    assert lexical.search(docs([(1, None)]), df).collect() == []


def test_large_weights_stay_exact():
    """Weights over several digits: sums as with whole numbers."""
    block = lexical.ItemBlock([b"a " * 3_000_000 + b"b c", b"c"])
    weights = np.array([60_000, 7, 59_999])
    (items, terms, cuts), = block.tiles(weights)
    impacts = np.array([[999_999, 1], [5, 999_998], [999_999, 0]])
    scores = sum((digit @ impacts[lo:hi].astype(float)).astype(np.int64) << (20 * n)
                 for lo, hi, digits in cuts for n, digit in enumerate(digits))
    counts = [[3_000_000, 1, 1], [0, 0, 1]]
    for row in range(2):
        for doc in range(2):
            assert int(scores[row, doc]) == sum(
                counts[row][t] * int(weights[t]) * int(impacts[t, doc]) for t in range(3))
    assert all((d < 1 << 20).all() for _, _, digits in cuts for d in digits)
    assert len(cuts[0][2]) == 2 and list(items) == [0, 1] and terms.tolist() == [0, 1, 2]


def test_lengths_beyond_64_bits():
    n = np.array([0, 10 ** 9], np.int64)
    assert lexical.lengths_of(n, 10 ** 12, 10 ** 15).tolist() == [25, 25 + 75 * 10 ** 21 // 10 ** 15]


# resampling ------------------------------------------------------------------

def test_shift_cancels_prefixes():
    rng = random.Random(10)
    for size in (0, 1, 5, 63, 64, 65, 130, 4097, 300_000):
        a = bytes(rng.randrange(256) for _ in range(rng.randint(0, 50)))
        b = bytes(rng.randrange(256) for _ in range(size))
        got = np.uint32(zlib.crc32(a + b)) ^ resample.shift(
            np.array([zlib.crc32(a)], np.uint32), np.array([size]))[0]
        assert got == zlib.crc32(b)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_grams(order):
    texts = [t or "" for _, t in corpus(11) + EDGES]
    words = [WORD.findall(t.translate(LOW)) for t in texts]
    n_words, grams = resample.gram_crcs([t.encode() for t in texts], order)
    assert n_words.tolist() == [len(w) for w in words]
    for n in range(1, order + 1):
        want = [zlib.crc32(" ".join(w[i:i + n]).encode()) for w in words
                for i in range(len(w) - n + 1)]
        assert grams[n - 1].tolist() == want
    assert all(len(g) == 0 for g in resample.gram_crcs([], order)[1])


def drawn(rows, target, buckets, share=25, least=20, seed=7):
    def gram_buckets(text):
        w = WORD.findall((text or "").translate(LOW))
        grams = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        return len(w), [zlib.crc32(g.encode()) % buckets for g in grams]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(gram_buckets(text)[1])
    for _, text in target:
        t.update(gram_buckets(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    out, able = {}, []
    for i, text in rows:
        n, own = gram_buckets(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets)
                                            / ((s[b] + 1) * (total_t + buckets)))) for b in own]
        weight = math.floor(Fraction(sum(gains), len(gains))) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [i, len(own), weight, score, None]
        if n >= least:
            able.append((-score, i))
    for rank, (_, i) in enumerate(sorted(able)[:share * len(able) // 100]):
        out[i][4] = rank + 1
    return sorted(map(tuple, out.values()))


@pytest.mark.parametrize("buckets", [10_000, 3, 100_000])
def test_resample(spark, docs, buckets):
    rows = corpus(12)
    target = [(1, rows[4][1]), (2, "Only7 the of"), (3, None)]
    got = resample.importance_resample(docs(rows), spark.createDataFrame(target, BENCH),
                                       buckets=buckets)
    got = got.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got)) == drawn(rows, target, buckets)


def test_resample_edges(spark, docs):
    none = spark.createDataFrame([], BENCH)
    rows = [(i, " ".join(["same"] * 20)) for i in range(40)]
    got = resample.importance_resample(docs(rows), none).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 11))
    order = [(-r.score, r.doc_id) for r in sorted(got, key=lambda r: r.rank or 99) if r.rank]
    assert order == sorted((-r.score, r.doc_id) for r in got)[:10]
    twice = resample.importance_resample(docs([(None, "a " * 30)] * 8, extra=True), none)
    assert sorted(r.rank or 0 for r in twice.collect()) == [0] * 6 + [1, 2]
    assert resample.importance_resample(docs([]), none).collect() == []

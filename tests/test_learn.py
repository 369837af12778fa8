"""Sub-words, training with history and many rules, against plain restatements."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import rules, softmax, subword

# --- sub-words -----------------------------------------------------------------

BERT_LIKE = ["un", "##aff", "##able", "##a", "##b", "a", "b", "ab", "##abb", "unaffable", "##x"]
CLIP_LIKE = ["un", "aff", "able</w>", "a", "b", "a</w>", "b</w>", "ab", "ab</w>", "abb", "x</w>"]


def plain_cut(word, pieces, continues, ends, unknown=100):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = (continues if at and continues else "") + word[at:end] \
                + (ends if end == len(word) else "")
            if piece in pieces:
                out.append(pieces[piece])
                at = end
                break
        else:
            return [unknown]
    return out


@pytest.mark.parametrize("vocab, continues, ends", [(BERT_LIKE, "##", ""), (CLIP_LIKE, "", "</w>"),
                                                    (["a", "ab", "abc", "c"], "", "")])
def test_longest_pieces(spark, vocab, continues, ends):
    pieces = {p: 200 + i for i, p in enumerate(vocab)}
    rng = random.Random(1)
    words = ["".join(rng.choice("abcxunfle") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    words += ["unaffable", "ab", "abb", "abab", "a" * 250]
    trie = subword.PieceTrie(pieces.items(), continues, ends)
    for w in words:
        want = [100] if len(w) > 200 else plain_cut(w, pieces, continues, ends)
        assert trie.cut(w) == want, w
    rows = [(i, words[3 * i:3 * i + 3]) for i in range(100)] + [(100, None), (101, [])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>").repartition(3)
    table = spark.createDataFrame(list(pieces.items()), "piece string, piece_id int")
    spelling = {"continues": continues, "ends": ends}
    got = {r.k: r.subword_ids for r in
           subword.subword_ids(df, "k", "tokens", table, **spelling).collect()}
    for k, toks in rows:
        assert got[k] == (None if toks is None else [i for w in toks for i in trie.cut(w)])
    used = {r.piece_id: r["count"] for r in
            subword.subword_vocab(df, "k", "tokens", table, **spelling).collect()}
    flat = [i for ids in got.values() for i in ids or []]
    assert used == {i: flat.count(i) for i in set(flat)}


def test_words_come_back(spark):
    words = [["un", "unaffable"], ["abb", "a"], [], ["zzz"], None]
    df = spark.createDataFrame(list(enumerate(words)), "k int, tokens array<string>")
    for vocab, spelling in ((BERT_LIKE, {"continues": "##"}),
                            (["un</w>", "aff", "able</w>", "a</w>", "abb</w>", "un"],
                             {"ends": "</w>"})):
        table = spark.createDataFrame([(p, 200 + i) for i, p in enumerate(vocab)],
                                      "piece string, piece_id int")
        ids = subword.subword_ids(df, "k", "tokens", table, **spelling)
        back = {r.k: r.decoded for r in
                subword.decode_subwords(ids, "k", "subword_ids", table, **spelling).collect()}
        assert back == {0: "un unaffable", 1: "abb a", 2: "", 3: "[UNK]", 4: None}


def test_vocabulary_bound(spark, monkeypatch):
    monkeypatch.setattr(subword, "MAX_PIECES", 2)
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "piece string, piece_id int")
    with pytest.raises(ValueError):
        subword.subword_ids(spark.createDataFrame([(1, ["a"])], "k int, t array<string>"), "k",
                            "t", table)


# --- training ------------------------------------------------------------------

def ledger(spark, n=120, seed=3):
    rng = random.Random(seed)
    sides = {"Food": "milk bread apple corn".split(), "Auto": "tire gas oil wheel".split(),
             "Home": "lamp chair rug wall".split()}
    rows = []
    for i in range(n):
        label = rng.choice(list(sides))
        words = [rng.choice(sides[label] + ["shop"]) for _ in range(rng.randint(0, 6))]
        rows.append((i, label if i % 17 else None, words if i % 13 else None, i % 3 == 0))
    return spark.createDataFrame(rows, "k long, label string, tokens array<string>, test boolean"), \
        rows


def plain_training(spark, rows, plan):
    """The same by dense matrices on one machine."""
    from ledgerlens.operators.batch import bucket_ids
    df = spark.createDataFrame([(r[0], r[2] or []) for r in rows], "k long, t array<string>")
    ids = {r.k: r.ids for r in df.select("k", bucket_ids("t", plan.buckets).alias("ids")).collect()}
    part = {r.k: r.s for r in df.select("k", F.pmod(F.xxhash64("k"), F.lit(plan.batches))
                                        .alias("s")).collect()}
    labels = sorted({r[1] for r in rows if r[1] and not r[3]})
    x = np.zeros((len(rows), plan.buckets + 1))
    for i, r in enumerate(rows):
        for b in ids[r[0]]:
            x[i, b] += 1 / len(ids[r[0]])
        x[i, 0] = 1
    y = np.array([labels.index(r[1]) if r[1] in labels else -1 for r in rows])
    test = np.array([r[3] for r in rows])
    w = np.zeros((plan.buckets + 1, len(labels)))
    m, v, rate, t = w * 0, w * 0, plan.rate, 0
    history, best, waited = [], math.inf, 0
    for epoch in range(plan.epochs):
        sums = np.zeros(3)

        def run(at):
            logits = x[at] @ w
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            own = y[at]
            return p, np.array([len(at), -np.log(p[np.arange(len(at)), own]).sum(),
                                (np.round(logits, 9).argmax(axis=1) == own).sum()])

        for s in range(plan.batches):
            at = np.array([i for i, r in enumerate(rows)
                           if y[i] >= 0 and not test[i] and part[r[0]] == s], int)
            if not len(at):
                continue
            p, one = run(at)
            sums += one
            p[np.arange(len(at)), y[at]] -= 1
            g = x[at].T @ p / len(at)
            t += 1
            m = plan.beta1 * m + (1 - plan.beta1) * g
            v = plan.beta2 * v + (1 - plan.beta2) * g * g
            w = w * (1 - rate * plan.decay) - rate * (m / (1 - plan.beta1 ** t)) / (
                np.sqrt(v / (1 - plan.beta2 ** t)) + plan.eps)
        val = run(np.flatnonzero((y >= 0) & test))[1]
        values = []
        for n, loss, right in (sums, val):
            values += [loss / math.ceil(n / 64), right / n]
        history += [(epoch + 1, k, z) for k, z in zip(softmax.METRICS, values)]
        waited = 0 if values[2] < best else waited + 1
        best = min(best, values[2])
        if waited >= plan.patience:
            break
    return history, w, labels


PLAN = softmax.Plan(epochs=5, batches=3, buckets=64, rate=0.2)


def test_history_equals_dense_training(spark):
    df, rows = ledger(spark)
    state = softmax.train(df, "k", "label", "tokens", "test", plan=PLAN)
    want, w, labels = plain_training(spark, rows, PLAN)
    assert state.labels == labels and not state.stopped
    assert [h[:2] for h in state.history] == [h[:2] for h in want]
    np.testing.assert_allclose([h[2] for h in state.history], [h[2] for h in want], rtol=1e-8)
    np.testing.assert_allclose(state.weights, w, rtol=1e-6, atol=1e-9)
    got = softmax.history(spark, state)
    assert got.columns == ["epoch", "metric", "value"] and got.count() == 20
    # the words decide: the labels of rows with some are learned
    pred = {r.k: r.pred_label for r in
            softmax.predict(state, df, "k", "tokens", PLAN.buckets).collect()}
    clear = [r for r in rows if r[1] and r[2] and set(r[2]) - {"shop"}]
    assert len(pred) == len(rows)
    assert sum(pred[r[0]] == r[1] for r in clear) >= 0.95 * len(clear)


def test_a_run_that_died_goes_on(spark, tmp_path):
    df, _ = ledger(spark)
    whole = softmax.train(df, "k", "label", "tokens", "test", plan=PLAN)
    path = str(tmp_path / "state")
    short = softmax.Plan(**{**PLAN.__dict__, "epochs": 2})
    softmax.train(df, "k", "label", "tokens", "test", plan=short, path=path)
    saved = softmax.load_state(spark, path)
    assert saved.epoch == 2 and len(saved.history) == 8
    rest = softmax.train(df, "k", "label", "tokens", "test", plan=PLAN, path=path)
    np.testing.assert_allclose([h[2] for h in rest.history], [h[2] for h in whole.history],
                               rtol=1e-9)
    again = softmax.train(df, "k", "label", "tokens", "test", plan=PLAN, path=path)
    assert again.history == rest.history          # nothing left to do


def test_rate_and_stop():
    """No better validation loss: the rate is halved after three epochs, training
    ends after five."""
    zero = np.zeros((2, 2))
    state = softmax.State(zero, zero, zero, ["a", "b"], 1.0)
    plan = softmax.Plan()
    rates = []
    for loss in (10.0, 11, 11, 11, 10.5, 12, 12, 12):
        softmax._after_epoch(state, plan, (64, 1.0, 1), (64, loss, 1))
        rates.append(state.rate)
        if state.stopped:
            break
    assert rates == [1, 1, 1, 0.5, 0.5, 0.5] and state.epoch == 6
    # a gain below one part in ten thousand does not count for the rate
    state = softmax.State(zero, zero, zero, ["a", "b"], 1.0)
    for loss in (10.0, 9.9999, 9.9998, 9.9997):
        softmax._after_epoch(state, plan, (64, 1.0, 1), (64, loss, 1))
    assert state.rate == 0.5 and not state.stopped


def test_training_edges(spark):
    df, _ = ledger(spark)
    none = softmax.train(df.where("false"), "k", "label", "tokens", "test", plan=PLAN)
    assert none.labels == [] and none.history == []
    only = softmax.train(df.where("not test"), "k", "label", "tokens", "test",
                         plan=softmax.Plan(epochs=1, buckets=16))
    assert dict((m, v) for _, m, v in only.history)["val_loss"] == 0
    with pytest.raises(ValueError):
        softmax.train(df, "k", "label", "tokens", "test", plan=softmax.Plan(buckets=1 << 23))


# --- rules ------------------------------------------------------------------------

def first_rule(text, table):
    hits = [(o, t) for t, o, p in table if p is not None and p in text]
    return min(hits)[1] if hits else None


def test_many_rules_equal_the_first_match(spark, monkeypatch):
    monkeypatch.setattr(rules, "CASE_RULES", 20)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["home", "decor", "Café", "x", "日本", "\U0001F600ok", "a.b", "%"])
                      for _ in range(rng.randint(0, 9))) for _ in range(200)]
    table = []
    for i in range(300):
        t = rng.choice(texts)
        a = rng.randrange(len(t) + 1)
        table.append((f"t{i % 7}", 1000 - i, t[a:a + rng.randint(1, 9)]))
    table = [r for r in table if r[2]] + [("none", 5000, "nowhere at all"), ("null", 1, None)]
    frame = spark.createDataFrame(table, "target string, rule_ord int, pattern string")
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, texts[0])]
    df = spark.createDataFrame(rows, "k int, path string")
    got = {r.k: r.target for r in rules.map_by_rule(df, "path", frame).collect()}
    assert got == {k: None if t is None else first_rule(t, table) for k, t in rows}
    lower = {r.k: r.target for r in
             rules.map_by_rule(df, "path", frame, ignore_case=True).collect()}
    folded = [(t, o, p and p.lower()) for t, o, p in table]
    assert lower == {k: None if t is None else first_rule(t.lower(), folded) for k, t in rows}
    # an empty pattern is in every text
    empty = frame.union(spark.createDataFrame([("all", 0, "")], frame.schema))
    assert {r.target for r in rules.map_by_rule(df, "path", empty).collect()} == {"all", None}


def test_a_hundred_thousand_rules(spark):
    """As many rules as that by the index: those that match are found, in order."""
    frame = spark.range(100_000).select(
        F.concat(F.lit("t"), F.col("id") % 10).alias("target"),
        F.col("id").cast("int").alias("rule_ord"),
        F.concat(F.lit("item|"), F.substring(F.md5(F.col("id").cast("string")), 1, 12))
        .alias("pattern"))
    texts = spark.range(0, 100_000, 37).select(
        "id", F.concat(F.lit("shop|item|"), F.md5(F.col("id").cast("string")),
                       F.lit("|item|"), F.md5((F.col("id") % 500).cast("string"))).alias("path"))
    got = rules.map_by_rule(texts, "path", frame).collect()
    assert len(got) == 2703
    assert all(r.target == f"t{min(r.id, r.id % 500) % 10}" for r in got)


def test_index_files_a_pattern_under_its_rarest_gram(spark):
    texts = spark.createDataFrame([("home decor",), ("home garden",), ("home zebra",)], "text string")
    frame = spark.createDataFrame([("a", 1, "home zebr"), ("b", 2, "ho"), ("c", 3, "")],
                                  "target string, rule_ord int, pattern string")
    got = {r.target: r.gram for r in rules.rule_index(frame, texts, 4).collect()}
    assert re.fullmatch("e ze| zeb|zebr|me z", got["a"]) and got["b"] == "ho" and got["c"] == ""


def test_rules_of_a_common_fragment_are_met_without_a_shuffle_of_texts(spark, monkeypatch):
    """All patterns share their grams of four characters, and most texts hold all of
    these: neither the texts nor their windows are shuffled or paired with the rules,
    whatever the number of files and blocks."""
    monkeypatch.setattr(rules, "CASE_RULES", 20)
    monkeypatch.setattr(rules, "BLOCK_CHARS", 64)
    rng = random.Random(6)
    words = [f"item {i:02d} of the shop" for i in range(40)]
    table = [(f"t{i % 9}", i, rng.choice(words)[rng.randrange(4):] + " " + rng.choice(words)
              + rng.choice(["", " item", " item 07 of the shop and the house"])) for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    frame = spark.createDataFrame(table, "target string, rule_ord int, pattern string")
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, texts[0])]
    df = spark.createDataFrame(rows, "k int, path string")
    kind = dict(frame.dtypes)["target"]
    paths = rules.rule_files(frame, chunk=50)
    out = rules.match_rules(df, "path", paths, kind, "target")
    assert len(paths) > 2
    assert {r.k: r.target for r in out.collect()} == \
        {k: None if t is None else first_rule(t, table) for k, t in rows}
    assert "Exchange" not in rules.map_by_rule(df, "path", frame) \
        ._jdf.queryExecution().executedPlan().toString()

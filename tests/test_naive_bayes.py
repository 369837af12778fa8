"""Naive Bayes against a brute-force restatement on a small fixture."""

import math
import random

import pytest

from ledgerlens.operators import naive_bayes as nb


def brute(train, test, alpha=1.0):
    classes = sorted({c for c, _ in train})
    vocab = {t for _, toks in train for t in toks}
    n = {c: sum(1 for cc, _ in train if cc == c) for c in classes}
    cnt = {c: {} for c in classes}
    for c, toks in train:
        for t in toks:
            cnt[c][t] = cnt[c].get(t, 0) + 1
    tot = {c: sum(cnt[c].values()) for c in classes}
    out = []
    for toks in test:
        best = None
        for i, c in enumerate(classes):
            s = math.log(n[c] / len(train))
            s += sum(math.log((cnt[c].get(t, 0) + alpha) / (tot[c] + alpha * len(vocab)))
                     for t in toks if t in vocab)
            key = (round(s, 9), -i)
            if best is None or key > best[0]:
                best = (key, c)
        out.append(best[1])
    return out


@pytest.mark.parametrize("dense_max", [nb.DENSE_MAX_CLASSES, 1])
def test_matches_brute_force(spark, monkeypatch, dense_max):
    # dense_max=1 sends the three classes through the sparse (many-class) path
    monkeypatch.setattr(nb, "DENSE_MAX_CLASSES", dense_max)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    train = []
    for i in range(300):
        c = rng.choice(["x", "y", "z"])
        bias = {"x": words[:15], "y": words[10:25], "z": words[20:]}[c]
        train.append((c, [rng.choice(bias) for _ in range(rng.randint(0, 12))]))
    test = [[rng.choice(words + ["unseen"]) for _ in range(rng.randint(0, 10))] for _ in range(200)]
    tr = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(train)],
                               "k int, label string, toks array<string>")
    te = spark.createDataFrame([(i, t) for i, t in enumerate(test)], "k int, toks array<string>")
    model = nb.fit(tr, "label", "toks")
    got = {r.k: r.pred_label for r in nb.score(model, te, "k", "toks").collect()}
    assert [got[i] for i in range(len(test))] == brute(train, test)


def test_unknown_tokens_get_largest_prior_and_ties_lowest_index(spark):
    tr = spark.createDataFrame([(1, "b", ["x"]), (2, "b", ["y"]), (3, "a", ["z"]),
                                (4, "c", ["q"])], "k int, label string, toks array<string>")
    te = spark.createDataFrame([(1, ["nope"]), (2, []), (3, None)], "k int, toks array<string>")
    got = {r.k: r.pred_label for r in nb.score(nb.fit(tr, "label", "toks"), te, "k", "toks").collect()}
    assert got == {1: "b", 2: "b", 3: "b"}
    tie = spark.createDataFrame([(1, "b", ["x"]), (2, "a", ["y"])], "k int, label string, toks array<string>")
    got = nb.score(nb.fit(tie, "label", "toks"), te, "k", "toks").collect()
    assert {r.pred_label for r in got} == {"a"}


@pytest.mark.parametrize("dense_max", [nb.DENSE_MAX_CLASSES, 1])
def test_carried_columns_come_through_both_paths(spark, monkeypatch, dense_max):
    monkeypatch.setattr(nb, "DENSE_MAX_CLASSES", dense_max)
    tr = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["z"]), (3, "c", ["q", "x"])],
                               "k int, label string, toks array<string>")
    te = spark.createDataFrame([(1, "a", ["x"]), (2, None, []), (3, "c", None), (4, "zz", ["nope"])],
                               "k int, truth string, toks array<string>")
    model = nb.fit(tr, "label", "toks")
    plain = {r.k: r.pred_label for r in nb.score(model, te, "k", "toks").collect()}
    out = nb.score(model, te, "k", "toks", carry=["truth"])
    assert out.columns[:2] == ["k", "truth"]
    got = {r.k: (r.truth, r.pred_label) for r in out.collect()}
    assert got == {1: ("a", plain[1]), 2: (None, plain[2]), 3: ("c", plain[3]), 4: ("zz", plain[4])}


@pytest.mark.parametrize("dense_max", [nb.DENSE_MAX_CLASSES, 1])
def test_heads_in_one_pass_equal_separate_scoring(spark, monkeypatch, dense_max):
    # two heads trained on different rows (one label is often missing), so
    # their vocabularies differ; dense_max=1 takes the per-head fallback
    monkeypatch.setattr(nb, "DENSE_MAX_CLASSES", dense_max)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, rng.choice(["x", "y"]), rng.choice(["p", "q", "r", None]),
             [rng.choice(words) for _ in range(rng.randint(0, 8))]) for i in range(200)]
    tr = spark.createDataFrame(rows, "k int, a string, b string, toks array<string>")
    models = {"cat": nb.fit(tr, "a", "toks"), "sub": nb.fit(tr, "b", "toks")}
    te = spark.createDataFrame(
        [(i, [rng.choice(words + ["unseen"]) for _ in range(rng.randint(0, 6))]) for i in range(80)]
        + [(80, None)], "k int, toks array<string>")
    both = {r.k: r for r in nb.score_heads(models, te, "k", "toks").collect()}
    assert len(both) == 81
    for h, m in models.items():
        alone = {r.k: r for r in nb.score(m, te, "k", "toks").collect()}
        for k, r in alone.items():
            assert both[k][f"{h}_pred_label"] == r.pred_label
            assert both[k][f"{h}_pred_idx"] == r.pred_idx
            assert math.isclose(both[k][f"{h}_log_norm"], r.log_norm, rel_tol=1e-9)


def test_large_models_score_by_blocks(spark, monkeypatch):
    """A model beyond the bound of a broadcast: sums by blocks of rows equal the sums by
    joined tokens, for one head and two; no weights are shuffled by row."""
    rows = [(i, None if i % 17 == 0 else [f"w{(i * j) % 23}" for j in range(i % 9)] + ["hot"] * 3,
             "abc"[i % 3], None if i % 5 == 0 else "xy"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, toks array<string>, a string, b string")
    models = nb.fit_heads(df.where("k < 150"), {"one": "a", "two": "b"}, "toks")

    def by_key(frame, names):
        return {r.k: [getattr(r, n) if "idx" in n else
                      [round(x, 9) for x in getattr(r, n)] for n in names]
                for r in frame.collect()}

    heads = [f"{h}_{c}" for h in models for c in ("scores", "pred_idx")]
    want = by_key(nb.score_heads(models, df, "k", "toks", carry=["a"]), heads)
    alone = by_key(nb.score(models["one"], df, "k", "toks"), ["scores", "pred_idx"])
    monkeypatch.setattr(nb, "BROADCAST_CELLS", 0)
    both = nb.score_heads(models, df, "k", "toks", carry=["a"])
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(k" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert by_key(both, heads) == want and len(want) == 200
    assert by_key(nb.score(models["one"], df, "k", "toks"), ["scores", "pred_idx"]) == alone

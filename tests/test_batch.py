"""Batch inference through a model object, against per-row restatements."""

import random

import numpy as np
import pyarrow as pa

from ledgerlens.operators.batch import (batch_predict, hashed_nb_predict_fn, list_parts,
                                        segment_sums)


def test_segment_sums_match_per_row_sums():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(3, 20))
    rows = [[], [1, 2, 3], [], [], [19], [0, 0, 5], []]
    arr = pa.array(rows + [None], type=pa.list_(pa.int32()))
    for start in range(len(rows)):
        part = arr.slice(start, 4)
        flat, offsets = list_parts(part)
        got = segment_sums(weights, flat.astype(np.int64), offsets)
        want = np.array([[weights[c, r or []].sum() for r in part.to_pylist()]
                         for c in range(3)])
        np.testing.assert_allclose(got, want)


def test_batch_predict_sees_every_row_once_in_batches(spark):
    df = spark.createDataFrame([(i, [i, i + 1]) for i in range(203)], "k long, ids array<int>")
    seen = []

    def make():
        def predict(batch):
            assert len(batch) <= 16
            seen.append(len(batch))
            return np.array([sum(r) for r in batch.to_pylist()])
        return predict
    out = batch_predict(df.repartition(3), "k", "ids", make, batch_size=16, out_col="s")
    got = {r.k: r.s for r in out.collect()}
    assert got == {i: 2 * i + 1 for i in range(203)}


def test_hashed_nb_matches_per_row_argmax(spark):
    rng = random.Random(11)
    buckets = 32
    train = []
    for i in range(400):
        c = rng.choice(["a", "b", "c"])
        lo = {"a": 1, "b": 8, "c": 16}[c]
        train.append((i, c, [rng.randint(lo, lo + 12) for _ in range(rng.randint(0, 9))]))
    test = [(i, [rng.randint(0, buckets) for _ in range(rng.randint(0, 15))]) for i in range(150)]
    test.append((150, None))
    tr = spark.createDataFrame(train, "k long, label string, ids array<int>")
    te = spark.createDataFrame(test, "k long, ids array<int>")
    make_fn, labels = hashed_nb_predict_fn(tr, "label", "ids", buckets=buckets)
    got = {r.k: r.p for r in batch_predict(te, "k", "ids", make_fn, batch_size=7,
                                           out_col="p").collect()}

    # per-row restatement of the same model
    k = len(labels)
    counts = np.zeros((k, buckets + 1))
    n_docs = np.zeros(k)
    for _, c, ids in train:
        n_docs[labels.index(c)] += 1
        for b in ids:
            counts[labels.index(c), b] += 1
    seen = counts.sum(axis=0) > 0
    prior = np.log(n_docs / n_docs.sum())
    lik = np.log((counts + 1.0) / (counts.sum(axis=1, keepdims=True) + seen.sum()))
    lik[:, 0] = 0.0
    lik[:, ~seen] = 0.0
    for key, ids in test:
        want = int(np.argmax(prior + sum((lik[:, b] for b in ids or []), np.zeros(k))))
        assert got[key] == want, key

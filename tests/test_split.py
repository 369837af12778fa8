import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import split
from ledgerlens.operators.evaluate import class_weights
from ledgerlens.operators.encode import class_table
from ledgerlens.operators.split import split_counts, threshold_hex, train_test_split


def test_threshold():
    assert threshold_hex(0.33) == "547ae147"


def test_split_disjoint_complete_stable(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "k")
    a = train_test_split(df, "k").collect()
    b = train_test_split(df.repartition(5), "k").collect()
    assert len(a) == 3000
    assert {(r.k, r.is_test) for r in a} == {(r.k, r.is_test) for r in b}
    frac = sum(r.is_test for r in a) / 3000
    assert 0.29 < frac < 0.37


def test_exact_split_and_counts(spark):
    df = spark.range(0, 1001).withColumnRenamed("id", "k")
    flagged = train_test_split(df, "k", exact=True)
    c = split_counts(flagged).first()
    assert c.n_test == math.ceil(0.33 * 1001) and c.n_total == 1001
    assert c.train_batches == math.ceil(c.n_train / 64)


def test_class_weights_includes_empty_class(spark):
    labels = spark.createDataFrame([("Food",)] * 242 + [("Pets",)] * 3, "c string")
    cls = class_table(spark, ["Food", "Pets", "Travel"])
    got = {r.class_name: (r.n, float(r.weight)) for r in class_weights(labels, "c", cls).collect()}
    assert got["Food"] == (242, round(248 / 243, 6))
    assert got["Pets"] == (3, round(248 / 4, 6))
    assert got["Travel"] == (0, 248.0)


def _brute_exact(keys, test_size, seed=42):
    import hashlib
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:8], k))
    return set(order[:math.ceil(test_size * len(keys))])


@pytest.mark.parametrize("n, test_size", [(1, 0.33), (2, 0.5), (997, 0.33), (3000, 0.9), (50, 0.0)])
def test_exact_split_matches_sorted_hashes(spark, n, test_size):
    df = spark.range(0, n).withColumnRenamed("id", "k")
    got = {r.k for r in train_test_split(df, "k", test_size=test_size, exact=True)
           .filter("is_test").collect()}
    assert got == _brute_exact(range(n), test_size)


@pytest.mark.parametrize("max_ties", [split.MAX_TIES, 2])
def test_exact_cutoff_with_heavy_ties(spark, monkeypatch, max_ties):
    # three hash values shared by many keys: the cut-off falls inside a tie group
    monkeypatch.setattr(split, "MAX_TIES", max_ties)
    df = spark.range(0, 300).withColumnRenamed("id", "k")
    h = F.lpad((F.col("k") % 3).cast("string"), 8, "0")
    rows = sorted(((f"{k % 3:08d}", k) for k in range(300)))
    for rank in (1, 99, 100, 101, 250, 300):
        assert split.exact_cutoff(df, "k", h, rank) == rows[rank - 1]


def test_head_metrics_equal_per_head_accuracy_and_loss(spark):
    from ledgerlens.operators.evaluate import accuracy_and_loss, head_metrics
    rows = [(i, i % 3 if i % 7 else None, (i * 5) % 3, -0.1 * (i % 4) - 0.01,
             i % 2, (i + 1) % 2, -0.2) for i in range(150)]
    df = spark.createDataFrame(
        rows, "k int, a_true int, a_pred int, a_lp double, b_true int, b_pred int, b_lp double")
    got = {r.head: (r.n, r.accuracy, r.loss) for r in head_metrics(
        df, {"a": ("a_true", "a_pred", "a_lp"), "b": ("b_true", "b_pred", "b_lp")}).collect()}
    for h in ("a", "b"):
        one = accuracy_and_loss(df.filter(F.col(f"{h}_true").isNotNull()), label_idx=f"{h}_true",
                                pred_idx=f"{h}_pred", log_p_true=f"{h}_lp").first()
        assert got[h] == (one.n, one.accuracy, one.loss)

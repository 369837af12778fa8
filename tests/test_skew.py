"""A token that holds a third of all (row, token) pairs, with the token table
too large to broadcast: the pairs are counted per row first, AQE splits the hot
partition of the shuffle join, and the results equal the broadcast plan's."""

import contextlib

from pyspark.sql import functions as F

from ledgerlens.operators import encode
from ledgerlens.operators import naive_bayes as nb

NO_BROADCAST_SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def hot_docs(spark, n=4000):
    """Each row: two ordinary tokens and the token 'hot' five times, which is a
    third of the distinct tokens of a row."""
    ordinary = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.concat(
        F.lit("t"), ((F.col("id") * 7 + i) % 500).cast("string")))
    return spark.range(n).select(
        F.col("id").alias("k"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")),
                     (F.col("id") % 3 + 1).cast("int")).alias("label"),
        F.concat(ordinary, F.array_repeat(F.lit("hot"), 5)).alias("toks"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_splits_hot_token(spark):
    docs = hot_docs(spark)
    model = nb.fit(docs, "label", "toks")
    want = {r.k: r.pred_label for r in nb.score(model, docs, "k", "toks").collect()}
    with conf(spark, NO_BROADCAST_SMALL_SKEW):
        out = nb.score(model, docs, "k", "toks", broadcast_cells=0)
        got = {r.k: r.pred_label for r in out.collect()}
        plan = _plan(out)
    assert got == want
    assert "SortMergeJoin(skew=true)" in plan


def test_token_ids_split_hot_token(spark):
    docs = hot_docs(spark).select("k", "toks")
    vocab = encode.build_vocab(docs.select(F.explode("toks").alias("token")))
    want = {r.k: r.token_ids for r in encode.token_ids(docs, "k", "toks", vocab).collect()}
    with conf(spark, NO_BROADCAST_SMALL_SKEW):
        out = encode.token_ids(docs, "k", "toks", vocab, broadcast_tokens=0)
        got = {r.k: r.token_ids for r in out.collect()}
        plan = _plan(out)
    assert got == want
    assert "SortMergeJoin(skew=true)" in plan
    # the hot token is the most frequent: the first id
    assert all(ids[-1] == encode.FIRST_TOKEN_ID for ids in got.values())

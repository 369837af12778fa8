"""Scoring a streaming ledger per micro-batch equals batch scoring."""

from pyspark.sql import functions as F

from ledgerlens.functions.text import clean_tokens
from ledgerlens.operators import naive_bayes as nb
from ledgerlens.session import scratch_path
from ledgerlens.streaming.score import clean_stream, dedupe_stream, parquet_sink, score_stream

SF = "/root/testdata/sf0.001"


def test_stream_scores_match_batch(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toks = docs.select("doc_id", "lang", clean_tokens("text").alias("tokens"))
    model = nb.fit(toks, "lang", "tokens")
    want = {r.doc_id: r.pred_label for r in nb.score(model, toks, "doc_id", "tokens").collect()}

    stream = (spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet")
              .option("maxFilesPerTrigger", 1).parquet(SF))
    out = scratch_path(spark, "stream-out")
    q = score_stream(model, stream, "doc_id", "text", parquet_sink(out),
                     checkpoint=scratch_path(spark, "stream-ckpt"), available_now=True)
    q.awaitTermination(300)
    got = {r.doc_id: r.pred_label for r in spark.read.parquet(out).collect()}
    assert got == want


def test_stream_scores_both_heads_in_one_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toks = docs.select("doc_id", "lang", "source", clean_tokens("text").alias("tokens"))
    models = {"cat": nb.fit(toks, "lang", "tokens"), "sub": nb.fit(toks, "source", "tokens")}
    want = {r.doc_id: (r.cat_pred_label, r.sub_pred_label)
            for r in nb.score_heads(models, toks, "doc_id", "tokens").collect()}

    stream = (spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet")
              .parquet(SF))
    out = scratch_path(spark, "stream-heads-out")
    q = score_stream(models, stream, "doc_id", "text", parquet_sink(out),
                     checkpoint=scratch_path(spark, "stream-heads-ckpt"), available_now=True)
    q.awaitTermination(300)
    got = {r.doc_id: (r.cat_pred_label, r.sub_pred_label) for r in spark.read.parquet(out).collect()}
    assert got == want


def test_stream_cleaning_and_keep_first(spark):
    """Cleaning equals the batch expression; one row per key survives."""
    from ledgerlens.functions.text import clean_text
    rows = spark.createDataFrame(
        [("ONE 1!", "2023-09-01 10:00:00"), ("ONE 1!", "2023-09-01 10:05:00"),
         ("Two, 2", "2023-09-01 10:06:00")], "Description string, t string")
    rows = rows.withColumn("t", F.col("t").cast("timestamp"))
    path = scratch_path(spark, "stream-in")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    out = scratch_path(spark, "stream-clean")
    q = (clean_stream(dedupe_stream(stream, ["Description"], "t"), out_col="clean")
         .writeStream.format("parquet").option("path", out).outputMode("append")
         .option("checkpointLocation", scratch_path(spark, "stream-clean-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted((r.Description, r.clean) for r in spark.read.parquet(out).collect())
    want = sorted({(r.Description, r.c) for r in
                   rows.select("Description", clean_text("Description").alias("c")).collect()})
    assert got == want and len(got) == 2

"""Label encoding, vocabulary, ids, padding, decoding, global rank."""

from pyspark.sql import functions as F

from ledgerlens.operators import encode
from ledgerlens.operators.rank import global_rank
from ledgerlens.taxonomy import MODEL_TAXONOMY, SUMMARY_TAXONOMY, distinct_subs, taxonomy_rows


def test_taxonomy_shapes():
    assert len(MODEL_TAXONOMY) == 13
    assert len(taxonomy_rows(MODEL_TAXONOMY)) == 61
    assert len(distinct_subs(MODEL_TAXONOMY)) == 58
    assert len(taxonomy_rows(SUMMARY_TAXONOMY)) == 62


def test_category_index(spark):
    cls = encode.class_table(spark, MODEL_TAXONOMY.keys())
    got = {r.class_name: r.class_idx for r in cls.collect()}
    assert got == {"Auto": 0, "Baby": 1, "Clothes": 2, "Electronics": 3, "Entertainment": 4,
                   "Food": 5, "Home": 6, "Kids": 7, "Medical": 8, "Personal_Care": 9,
                   "Pets": 10, "Subscriptions_Memberships": 11, "Travel": 12}


def test_one_hot_round_trip_and_unknown(spark):
    cls = encode.class_table(spark, MODEL_TAXONOMY.keys())
    df = spark.createDataFrame([("Food",), ("Utilities",), (None,)], "Category string")
    out = encode.encode_labels(df, "Category", cls, idx_col="idx", vec_col="vec", k=13)
    rows = {r.Category: r for r in out.withColumn("back", encode.argmax_index("vec")).collect()}
    assert rows["Food"].idx == 5 and rows["Food"].back == 5 and sum(rows["Food"].vec) == 1.0
    assert rows["Utilities"].idx is None and rows["Utilities"].vec is None
    assert out.count() == 3


def test_vocab_ids_pad_decode(spark):
    df = spark.createDataFrame(
        [(1, ["b", "a", "b"]), (2, ["c"]), (3, []), (4, None)], "k int, toks array<string>")
    vocab = encode.build_vocab(df.select(F.explode("toks").alias("token")))
    assert {(r.token, r.token_id, r["count"]) for r in vocab.collect()} == {
        ("b", 101, 2), ("a", 102, 1), ("c", 103, 1)}
    other = spark.createDataFrame([(9, ["a", "zzz"])], "k int, toks array<string>")
    ids = {r.k: r.token_ids for r in encode.token_ids(df.unionByName(other), "k", "toks", vocab).collect()}
    assert ids == {1: [101, 102, 101], 2: [103], 3: [], 4: None, 9: [102, 100]}
    padded = spark.createDataFrame([([1, 2, 3],), ([],)], "ids array<int>") \
        .select(encode.pad_ids("ids", 2).alias("p2"), encode.pad_ids("ids", 5).alias("p5")).collect()
    assert [r.p2 for r in padded] == [[1, 2], [0, 0]]
    assert [r.p5 for r in padded] == [[1, 2, 3, 0, 0], [0, 0, 0, 0, 0]]
    dec = spark.createDataFrame([(1, [101, 100, 0, 0]), (2, [0])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in encode.decode_ids(dec, "k", "ids", vocab).collect()}
    assert got == {1: "b [UNK]", 2: ""}


def test_global_rank_matches_row_number(spark):
    df = spark.range(0, 5000, numPartitions=7).select(
        (F.col("id") * 7919 % 5000).alias("x"), F.col("id"))
    ranked = global_rank(df, [F.col("x"), F.col("id")], "r")
    got = {r.id: r.r for r in ranked.collect()}
    want = {r.id: i + 1 for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.x, r.id)))}
    assert got == want


def test_ids_of_whole_rows_by_blocks(spark, monkeypatch):
    """Rows of many blocks against a vocabulary of any size: null and empty rows, null
    and unknown tokens, pads; no token travels with a row's key."""
    from ledgerlens.operators import blocks
    rng = __import__("random").Random(3)
    rows = [(k, None if k % 31 == 0 else
             [rng.choice(["a", "b", "ß", "long word", "", None, f"w{rng.randrange(300)}"])
              for _ in range(rng.randrange(12))]) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, toks array<string>").repartition(3, "k")
    words = sorted({t for _, ts in rows for t in ts or [] if t is not None and t[-1:] != "7"})
    table = [(t, 101 + i, 1) for i, t in enumerate(words)]
    vocab = spark.createDataFrame(table, "token string, token_id bigint, count bigint")
    for size in (1, 40, blocks.BLOCK_ITEMS):
        monkeypatch.setattr(blocks.blocks_of, "__defaults__", (size,))
        monkeypatch.setattr(blocks.look_up, "__defaults__", (size,))
        ids = encode.token_ids(df, "k", "toks", vocab)
        assert "Exchange hashpartitioning(k" not in \
            ids._jdf.queryExecution().executedPlan().toString()
        of = {t: i for t, i, _ in table}
        want = {k: None if ts is None else [of.get(t, encode.UNKNOWN_ID) for t in ts]
                for k, ts in rows}
        assert {r.k: r.token_ids for r in ids.collect()} == want
    padded = ids.withColumn("token_ids", F.concat("token_ids", F.array(F.lit(0), F.lit(99999))))
    back = {i: t for t, i, _ in table}
    got = {r.k: r.decoded for r in encode.decode_ids(padded, "k", "token_ids", vocab).collect()}
    assert got == {k: None if x is None else " ".join([back.get(i, "[UNK]") for i in x] + ["[UNK]"])
                   for k, x in want.items()}

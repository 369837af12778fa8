"""Plan shape at scale: hot keys, pushdown, no single-partition windows over
data, bounded broadcasts."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions.text import clean_tokens
from ledgerlens.operators import naive_bayes as nb
from ledgerlens.operators import summary
from ledgerlens.operators.dedupe import dedupe_first
from ledgerlens.plans.catalog import all_queries
from ledgerlens.taxonomy import SUMMARY_TAXONOMY

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _run_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return _plan(df)


def test_hot_key_dedupe_is_partially_aggregated(spark):
    # one key holds a third of all rows
    df = spark.range(0, 30000, numPartitions=6).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.lit("x").alias("v"))
    out = dedupe_first(df, ["k"], "id")
    plan = _plan(out)
    assert "partial_min" in plan and "Window" not in plan
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    rows = {r.k: r.id for r in out.collect()}
    assert rows["hot"] == 0 and len(rows) == 20001


def test_hot_category_tree_single_scan(spark):
    rows = [("d", "Food", "Groceries", 1.0, dt.date(2023, 9, 1))] * 3000 + \
           [("d", "Home", "Rent", 2.0, dt.date(2023, 9, 2))] * 10
    led = spark.createDataFrame(
        rows, "Description string, Category string, Sub_category string, Price double, Date date")
    tree = summary.spend_tree(led, SUMMARY_TAXONOMY, dt.date(2023, 9, 15), "month")
    plan = _run_plan(tree)
    assert "partial_sum" in plan
    got = {(r.parent, r.label): float(r.value) for r in tree.collect()}
    assert got[("", "Food")] == 3000.0 and got[("Food", "Groceries")] == 3000.0


def test_period_filter_and_columns_reach_the_scan(spark):
    df = all_queries()["spend_tree_ytd"].run(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    assert "In(p_type" in plan
    assert "l_tax" not in plan and "l_quantity" not in plan


def test_scoring_is_one_aggregation_and_bounded_broadcast(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toks = docs.select("doc_id", "lang", clean_tokens("text").alias("tokens"))
    model = nb.fit(toks, "lang", "tokens")
    k = len(model.class_params())
    assert model.vocab_size * (k + 1) <= nb.BROADCAST_CELLS
    plan = _run_plan(nb.score(model, toks, "doc_id", "tokens"))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan
    # one weight column per class: no per-class CASE WHEN over joined rows
    assert "CASE WHEN" not in plan
    # above the bound the token table is not hinted for broadcast
    side = nb._token_side(model, k, broadcast_cells=0)
    assert "ResolvedHint" not in side._jdf.queryExecution().analyzed().toString()


def test_no_generate_filter_reevaluating_cleaning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toks = docs.select("doc_id", clean_tokens("text").alias("tokens"))
    from ledgerlens.functions.arrays import explode_elements
    plan = _plan(explode_elements(toks, ["doc_id"], "tokens", "token"))
    assert plan.count("regexp_extract_all") == 1


def test_two_heads_shuffle_the_documents_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toks = docs.select("doc_id", "lang", "source", clean_tokens("text").alias("tokens"))
    models = {"cat": nb.fit(toks, "lang", "tokens"), "sub": nb.fit(toks, "source", "tokens")}
    plan = _run_plan(nb.score_heads(models, toks, "doc_id", "tokens", carry=["lang"]))
    # the only exchange on the document side is the one keyed by the row key;
    # the others are the model-sized outer join of the dense tables on token
    assert plan.count("Exchange hashpartitioning(doc_id") == 1
    assert plan.count("BroadcastHashJoin") == 1


def test_exact_split_flags_without_a_shuffle(spark):
    from ledgerlens.operators.split import train_test_split
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name")
    flagged = train_test_split(part, "p_partkey", exact=True)
    plan = _run_plan(flagged)
    assert "Exchange" not in plan and "Sort" not in plan
    assert flagged.filter("is_test").count() == -(-33 * part.count() // 100)


def test_heads_are_fitted_from_one_pass(spark):
    """The training rows are exploded once for any number of heads."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = docs.select("doc_id", "lang", "source", clean_tokens("text").alias("tokens"))
    rows = rows.mapInArrow(count, rows.schema)
    models = nb.fit_heads(rows, {"a": "lang", "b": "source"}, "tokens")
    assert seen.value == docs.count()
    for head, label in (("a", "lang"), ("b", "source")):
        alone = nb.fit(rows, label, "tokens")
        assert sorted(map(tuple, alone.classes.collect())) == \
            sorted(map(tuple, models[head].classes.collect()))

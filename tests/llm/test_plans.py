"""Plans of the operators that work in blocks."""

import random

from ledgerlens.llm import decontaminate
from small_texts import sentence


def test_many_blocks_are_one_python_step(spark, docs):
    rng = random.Random(4)
    items = [(i, sentence(rng, 30)) for i in range(60)]
    rows = [(i, sentence(rng, 20) + " " + rng.choice(items)[1]) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    few = decontaminate.contamination(docs(rows), bench)
    assert len(decontaminate.automata(bench, block_words=60)) >= 20
    many = decontaminate.contamination(docs(rows), bench, block_words=60)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan

    def result(df):
        return sorted((r.doc_id, r.n_hit, tuple(r.item_ids), bytes(r.mask)) for r in df.collect())
    assert result(many) == result(few)

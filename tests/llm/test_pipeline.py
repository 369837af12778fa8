"""The pipeline's stages against brute force on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import quality

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_order_and_columns(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "near-duplicates",
                     "benchmark decontamination", "packing"]
    for out in stages[1:-1]:
        assert out.columns == stages[0].columns
    counts = [s.count() for s in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_quality_keeps_the_good(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages[1].select("doc_id").withColumn("kept", F.lit(True))
    rows = stages[0].join(labels, "doc_id").join(kept, "doc_id", "left").collect()
    good = [r for r in rows if r.quality == 1]
    junk = [r for r in rows if r.quality == 0]
    assert sum(bool(r.kept) for r in good) >= 0.98 * len(good)
    assert sum(bool(r.kept) for r in junk) <= 0.2 * len(junk)
    assert quality.KEEP == 0.3


def test_lines_leave_no_repeat(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    after = {r.doc_id: r.text for r in stages[2].collect()}
    seen, gone = set(), {i: set() for i in before}
    for i in sorted(before):
        t = before[i].split("\n")
        n = [max(1, len(x.strip(" ").split(" "))) for x in t]
        for p in range(len(t)):
            total = 0
            for q in range(p, len(t)):
                total += n[q]
                if total >= 50:
                    run = tuple(t[p:q + 1])
                    if run in seen:
                        gone[i].update(range(p, q + 1))
                    seen.add(run)
        want = "\n".join(x for p, x in enumerate(t) if p not in gone[i])
        assert after.get(i, "").strip() == want.strip()
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_one_of_each_group_stays(stages):
    rows = {r.doc_id: r.text for r in stages[2].collect()}
    kept = {r.doc_id for r in stages[3].collect()}
    sets = {}
    for i, text in rows.items():
        w = text.translate(FOLD).split()
        n = min(5, len(w))
        sets[i] = frozenset(tuple(w[p:p + n]) for p in range(len(w) - n + 1)) if w else frozenset()
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                name[q] = p
    assert kept == {i for i in ids if root(i) == i}


def test_no_benchmark_window_is_left(spark, stages):
    import re
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(r.text.translate(FOLD))
        n = min(10, len(w))
        windows |= {tuple(w[p:p + n]) for p in range(len(w) - n + 1)} if w else set()
    before = {r.doc_id: word.findall(r.text.translate(FOLD)) for r in stages[3].collect()}
    after = {r.doc_id: word.findall(r.text.translate(FOLD)) for r in stages[4].collect()}
    for i, w in before.items():
        hit = set()
        for p in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[p:p + n]) in windows:
                    hit.update(range(p, p + n))
        if len(hit) > 0.5 * len(w):
            assert i not in after
        else:
            assert after[i] == [x for p, x in enumerate(w) if p not in hit]


def test_packing_covers_all_that_is_left(stages):
    pieces = stages[5]
    docs = stages[4].count()
    assert pieces.where("start = 0").count() == docs
    sums = pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert all(r.n == r.doc_tokens for r in sums)


def test_tables_of_finished_stages_go(spark, stages):
    import os
    from urllib.parse import urlparse

    from ledgerlens.session import checkpoint_dir, scratch_scope
    folder = urlparse(checkpoint_dir(spark)).path + "/scratch"
    before = set(os.listdir(folder))
    with scratch_scope() as made:
        out = corpus_pipeline.run(spark, SF)
    assert out.count() == stages[5].count()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left == {"stage-3"} and len(made) > 10

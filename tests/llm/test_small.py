"""Every operator and stage on odd rows, repeated rows, clashing columns and
empty tables."""

import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from small_texts import EDGES

from ledgerlens.llm import (decontaminate, exact, hmm, html_text, langid, lexical, lines, minhash,
                            packing, quality, queries, records, resample, substrings)

BENCH = "item_id long, text string"


def bench(spark, rows=((1, "two words"), (None, "no id here"), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), BENCH)


def run_all(spark, docs):
    """Rows of every operator by name."""
    labels = spark.createDataFrame([(4, 1), (6, 0), (6, None), (None, 1)],
                                   "doc_id long, quality int")
    out = {
        "contamination": decontaminate.contamination(docs, bench(spark)),
        "decontaminate": decontaminate.decontaminate(docs, bench(spark)),
        "exact": exact.exact_dedup(docs),
        "lines": lines.dedup_lines(docs, report="the_report"),
        "near": minhash.near_duplicates(docs),
        "substrings": substrings.remove_repeats(docs),
        "quality": quality.score(docs, quality.fit(docs, labels), name="the_score"),
        "langid": langid.identify(docs, langid.fit(docs.select("lang", "text"))),
        "records": records.read_records(records.write_records(
            docs, queries.tokenizer_path(queries.WORD_BPE))),
        "html": html_text.extract_text(docs, "text", ("doc_id",)),
        "hmm": hmm.language_scores(docs, F.col("doc_id") != 5),
        "resample": resample.importance_resample(docs, bench(spark)),
        "packing": packing.pack(docs, queries.tokenizer_path(queries.BYTE_BPE)),
    }
    return {name: df.collect() for name, df in out.items()}


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows_give_one_result_each(spark, docs, extra):
    df = docs(EDGES, extra)
    for name, rows in run_all(spark, df).items():
        if name == "packing":
            pieces = sorted((r.doc_id is None, r.doc_id or 0) for r in rows if r.start == 0)
            assert len(pieces) == len(EDGES)
        else:
            ids = sorted(((r.doc_id is None, r.doc_id or 0) for r in rows))
            want = sorted((i is None, i or 0) for i, _ in EDGES)
            if name == "decontaminate":      # two texts are benchmark items whole
                want = [w for w in want if w != (True, 0)] + [(True, 0)]
                want.remove((False, 4))
            assert ids == want, name


def test_empty_tables(spark, docs):
    for name, rows in run_all(spark, docs([])).items():
        assert rows == [], name


def test_no_benchmark_no_labels(spark, docs):
    df = docs(EDGES)
    none = spark.createDataFrame([], BENCH)
    assert decontaminate.contamination(df, none).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(df, none).count() == len(EDGES)
    assert quality.fit(df, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert {r.score for r in quality.score(df, None).collect()} == {0.5}
    model = langid.fit(df.where("false").select("lang", "text"))
    assert model is None
    assert {(r.lang_pred, r.score) for r in langid.identify(df, model).collect()} == {("und", 0.0)}


@pytest.mark.parametrize("rows", [[], EDGES])
def test_stages_on_odd_rows(spark, docs, tmp_path, rows):
    spark.createDataFrame([(4, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    df = docs(rows, extra=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert [t for _, t in out.dtypes] == [t for _, t in df.dtypes], name
        assert out.count() <= len(rows)
    last = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))
    assert last.where("start = 0").count() == len(rows)


def test_odd_texts_have_the_stated_results(spark, docs):
    df = docs(EDGES)
    by = {}
    for r in decontaminate.contamination(df, bench(spark)).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.n_words, r.n_hit) for r in by[1]] == [(0, 0)]
    assert [r.item_ids for r in by[4] if r.n_hit] == [["1"]]
    assert sorted(r.n_hit for r in by[None]) == [0, 3]
    groups = exact.exact_dedup(df).collect()
    empty = [r for r in groups if r.doc_id in (1, 2, 3, 8)]
    # the null-id row without text is in the group too; most code points stay
    assert {(r.keep_id, r.group_size) for r in empty} == {(8, 5)}
    near = {r.doc_id: r for r in minhash.near_duplicates(df).where("doc_id is not null").collect()}
    assert near[1].n_shingles == near[2].n_shingles == near[3].n_shingles == 0
    assert near[1].kept and near[2].kept and near[3].kept
    assert lines.dedup_lines(docs([(1, None), (2, "")])).where("text is null").count() == 1
    langs = langid.identify(df, langid.fit(df.select("lang", "text"))).collect()
    assert {r.lang_pred for r in langs if r.doc_id in (1, 2, 3, 8)} == {"und"}
    assert all(0 <= r.score <= 1 for r in langs)


def test_ids_of_any_type(spark):
    """Text ids, and the largest number, which is not null."""
    top = 2 ** 63 - 1
    rows = [("b", "x y"), ("a", "xy"), (None, "x y"), ("c", "other"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for history in (F.lit(True), F.lit(False), F.col("doc_id") == "b", None):
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept)
               for r in exact.exact_dedup(df, history).collect()}
        assert got == {("b", "b", 3, True), ("a", "b", 3, False), (None, "b", 3, False),
                       ("c", "c", 1, True), (None, None, 1, True)}
    numbers = spark.createDataFrame([(top, "same"), (None, "same"), (None, "alone")],
                                    "doc_id long, text string")
    for history in (F.lit(True), F.lit(False), F.col("doc_id").isNull(), None):
        got = {(r.doc_id, r.keep_id) for r in exact.exact_dedup(numbers, history).collect()}
        assert got == {(top, top), (None, top), (None, None)}
    path = queries.tokenizer_path(queries.WORD_BPE)
    back = records.read_records(records.write_records(df, path), id_type="string").collect()
    in_order = [r.doc_id for r in sorted(back, key=lambda r: r.start)]
    assert in_order == [None, None, "a", "b", "c"]
    wide = records.read_records(records.write_records(numbers, path)).collect()
    assert sorted((r.doc_id or 0) for r in wide) == [0, 0, top]


def test_digests_that_share_64_bits():
    import numpy as np
    digests = np.zeros((5, 32), np.uint8)
    digests[:, 8] = range(5)            # equal first 64 bits
    digests[4, 0] = 1
    numbers = np.arange(5)
    index = exact.DigestIndex(digests, numbers, numbers * 10, numbers + 1)
    slots = index.find(digests)
    assert sorted(slots.tolist()) == list(range(5))
    assert index.ids[slots].tolist() == [0, 10, 20, 30, 40]
    other = digests.copy()
    other[:, 31] = 9
    assert index.find(other).tolist() == [-1] * 5


def test_a_worker_loads_one_tokenizer_and_encodes_small_batches(monkeypatch):
    """Tasks of one worker share a coder; texts are encoded in batches of a few MB."""
    import pyarrow as pa
    from ledgerlens.llm import tokens
    path = queries.tokenizer_path(queries.WORD_BPE)
    coder = tokens.token_coder(path, False)
    assert tokens.token_coder(path, False) is coder
    monkeypatch.setattr(tokens, "BATCH_TEXT", 1000)
    rows = pa.RecordBatch.from_pydict({"i": list(range(50)), "text": ["a few words " * 20] * 50})
    parts = list(tokens.encoded_batches(coder, [rows], 1))
    assert len(parts) > 5 and [i for b, _ in parts for i in b.column(0).to_pylist()] == list(range(50))
    assert [x for _, ids in parts for x in ids] == coder.encode(rows.column(1))


def peak_of(step):
    import tracemalloc
    tracemalloc.start()
    try:
        out = step()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_anchors_hold_a_block_of_a_text():
    """Working memory for the anchors of a text does not grow with it (here 6 MB; over
    a hundred bytes for each of its bytes before)."""
    import numpy as np
    text = np.random.default_rng(3).integers(0, 256, 6 << 20, np.uint8).tobytes()
    finder = substrings.Anchors(400, 32)
    (own, _, first, last, at), peak = peak_of(lambda: finder.find([text]))
    assert peak < 32 << 20
    # every start in one stretch, its anchor inside all strings of the stretch
    assert not own.any() and first[0] == 0 and last[-1] == len(text) - 400
    assert (first[1:] == last[:-1] + 1).all() and (at[1:] != at[:-1]).all()
    assert (last <= at).all() and (at + 32 <= first + 400).all()


@pytest.mark.parametrize("size", [1, 7, 64, 100])
def test_anchors_do_not_depend_on_blocks(monkeypatch, size):
    import random
    rng = random.Random(size)
    texts = [bytes(rng.choices(b"ab" if k % 2 else b"abcdefgh", k=rng.choice(
        (0, 39, 40, 41, 150, 600)))) for k in range(20)] + [b"x" * 300]
    want = [c.tolist() for c in substrings.Anchors(40, 8).find(texts)]
    monkeypatch.setattr(substrings, "_BLOCK", size)
    assert [c.tolist() for c in substrings.Anchors(40, 8).find(texts)] == want
    assert [c.tolist() for c in substrings.Anchors(40, 8).find([b"", b"short"])] == [[]] * 5


def test_contexts_and_cuts_take_little_memory():
    import pyarrow as pa
    import random
    rng = random.Random(5)
    bodies = [rng.randbytes(768) for _ in range(1000)]
    _, peak = peak_of(lambda: substrings.Contexts(bodies, [368] * 1000, 400))
    assert peak < 12 << 20              # 8 bytes a position; 40 before
    text = rng.randbytes(200_000)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("fp", "c1", "c2")]
                              + [(c, pa.int32()) for c in ("lo", "hi", "pos")]))
    wanted = [[dict(fp=i, c1=-i, c2=7, lo=i, hi=i + 3, pos=i + 2) for i in range(k, k + n)]
              for k, n in ((0, 5), (5, 20_000), (9, 1))]
    rows = pa.RecordBatch.from_arrays([pa.array([text] * 3, pa.binary()),
                                       pa.array(wanted, kind)], names=["_text", "w"])
    parts = list(substrings._cut(400)([rows.slice(1)]))
    assert max(p.num_rows for p in parts) <= substrings._ROWS
    got = pa.Table.from_batches(parts).to_pylist()
    assert got == [dict(fp=w["fp"], c1=w["c1"], c2=w["c2"], at=2,
                        body=text[w["lo"]:w["hi"] + 400]) for ws in wanted[1:] for w in ws]

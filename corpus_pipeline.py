"""A training-data pipeline of five operators over ``documents``.

``STAGES`` are applied in order, each to all that the one before kept, written
as Parquet in between.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, lines, minhash, packing, quality
from ledgerlens.llm.common import bound_batches, free_name, read_table, shared_table
from ledgerlens.llm.queries import BYTE_BPE, tokenizer_path
from ledgerlens.session import drop_paths, scratch_scope


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores as good, learned from ``labels``."""
    field = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    name = free_name(docs, "_score")
    scored = quality.score(docs, field, name=name)
    return scored.where(F.col(name) >= quality.KEEP).drop(name)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages deleted; documents that lost all words go."""
    bound_batches(spark)
    report = free_name(docs, "_report")
    done = lines.dedup_lines(docs, report=report)
    lost = (F.col(f"{report}.n_removed") > 0) & (F.trim(F.col("text")) == "")
    return _measured(done.where(~F.coalesce(lost, F.lit(False))).drop(report))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, 0.8)."""
    bound_batches(spark)
    found = minhash.near_duplicates(docs)
    gone = found.where("not kept").select(F.col("doc_id").alias("_id"), "_row").distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"])
                     & (F.xxhash64(docs["text"]) == gone["_row"]), "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; mostly contaminated documents go."""
    return _measured(decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    bound_batches(spark)
    return packing.pack(docs, tokenizer_path(BYTE_BPE)).drop("ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

# the classifier's score and the tokenizer are not SQL; the stages are tested
# against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  Once a stage is written, the tables it was made
    from are deleted, so that no more than one stage's lie on the shared storage."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        with scratch_scope() as made:
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = shared_table(docs, f"stage-{i}")
        if i < len(STAGES) - 1:
            drop_paths(spark, [*before, *made[:-1]])
            before = made[-1:]
    return docs

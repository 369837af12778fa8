"""The thin ``opN_<name>`` queries: each applies one operator, with production
parameters, to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (decontaminate, exact, hmm, html_text, langid, lexical, lines, minhash,
                            packing, quality, records, resample, substrings)
from ledgerlens.llm.common import read_table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"),
                                        read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))
    return pieces.drop("ids")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=2).drop("_row")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    field = quality.fit(docs, labels)
    scored = quality.score(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
                         .alias("held_out"), "score",
                         (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "_report.n_lines", "_report.n_removed",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write_records(read_table(spark, sf_dir, "documents"),
                                     tokenizer_path(WORD_BPE))
    return records.read_records(manifest)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(read_table(spark, sf_dir, "documents"), with_kept=False)
    return done.select("doc_id", "n_bytes", "n_removed",
                       F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rest = fold("doc_id", 4)
    model = langid.fit(docs.where(rest != 2).select("lang", "text"))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "cross_entropy", "rejected")


def op11_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    found = hmm.language_scores(docs, ~held_out)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"),
                          read_table(spark, sf_dir, "benchmark"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.importance_resample(read_table(spark, sf_dir, "documents"),
                                         read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_decontaminate, op2_packing, op3_minhash, op4_exact_dedup, op5_quality, op6_html,
        op7_lines, op8_records, op9_suffix, op10_langid, op11_hmm, op12_search, op13_resample)}


def llm_sql() -> dict[str, str]:
    from ledgerlens.llm.sql import SQL
    return dict(SQL)

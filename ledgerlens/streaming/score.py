"""Cleaning and scoring on streaming ledgers.

Cleaning is a stateless per-row expression, so it applies to a streaming
DataFrame unchanged.  Keep-first de-duplication needs state: on a stream it
is ``dropDuplicatesWithinWatermark`` over an event-time column.  Scoring
aggregates per row key, so it runs per micro-batch through ``foreachBatch``
against a model whose tables sit on shared storage (exactly-once with an
idempotent, batch-id-named sink folder).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean_text, clean_tokens
from ..operators import naive_bayes as nb


def clean_stream(stream: DataFrame, text_col: str = "Description",
                 out_col: str | None = None) -> DataFrame:
    return stream.withColumn(out_col or text_col, clean_text(text_col))


def dedupe_stream(stream: DataFrame, keys: Sequence[str], event_time: str,
                  delay: str = "1 hour") -> DataFrame:
    """Keep the first arrival per key among events within the watermark delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def score_batches(model: nb.NaiveBayesModel | Mapping[str, nb.NaiveBayesModel], key: str,
                  text_col: str,
                  sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: clean, score, hand the predictions to
    ``sink(predictions, batch_id)``: ``(key, pred_label)`` for one model, or
    ``(key, {head}_pred_label, ...)`` for a mapping of heads, all scored in
    one pass.  The models' class parameters and dense tables are read once
    and reused by every micro-batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(key, clean_tokens(text_col).alias("_tokens"))
        if isinstance(model, Mapping):
            preds = nb.score_heads(model, rows, key, "_tokens").select(
                key, *[f"{h}_pred_label" for h in model])
        else:
            preds = nb.score(model, rows, key, "_tokens").select(key, "pred_label")
        sink(preds, batch_id)
    return run


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Idempotent sink: each micro-batch overwrites its own folder."""
    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return sink


def score_stream(model: nb.NaiveBayesModel | Mapping[str, nb.NaiveBayesModel],
                 stream: DataFrame, key: str, text_col: str,
                 sink: Callable[[DataFrame, int], None], checkpoint: str,
                 available_now: bool = False) -> StreamingQuery:
    writer = (stream.writeStream.foreachBatch(score_batches(model, key, text_col, sink))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()

"""Class weights and validation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .split import BATCH_SIZE

METRIC = "decimal(18,6)"


def fixed6(x):
    """A metric rounded to 6 places as an exact decimal (stable to compare
    and hash across engines, unlike a rounded double)."""
    return F.round(x, 6).cast(METRIC)


def class_weights(labels: DataFrame, label_col: str, classes: DataFrame) -> DataFrame:
    """``(class_name, class_idx, n, weight)`` for every class, observed or
    not: ``weight = (N + K) / (n + 1)`` with N the rows whose label is a known
    class and K the number of classes.  Labels outside the class table are
    not counted, so what is counted and broadcast is bounded by the class
    table (whose size is checked where it is made)."""
    known = labels.select(F.col(label_col).alias("class_name")).join(
        F.broadcast(classes.select("class_name")), "class_name", "left_semi")
    counts = known.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    per_class = (classes.join(F.broadcast(counts), "class_name", "left")
                 .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))
    everything = Window.partitionBy()
    return per_class.select(
        "class_name", F.col("class_idx").cast("int").alias("class_idx"), "n",
        fixed6((F.sum("n").over(everything) + F.count(F.lit(1)).over(everything))
               / (F.col("n") + 1)).alias("weight"))


def accuracy_and_loss(scored: DataFrame, *, label_idx: str, pred_idx: str,
                      log_p_true: str, batch_size: int = BATCH_SIZE) -> DataFrame:
    """``n, accuracy, loss``: accuracy = correct / n; loss = summed
    cross-entropy ``-ln p(true class)`` divided by the number of mini-batches
    ``ceil(n / batch_size)``."""
    n = F.count(F.lit(1))
    return scored.agg(
        n.cast("bigint").alias("n"),
        fixed6(F.avg((F.col(pred_idx) == F.col(label_idx)).cast("double"))).alias("accuracy"),
        fixed6(F.sum(-F.col(log_p_true)) / F.ceil(n / batch_size)).alias("loss"))


def head_metrics(scored: DataFrame, heads: dict[str, tuple[str, str, str]], *,
                 batch_size: int = BATCH_SIZE, split: str | None = None) -> DataFrame:
    """``(head, n, accuracy, loss)`` for several heads in ONE aggregate, with
    ``split`` for each value of that column.
    ``heads`` maps a head name to its ``(label_idx, pred_idx, log_p_true)``
    columns; a row counts for a head only where its ``label_idx`` is set
    (the true label is a class of that head).  Same formulas as
    ``accuracy_and_loss``."""
    aggs = []
    for h, (label_idx, pred_idx, log_p_true) in heads.items():
        known = F.col(label_idx).isNotNull()
        n = F.count(F.when(known, 1))
        aggs += [n.cast("bigint").alias(f"{h}__n"),
                 fixed6(F.avg(F.when(known, (F.col(pred_idx) == F.col(label_idx))
                                     .cast("double")))).alias(f"{h}__accuracy"),
                 fixed6(F.sum(F.when(known, -F.col(log_p_true))) / F.ceil(n / batch_size))
                 .alias(f"{h}__loss")]
    by = [split] if split else []
    wide = scored.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(h).alias("head"), F.col(f"{h}__n").alias("n"),
                              F.col(f"{h}__accuracy").alias("accuracy"),
                              F.col(f"{h}__loss").alias("loss")) for h in heads])
    return wide.select(*by, F.inline(rows))

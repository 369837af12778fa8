"""An iterative learner with history: mini-batch softmax regression.

Features of a row are its hashed token counts divided by its number of tokens,
and a constant.  An epoch takes the training rows in ``batches`` hash slices; each
slice is one synchronous step: the partitions compute the gradient of their rows,
Spark adds them up per bucket, and the driver updates the (buckets x classes)
weights by Adam with decoupled weight decay.  After an epoch the validation rows
are scored with the new weights, and four metrics are kept: training loss and
accuracy (of the forward passes of the epoch's steps), validation loss and
accuracy.  Losses are summed cross-entropies over the number of mini-batches of 64.

The learning rate is halved after more than ``flat_epochs`` epochs without a better
validation loss, and training ends early after ``patience`` of them.  Each epoch's
state (weights, moments, rates, history) is committed as one version, so a job
that dies goes on from the last whole epoch, with the same result.

Scale: features are computed once into a table partitioned by slice, so a step
reads its own rows alone.  A task sends one row per bucket it has seen, added up
before the shuffle; weights are bounded by ``MAX_PARAMS`` numbers and broadcast
once a step.  No step depends on the number of rows in one task.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.versions import committed, publish
from .batch import MAX_PARAMS, bucket_ids
from .encode import MAX_CLASSES
from .split import BATCH_SIZE

BUCKETS = 1 << 14
METRICS = ("train_loss", "train_acc", "val_loss", "val_acc")


@dataclass(frozen=True)
class Plan:
    """Settings of a training run."""
    epochs: int = 10
    batches: int = 4              # steps of an epoch
    buckets: int = BUCKETS
    rate: float = 0.3
    decay: float = 0.01           # decoupled weight decay
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    flat_epochs: int = 2          # epochs without a better loss before the rate is halved
    patience: int = 5             # ... and before training ends
    better: float = 1e-4          # relative gain that counts as better for the rate


@dataclass
class State:
    """All that one epoch hands to the next."""
    weights: np.ndarray           # (1 + buckets) x classes; row 0 belongs to the constant
    first: np.ndarray             # moments of Adam
    second: np.ndarray
    labels: list[str]
    rate: float
    steps: int = 0
    epoch: int = 0
    best: float = float("inf")    # validation loss: for early stopping
    waited: int = 0
    rate_best: float = float("inf")   # for the rate
    rate_waited: int = 0
    stopped: bool = False
    history: list[tuple] = field(default_factory=list)    # (epoch, metric, value)

    def numbers(self) -> dict:
        return {k: getattr(self, k) for k in (
            "labels", "rate", "steps", "epoch", "best", "waited", "rate_best", "rate_waited",
            "stopped", "history")}


# features --------------------------------------------------------------------

def feature_table(rows: DataFrame, key: str, label_col: str, tokens_col: str, test_col: str,
                  labels: Sequence[str], plan: Plan) -> DataFrame:
    """Table of ``key, label (index), ids (buckets of the tokens), slice``.
    Validation rows are slice -1; rows of no known label are left out."""
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label_col)) - 1
    tokens = F.coalesce(F.col(tokens_col), F.array().cast("array<string>"))
    part = F.when(F.col(test_col), F.lit(-1)).otherwise(
        F.pmod(F.xxhash64(F.col(key)), F.lit(plan.batches)).cast("int"))
    out = rows.select(key, index.cast("int").alias("label"),
                      bucket_ids(tokens, plan.buckets).alias("ids"),
                      part.alias("slice")).where("label >= 0")
    path = scratch_path(rows.sparkSession, "softmax-features")
    out.write.partitionBy("slice").parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)


def _logits(weights: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows x classes: the mean weight of a row's buckets, and the constant's."""
    n = len(ends) - 1
    out = np.zeros((n, weights.shape[1]))
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        out[some] = np.add.reduceat(weights[flat], ends[:-1][some], axis=0) \
            / np.diff(ends)[some, None]
    return out + weights[0]


def _forward(weights, batch):
    """(log-probabilities, labels, flat buckets, row ends, rightly labelled)."""
    label = batch.column(0).to_numpy()
    ids = batch.column(1)
    at = ids.offsets.to_numpy().astype(np.int64)
    flat, ends = ids.flatten().to_numpy(), at - at[0]
    logits = _logits(weights, flat, ends)
    top = logits.max(axis=1, keepdims=True)
    logp = logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))
    # the lowest index wins ties, after rounding
    right = np.round(logits, 9).argmax(axis=1) == label
    return logp, label, flat, ends, right


def _sums(rows: DataFrame, weights: np.ndarray, gradient: bool) -> tuple[np.ndarray, tuple]:
    """Gradient of the summed loss (empty unless wanted) and (rows, loss, right)."""
    classes = weights.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    names = [f"g{c}" for c in range(classes)]

    def step(batches):
        w = shared.value
        total = np.zeros_like(w) if gradient else None
        n = loss = hits = 0
        for batch in batches:
            logp, label, flat, ends, right = _forward(w, batch)
            n += len(label)
            loss -= float(logp[np.arange(len(label)), label].sum())
            hits += int(right.sum())
            if gradient:
                error = np.exp(logp)
                error[np.arange(len(label)), label] -= 1
                sizes = np.diff(ends)
                owner = np.repeat(np.arange(len(label)), sizes)
                per = error / np.maximum(sizes, 1)[:, None]
                for c in range(classes):
                    total[:, c] += np.bincount(flat, per[owner, c], len(w))
                total[0] += error.sum(axis=0)
        cells, values = [-1], [np.array([n, loss, hits, *[0.0] * max(0, classes - 3)])]
        if gradient:
            some = np.flatnonzero(total.any(axis=1))
            cells += some.tolist()
            values += list(total[some])
        width = max(3, classes)
        table = np.zeros((len(cells), width))
        for i, row in enumerate(values):
            table[i, :len(row)] = row
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int64()), *[pa.array(table[:, c]) for c in range(width)]],
            names=["cell", *wide])

    wide = names + [f"g{c}" for c in range(classes, 3)]
    found = (rows.select("label", "ids")
             .mapInArrow(step, "cell long, " + ", ".join(f"{x} double" for x in wide))
             .groupBy("cell").agg(*[F.sum(x).alias(x) for x in wide]).toArrow())
    shared.destroy()
    cell = found.column("cell").to_numpy()
    values = np.stack([found.column(x).to_numpy() for x in wide], axis=1) if len(cell) else \
        np.zeros((0, len(wide)))
    totals = values[cell == -1].sum(axis=0) if len(cell) else np.zeros(3)
    grad = np.zeros_like(weights)
    grad[cell[cell >= 0]] = values[cell >= 0][:, :classes]
    return grad, (int(totals[0]), float(totals[1]), int(totals[2]))


# training --------------------------------------------------------------------

def _adam(state: State, grad: np.ndarray, plan: Plan) -> None:
    state.steps += 1
    state.first = plan.beta1 * state.first + (1 - plan.beta1) * grad
    state.second = plan.beta2 * state.second + (1 - plan.beta2) * grad ** 2
    m = state.first / (1 - plan.beta1 ** state.steps)
    v = state.second / (1 - plan.beta2 ** state.steps)
    state.weights = state.weights * (1 - state.rate * plan.decay) \
        - state.rate * m / (np.sqrt(v) + plan.eps)


def _metrics(n: int, loss: float, right: int) -> tuple[float, float]:
    return (loss / -(-n // BATCH_SIZE), right / n) if n else (0.0, 0.0)


def _after_epoch(state: State, plan: Plan, train: tuple, val: tuple) -> None:
    """History, learning rate and early stopping."""
    state.epoch += 1
    values = (*_metrics(*train), *_metrics(*val))
    state.history += [(state.epoch, name, float(v)) for name, v in zip(METRICS, values)]
    loss = values[2]
    if loss < state.rate_best * (1 - plan.better):
        state.rate_best, state.rate_waited = loss, 0
    else:
        state.rate_waited += 1
        if state.rate_waited > plan.flat_epochs:
            state.rate, state.rate_waited = state.rate / 2, 0
    if loss < state.best:
        state.best, state.waited = loss, 0
    else:
        state.waited += 1
    state.stopped = state.waited >= plan.patience


def train(rows: DataFrame, key: str, label_col: str, tokens_col: str, test_col: str, *,
          plan: Plan = Plan(), path: str | None = None) -> State:
    """Train on the rows that are not ``test_col``, validate on the others.

    ``path``: commit every epoch's state there, and go on from the last one found
    (same rows and plan); without it nothing is kept."""
    spark = rows.sparkSession
    state = load_state(spark, path) if path else None
    if state is None:
        found = (rows.where(~F.col(test_col)).select(label_col).dropna().distinct()
                 .limit(MAX_CLASSES + 1).collect())
        labels = sorted(r[0] for r in found)
        if len(labels) > MAX_CLASSES or len(labels) * (plan.buckets + 1) > MAX_PARAMS:
            raise ValueError("too many classes for the number of buckets")
        zero = np.zeros((plan.buckets + 1, len(labels)))
        state = State(zero, zero.copy(), zero.copy(), labels, plan.rate)
    if not state.labels or state.stopped or state.epoch >= plan.epochs:
        return state
    table = feature_table(rows, key, label_col, tokens_col, test_col, state.labels, plan)
    while state.epoch < plan.epochs and not state.stopped:
        totals = np.zeros(3)
        for part in range(plan.batches):
            grad, sums = _sums(table.where(F.col("slice") == part), state.weights, True)
            totals += sums
            if sums[0]:
                _adam(state, grad / sums[0], plan)
        n, loss, right = totals
        val = _sums(table.where("slice = -1"), state.weights, False)[1]
        _after_epoch(state, plan, (int(n), loss, int(right)), val)
        if path:
            save_state(spark, state, path)
    return state


def history(spark: SparkSession, state: State) -> DataFrame:
    """``(epoch, metric, value)``."""
    return spark.createDataFrame(state.history, "epoch int, metric string, value double")


def predict(state: State, rows: DataFrame, key: str, tokens_col: str, buckets: int = BUCKETS,
            out_col: str = "pred_label") -> DataFrame:
    """``(key, out_col)`` for every row; without tokens the constant decides."""
    shared = rows.sparkSession.sparkContext.broadcast((state.weights, state.labels))
    ids = bucket_ids(F.coalesce(F.col(tokens_col), F.array().cast("array<string>")), buckets)
    data = rows.select(F.lit(0).alias("label"), ids.alias("ids"), key)

    def step(batches):
        w, labels = shared.value
        for batch in batches:
            at = batch.column(1).offsets.to_numpy().astype(np.int64)
            best = np.round(_logits(w, batch.column(1).flatten().to_numpy(), at - at[0]), 9) \
                .argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array([labels[i] for i in best], pa.string())],
                names=[key, out_col])

    kind = dict(rows.dtypes)[key]
    return data.mapInArrow(step, f"`{key}` {kind}, `{out_col}` string")


# state on shared storage -----------------------------------------------------

def save_state(spark: SparkSession, state: State, path: str) -> None:
    """One committed version: readers see this epoch or the one before, whole."""
    def write(folder: str) -> None:
        arrays = pa.table({"cell": np.arange(len(state.weights)), **{
            name: pa.array(list(getattr(state, name)), pa.list_(pa.float64()))
            for name in ("weights", "first", "second")}})
        spark.createDataFrame(arrays).write.parquet(f"{folder}/arrays")
        spark.createDataFrame([(json.dumps(state.numbers()),)], "state string") \
            .coalesce(1).write.parquet(f"{folder}/numbers")

    publish(spark, path, write)


def load_state(spark: SparkSession, path: str) -> State | None:
    """The last committed epoch; None if there is none."""
    folder = committed(spark, path)
    if folder is None:
        return None
    numbers = json.loads(spark.read.parquet(f"{folder}/numbers").first().state)
    numbers["history"] = [tuple(h) for h in numbers["history"]]
    found = spark.read.parquet(f"{folder}/arrays").orderBy("cell").toArrow()
    arrays = {name: np.array(found.column(name).combine_chunks().flatten().to_numpy(
        zero_copy_only=False)).reshape(found.num_rows, -1)
        for name in ("weights", "first", "second")}
    return State(**arrays, **numbers)

"""Batch inference with a user-supplied model object.

``batch_predict`` runs ``make_predict_fn()`` once per task (so a model is
loaded once, not per row) and feeds it mini-batches of ``batch_size`` rows
sliced from the task's Arrow record batches (``mapInArrow``, zero-copy).  The
callable receives the batch's input column as a ``pyarrow`` array and returns
one prediction per row.  This is the only Python in the scoring path, and
only because the callable is the user's.

``hashed_nb_predict_fn`` is a small ready-made model for it: naive Bayes over
hashed token buckets, trained with Spark aggregations; its parameters are a
K x buckets matrix, bounded by construction and shipped by broadcast.  It
scores a whole mini-batch with array operations (one gather of the flat
token ids, one segmented sum by the list offsets), never row by row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_elements

DEFAULT_BUCKETS = 1 << 16
MAX_PARAMS = 8_000_000      # classes x buckets: the counts the driver holds


def bucket_ids(tokens: str | Column, buckets: int = DEFAULT_BUCKETS) -> Column:
    """Token -> bucket id in ``[1, buckets]`` (0 stays free for padding): the
    first 32 bits of its md5, modulo ``buckets``, so any engine can repeat it."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.transform(t, lambda w: (F.pmod(
        F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)) + 1)
        .cast("int"))


def batch_predict(df: DataFrame, key: str, input_col: str,
                  make_predict_fn: Callable[[], Callable[[pa.Array], np.ndarray]], *,
                  batch_size: int = 64, out_col: str = "prediction",
                  out_type: str = "int") -> DataFrame:
    """``(key, out_col)``: ``predict(inputs)`` applied to every mini-batch of
    ``batch_size`` rows; ``inputs`` is a ``pyarrow`` array of the batch's
    ``input_col`` values."""
    key_type = dict(df.dtypes)[key]
    schema = f"`{key}` {key_type}, `{out_col}` {out_type}"
    arrow_out = pa.int32() if out_type == "int" else None

    def run(batches):
        predict = make_predict_fn()
        for rb in batches:
            inputs = rb.column(input_col)
            preds = [np.asarray(predict(inputs.slice(start, batch_size)))
                     for start in range(0, rb.num_rows, batch_size)]
            if preds:
                yield pa.RecordBatch.from_arrays(
                    [rb.column(key), pa.array(np.concatenate(preds), type=arrow_out)],
                    names=[key, out_col])

    return df.select(key, input_col).mapInArrow(run, schema)


def list_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(flat values, offsets rebased to 0)`` of a (possibly sliced) list
    array; a null list has no values."""
    offsets = arr.offsets.to_numpy().astype(np.int64)
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return flat, offsets - offsets[0]


def segment_sums(weights: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``out[c, r] = sum(weights[c, flat[offsets[r]:offsets[r + 1]]])`` for a
    K x buckets weight matrix -> K x n; empty rows sum to 0.  One vectorised
    pass per class, so memory stays at one value per token of the batch."""
    n = len(offsets) - 1
    out = np.zeros((weights.shape[0], n))
    rows = np.flatnonzero(np.diff(offsets) > 0)
    if rows.size:
        # the starts of the non-empty rows are strictly increasing and each
        # such row's tokens run to the next non-empty start
        starts = offsets[rows]
        for c in range(weights.shape[0]):
            out[c, rows] = np.add.reduceat(weights[c, flat], starts)
    return out


def hashed_nb_predict_fn(train: DataFrame, label_col: str, ids_col: str, *,
                         buckets: int = DEFAULT_BUCKETS, alpha: float = 1.0):
    """Fit naive Bayes on hashed buckets; return ``(make_predict_fn, labels)``.

    Counting is a Spark group-by on (label, bucket); only the K x buckets
    count matrix reaches the driver (checked against ``MAX_PARAMS``)."""
    spark = train.sparkSession
    rows = train.filter(F.col(label_col).isNotNull())
    # K class names (bounded: a longer list fails the parameter check below)
    limit = MAX_PARAMS // (buckets + 1) + 1
    labels = sorted(r[0] for r in rows.select(label_col).distinct().limit(limit).collect())
    k = len(labels)
    if k * (buckets + 1) > MAX_PARAMS:
        raise ValueError("model too large for a broadcast")
    index = {n: i for i, n in enumerate(labels)}
    docs = rows.groupBy(label_col).count().toPandas()
    pairs = (explode_elements(rows, [label_col], ids_col, "b")
             .groupBy(label_col, "b").count().toPandas())      # Arrow transfer, <= K x buckets rows
    counts = np.zeros((k, buckets + 1))
    counts[pairs[label_col].map(index).to_numpy(), pairs["b"].to_numpy()] = pairs["count"].to_numpy()
    n_docs = np.zeros(k)
    n_docs[docs[label_col].map(index).to_numpy()] = docs["count"].to_numpy()
    used = int((counts.sum(axis=0) > 0).sum())
    log_prior = np.log(n_docs / n_docs.sum())
    log_lik = np.log((counts + alpha) / (counts.sum(axis=1, keepdims=True) + alpha * used))
    log_lik[:, 0] = 0.0                      # padding contributes nothing
    seen = counts.sum(axis=0) > 0
    log_lik[:, ~seen] = 0.0                  # unseen buckets are skipped
    params = spark.sparkContext.broadcast((log_prior, log_lik))

    def make_predict_fn():
        prior, lik = params.value

        def predict(batch: pa.Array) -> np.ndarray:
            flat, offsets = list_parts(batch)
            scores = prior[:, None] + segment_sums(lik, flat.astype(np.int64), offsets)
            return np.argmax(scores, axis=0).astype(np.int32)   # first max on ties
        return predict

    return make_predict_fn, labels


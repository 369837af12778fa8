"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is a node with label good or bad.  Its features are
rates of its own characters and words and those of the line before and after;
transitions between neighbouring labels are learned with them.  A document's
score is the mean of its lines' marginal probabilities of good (forward-
backward), weighted by line length.

The field is fitted by gradient ascent of the conditional likelihood on at most
``max_docs`` labelled documents (of those in the table, the ones whose ids have
the smallest hashes), each line carrying its document's label; of a document of
more than ``max_lines`` lines a run of so many is learned from, which starts at
a hash of the text.  Only features reach the driver.

Defined results: a null or empty text is one empty line; with no labelled rows,
or one label only, every score is 0.5; rows with a null label are not learned
from; a document labelled more than once counts with each label; an empty table
gives no rows.

Scale: scoring is one Arrow step over whole texts with no shuffle; fitting
moves a bounded sample.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import as_bytes, small_batches

MAX_DOCS = 4000
MAX_LINES = 200
KEEP = 0.3        # least score of a document to keep
STEPS = 150
L2 = 2e-2
_SIGNS = b"#$%&*|!~^_=<>{}[]\\@+"
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_OWN = 11


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, bytes of every line) of one document."""
    lines = text.split(b"\n")
    own = np.zeros((len(lines), _OWN), np.float32)
    sizes = np.empty(len(lines), np.int64)
    before: set = set()
    rows = []
    for i, line in enumerate(lines):
        size = len(line)
        sizes[i] = size
        words = line.split()
        distinct = set(words)
        n, d = len(words), len(distinct)
        size, n, d = size or 1, n or 1, d or 1
        rows.append((
            (len(line) - len(line.translate(None, _SIGNS))) / size,
            (len(line) - len(line.translate(None, _UPPER))) / size,
            (len(line) - len(line.translate(None, _DIGIT))) / size,
            line.count(b"|") / n,
            1.0 - d / n,
            math.sqrt(n) / d,
            min(n / d, 20.0) / 4,
            math.log(size) / 4,
            min(size / n, 20.0) / 8,
            len(distinct & before) / d,
            1.0 if line in (lines[i - 1:i] if i else ()) else 0.0))
        before = distinct
    own[:] = rows
    pad = np.zeros((1, _OWN), np.float32)
    edges = np.zeros((len(lines), 2), np.float32)
    edges[0, 0] = edges[-1, 1] = 1
    x = np.hstack((own, np.vstack((pad, own[:-1])), np.vstack((own[1:], pad)), edges))
    return x, sizes


def run_features(text: bytes, max_lines: int) -> np.ndarray:
    """Features of the text's lines, or of a hashed run of ``max_lines`` of them;
    those of a line are the same either way."""
    n = text.count(b"\n") + 1
    if n <= max_lines:
        return line_features(text)[0]
    first = xxhash.xxh3_64_intdigest(text) % (n - max_lines + 1)
    # a line's features reach two lines back and one ahead
    begin = max(0, first - 2)
    part = text.split(b"\n")[begin:first + max_lines + 1]
    return line_features(b"\n".join(part))[0][first - begin:first - begin + max_lines]


class LineField:
    """Two-label chain: score of good for each line, and a 2 x 2 transition
    table indexed [label, next label] (0 bad, 1 good)."""

    def __init__(self, mean, scale, weights, transitions):
        self.mean, self.scale = mean, scale
        self.weights, self.transitions = weights, transitions

    def line_scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return z @ self.weights[:-1] + self.weights[-1]

    def marginals(self, scores: list[float]) -> list[float]:
        """P(good) of every line; messages are log-odds, one number a line."""
        a = self.transitions
        forward, message = [], 0.0
        for s in scores:
            forward.append(message + s)
            message = _pass(message + s, a[0][0], a[1][0], a[0][1], a[1][1])
        out, message = [0.0] * len(scores), 0.0
        for i in range(len(scores) - 1, -1, -1):
            out[i] = _logistic(forward[i] + message)
            message = _pass(message + scores[i], a[0][0], a[0][1], a[1][0], a[1][1])
        return out

    def document(self, text: bytes) -> float:
        x, sizes = line_features(text)
        good = self.marginals(self.line_scores(x).tolist())
        weight = sizes.tolist()
        total = sum(weight)
        if not total:
            return sum(good) / len(good)
        return sum(g * w for g, w in zip(good, weight)) / total


def _pass(odds: float, bb: float, gb: float, bg: float, gg: float) -> float:
    """Log-odds sent across one transition; xy: weight from x to y (for the
    backward pass, of y before x)."""
    odds = max(-500.0, min(500.0, odds))
    if odds > 0:
        e = math.exp(-odds)
        return math.log(e * math.exp(bg) + math.exp(gg)) - math.log(e * math.exp(bb) + math.exp(gb))
    e = math.exp(odds)
    return math.log(math.exp(bg) + e * math.exp(gg)) - math.log(math.exp(bb) + e * math.exp(gb))


def _logistic(v: float) -> float:
    return 1 / (1 + math.exp(-v)) if v > -500 else 0.0


def fit_field(chains: list[np.ndarray], labels: np.ndarray, steps: int = STEPS,
              l2: float = L2) -> LineField:
    """Adam on the mean conditional log-likelihood of the chains; labels: of
    each chain, carried by all of its lines."""
    order = np.argsort([-len(c) for c in chains], kind="stable")
    chains = [chains[i] for i in order]
    labels = labels[order].astype(np.float64)
    lengths = np.array([len(c) for c in chains])
    stacked = np.vstack(chains).astype(np.float64)
    mean, scale = stacked.mean(axis=0), stacked.std(axis=0) + 1e-3
    z = np.clip((stacked - mean) / scale, -6, 6)
    z = np.hstack((z, np.ones((len(z), 1))))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    longest = int(lengths[0])
    alive = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest)]
    target = np.repeat(labels, lengths)
    # weight chains of both labels alike and lines of long chains less
    share = np.where(labels > 0.5, 0.5 / max(1, (labels > 0.5).sum()),
                     0.5 / max(1, (labels < 0.5).sum()))
    chain_weight = share / np.sqrt(lengths)
    line_weight = np.repeat(chain_weight, lengths)
    params = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    observed = np.zeros((2, 2))
    for y, n, w in zip(labels.astype(int), lengths, chain_weight):
        observed[y, y] += (n - 1) * w
    for step in range(1, steps + 1):
        scores = z @ params[:-4]
        a = params[-4:].reshape(2, 2)
        forward = np.zeros((len(scores), 2))   # log-messages (bad, good) into each line
        backward = np.zeros((len(scores), 2))
        emit = np.stack((np.zeros_like(scores), scores), axis=1)
        for t in range(1, longest):
            at = starts[:alive[t]] + t
            send = forward[at - 1] + emit[at - 1]
            got = np.logaddexp(send[:, :1] + a[0], send[:, 1:] + a[1])
            forward[at] = got - got.max(axis=1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(longest - 1, 0, -1):
            at = starts[:alive[t]] + t
            send = backward[at] + emit[at]
            got = np.logaddexp(a[:, 0] + send[:, :1], a[:, 1] + send[:, 1:])
            backward[at - 1] = got - got.max(axis=1, keepdims=True)
            pair = (forward[at - 1] + emit[at - 1])[:, :, None] + a + send[:, None, :]
            pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            expected += (pair * chain_weight[:alive[t], None, None]).sum(axis=0)
        odds = np.clip(forward[:, 1] + backward[:, 1] + scores
                       - forward[:, 0] - backward[:, 0], -500, 500)
        gradient = np.concatenate((
            ((target - 1 / (1 + np.exp(-odds))) * line_weight) @ z,
            (observed - expected).ravel()))
        gradient -= l2 * params * np.concatenate((np.ones(z.shape[1] - 1), [0], np.ones(4)))
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient ** 2
        params = params + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return LineField(mean.astype(np.float32), scale.astype(np.float32),
                     params[:-4].astype(np.float32), params[-4:].reshape(2, 2).tolist())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_docs: int = MAX_DOCS,
        max_lines: int = MAX_LINES) -> LineField | None:
    """A field learned from documents whose id has a label 0 or 1 in
    ``labels``; None without both labels."""
    chosen = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
              .where("_id is not null and _y in (0, 1)")
              .join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi")
              .orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_docs))
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(chosen), "_id").select("_text", "_y").limit(max_docs))

    def step(batches):
        for batch in batches:
            found = [run_features(t, max_lines).astype("<f4").tobytes()
                     for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), batch.column(1)], names=["x", "y"])

    sample = rows.mapInArrow(step, "x binary, y int").collect()
    labels = np.array([r.y for r in sample])
    if len(set(labels.tolist())) < 2:
        return None
    width = 3 * _OWN + 2
    return fit_field([np.frombuffer(r.x, "<f4").reshape(-1, width) for r in sample], labels)


def score(docs: DataFrame, field: LineField | None, text_col: str = "text",
          name: str = "score") -> DataFrame:
    """``docs`` (all columns) and the quality score of every row."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def step(batches):
        field = shared.value
        for batch in small_batches(batches, at):
            if field is None:
                found = [0.5] * batch.num_rows
            else:
                found = [min(1.0, max(0.0, field.document(t)))
                         for t in as_bytes(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())],
                                             names=schema.names)

    return docs.mapInArrow(step, schema)

"""Multinomial naive Bayes as DataFrame aggregations.

Fit (α = Laplace smoothing, V = distinct training tokens, T_c = token count
of class c, n_c = training rows of class c, N = all training rows):

    log_prior(c)  = ln(n_c / N)
    log_lik(t, c) = ln((count(t, c) + α) / (T_c + α·V))

Score of a row d and its arg-max (ties -> lowest class index):

    score(d, c) = log_prior(c) + Σ_{t in d, t in V} log_lik(t, c)

Sparse form used for scoring, so the model never becomes K × V rows:

    score(d, c) = log_prior(c) + n_known(d)·ln(α / (T_c + α·V))
                  + Σ_{t in d, (t, c) seen} ln((count(t, c) + α) / α)

The model has two tables: ``classes`` (K rows) and ``tokens`` (one row per
seen (token, class) pair plus one "known token" row per token).  The counts they
derive from are a table below the shared folder (a row per token, a column per
class of every head), which cuts lineage and gives exact sizes.

For scoring with up to ``DENSE_MAX_CLASSES`` classes the token table is
pivoted once per model into one row per token with one weight column per
class (0 for a pair never seen, which is exactly its sparse weight
ln(α/α)), so every document token joins to one row and the per-document
sums are plain column sums.  That table is broadcast only when its cell
count (V × (K + 1)) is at most ``BROADCAST_CELLS``; otherwise the distinct tokens
of a block of rows are joined to it and the sums are taken per block
(``block_sums``), so neither a token nor its weights travel once per row.  A number
given as ``broadcast_cells`` is the bound of a broadcast beyond which a plan of
exploded rows joins by a shuffle, whose hot tokens AQE splits.  The K class rows are the only
thing read on the driver; they become literals in the scoring expression
(bounded by ``MAX_CLASSES``).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import explode_elements
from ..sources.scratch import shared_table
from .blocks import meet_by_blocks, places
from .encode import MAX_CLASSES, class_table

KNOWN = -1               # class index of the per-token "in vocabulary" row
DENSE_MAX_CLASSES = 96   # up to this many classes: one weight column per class, which
                         # keeps the aggregate inside code generation (100 fields)
BROADCAST_CELLS = 8_000_000   # dense token table cells (V x (K + 1)) broadcast below this
TIE_DECIMALS = 9         # scores are compared after rounding to this many places

CLASS_SCHEMA = T.StructType([
    T.StructField("class_name", T.StringType(), False),
    T.StructField("class_idx", T.IntegerType(), False),
    T.StructField("n_docs", T.LongType(), False),
    T.StructField("n_tokens", T.LongType(), False),
    T.StructField("log_prior", T.DoubleType(), True),
    T.StructField("log_denom", T.DoubleType(), True),
])


@dataclass
class NaiveBayesModel:
    classes: DataFrame   # class_name, class_idx, n_docs, n_tokens, log_prior, log_denom
    tokens: DataFrame    # token, class_idx, count, log_lik, weight
    vocab_size: int
    alpha: float
    token_rows: int
    _dense: DataFrame | None = field(default=None, repr=False, compare=False)
    _params: list | None = field(default=None, repr=False, compare=False)
    # the weights of all heads of one fit, and this head's number in it
    _wide: tuple[DataFrame, int] | None = field(default=None, repr=False, compare=False)

    def class_params(self) -> list[tuple[int, str, float | None, float]]:
        """The K class rows, read once per model (scoring every micro-batch of
        a stream does not re-run this job)."""
        if self._params is None:
            rows = (self.classes.select("class_idx", "class_name", "log_prior", "log_denom")
                    .orderBy("class_idx").limit(MAX_CLASSES + 1).collect())
            if len(rows) > MAX_CLASSES:
                raise ValueError(f"more than {MAX_CLASSES} classes")
            self._params = [(r.class_idx, r.class_name, r.log_prior, r.log_denom) for r in rows]
        return self._params

    def dense_tokens(self, k: int) -> DataFrame:
        """``(token, _hit, _w0 .. _w{k-1})``: one row per vocabulary token with
        the weight of every class (0 where the pair was never seen).  Made by
        the fit, or for a loaded model once from its token table (at most
        K + 1 rows per token) and checkpointed, so repeated scoring
        (micro-batches, both heads) reuses it."""
        if self._dense is None:
            pairs = self.tokens.filter(F.col("class_idx") != KNOWN)
            self._dense = pivot_weights(pairs, k).checkpoint(eager=True)
        return self._dense

    def save(self, path: str) -> None:
        from ..sources.models import save_nb
        save_nb(self, path)


DOC_MARKER = ""          # pseudo-token counted once per row (real tokens are never empty)


def pivot_weights(pairs: DataFrame, k: int) -> DataFrame:
    """``(token, _hit, _w0 .. _w{k-1})`` from seen ``(token, class_idx,
    weight)`` pairs: one row per token (at most K pairs each), weight 0
    where a pair was never seen."""
    cls = F.col("class_idx")
    return pairs.groupBy("token").agg(
        F.lit(True).alias("_hit"),
        *[F.coalesce(F.sum(F.when(cls == c, F.col("weight"))), F.lit(0.0)).alias(f"_w{c}")
          for c in range(k)])


def fit(df: DataFrame, label_col: str, tokens_col: str, *, alpha: float = 1.0,
        classes: DataFrame | list[str] | None = None) -> NaiveBayesModel:
    """Train on rows with a non-null label that is a known class.  Without a
    class list the distinct labels are the classes (sorted = index order)."""
    return fit_heads(df, {"": label_col}, tokens_col, alpha=alpha, classes={"": classes})[""]


def fit_heads(df: DataFrame, labels: Mapping[str, str], tokens_col: str, *, alpha: float = 1.0,
              classes: Mapping[str, DataFrame | list[str] | None] | None = None,
              ) -> dict[str, NaiveBayesModel]:
    """One model per head (``labels``: head -> label column) from ONE pass over
    the training rows: each row explodes into its tokens plus one marker, and a
    single partially aggregated group-by on (all labels, token) counts them.  That
    result is a table; one pivot of it has the counts of every class of every head
    (``_fit_wide``).  With more than ``DENSE_MAX_CLASSES`` classes in all heads
    together each head's counts are an aggregate of their own.  Empty tokens are not
    counted."""
    known = {h: _class_names((classes or {}).get(h)) for h in labels}
    columns = list(dict.fromkeys(labels.values()))
    real = F.filter(F.coalesce(F.col(tokens_col), F.array().cast("array<string>")),
                    lambda t: t != DOC_MARKER)
    with_marker = F.concat(F.array(F.lit(DOC_MARKER)), real)
    joint = shared_table(explode_elements(df, columns, with_marker, "token")
                         .groupBy(*columns, "token").agg(F.count(F.lit(1)).alias("count")),
                         "nb-joint")
    rows = _label_counts(joint, columns)
    names = {h: known[h] if known[h] is not None else
             sorted({r[label] for r in rows if r[label] is not None})
             for h, label in labels.items()}
    if sum(map(len, names.values())) <= DENSE_MAX_CLASSES:
        return _fit_wide(joint.where(F.col("token") != DOC_MARKER), rows, labels, names, alpha)
    out = {}
    for head, label in labels.items():
        counts = joint.select(F.col(label).alias("class_name"), "token", "count") \
            .where(F.col("class_name").isNotNull())
        own = class_table(df.sparkSession, known[head]) if known[head] is not None else None
        if own is not None:
            counts = counts.join(F.broadcast(own.select("class_name")), "class_name", "left_semi")
        if len(columns) > 1:
            counts = counts.groupBy("class_name", "token").agg(F.sum("count").alias("count"))
            counts = counts.checkpoint(eager=True)
        out[head] = _from_counts(counts, own, alpha)
    return out


def _class_names(classes: DataFrame | list[str] | None) -> list[str] | None:
    """Sorted names of a class list; None if the data decide."""
    if classes is None:
        return None
    if isinstance(classes, DataFrame):
        classes = [r.class_name for r in classes.select("class_name", "class_idx")
                   .orderBy("class_idx").limit(MAX_CLASSES + 1).collect()]
    names = sorted(set(classes))
    if len(names) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return names


def _label_counts(joint: DataFrame, columns: list[str]) -> list:
    """Rows per label of every head (a few rows: checked)."""
    marked = joint.where(F.col("token") == DOC_MARKER)
    counts = None
    for column in columns:
        own = marked.where(F.col(column).isNotNull()).groupBy(F.col(column)).agg(
            F.sum("count").alias("_n")).limit(MAX_CLASSES + 1)
        own = own.select(*[F.col(column) if c == column else F.lit(None).cast("string").alias(c)
                           for c in columns], "_n")
        counts = own if counts is None else counts.unionByName(own)
    rows = counts.collect()
    for column in columns:
        if sum(r[column] is not None for r in rows) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
    return rows


def _fit_wide(joint: DataFrame, rows: list, labels: Mapping[str, str],
              names: Mapping[str, list[str]], alpha: float) -> dict[str, NaiveBayesModel]:
    """All heads from one group-by of the joint counts on token: a count column per
    class of every head.  That table (one row per token) holds all that the models
    need; what follows are narrow steps and one aggregate of it."""
    spark = joint.sparkSession
    heads = list(labels)
    cells = [(i, c, F.col(labels[h]) == name) for i, h in enumerate(heads)
             for c, name in enumerate(names[h])]
    if not cells:
        counts = joint.select("token").where("false")
    else:
        counts = joint.groupBy("token").agg(*[
            F.coalesce(F.sum(F.when(is_class, F.col("count"))), F.lit(0)).alias(f"_c_{i}_{c}")
            for i, c, is_class in cells])
    counts = shared_table(counts, "nb-counts")
    a, log_a = float(alpha), math.log(float(alpha))
    hits = []
    for i, h in enumerate(heads):
        any_class = F.lit(False)
        for c in range(len(names[h])):
            any_class = any_class | (F.col(f"_c_{i}_{c}") > 0)
        hits.append(any_class)
    stats = counts.agg(
        *[F.sum(f"_c_{i}_{c}").alias(f"t_{i}_{c}") for i, c, _ in cells],
        *[F.count(F.when(F.col(f"_c_{i}_{c}") > 0, 1)).alias(f"p_{i}_{c}") for i, c, _ in cells],
        *[F.count(F.when(hit, 1)).alias(f"v_{i}") for i, hit in enumerate(hits)]).first()
    wide = counts.select(
        "token", *[F.nullif(hit, F.lit(False)).alias(f"_hit_{i}") for i, hit in enumerate(hits)],
        *[(F.ln(F.col(f"_c_{i}_{c}") + F.lit(a)) - F.lit(log_a)).alias(f"_w_{i}_{c}")
          for i, c, _ in cells])
    out = {}
    for i, h in enumerate(heads):
        k, vocab_size = len(names[h]), int(stats[f"v_{i}"] or 0)
        n_docs = {r[labels[h]]: int(r["_n"]) for r in rows if r[labels[h]] in set(names[h])}
        total = sum(n_docs.values())
        params = []
        for c, name in enumerate(names[h]):
            n, tokens = n_docs.get(name, 0), int(stats[f"t_{i}_{c}"] or 0)
            params.append((name, c, n, tokens, math.log(n / total) if n else None,
                           math.log(tokens + a * vocab_size) if tokens + a * vocab_size else None))
        own = counts.where(hits[i])
        # the table by pairs: a row per seen (token, class), and one per token
        pair = [F.struct(F.lit(c).alias("class_idx"), F.col(f"_c_{i}_{c}").alias("count"),
                         F.lit(params[c][5]).cast("double").alias("log_denom"))
                for c in range(k)]
        known = F.struct(F.lit(KNOWN).alias("class_idx"), F.lit(0).cast("bigint").alias("count"),
                         F.lit(None).cast("double").alias("log_denom"))
        tokens = (own.select("token", F.inline(F.array(*pair, known)))
                  .where((F.col("class_idx") == KNOWN) | (F.col("count") > 0))
                  .select("token", "class_idx", "count",
                          (F.ln(F.col("count") + F.lit(a)) - F.col("log_denom")).alias("log_lik"),
                          F.when(F.col("class_idx") == KNOWN, F.lit(1.0))
                          .otherwise(F.ln(F.col("count") + F.lit(a)) - F.lit(log_a))
                          .alias("weight")))
        dense = wide.where(F.col(f"_hit_{i}")).select(
            "token", F.col(f"_hit_{i}").alias("_hit"),
            *[F.col(f"_w_{i}_{c}").alias(f"_w{c}") for c in range(k)])
        pairs = sum(int(stats[f"p_{i}_{c}"] or 0) for c in range(k))
        out[h] = NaiveBayesModel(
            spark.createDataFrame(params, CLASS_SCHEMA), tokens, vocab_size, a,
            pairs + vocab_size, dense, [(c, name, prior, denom)
                                        for name, c, _, _, prior, denom in params], (wide, i))
    return out


def _from_counts(counts: DataFrame, classes: DataFrame | None, alpha: float) -> NaiveBayesModel:
    """A model from ``(class_name, token, count)``, the marker's count being the
    class's rows: the K class rows (read on the driver), the dense scoring table
    (the only shuffle, keyed by token; its row count is the vocabulary size) and
    the sparse token table (a narrow union, no shuffle)."""
    spark = counts.sparkSession
    # K rows (bounded by MAX_CLASSES): rows, tokens and seen pairs per class
    is_doc = F.col("token") == DOC_MARKER
    per_class = (counts.groupBy("class_name").agg(
        F.sum(F.when(is_doc, F.col("count"))).alias("n_docs"),
        F.sum(F.when(~is_doc, F.col("count"))).alias("n_tokens"),
        F.count(F.when(~is_doc, 1)).alias("n_pairs"))
        .limit(MAX_CLASSES + 1).collect())
    if len(per_class) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    stats_by = {r.class_name: (int(r.n_docs or 0), int(r.n_tokens or 0)) for r in per_class}
    n_pairs = sum(int(r.n_pairs or 0) for r in per_class)
    if classes is None:
        names = sorted(stats_by)
    else:
        names = [r.class_name for r in classes.select("class_name", "class_idx")
                 .orderBy("class_idx").limit(MAX_CLASSES + 1).collect()]
    k = len(names)
    idx = spark.createDataFrame(list(enumerate(names)), "class_idx int, class_name string")

    a = float(alpha)
    log_a = math.log(a)
    pairs = (counts.filter(~is_doc).join(F.broadcast(idx), "class_name")
             .select("token", "class_idx", "count",
                     (F.ln(F.col("count") + F.lit(a)) - F.lit(log_a)).alias("weight")))
    if k <= DENSE_MAX_CLASSES:
        dense = pivot_weights(pairs, k).checkpoint(eager=True)
        vocab_size = dense.count()          # one row per distinct token: a scan
        known = dense.select("token")
    else:
        dense = None
        known = pairs.select("token").distinct().checkpoint(eager=True)
        vocab_size = known.count()

    v = float(vocab_size)
    n_total = sum(d for d, _ in stats_by.values())
    rows = []
    for i, name in enumerate(names):
        n_docs, n_tokens = stats_by.get(name, (0, 0))
        rows.append((name, i, n_docs, n_tokens,
                     math.log(n_docs / n_total) if n_docs > 0 else None,
                     math.log(n_tokens + a * v) if n_tokens + a * v > 0 else None))
    classes_out = spark.createDataFrame(rows, CLASS_SCHEMA)

    seen = (pairs.join(F.broadcast(classes_out.select("class_idx", "log_denom")), "class_idx")
            .select("token", "class_idx", "count",
                    (F.ln(F.col("count") + F.lit(a)) - F.col("log_denom")).alias("log_lik"),
                    "weight"))
    marker = known.select("token", F.lit(KNOWN).alias("class_idx"),
                          F.lit(0).cast("bigint").alias("count"),
                          F.lit(None).cast("double").alias("log_lik"), F.lit(1.0).alias("weight"))
    # narrow steps from the checkpointed counts (and dense table): no shuffle
    # to re-run on recovery, so no checkpoint of its own
    tokens = seen.unionByName(marker)
    params = [(i, name, log_prior, log_denom)
              for name, i, _, _, log_prior, log_denom in rows]
    return NaiveBayesModel(classes_out, tokens, vocab_size, a, n_pairs + vocab_size,
                           dense, params)


def _sized_side(model: NaiveBayesModel, k: int, broadcast_cells: int) -> tuple[DataFrame, bool]:
    """The token table the documents join to, and whether its exact size (known
    from the fit) allows a broadcast."""
    if k <= DENSE_MAX_CLASSES:
        return model.dense_tokens(k), model.vocab_size * (k + 1) <= broadcast_cells
    return (model.tokens.select("token", "class_idx", "weight"),
            model.token_rows * 3 <= broadcast_cells)


def _token_side(model: NaiveBayesModel, k: int, broadcast_cells: int) -> DataFrame:
    """``_sized_side`` with its broadcast hint, where the size allows one."""
    side, fits = _sized_side(model, k, broadcast_cells)
    return F.broadcast(side) if fits else side


def _occurrences(df: DataFrame, keys: list, tokens_col: str, broadcast: bool) -> DataFrame:
    """``(*keys, token)``: every token of every row, or, for a shuffle join, each
    distinct token of a row once with its count ``_n``, so a common token is sent
    once per row that has it."""
    exploded = df.select(*keys, F.explode_outer(tokens_col).alias("token"))
    if broadcast:
        return exploded
    return exploded.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("_n"))


def _times(weight: str, counted: bool) -> Column:
    return F.col(weight) * F.col("_n") if counted else F.col(weight)


def _hits(hit: str, counted: bool) -> Column:
    """Known tokens of a row."""
    if not counted:
        return F.count(hit)
    return F.coalesce(F.sum(F.when(F.col(hit), F.col("_n"))), F.lit(0))


def block_sums(df: DataFrame, keys: Sequence[str], tokens_col: str, table: DataFrame,
               hits: Mapping[str, str], weights: Mapping[str, str]) -> DataFrame:
    """``(*keys, *hits, *weights)``: for every row the number of its tokens whose
    column of ``hits`` (name -> column of ``table``) is set, and the sums over its
    tokens of the columns of ``weights``; by blocks, for a ``table`` of any size."""
    schema = T.StructType([*[df.schema[k] for k in keys],
                           *[T.StructField(n, T.LongType()) for n in hits],
                           *[T.StructField(n, T.DoubleType()) for n in weights]])
    names, counted = [*hits, *weights], set(hits)
    cells = {n: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n)
             for n, c in {**hits, **weights}.items()}     # flags as 1.0

    keys = list(keys)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        at, offsets, _ = places(rows, found, "token")
        at = at.fill_null(len(found)).to_numpy(zero_copy_only=False)
        some = offsets[1:] > offsets[:-1]
        out = {k: rows.column(k) for k in keys}
        for name in names:
            # a token that is not in the table has the weight 0
            weight = np.append(found.column(name).to_numpy(), 0.0)
            sums = np.zeros(len(rows))
            if some.any():
                sums[some] = np.add.reduceat(weight[at], offsets[:-1][some])
            out[name] = pa.array(sums.astype(np.int64) if name in counted else sums)
        return pa.table(out)

    return meet_by_blocks(df, keys, tokens_col, table.select("token", *cells.values()), "token",
                          run, schema)


def score(model: NaiveBayesModel, df: DataFrame, key: str, tokens_col: str, *,
          carry: Sequence[str] = (), broadcast_cells: int | None = None) -> DataFrame:
    """``(key, scores array<double> indexed by class, pred_idx, pred_label,
    log_norm)`` for every row of ``df`` (rows without a known token get the
    prior's class).  ``key`` must be unique per row.

    Plan: outer explode (rows without tokens survive), left join to the
    dense token table (one row per token), then ONE group-by on the key with
    a sum per class column (combined map-side: with a broadcast join a row's
    tokens sit in one task, so the shuffle carries one partial row per key).
    With more than ``DENSE_MAX_CLASSES`` classes the join goes to the sparse
    (token, class) table and the sums through a (key, class) aggregate and a
    per-key map instead.

    ``carry`` names short per-row columns (e.g. the true label) to keep in the
    output: they ride along as extra group-by keys (the key is unique), so no
    join back to ``df`` is needed.  Keep long text out of it: it would be
    repeated on every exploded token."""
    carry = list(carry)
    params = model.class_params()
    a = model.alpha
    k = max(p[0] for p in params) + 1 if params else 0
    bound = BROADCAST_CELLS if broadcast_cells is None else broadcast_cells
    side, fits = _sized_side(model, k, bound)
    exploded = _occurrences(df, [key, *carry], tokens_col, fits)
    joined = exploded.join(_token_side(model, k, bound), "token", "left")
    if k <= DENSE_MAX_CLASSES and not fits and broadcast_cells is None:
        sums = block_sums(df, [key, *carry], tokens_col, side, {"_known": "_hit"},
                          {f"_s{c}": f"_w{c}" for c in range(k)})
        n_known = F.col("_known")

        def s_of(c: int) -> Column:
            return F.col(f"_s{c}")
    elif k <= DENSE_MAX_CLASSES:
        sums = joined.groupBy(key, *carry).agg(
            _hits("_hit", not fits).alias("_known"),
            *[F.sum(_times(f"_w{c}", not fits)).alias(f"_s{c}") for c in range(k)])
        n_known = F.col("_known")

        def s_of(c: int) -> Column:
            return F.col(f"_s{c}")
    else:
        per_class = (joined.filter(F.col("class_idx").isNotNull())
                     .groupBy(key, "class_idx")
                     .agg(F.sum(_times("weight", not fits)).alias("s")))
        # at most K + 1 entries per key (the known-token row counts matches)
        per_row = per_class.groupBy(key).agg(
            F.map_from_entries(F.collect_list(F.struct("class_idx", "s"))).alias("_m"))
        sums = df.select(key, *carry).join(per_row, key, "left")

        def s_of(c: int) -> Column:
            return F.try_element_at(F.col("_m"), F.lit(c))

        n_known = F.coalesce(s_of(KNOWN), F.lit(0.0))

    out = sums.select(key, *carry, _score_array(params, a, n_known, s_of).alias("scores"))
    return _add_predictions(out, {"": (params, "scores")}).select(
        key, *carry, "scores", "pred_idx", "pred_label", "log_norm")


def _score_array(params, alpha: float, n_known: Column, s_of) -> Column:
    """``array<double>`` of the K class scores (null for a class without
    training rows) from the matched-token count and the per-class sums."""
    by_idx = {p[0]: p for p in params}
    k = max(by_idx) + 1 if by_idx else 0
    terms = []
    for c in range(k):
        p = by_idx.get(c)
        if p is None or p[2] is None:      # class without training rows
            terms.append(F.lit(None).cast("double"))
            continue
        _, _, log_prior, log_denom = p
        terms.append(F.lit(log_prior) + n_known * F.lit(math.log(alpha) - log_denom)
                     + F.coalesce(s_of(c), F.lit(0.0)))
    return F.array(*terms)


def _add_predictions(df: DataFrame, heads: Mapping[str, tuple]) -> DataFrame:
    """For each ``prefix -> (class params, scores column)`` add
    ``{prefix}pred_idx`` (arg-max, lowest index on ties after rounding),
    ``{prefix}pred_label`` and ``{prefix}log_norm``."""
    def arg_max(scores: str) -> Column:
        best = F.array_max(F.filter(
            F.transform(scores, lambda x, i: F.struct(F.round(x, TIE_DECIMALS).alias("s"),
                                                      (-i).alias("neg"))),
            lambda t: t["s"].isNotNull()))
        return (-best["neg"]).cast("int")

    def names(params) -> Column:
        by_idx = {p[0]: p[1] for p in params}
        k = max(by_idx) + 1 if by_idx else 0
        return F.array(*[F.lit(by_idx.get(c)).cast("string") for c in range(k)])

    with_idx = df.select("*", *[arg_max(sc).alias(f"{p}pred_idx")
                                for p, (_, sc) in heads.items()])
    return with_idx.select("*", *[
        col for p, (params, sc) in heads.items() for col in
        (F.element_at(names(params), F.col(f"{p}pred_idx") + 1).alias(f"{p}pred_label"),
         log_sum_exp(sc).alias(f"{p}log_norm"))])


def score_heads(models: Mapping[str, NaiveBayesModel], df: DataFrame, key: str,
                tokens_col: str, *, carry: Sequence[str] = (),
                broadcast_cells: int | None = None) -> DataFrame:
    """Several independent classifiers over the same tokens in ONE pass:
    ``(key, *carry, {head}_scores, {head}_pred_idx, {head}_pred_label,
    {head}_log_norm, ...)``.  Each head's arg-max is its own (a pair of
    predictions may be one no taxonomy lists).

    The heads' weights stand in one wide table, as the fit made them (tables of
    models that were loaded or fitted apart are outer-joined on token first), so the
    rows are exploded, joined and aggregated once instead of once per head.  Heads with more than ``DENSE_MAX_CLASSES`` classes
    are scored on their own and joined on the key."""
    carry = list(carry)
    params = {h: m.class_params() for h, m in models.items()}
    ks = {h: (max(p[0] for p in ps) + 1 if ps else 0) for h, ps in params.items()}
    if any(k > DENSE_MAX_CLASSES for k in ks.values()) or not models:
        out = None
        for h, m in models.items():
            one = score(m, df, key, tokens_col, carry=carry if out is None else (),
                        broadcast_cells=broadcast_cells)
            one = one.select(key, *(carry if out is None else []),
                             *[F.col(c).alias(f"{h}_{c}") for c in
                               ("scores", "pred_idx", "pred_label", "log_norm")])
            out = one if out is None else out.join(one, key)
        return out
    cells = sum(m.vocab_size * (ks[h] + 1) for h, m in models.items())
    wide = _one_table(models, ks)
    for h, m in models.items() if wide is None else ():
        k = ks[h]
        d = m.dense_tokens(k).select(
            "token", F.col("_hit").alias(f"_hit_{h}"),
            *[F.col(f"_w{c}").alias(f"_w_{h}_{c}") for c in range(k)])
        wide = d if wide is None else wide.join(d, "token", "full_outer")
    bound = BROADCAST_CELLS if broadcast_cells is None else broadcast_cells
    counted = cells > bound
    if counted and broadcast_cells is None:
        sums = block_sums(df, [key, *carry], tokens_col, wide,
                          {f"_known_{h}": f"_hit_{h}" for h in models},
                          {f"_s_{h}_{c}": f"_w_{h}_{c}" for h in models for c in range(ks[h])})
    else:
        side = wide if counted else F.broadcast(wide)
        exploded = _occurrences(df, [key, *carry], tokens_col, not counted)
        sums = exploded.join(side, "token", "left").groupBy(key, *carry).agg(*[
            agg for h in models for agg in
            [_hits(f"_hit_{h}", counted).alias(f"_known_{h}"),
             *[F.sum(_times(f"_w_{h}_{c}", counted)).alias(f"_s_{h}_{c}")
               for c in range(ks[h])]]])
    out = sums.select(key, *carry, *[
        _score_array(params[h], models[h].alpha, F.col(f"_known_{h}"),
                     lambda c, h=h: F.col(f"_s_{h}_{c}")).alias(f"{h}_scores")
        for h in models])
    out = _add_predictions(out, {f"{h}_": (params[h], f"{h}_scores") for h in models})
    return out.select(key, *carry, *[f"{h}_{c}" for h in models for c in
                                     ("scores", "pred_idx", "pred_label", "log_norm")])


def _one_table(models: Mapping[str, NaiveBayesModel], ks: Mapping[str, int]) -> DataFrame | None:
    """The wide table of heads that were fitted together, under their names."""
    tables = [m._wide[0] for m in models.values() if m._wide is not None]
    if len(tables) < len(models) or any(t is not tables[0] for t in tables):
        return None
    return tables[0].select(
        "token", *[F.col(f"_hit_{m._wide[1]}").alias(f"_hit_{h}") for h, m in models.items()],
        *[F.col(f"_w_{m._wide[1]}_{c}").alias(f"_w_{h}_{c}") for h, m in models.items()
          for c in range(ks[h])])


def evaluate_heads(models: Mapping[str, NaiveBayesModel], test: DataFrame, key: str,
                   tokens_col: str, labels: Mapping[str, str],
                   split: str | None = None) -> DataFrame:
    """``(head, n, accuracy, loss)`` of every head on ``test``, per value of the
    column ``split`` if one is named (``labels``:
    head -> true-label column): one scoring pass with the true labels carried
    through its aggregate, each head's true class index from a broadcast of
    its K-row class table, and all metrics in one aggregate.  A row counts
    for a head only when its true label is one of that head's classes."""
    from .evaluate import head_metrics
    carry = list(dict.fromkeys([*labels.values(), *([split] if split else [])]))
    scored = score_heads(models, test, key, tokens_col, carry=carry)
    cols = {}
    for head, label in labels.items():
        idx = f"{head}_true_idx"
        truth_idx = models[head].classes.select(F.col("class_name").alias(label),
                                                F.col("class_idx").alias(idx))
        scored = scored.join(F.broadcast(truth_idx), label, "left").withColumn(
            f"{head}_log_p_true", F.element_at(f"{head}_scores", F.col(idx) + 1)
            - F.col(f"{head}_log_norm"))
        cols[head] = (idx, f"{head}_pred_idx", f"{head}_log_p_true")
    return head_metrics(scored, cols, split=split)


def log_sum_exp(scores: str | Column) -> Column:
    s = F.col(scores) if isinstance(scores, str) else scores
    valid = F.filter(s, lambda x: x.isNotNull())
    mx = F.array_max(valid)
    total = F.aggregate(valid, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx))
    return mx + F.ln(total)


def predict(model: NaiveBayesModel, df: DataFrame, key: str, tokens_col: str,
            out_col: str, **kw) -> DataFrame:
    """``df`` with the predicted class name in ``out_col``."""
    scored = score(model, df, key, tokens_col, **kw).select(
        key, F.col("pred_label").alias(out_col))
    return df.join(scored, key, "left")

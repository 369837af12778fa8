"""Language-model scoring by a hidden Markov model over words.

Tokens are the maximal runs of other characters than ASCII white space, A-Z
lower-cased, and one end token per text.  A chain of ``states`` latent states
emits word classes, and a class emits its words:

* the ``own`` most frequent words and the end token are classes of their own;
* every other word belongs to the class of its ending (a hash of its last two
  characters), where it has the probability (c + 1) / (N_f + V_f + 1): its count,
  and the tokens and distinct words of the class in the training texts.  A word
  never seen has the count 0 there.

The sum over all words, and one unseen word per class, is 1 in every state.
Start, transition and emission probabilities are trained by Baum-Welch: every
pass computes expected counts by the scaled forward-backward recursion in the
partitions over all training tokens, Spark adds them up, and the driver
normalises the (states x classes) sums.  In training a text is cut into runs of
``RUN`` tokens, of which the later ones start with the occupancy of the states;
scoring cuts nothing: the forward recursion gives the likelihood of the whole
sequence (long texts by one matrix per run of tokens, which is the same product).

``language_scores`` also gives the add-one unigram score of every text (its
``base_score``), which needs the count of every single word.

Defined results: a null text is empty and has the end token alone; repeated rows
and ids are scored each; rows that are not learned from are scored by the same
model; without training rows the score is the base score, which is 0; an empty
table gives no rows.  Words are told apart by 64-bit hashes.

Scale: word counts are added up per task, then by one shuffle of distinct words;
they grow with the corpus and never reach the driver.  Only the at most
``frequent`` most frequent words are broadcast (18 bytes each).  All occurrences
of the others are joined with the table of counts by a shuffle; a word of that
join is rare by its count over all texts, so no key of it is hot.  Texts are
tokenised twice and then stand as two bytes a token in a table that every pass
reads.  Expected counts are ``states`` numbers per class and task.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import gathered_batches, shared_table

STATES = 8
PASSES = 6
GAIN = 2e-4          # least relative gain in log-likelihood for one more pass
OWN = 8192           # words that are classes of their own, at most
FORMS = 512          # classes of endings
FREQUENT = 1 << 19   # words in the broadcast table, at most
RUN = 512            # tokens of a training run
LONG = 2048          # tokens of a scoring run
PSEUDO = 100.0       # pseudo-tokens a state takes from the class frequencies
_TOKENS_AT_ONCE = 1 << 18
_KEYS_AT_ONCE = 1 << 21
_TEXT_BYTES = 16 << 20


# words -----------------------------------------------------------------------

def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, their number at every place, words of every text)."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    ends = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    sizes = np.diff(ends)
    if "" in words:            # white space at an edge of a text
        keep = index != words.index("")
        owner = np.repeat(np.arange(len(sizes)), sizes)
        index, sizes = index[keep], np.bincount(owner[keep], minlength=len(sizes))
    return words, index, sizes


def word_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the form (class of endings) of every word."""
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    forms = np.fromiter((zlib.crc32(w[-2:].encode()) % FORMS for w in words), np.int64,
                        len(words))
    return keys, forms


def _count_words(rows: DataFrame) -> DataFrame:
    """key, form, n (training tokens), every (all tokens) of the rows
    (_id, _text, _learn); summed per task first."""

    def step(batches):
        kept = [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3

        def out(keys, forms, n, every):
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(forms), pa.array(n), pa.array(every)],
                names=["key", "form", "n", "every"])

        for batch in gathered_batches(batches, 1, _TEXT_BYTES):
            words, index, sizes = split_words(batch.column(1))
            learn = np.repeat(batch.column(2).to_numpy(zero_copy_only=False).astype(bool), sizes)
            keys, forms = word_keys(words)
            every = np.bincount(index, minlength=len(words))
            n = np.bincount(index[learn], minlength=len(words))
            keys = np.concatenate((kept[0], keys))
            distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
            kept = [distinct, np.concatenate((kept[1], forms))[first],
                    *[np.bincount(place, np.concatenate((old, new)), len(distinct))
                      .astype(np.int64) for old, new in zip(kept[2:], (n, every))]]
            if len(distinct) > _KEYS_AT_ONCE:
                yield out(*kept)
                kept = [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3
        yield out(*kept)

    return (rows.mapInArrow(step, "key long, form long, n long, every long")
            .where("every > 0").groupBy("key")
            .agg(F.min("form").alias("form"), F.sum("n").alias("n"),
                 F.sum("every").alias("every")))


@dataclass
class Words:
    """Counts of words: a table for all, arrays for the frequent ones."""
    counts: DataFrame            # key, form, n, every
    tokens: int                  # N, training tokens with the end tokens
    distinct: int                # V, distinct ones
    texts: int                   # training texts
    form_tokens: np.ndarray      # tokens and distinct words of every form, of the
    form_words: np.ndarray       # words that are no classes of their own
    least: int                   # words of so many tokens (of all texts) are frequent
    keys: np.ndarray             # frequent words, sorted: keys,
    n: np.ndarray                # training counts,
    classes: np.ndarray          # and classes (own ones, or of the form)
    own: int                     # classes: 0 end, 1..own, own + 1 + form

    @property
    def n_classes(self) -> int:
        return 1 + self.own + FORMS

    def base(self, n: np.ndarray) -> np.ndarray:
        """log10 of the add-one unigram probability of a token of count n."""
        return np.log10((n + 1) / (self.tokens + 1 * (self.distinct + 1)))

    def inside(self, n: np.ndarray, forms: np.ndarray) -> np.ndarray:
        """log10 of a word's probability in the class of its form."""
        return np.log10((n + 1) / (self.form_tokens + self.form_words + 1)[forms])

    def class_counts(self) -> np.ndarray:
        out = np.zeros(self.n_classes)
        out[0] = self.texts
        mine = (self.classes > 0) & (self.classes <= self.own)
        out[self.classes[mine]] = self.n[mine]
        out[1 + self.own:] = self.form_tokens
        return out


def _least(counts: DataFrame, column: str, most: int) -> int:
    """The smallest count such that at most ``most`` words have it or more; one
    row per twentieth of a doubling is collected."""
    step = F.floor(F.log2(F.col(column).cast("double")) * 20)
    found = (counts.where(F.col(column) > 0).groupBy(step.alias("step"))
             .agg(F.count("*").alias("words"), F.min(column).alias("least"))
             .orderBy(F.desc("step")).collect())
    total, least = 0, 1 << 62
    for row in found:
        total += row.words
        if total > most:
            break
        least = row.least
    return least


def count_words(rows: DataFrame, own: int = OWN, frequent: int = FREQUENT) -> Words:
    """Counts over the rows (_id, _text, _learn)."""
    counts = shared_table(_count_words(rows), "words")
    texts = rows.where("_learn").count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
                       F.count_if(F.col("n") > 0).alias("distinct")).first()
    least, least_own = _least(counts, "every", frequent), _least(counts, "n", own)
    # a class of its own is frequent over all texts too, or else goes by its form
    is_own = (F.col("n") >= least_own) & (F.col("every") >= least)
    forms = counts.where(~is_own & (F.col("n") > 0)).groupBy("form").agg(
        F.sum("n").alias("tokens"), F.count("*").alias("words")).collect()
    form_tokens, form_words = np.zeros(FORMS), np.zeros(FORMS)
    for row in forms:
        form_tokens[row.form], form_words[row.form] = row.tokens, row.words
    table = counts.where(F.col("every") >= least).select("key", "form", "n",
                                                         is_own.alias("own")).toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    mine = table.column("own").to_numpy(zero_copy_only=False).astype(bool)[order]
    n_own = int(mine.sum())
    classes = table.column("form").to_numpy()[order] + 1 + n_own
    classes[mine] = np.arange(1, n_own + 1)
    return Words(counts, int(total.tokens) + texts, int(total.distinct) + (texts > 0), texts,
                 form_tokens, form_words, least, keys[order],
                 table.column("n").to_numpy()[order], classes.astype(np.uint16), n_own)


# texts as classes ------------------------------------------------------------

_ENCODED = ("_row long, _id {id}, _learn boolean, n_tokens long, n_known long, base double, "
            "inside double, classes binary, rare array<struct<key: long, form: long, k: long>>")


def encode(rows: DataFrame, words: Words) -> DataFrame:
    """Table of the rows (_id, _text, _learn) as classes (two bytes a token, the
    end token last), what the frequent words add to the scores, and the others."""
    kind = rows.schema["_id"].dataType.simpleString()
    counts, words.counts = words.counts, None     # tables stay on the driver
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def step(batches):
        w = shared.value
        end_known, end_base = int(w.texts > 0), float(w.base(w.texts))
        row = TaskContext.get().partitionId() << 40
        for batch in gathered_batches(batches, 1, _TEXT_BYTES):
            found, index, sizes = split_words(batch.column(1))
            keys, forms = word_keys(found)
            at = np.minimum(np.searchsorted(w.keys, keys), max(0, len(w.keys) - 1))
            known = w.keys[at] == keys if len(w.keys) else np.zeros(len(keys), bool)
            n = np.where(known, w.n[at], 0) if len(w.keys) else np.zeros(len(keys), np.int64)
            classes = forms + 1 + w.own
            classes[known] = w.classes[at[known]]
            base = np.where(known, w.base(n), 0.0)
            inside = np.where(known & (classes > w.own), w.inside(n, forms), 0.0)
            seen = n > 0
            m = len(sizes)
            owner = np.repeat(np.arange(m), sizes)
            ends = np.cumsum(sizes)
            # one end token after every text's words
            tokens = np.zeros(len(index) + m, "<u2")
            tokens[np.arange(len(index)) + owner] = classes[index]
            cuts = ((ends + np.arange(m) + 1) * 2).astype(np.int64)
            rare = np.flatnonzero(~known[index])
            pair, k = np.unique(owner[rare] * len(found) + index[rare], return_counts=True) \
                if len(rare) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            who, which = pair // max(1, len(found)), pair % max(1, len(found))
            items = pa.StructArray.from_arrays(
                [pa.array(keys[which].view(np.int64)), pa.array(forms[which]),
                 pa.array(k.astype(np.int64))], names=["key", "form", "k"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate((
                [0], np.cumsum(np.bincount(who, minlength=m)))).astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(m)), batch.column(0), batch.column(2),
                 pa.array((sizes + 1).astype(np.int64)),
                 pa.array(np.bincount(owner, seen[index], m).astype(np.int64) + end_known),
                 pa.array(np.bincount(owner, base[index], m) + end_base, pa.float64()),
                 pa.array(np.bincount(owner, inside[index], m).astype(np.float64)),
                 pa.Array.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(np.concatenate(
                     ([0], cuts)).astype(np.int64)), pa.py_buffer(tokens)]).cast(pa.binary()),
                 lists], names=["_row", "_id", "_learn", "n_tokens", "n_known", "base", "inside",
                                "classes", "rare"])
            row += m

    out = shared_table(rows.mapInArrow(step, _ENCODED.format(id=kind)), "classes")
    words.counts = counts
    return out


# the model -------------------------------------------------------------------

class TimeMajor:
    """Places of the tokens of many sequences, longest first, step by step: the
    sequences still running at a step stand together and in the same order."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        steps = int(lengths[0]) if len(lengths) else 0
        running = np.searchsorted(-lengths, -np.arange(steps), side="left")
        self.off = np.concatenate(([0], np.cumsum(running)))
        starts = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        self.rank = np.repeat(np.arange(len(lengths)), lengths)
        self.place = self.off[np.arange(total) - np.repeat(starts, lengths)] + self.rank
        self.steps, self.total = steps, total


def _flat(parts: list[np.ndarray], lay: TimeMajor) -> np.ndarray:
    """Tokens of the sequences in time-major order."""
    out = np.empty(lay.total, np.int64)
    if lay.total:
        out[lay.place] = np.concatenate([parts[i] for i in lay.order])
    return out


class HiddenMarkov:
    """``start`` of a text, ``later`` start of a training run inside a text,
    ``trans`` [state, next state], ``emit`` [class, state]."""

    def __init__(self, start, later, trans, emit):
        self.start, self.later, self.trans, self.emit = start, later, trans, emit

    @classmethod
    def initial(cls, class_counts: np.ndarray, states: int, seed: int) -> HiddenMarkov:
        """Class frequencies disturbed at random, and states that tend to stay."""
        rng = np.random.RandomState(seed)
        prior = (class_counts + 1) / (class_counts + 1).sum()
        emit = prior[:, None] * np.exp(rng.standard_normal((len(prior), states)))
        same = np.full(states, 1 / states)
        trans = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(same, same, trans, emit / emit.sum(axis=0))

    def expected(self, parts: list[np.ndarray], first: np.ndarray):
        """Expected counts of starts (of texts), transitions and emissions over
        the sequences ``parts``, and their log-likelihood (natural)."""
        lay = TimeMajor(np.array([len(p) for p in parts], np.int64))
        classes, off = _flat(parts, lay), lay.off
        states = len(self.start)
        ones = np.ones(states)
        e = self.emit[classes]
        alpha, scale = np.empty_like(e), np.empty(lay.total)
        begins = np.where(first[lay.order][:, None], self.start, self.later)
        for t in range(lay.steps):
            lo, hi = off[t], off[t + 1]
            a = alpha[lo:hi]
            if t:
                np.matmul(alpha[off[t - 1]:off[t - 1] + hi - lo], self.trans, out=a)
                a *= e[lo:hi]
            else:
                np.multiply(begins, e[lo:hi], out=a)
            s = a @ ones
            scale[lo:hi] = s
            a /= s[:, None]
        # e becomes emission x backward message / scale
        back, e = np.ones_like(e), e / scale[:, None]
        turned = np.ascontiguousarray(self.trans.T)
        for t in range(lay.steps - 1, 0, -1):
            lo, hi = off[t], off[t + 1]
            e[lo:hi] *= back[lo:hi]
            np.matmul(e[lo:hi], turned, out=back[off[t - 1]:off[t - 1] + hi - lo])
        size = off[1:] - off[:-1]
        n0 = size[0] if lay.steps else 0
        before = np.arange(n0, lay.total) - np.repeat(size[:-1], size[1:]) \
            if lay.steps > 1 else np.zeros(0, np.int64)
        trans = self.trans * (alpha[before].T @ e[n0:])
        gamma = alpha * back
        emit = np.stack([np.bincount(classes, gamma[:, k], len(self.emit))
                         for k in range(states)], axis=1)
        start = gamma[:n0][first[lay.order]].sum(axis=0)
        return start, trans, emit, float(np.log(scale).sum())

    def updated(self, start, trans, emit, class_counts) -> HiddenMarkov:
        prior = (class_counts + 1) / (class_counts + 1).sum()
        later = (emit.sum(axis=0) + 1) / (emit.sum() + emit.shape[1])
        start, trans = start + 0.1, trans + 0.1
        emit = emit + PSEUDO * prior[:, None]
        return HiddenMarkov(start / start.sum(), later, trans / trans.sum(axis=1, keepdims=True),
                            emit / emit.sum(axis=0))

    def _forward(self, parts: list[np.ndarray], begins: np.ndarray):
        """Log-likelihood (natural) of every sequence from its distribution of
        the first state, and the distribution of its last state."""
        lay = TimeMajor(np.array([len(p) for p in parts], np.int64))
        classes, off = _flat(parts, lay), lay.off
        ones = np.ones(len(self.start))
        scale = np.empty(lay.total)
        last = np.empty((len(parts), len(self.start)))
        a = begins[lay.order]
        for t in range(lay.steps):
            lo, hi = off[t], off[t + 1]
            if t:
                if hi - lo < len(a):
                    last[lay.order[hi - lo:len(a)]] = a[hi - lo:]
                a = a[:hi - lo] @ self.trans
            a = a * self.emit[classes[lo:hi]]
            s = a @ ones
            scale[lo:hi] = s
            a /= s[:, None]
        last[lay.order[:len(a)]] = a
        out = np.empty(len(parts))
        out[lay.order] = np.bincount(lay.rank, np.log(scale)[lay.place], len(parts))
        return out, last

    def log10(self, texts: list[np.ndarray], long: int = LONG) -> np.ndarray:
        """log10 of the probability of every text's classes, of one at least.
        Runs after the first are taken from every state and chained."""
        states = len(self.start)
        parts, begins, runs = [], [], []
        for i, text in enumerate(texts):
            for at in range(0, len(text), long):
                part = text[at:at + long]
                if at:
                    runs.append((i, len(parts)))
                    parts += [part] * states
                    begins.append(self.trans)
                else:
                    parts.append(part)
                    begins.append(self.start[None])
                    runs.append((i, len(parts) - 1))
        out = np.zeros(len(texts))
        if not parts:
            return out
        found, last = self._forward(parts, np.concatenate(begins))
        now: dict[int, np.ndarray] = {}
        for i, p in runs:
            if i not in now:
                out[i], now[i] = found[p], last[p]
                continue
            own = found[p:p + states]
            top = own.max()
            share = now[i] * np.exp(own - top)
            out[i] += top + np.log(share.sum())
            now[i] = (share / share.sum()) @ last[p:p + states]
        return out / np.log(10)


def _chunks(batches, column: int, size: int):
    """(batch, list of token arrays) of about ``size`` tokens each."""
    for batch in batches:
        texts = [np.frombuffer(b, "<u2") for b in batch.column(column).to_pylist()]
        at = total = 0
        for i, text in enumerate(texts):
            total += len(text)
            if total >= size or i == len(texts) - 1:
                yield batch.slice(at, i + 1 - at), texts[at:i + 1]
                at, total = i + 1, 0


def baum_welch(encoded: DataFrame, words: Words, states: int = STATES, passes: int = PASSES,
               gain: float = GAIN, seed: int = 11) -> tuple[HiddenMarkov, list[float]]:
    """The model, and the log-likelihood before every pass."""
    sc = encoded.sparkSession.sparkContext
    totals = words.class_counts()
    model = HiddenMarkov.initial(totals, states, seed)
    names = [f"s{k}" for k in range(states)]
    schema = "cell long, " + ", ".join(f"{name} double" for name in names)
    rows = encoded.where("_learn").select("classes")
    n_classes, history = words.n_classes, []
    for _ in range(passes):
        shared = sc.broadcast(model)

        def step(batches, shared=shared):
            m = shared.value
            # rows: classes, then transitions, starts, and the log-likelihood
            sums = np.zeros((n_classes + states + 2, states))
            parts, first, held = [], [], 0

            def add():
                start, trans, emit, logp = m.expected(parts, np.array(first, bool))
                sums[:n_classes] += emit
                sums[n_classes:n_classes + states] += trans
                sums[-2] += start
                sums[-1, 0] += logp
                parts.clear()
                first.clear()

            for _, texts in _chunks(batches, 0, _TOKENS_AT_ONCE):
                for text in texts:
                    for at in range(0, len(text), RUN):
                        parts.append(text[at:at + RUN])
                        first.append(at == 0)
                        held += len(parts[-1])
                        if held >= _TOKENS_AT_ONCE:
                            add()
                            held = 0
            if parts:
                add()
            some = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), *[pa.array(sums[some, k]) for k in range(states)]],
                names=["cell", *names])

        found = (rows.mapInArrow(step, schema).groupBy("cell")
                 .agg(*[F.sum(name).alias(name) for name in names]).toArrow())
        sums = np.zeros((n_classes + states + 2, states))
        sums[found.column("cell").to_numpy()] = np.stack(
            [found.column(name).to_numpy() for name in names], axis=1)
        shared.destroy()
        history.append(float(sums[-1, 0]))
        model = model.updated(sums[-2], sums[n_classes:n_classes + states], sums[:n_classes],
                              totals)
        if len(history) > 1 and history[-1] - history[-2] < gain * abs(history[-2]):
            break
    return model, history


def score(encoded: DataFrame, words: Words, model: HiddenMarkov | None) -> DataFrame:
    """_id, _learn, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    # the other words: their counts, by a join on keys that are rare everywhere
    rest = words.counts.where(F.col("every") < words.least).select("key", "n")
    share = encoded.sparkSession.createDataFrame(
        [(i, float(t)) for i, t in enumerate(words.form_tokens + words.form_words + 1)],
        "form long, size double")
    whole = float(words.tokens + words.distinct + 1)
    rare = (encoded.select("_row", F.explode("rare").alias("r")).select("_row", "r.*")
            .join(rest, "key", "left").join(F.broadcast(share), "form")
            .withColumn("n", F.coalesce("n", F.lit(0)))
            .groupBy("_row").agg(
                F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("more_known"),
                F.sum(F.expr(f"k * log10((n + 1) / {whole!r}D)")).alias("more_base"),
                F.sum(F.expr("k * log10((n + 1) / size)")).alias("more_inside")))
    if model is None:
        chain = encoded.select("_row", "_id", "_learn", "n_tokens", "n_known", "base",
                               F.lit(None).cast("double").alias("chain"))
    else:
        kind = encoded.schema["_id"].dataType.simpleString()
        shared = encoded.sparkSession.sparkContext.broadcast(model)

        def step(batches):
            m = shared.value
            for batch, texts in _chunks(batches, 7, 4 * _TOKENS_AT_ONCE):
                chain = m.log10(texts) + batch.column(6).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:6], pa.array(chain)],
                    names=[*batch.schema.names[:6], "chain"])

        chain = encoded.drop("rare").mapInArrow(
            step, f"_row long, _id {kind}, _learn boolean, n_tokens long, n_known long, "
                  f"base double, chain double")
    zero = F.lit(0.0)
    base = F.col("base") + F.coalesce("more_base", zero)
    return chain.join(rare, "_row", "left").select(
        "_id", "_learn", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        F.coalesce(F.col("chain") + F.coalesce("more_inside", zero), base).alias("score"))


def language_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id",
                    text_col: str = "text", states: int = STATES, passes: int = PASSES,
                    own: int = OWN, frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs``: id, learned, n_tokens, n_known (tokens that the
    training texts hold), train_tokens, base_score, score.  ``learn``: which rows
    to learn from (null: not)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       F.coalesce(learn, F.lit(False)).alias("_learn"))
    words = count_words(rows, own, frequent)
    encoded = encode(rows, words)
    model = baum_welch(encoded, words, states, passes)[0] if words.texts else None
    return (score(encoded, words, model).withColumnRenamed("_id", id_col)
            .withColumnRenamed("_learn", "learned"))

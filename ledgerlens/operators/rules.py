"""Fragment rules: a text (e.g. a retailer category path) gets the target of
the first rule (lowest ``rule_ord``) whose pattern it contains.

A short rule table (``CASE_RULES``) becomes one ``CASE WHEN`` expression evaluated
per row inside whole-stage code generation: no join, no shuffle.

A longer one is met by a scan for windows.  Every distinct pattern stands with its
lowest ``rule_ord`` and is filed under itself, or, beyond ``GRAM`` characters, under
one of its grams of that size, the one that the fewest patterns hold.  The rules are
dealt by ``rule_ord`` to files of about ``CHUNK_RULES``.  A task takes its texts
through the files in that order: the hash of each window of a text is looked up
among the file's grams, the rules found are verified against the whole text in
order, and a text that has its rule meets no later file (whose rules all come after
it).  So no text and no window is shuffled, no text is paired with the rules of a
common gram, and a task holds one file and the windows of one block of text,
however many rules there are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.blobs import bound_batches, load_object, save_object
from ..sources.scratch import shared_table
from ..taxonomy import rule_rows

CASE_RULES = 200     # rules evaluated one after another per row, at most
GRAM = 32            # windows of at most this many characters are looked up
CHUNK_RULES = 100_000
BLOCK_CHARS = 1 << 19    # characters of which a task holds all windows


def rule_list(rules: Mapping[str, Sequence[str]] | DataFrame) -> list[tuple[str, int, str]] | None:
    """The rules in order; None if there are more than ``CASE_RULES``."""
    if isinstance(rules, DataFrame):
        rows = rules.select("target", "rule_ord", "pattern").limit(CASE_RULES + 1).collect()
        found = sorted(((r.target, r.rule_ord, r.pattern) for r in rows), key=lambda r: r[1])
    else:
        found = rule_rows(rules)
    return found if len(found) <= CASE_RULES else None


def rule_target(text: str | Column, rules: Mapping[str, Sequence[str]] | DataFrame,
                *, ignore_case: bool = False) -> Column:
    """Target of the first matching rule, null when none matches, as one
    expression; for at most ``CASE_RULES`` rules."""
    found = rule_list(rules)
    if found is None:
        raise ValueError(f"more than {CASE_RULES} rules: use map_by_rule")
    t = F.col(text) if isinstance(text, str) else text
    if ignore_case:
        t = F.lower(t)
    expr = None
    for target, _, pattern in sorted(found, key=lambda r: r[1]):
        if pattern is None:
            continue
        p = F.lit(pattern.lower() if ignore_case else pattern)
        cond = F.contains(t, p)
        expr = F.when(cond, F.lit(target)) if expr is None else expr.when(cond, F.lit(target))
    return F.lit(None).cast("string") if expr is None else expr


def _grams(pattern: str, size: str) -> Column:
    """Distinct grams of a pattern column (short); ``size`` is a column of lengths."""
    return F.expr(f"array_distinct(transform(sequence(1, length({pattern}) - {size} + 1), "
                  f"i -> substr({pattern}, i, {size})))")


def _long_grams(text: str, size: int) -> Column:
    """Distinct grams of a text: one scan by a look-ahead at every place (``substr``
    at a place counts characters from the start each time)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def rule_index(rules: DataFrame, texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """``(gram, rule_ord, target, pattern)``: every pattern under its gram that is
    in the fewest of the ``texts`` (a column ``text``); empty patterns under ''."""
    sized = rules.withColumn("size", F.least(F.lit(gram), F.length("pattern")))
    filed = sized.where("size > 0").select(
        "rule_ord", "target", "pattern", "size", F.explode(_grams("pattern", "size")).alias("gram"))
    wanted = filed.select("gram").distinct()
    sizes = [r.size for r in sized.select("size").distinct().collect()]   # 0 .. gram
    counts = (_text_grams(texts, "text", sizes).join(wanted, "gram", "left_semi")
              .groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    best = (filed.join(counts, "gram", "left")
            .groupBy("rule_ord", "target", "pattern")
            .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))
    empty = sized.where("size = 0").select("rule_ord", "target", "pattern",
                                           F.lit("").alias("gram"))
    return best.unionByName(empty).select("gram", "rule_ord", "target", "pattern")


def _text_grams(texts: DataFrame, text: str, sizes: Sequence[int], *keep: str) -> DataFrame:
    """One row per text and distinct gram of one of the ``sizes``."""
    per_size = [_long_grams(text, n) if n else F.array(F.lit("")) for n in sorted(sizes)]
    every = F.concat(*per_size) if per_size else F.array().cast("array<string>")
    return texts.select(*keep, F.explode_outer(every).alias("gram")).where("gram is not null")


def rule_files(rules: DataFrame, gram: int = GRAM, chunk: int = CHUNK_RULES) -> list[str]:
    """Files of about ``chunk`` rules each, in the order of ``rule_ord``."""
    spark = rules.sparkSession
    first = (rules.where("pattern is not null and rule_ord is not null").groupBy("pattern")
             .agg(F.min_by(F.struct("rule_ord", "target"), "rule_ord").alias("r"))
             .select("r.rule_ord", "r.target", "pattern"))
    first = shared_table(first, "rules")
    index = rule_index(first, first.select(F.col("pattern").alias("text")), gram)
    folder = scratch_path(spark, "rule-files")
    parts = -(-first.count() // chunk)
    if not parts:
        return []

    def write(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            file = RuleFile(pa.Table.from_batches(rows))
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "path": [save_object(folder, f"rules-{part}", file)]})

    made = (index.repartitionByRange(parts, "rule_ord").sortWithinPartitions("rule_ord")
            .mapInArrow(write, "part long, path string"))
    return [r.path for r in sorted(made.collect(), key=lambda r: r.part)]


class RuleFile:
    """Rules in order, and for every size of gram the sorted hashes of the grams
    with the rules (numbers in that order) filed under each."""

    def __init__(self, rows: pa.Table):
        self.patterns = rows.column("pattern").combine_chunks()
        self.targets = rows.column("target").combine_chunks()
        grams = rows.column("gram").to_pylist()
        by_size: dict[int, list[int]] = {}
        for rule, g in enumerate(grams):
            by_size.setdefault(len(g), []).append(rule)
        # an empty pattern is in every text
        self.every = min(by_size.pop(0, [len(grams)]))
        self.longest = max(by_size, default=0)
        self.tables = []
        for size, which in sorted(by_size.items()):
            windows = Windows([grams[r] for r in which])
            hashes = windows.hashes(size)[windows.ends - size]
            order = np.argsort(hashes, kind="stable")
            distinct, starts = np.unique(hashes[order], return_index=True)
            bits = max(10, (16 * len(distinct)).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[distinct >> np.uint64(64 - bits)] = True
            self.tables.append((size, np.uint64(64 - bits), seen, distinct,
                                np.append(starts, len(which)), np.array(which)[order]))

    def found(self, pieces: list[str], texts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """``(text, rule)`` numbers of the rules whose grams the pieces have."""
        windows = Windows(pieces)
        for size, shift, seen, distinct, starts, which in self.tables:
            hashes = windows.hashes(size)
            at = np.flatnonzero(seen[hashes >> shift])
            place = np.searchsorted(distinct, hashes[at])
            place[place == len(distinct)] = 0
            hit = distinct[place] == hashes[at]
            at, place = at[hit], place[hit]
            piece = np.searchsorted(windows.ends, at, "right")
            whole = at + size <= windows.ends[piece]
            pair = np.unique(texts[piece[whole]] * len(distinct) + place[whole])
            text, place = np.divmod(pair, len(distinct))
            for i, a, b in zip(*_runs(text)):
                own = place[a:b]
                n = starts[own + 1] - starts[own]
                first = np.repeat(starts[own] - np.cumsum(n) + n, n)
                yield i, which[first + np.arange(len(first))]


def _runs(values: np.ndarray):
    """Value, start and end of every run of equal ``values``."""
    starts = np.flatnonzero(np.diff(values, prepend=-1))
    return values[starts].tolist(), starts.tolist(), np.append(starts[1:], len(values)).tolist()


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        both.append(np.cumprod(x, dtype=np.uint64))
    return tuple(both)


class Windows:
    """Hashes of all windows of joined texts, for any size, from one sum."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum([len(t) for t in texts])
        self.power, self.inverse = _powers(1 << max(16, len(codes).bit_length()))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.power[:len(codes)], out=self.sums[1:])

    def hashes(self, size: int) -> np.ndarray:
        """One per place at which a window of ``size`` starts."""
        n = max(0, len(self.sums) - size)
        h = (self.sums[size:] - self.sums[:n]) * self.inverse[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _blocks(texts: Sequence[str | None], which: list[int], overlap: int):
    """``(pieces, text numbers)`` of about ``BLOCK_CHARS`` characters; longer texts
    are cut into pieces that share ``overlap`` characters."""
    pieces, numbers, n = [], [], 0
    for i in which:
        text = texts[i]
        for at in range(0, max(1, len(text) - overlap), BLOCK_CHARS):
            piece = text[at:at + BLOCK_CHARS + overlap]
            if n + len(piece) > 2 * BLOCK_CHARS:
                yield pieces, np.array(numbers)
                pieces, numbers, n = [], [], 0
            pieces.append(piece)
            numbers.append(i)
            n += len(piece)
    if pieces:
        yield pieces, np.array(numbers)


def first_rules(texts: Sequence[str | None], file: RuleFile, open_: list[int]) -> dict[int, int]:
    """The first rule of ``file`` in each of the texts numbered in ``open_``, if any."""
    found: dict[int, list] = {}
    for pieces, numbers in _blocks(texts, open_, max(0, file.longest - 1)):
        for i, own in file.found(pieces, numbers):
            found.setdefault(i, []).append(own)
    out = {i: file.every for i in open_} if file.every < len(file.patterns) else {}
    for i, own in found.items():
        for rule in np.unique(np.concatenate(own)).tolist():
            if rule >= out.get(i, len(file.patterns)):
                break
            if file.patterns[rule].as_py() in texts[i]:
                out[i] = rule
                break
    return out


def match_rules(rows: DataFrame, text_col: str, paths: list[str], target_type: str,
                out_col: str) -> DataFrame:
    """``rows`` with the target of the first rule of the files that is in ``text_col``."""
    kept = [c for c in rows.columns if c != out_col]
    schema = rows.select(*kept, F.lit(None).cast(target_type).alias(out_col)).schema

    def match(batches):
        first = load_object(paths[0]) if paths else None
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            open_ = [i for i, t in enumerate(texts) if t is not None]
            targets = [None] * len(texts)
            for number, path in enumerate(paths):
                if not open_:
                    break
                file = load_object(path) if number else first
                found = first_rules(texts, file, open_)
                for i, rule in found.items():
                    targets[i] = file.targets[rule].as_py()
                open_ = [i for i in open_ if i not in found]
            targets = pa.array(targets, first.targets.type if paths else pa.null())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], targets],
                                             names=[*kept, out_col])

    bound_batches(rows.sparkSession)
    return rows.select(*kept).mapInArrow(match, schema)


def map_by_rule(df: DataFrame, text_col: str, rules, out_col: str = "target", *,
                ignore_case: bool = False, gram: int = GRAM) -> DataFrame:
    """``df`` with the target of the first matching rule (null: none), from a
    mapping target -> patterns or a table ``(target, rule_ord, pattern)`` of any
    length; ``rule_ord`` is unique."""
    if rule_list(rules) is not None:
        return df.withColumn(out_col, rule_target(text_col, rules, ignore_case=ignore_case))
    if not isinstance(rules, DataFrame):
        rules = df.sparkSession.createDataFrame(
            rule_rows(rules), "target string, rule_ord int, pattern string")
    pattern = F.lower("pattern") if ignore_case else F.col("pattern")
    paths = rule_files(rules.select("rule_ord", "target", pattern.alias("pattern")), gram)
    text = text_col
    if ignore_case or text_col == out_col:
        text = "_rule_text"
        df = df.withColumn(text, F.lower(text_col) if ignore_case else F.col(text_col))
    out = match_rules(df, text, paths, dict(rules.dtypes)["target"], out_col)
    return out if text == text_col else out.drop(text)

"""Line dedup by winnowing over line hashes, DataFrame functions only.

A text is its lines (cut at ``\\n``).  A passage is a run of consecutive lines
with ``min_words`` words or more together.  Every line of a passage that also
stands earlier in the corpus is deleted; the first occurrence stays.  Earlier is
by (id, hash of the text, line number); null ids come first.

Words of a line are its runs of other characters than ASCII white space, of at
most 40 characters each, so that text without spaces has words too; every
Chinese, Japanese or Korean character is a word by itself.  A line without any
counts as one.

* Windows are the shortest passages that start, or that end, at a line; every line
  of a repeated passage lies in a repeated window.  The smallest line hash of a
  window is its fingerprint, and its place is selected (winnowing): equal
  windows select the same line, so a repeated passage shares a selected place.
* Fingerprints that stand at one place only drop out.  The others are joined:
  every later place to the first place of a fingerprint in the same window, which
  is one row per place and window, however often the fingerprint stands.
* Each pair of places is extended both ways, line by line, as long as the lines are
  equal (by 128 bits of hash each), at most ``min_words`` lines; no window with the
  fingerprint reaches further, as a line counts one word at least.
* A run of ``min_words`` words found so loses its lines in the later text;
  overlapping runs add up to whole passages.

Defined results: a null text stays null and an empty one empty; rows that agree
in id and text count as one place, so both keep their lines; a text all of whose
lines go becomes empty; an empty table gives no rows.  All columns of the
documents are kept.

Scale: texts are read twice and shuffled once, for the deletion; two hashes and the
word count of every line are a shared table, which the windows are taken from
and the extension reads.  What is joined are hashes and positions of repeated
fingerprints; hot ones meet in partial aggregates and in joins on the hash or the
text's key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_table

MIN_WORDS = 50
# fixed values: ranges of Chinese, Japanese and Korean characters
_CJK = r"\x{2E80}-\x{9FFF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
WORD = rf"[{_CJK}]|[^\x20\x09-\x0D{_CJK}]{{1,40}}"


def _windows(words: str, min_words: int) -> str:
    """SQL for the distinct windows (p: first line from 1, n: lines) of a text
    whose lines have ``words`` words, one at least each."""
    # a running lines * 2^40 + words that stops growing once the words suffice
    unit = 1 << 40
    size = (f"aggregate({{part}}, 0L, (s, x) -> if(s % {unit}L >= {min_words}, s, s + {unit}L + x),"
            f" s -> if(s % {unit}L >= {min_words}, int(s div {unit}L), 0))")
    ahead = size.format(part=f"slice({words}, i, {min_words})")
    back = size.format(part=f"reverse(slice({words}, greatest(i - {min_words - 1}, 1), "
                            f"least(i, {min_words})))")
    both = (f"transform(transform(sequence(1, size({words})), "
            f"i -> struct(i as i, {ahead} as a, {back} as b)), "
            "s -> array(struct(s.i as p, s.a as n), struct(s.i - s.b + 1 as p, s.b as n)))")
    return f"filter(array_distinct(flatten({both})), x -> x.n > 0)"


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Table of _id, _row (hash of the text), and per line two hashes and its words;
    equal rows once."""
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_row"),
        F.split(F.col(text_col), "\n").alias("lines"))
    return shared_table(rows.select(
        "_id", "_row",
        F.expr("transform(lines, x -> xxhash64(x))").alias("h1"),
        F.expr("transform(lines, x -> xxhash64('second', x))").alias("h2"),
        F.transform("lines", lambda x: F.greatest(F.regexp_count(x, F.lit(WORD)), F.lit(1)))
        .alias("words")), "line-hashes")


def windows(table: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per window of a text: _id, _row, its fingerprint f and its line q (from
    1), and a hash k of the window that also says where in it the fingerprint is."""
    rows = table.select("_id", "_row", "h1", F.explode(F.expr(_windows("words", min_words)))
                        .alias("w"))
    part = "slice(h1, w.p, w.n)"
    return (rows.select("_id", "_row", F.expr(f"array_min({part})").alias("f"),
                        F.expr(f"xxhash64({part})").alias("k"),
                        F.expr(f"int(w.p + array_position({part}, array_min({part})) - 1)")
                        .alias("q")))


def pairs(table: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _row, first (the _id and _row of a text), places (line of the later
    text, line of the first): later places of fingerprints and the first place of
    the same fingerprint in the same window."""
    found = windows(table, min_words)
    # tables of their own: joins with them can be split where a key is hot
    place = F.xxhash64("_id", "_row", "q")
    repeated = shared_table(
        found.groupBy("f").agg(F.min(place).alias("a"), F.max(place).alias("b"))
        .where("a <> b").select("f"), "fingerprints")
    near = shared_table(found.join(repeated, "f"), "near")
    here = F.struct("_id", "_row", "q")
    first = shared_table(
        near.groupBy("f", "k").agg(F.min(here).alias("first"), F.max(here).alias("last"))
        .where("first <> last").drop("last"), "first")
    later = near.join(first, ["f", "k"]).where(here > F.col("first"))
    return later.groupBy("_id", "_row", F.struct("first._id", "first._row").alias("first")).agg(
        F.collect_set(F.struct(F.col("q"), F.col("first.q").alias("r"))).alias("places"))


def _reach(min_words: int, step: str) -> str:
    """SQL for the number of equal lines next to the place x (``step``: + or -)."""
    same = " and ".join(f"get({h}, x.q - 1 {step} j) = get(first_{h}, x.r - 1 {step} j)"
                        for h in ("h1", "h2"))
    # lines before the first or after the last are null, which ends the run
    return (f"aggregate(sequence(0, {min_words}), 0, "
            f"(n, j) -> if(n = j and coalesce({same}, false), n + 1, n))")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _row and the (distinct) numbers of the lines to delete."""
    table = line_table(docs, id_col, text_col)
    met = shared_table(pairs(table, min_words), "pairs")
    # rows that agree in id and text stand for one text
    texts = table.dropDuplicates(["_id", "_row"])
    first = texts.select(F.struct("_id", "_row").alias("first"), F.col("h1").alias("first_h1"),
                         F.col("h2").alias("first_h2"))
    both = met.join(first, F.xxhash64(met["first._id"], met["first._row"])
                    == F.xxhash64(first["first._id"], first["first._row"])) \
        .where(met["first"].eqNullSafe(first["first"])).drop(first["first"])
    own = texts.withColumnsRenamed({"_id": "_own_id", "_row": "_own_row"})
    both = both.join(own, F.col("_id").eqNullSafe(F.col("_own_id"))
                     & (F.col("_row") == F.col("_own_row")))
    runs = F.expr(f"transform(places, x -> struct(x.q - {_reach(min_words, '-')} + 1 as a, "
                  f"x.q + {_reach(min_words, '+')} - 1 as b))")
    enough = (f"x.a <= x.b and aggregate(slice(words, x.a, x.b - x.a + 1), 0, (s, n) -> s + n) "
              f">= {min_words}")
    gone = both.select("_id", "_row", "words", runs.alias("runs")).select(
        "_id", "_row", F.expr(f"array_distinct(flatten(transform(filter(runs, x -> {enough}), "
                              f"x -> sequence(x.a, x.b))))").alias("some"))
    return gone.groupBy("_id", "_row").agg(
        F.array_distinct(F.flatten(F.collect_list("some"))).alias("gone")).where("size(gone) > 0")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS, report: str = "_report") -> DataFrame:
    """``docs`` (all columns) with later repeats deleted from the text, and a
    struct ``report`` of n_lines and n_removed."""
    if report in docs.columns:
        raise ValueError(f"the documents have a column {report!r} already")
    gone = repeated_lines(docs, id_col, text_col, min_words)
    text = F.col(f"d.{text_col}")
    rows = docs.alias("d").join(gone.alias("g"), F.col(f"d.{id_col}").eqNullSafe(F.col("g._id"))
                                & (F.xxhash64(text) == F.col("g._row")), "left")
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col("g.gone"))
    cut = F.array_join(F.transform(kept, lambda i: F.get(lines, i - 1)), "\n")
    new = F.when(F.col("g.gone").isNull(), text).otherwise(cut)
    counts = F.struct(
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("g.gone").isNull(), 0).otherwise(F.size("g.gone")).cast("long")
        .alias("n_removed"))
    return rows.select(*[new.alias(c) if c == text_col else F.col(f"d.{c}")
                         for c in docs.columns], counts.alias(report))

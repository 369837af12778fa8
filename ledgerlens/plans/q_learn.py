"""Sub-word ids, training with history and many-pattern rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_tokens, clean_tokens_sql
from ..operators import rules, softmax, subword
from ..operators.encode import ids_text
from ..operators.evaluate import fixed6
from ..sources.scratch import shared_table
from ..sources.tables import docs_ledger, spread, table
from .catalog import register
from .q_model import _docs_sql, prepared_docs

# --- sub-words: the public vocabulary with word ends ------------------------

ENDS = "</w>"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file ('' where none is installed)."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return ""
    return public_tokenizers.path(name)


SUBWORD_SQL = f"""RECURSIVE voc AS (
  SELECT e.key AS piece, e.value AS piece_id FROM (
    SELECT unnest(map_entries(CAST(json_extract(content, '$.model.vocab')
                                   AS MAP(VARCHAR, INTEGER)))) AS e
    FROM read_text('{vocabulary_path()}')) f),
d AS (SELECT doc_id, {clean_tokens_sql('text')} AS toks FROM documents),
e AS (SELECT doc_id, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM d),
w AS (SELECT word, length(word) AS n, COUNT(*) AS cnt FROM e GROUP BY word),
cand AS (SELECT c.word, c.p, c.q, voc.piece_id
         FROM (SELECT word, n, p, unnest(range(p, n + 1)) AS q
               FROM (SELECT word, n, unnest(range(1, n + 1)) AS p FROM w WHERE n <= 200)) c
         JOIN voc ON voc.piece = substr(c.word, c.p, c.q - c.p + 1)
                     || CASE WHEN c.q = c.n THEN '{ENDS}' ELSE '' END),
best AS (SELECT word, p, MAX(q) AS q, arg_max(piece_id, q) AS piece_id FROM cand GROUP BY 1, 2),
walk AS (SELECT word, p, q, piece_id FROM best WHERE p = 1
         UNION ALL
         SELECT b.word, b.p, b.q, b.piece_id FROM walk a JOIN best b
           ON b.word = a.word AND b.p = a.q + 1),
whole AS (SELECT word, n, cnt, (SELECT MAX(q) FROM walk WHERE walk.word = w.word) AS upto FROM w),
cut AS (SELECT k.word, walk.p, walk.piece_id, k.cnt
        FROM whole k JOIN walk ON walk.word = k.word WHERE k.upto = k.n
        UNION ALL SELECT word, 1, 100, cnt FROM whole WHERE upto IS NULL OR upto < n)"""


def _doc_words(spark, sf_dir):
    return docs_ledger(spark, sf_dir).select("doc_id",
                                             clean_tokens("Description").alias("tokens"))


@register("subword_ids", f"""WITH {SUBWORD_SQL},
i AS (SELECT e.doc_id, string_agg(CAST(cut.piece_id AS VARCHAR), ' ' ORDER BY e.pos, cut.p) AS ids,
             COUNT(*) AS n FROM e JOIN cut ON cut.word = e.word GROUP BY e.doc_id)
SELECT d.doc_id, COALESCE(i.ids, CASE WHEN d.toks IS NOT NULL THEN '' END) AS ids,
       CAST(CASE WHEN d.toks IS NOT NULL THEN COALESCE(i.n, 0) END AS INTEGER) AS n_ids
FROM d LEFT JOIN i ON i.doc_id = d.doc_id""")
def q_subword_ids(spark, sf_dir):
    """Greedy longest pieces of every cleaned word of whole documents."""
    pieces = subword.pieces_of_file(spark, vocabulary_path())
    out = subword.subword_ids(_doc_words(spark, sf_dir), "doc_id", "tokens", pieces, ends=ENDS)
    return out.select("doc_id", ids_text("subword_ids").alias("ids"),
                      F.when(F.col("subword_ids").isNotNull(), F.size("subword_ids"))
                      .alias("n_ids"))


@register("subword_vocab", f"""WITH {SUBWORD_SQL}
SELECT COALESCE(voc.piece, '[UNK]') AS piece, cut.piece_id, CAST(SUM(cut.cnt) AS BIGINT) AS count
FROM cut LEFT JOIN voc ON voc.piece_id = cut.piece_id GROUP BY 1, 2""")
def q_subword_vocab(spark, sf_dir):
    """The pieces that the documents' words use, and how often."""
    pieces = subword.pieces_of_file(spark, vocabulary_path())
    return subword.subword_vocab(_doc_words(spark, sf_dir), "doc_id", "tokens", pieces, ends=ENDS)


# --- training with history ---------------------------------------------------

STEP = softmax.Plan(epochs=1, batches=1, rate=0.5)

# the first step from zero weights: every class has the probability 1 / K, and
# Adam's first update is the rate times g / (|g| + eps)
STEP_SQL = f"""WITH {_docs_sql()},
cls AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS c
        FROM (SELECT DISTINCT lang FROM d WHERE NOT is_test AND lang IS NOT NULL) x),
k AS (SELECT COUNT(*) AS k FROM cls),
r AS (SELECT doc_id, is_test, c AS label, toks, len(toks) AS n FROM d JOIN cls ON cls.lang = d.lang),
t AS (SELECT doc_id, bucket, COUNT(*) / any_value(n) AS x
      FROM (SELECT doc_id, n, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {STEP.buckets} + 1
                   AS bucket FROM (SELECT doc_id, n, unnest(toks) AS w FROM r) a) b
      GROUP BY doc_id, bucket
      UNION ALL SELECT doc_id, 0, 1.0 FROM r),
m AS (SELECT COUNT(*) AS m, COUNT(*) FILTER (WHERE label = 0) AS zero FROM r WHERE NOT is_test),
g AS (SELECT t.bucket, cls.c,
             SUM(t.x * (1.0 / k.k - CASE WHEN r.label = cls.c THEN 1 ELSE 0 END)) / any_value(m.m)
               AS g
      FROM t JOIN r ON r.doc_id = t.doc_id AND NOT r.is_test, cls, k, m GROUP BY 1, 2),
w AS (SELECT bucket, c, -{STEP.rate} * g / (abs(g) + {STEP.eps}) AS w FROM g),
s AS (SELECT r.doc_id, r.label, cls.c, COALESCE(SUM(t.x * w.w), 0) AS s
      FROM r CROSS JOIN cls JOIN t ON t.doc_id = r.doc_id
      LEFT JOIN w ON w.bucket = t.bucket AND w.c = cls.c
      WHERE r.is_test GROUP BY 1, 2, 3),
p AS (SELECT doc_id, any_value(label) AS label, MAX(s) + ln(SUM(exp(s - mx))) AS norm,
             arg_min(c, (-round(s, 9), c)) AS pred, MAX(CASE WHEN label = c THEN s END) AS own
      FROM (SELECT *, MAX(s) OVER (PARTITION BY doc_id) AS mx FROM s) y GROUP BY doc_id),
v AS (SELECT COUNT(*) AS n, SUM(norm - own) AS loss, SUM(CASE WHEN pred = label THEN 1 ELSE 0 END)
             AS hits FROM p)
SELECT 1 AS epoch, metric, CAST(round(value, 6) AS DECIMAL(18,6)) AS value FROM (
  SELECT 'train_loss' AS metric, m.m * ln(k.k) / ceil(m.m / 64.0) AS value FROM m, k
  UNION ALL SELECT 'train_acc', m.zero / m.m FROM m
  UNION ALL SELECT 'val_loss', v.loss / ceil(v.n / 64.0) FROM v
  UNION ALL SELECT 'val_acc', v.hits / v.n FROM v) z"""


def _history(spark, sf_dir, plan):
    prepared = prepared_docs(spark, sf_dir)
    state = softmax.train(prepared, "doc_id", "Category", "tokens", "is_test", plan=plan)
    return softmax.history(spark, state).withColumn("value", fixed6(F.col("value")))


@register("train_history_step", STEP_SQL)
def q_train_history_step(spark, sf_dir):
    """One epoch of one step over all training documents, and its validation."""
    return _history(spark, sf_dir, STEP)


@register("train_history", None)
def q_train_history(spark, sf_dir):
    """Epochs of mini-batch steps with their four metrics."""
    return _history(spark, sf_dir, softmax.Plan(epochs=4))


# --- many rules ---------------------------------------------------------------

@register("map_by_many_rules", """
WITH r AS (SELECT doc_id AS rule_ord, source AS target, substr(text, 41, 12) AS pattern
           FROM documents WHERE length(text) >= 52),
m AS (SELECT d.doc_id, arg_min(r.target, r.rule_ord) AS target
      FROM documents d JOIN r ON contains(d.text, r.pattern) GROUP BY d.doc_id)
SELECT d.doc_id, m.target FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id""")
def q_map_by_many_rules(spark, sf_dir):
    """A rule per document (a fragment of its text, its source) over whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    table_of_rules = docs.where(F.length("text") >= 52).select(
        F.col("source").alias("target"), F.col("doc_id").alias("rule_ord"),
        F.substring("text", 41, 12).alias("pattern"))
    rules_table = shared_table(table_of_rules, "rule-table")
    texts = spread(docs.select("doc_id", "text"), "doc_id")
    return rules.map_by_rule(texts, "text", rules_table).drop("text")

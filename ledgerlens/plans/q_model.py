"""Learning queries on the labelled documents (Category = lang, Sub_Category =
source): keep-first de-duplication, cleaning, md5 split, naive Bayes per
head, prediction, evaluation and model round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_tokens, clean_tokens_sql
from ..operators import naive_bayes as nb
from ..operators.dedupe import dedupe_first
from ..operators.evaluate import fixed6
from ..operators.split import threshold_hex, train_test_split
from ..session import checkpoint_dir, scratch_path
from ..sources.models import load_nb
from ..sources.scratch import shared_table
from ..sources.tables import docs_ledger
from .catalog import register

SEED = 42
TEST_SIZE = 0.33
HEADS = {"category": "Category", "sub_category": "Sub_Category"}
SQL_LABEL = {"Category": "lang", "Sub_Category": "source"}


# --- Spark side ------------------------------------------------------------

def prepared_docs(spark, sf_dir):
    """Keep-first on raw (Description, Category) by doc_id, then clean and
    flag the md5 test split.  A table on shared storage: both heads' fits and
    scores read it several times (each the columns it needs), and recomputing
    means another shuffle of the texts and another pass of the cleaning regex."""
    checkpoint_dir(spark)
    # the de-duplication's shuffle spreads the rows before the cleaning runs
    docs = docs_ledger(spark, sf_dir, spread_rows=False)
    first = dedupe_first(docs, ["Description", "Category"], "doc_id")
    toks = first.select("doc_id", "Category", "Sub_Category",
                        clean_tokens("Description").alias("tokens"))
    return shared_table(train_test_split(toks, "doc_id", test_size=TEST_SIZE, seed=SEED),
                        "prepared")


def fit_head(prepared, label):
    return nb.fit(prepared.filter(~F.col("is_test")), label, "tokens")


def token_table(model):
    names = model.classes.select("class_idx", "class_name")
    return (model.tokens.filter(F.col("class_idx") >= 0)
            .join(F.broadcast(names), "class_idx")
            .select("class_name", "token", F.col("count").cast("bigint").alias("count"),
                    fixed6(F.col("log_lik")).alias("log_lik")))


# --- SQL side --------------------------------------------------------------

def _docs_sql() -> str:
    split = (f"substr(md5('{SEED}|' || CAST(doc_id AS VARCHAR)), 1, 8) "
             f"< '{threshold_hex(TEST_SIZE)}'")
    return f"""d AS (
  SELECT doc_id, lang, source, {clean_tokens_sql('text')} AS toks, {split} AS is_test
  FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn
        FROM documents) x
  WHERE rn = 1)"""


def _head_sql(label: str, p: str) -> str:
    """CTEs ``{p}tc``, ``{p}params`` for one head (α = 1)."""
    return f"""{p}train AS (SELECT doc_id, {label} AS label, toks FROM d
                 WHERE NOT is_test AND {label} IS NOT NULL),
{p}tc AS (SELECT label, token, COUNT(*) AS cnt
          FROM (SELECT label, unnest(toks) AS token FROM {p}train) x GROUP BY 1, 2),
{p}cls0 AS (SELECT label, COUNT(*) AS n_docs FROM {p}train GROUP BY label),
{p}cls AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_idx,
                  n_docs FROM {p}cls0),
{p}ntok AS (SELECT label, SUM(cnt) AS n_tokens FROM {p}tc GROUP BY label),
{p}params AS (
  SELECT c.label, c.class_idx, c.n_docs, COALESCE(n.n_tokens, 0) AS n_tokens,
         ln(c.n_docs / (SELECT SUM(n_docs) FROM {p}cls)) AS log_prior,
         ln(COALESCE(n.n_tokens, 0) + (SELECT COUNT(DISTINCT token) FROM {p}tc)) AS log_denom
  FROM {p}cls c LEFT JOIN {p}ntok n ON c.label = n.label)"""


def _score_sql(label: str, p: str, test: str = "test") -> str:
    """CTEs ``{p}sc`` (doc_id, class_idx, class_name, score) and ``{p}pred``
    for the rows of CTE ``test`` (doc_id, toks)."""
    return f"""{p}known AS (SELECT doc_id, token FROM (SELECT doc_id, unnest(toks) AS token FROM {test}) x
            WHERE token IN (SELECT token FROM {p}tc)),
{p}ll AS (SELECT k.doc_id, pp.class_idx,
                 SUM(ln(COALESCE(t.cnt, 0) + 1.0) - pp.log_denom) AS s
          FROM {p}known k CROSS JOIN {p}params pp
          LEFT JOIN {p}tc t ON t.token = k.token AND t.label = pp.label
          GROUP BY 1, 2),
{p}sc AS (SELECT r.doc_id, pp.class_idx, pp.label AS class_name,
                 pp.log_prior + COALESCE(l.s, 0) AS score
          FROM {test} r CROSS JOIN {p}params pp
          LEFT JOIN {p}ll l ON l.doc_id = r.doc_id AND l.class_idx = pp.class_idx),
{p}pred AS (SELECT doc_id, class_name AS pred FROM (
              SELECT *, row_number() OVER (PARTITION BY doc_id
                                           ORDER BY round(score, 9) DESC, class_idx) AS rn
              FROM {p}sc) x WHERE rn = 1)"""


def _train_sql(label: str) -> str:
    return f"""WITH {_docs_sql()}, {_head_sql(label, 'h_')}
SELECT pp.label AS class_name, t.token, CAST(t.cnt AS BIGINT) AS count,
       CAST(round(ln(t.cnt + 1.0) - pp.log_denom, 6) AS DECIMAL(18,6)) AS log_lik
FROM h_tc t JOIN h_params pp ON t.label = pp.label"""


@register("train_nb", _train_sql("lang"))
def q_train_nb(spark, sf_dir):
    """Category head (13 in the reference; here the 4 languages)."""
    return token_table(fit_head(prepared_docs(spark, sf_dir), "Category"))


@register("train_nb_sub", _train_sql("source"))
def q_train_nb_sub(spark, sf_dir):
    """Sub-category head, trained independently of the category."""
    return token_table(fit_head(prepared_docs(spark, sf_dir), "Sub_Category"))


@register("nb_classes", f"""WITH {_docs_sql()}, {_head_sql('lang', 'c_')}, {_head_sql('source', 's_')}
SELECT 'category' AS head, label AS class_name, class_idx, CAST(n_docs AS BIGINT) AS n_docs,
       CAST(n_tokens AS BIGINT) AS n_tokens,
       CAST(round(log_prior, 6) AS DECIMAL(18,6)) AS log_prior,
       CAST(round(log_denom, 6) AS DECIMAL(18,6)) AS log_denom FROM c_params
UNION ALL
SELECT 'sub_category', label, class_idx, CAST(n_docs AS BIGINT), CAST(n_tokens AS BIGINT),
       CAST(round(log_prior, 6) AS DECIMAL(18,6)), CAST(round(log_denom, 6) AS DECIMAL(18,6))
FROM s_params""")
def q_nb_classes(spark, sf_dir):
    prepared = prepared_docs(spark, sf_dir)
    out = None
    for head, m in nb.fit_heads(prepared.filter(~F.col("is_test")), HEADS, "tokens").items():
        t = m.classes.select(F.lit(head).alias("head"), "class_name", "class_idx", "n_docs",
                             "n_tokens", fixed6(F.col("log_prior")).alias("log_prior"),
                             fixed6(F.col("log_denom")).alias("log_denom"))
        out = t if out is None else out.unionByName(t)
    return out


def _predict_sql(label: str) -> str:
    return f"""WITH {_docs_sql()}, {_head_sql(label, 'h_')},
test AS (SELECT doc_id, toks FROM d WHERE is_test), {_score_sql(label, 'h_')}
SELECT doc_id, pred AS pred_label FROM h_pred"""


def _predict_test(prepared, model):
    test = prepared.filter(F.col("is_test"))
    return nb.score(model, test, "doc_id", "tokens").select("doc_id", "pred_label")


@register("predict_nb", _predict_sql("lang"))
def q_predict_nb(spark, sf_dir):
    prepared = prepared_docs(spark, sf_dir)
    return _predict_test(prepared, fit_head(prepared, "Category"))


@register("model_roundtrip", _predict_sql("lang"))
def q_model_roundtrip(spark, sf_dir):
    """Fit, save the model tables to shared storage, load them, predict."""
    prepared = prepared_docs(spark, sf_dir)
    path = scratch_path(spark, "nb-model")
    fit_head(prepared, "Category").save(path)
    return _predict_test(prepared, load_nb(spark, path))


@register("predict_both", f"""WITH {_docs_sql()}, {_head_sql('lang', 'c_')}, {_head_sql('source', 's_')},
test AS (SELECT doc_id, toks FROM d WHERE is_test),
{_score_sql('lang', 'c_')}, {_score_sql('source', 's_')}
SELECT t.doc_id, array_to_string(t.toks, ' ') AS Description, c.pred AS Category,
       s.pred AS Subcategory
FROM test t JOIN c_pred c ON t.doc_id = c.doc_id JOIN s_pred s ON t.doc_id = s.doc_id""")
def q_predict_both(spark, sf_dir):
    """Prediction table: cleaned text and both heads, scored independently
    (so a pair may lie outside the taxonomy)."""
    prepared = prepared_docs(spark, sf_dir)
    test = prepared.filter(F.col("is_test"))
    models = nb.fit_heads(prepared.filter(~F.col("is_test")),
                          {"cat": "Category", "sub": "Sub_Category"}, "tokens")
    # both heads in one explode / join / aggregate
    preds = nb.score_heads(models, test, "doc_id", "tokens")
    return (test.select("doc_id", F.array_join("tokens", " ").alias("Description"))
            .join(preds.select("doc_id", F.col("cat_pred_label").alias("Category"),
                               F.col("sub_pred_label").alias("Subcategory")), "doc_id"))


def _eval_sql() -> str:
    parts = []
    for head, label in HEADS.items():
        col = SQL_LABEL[label]
        p = head[0] + "_"
        parts.append(f"""SELECT CASE WHEN t.is_test THEN 'test' ELSE 'train' END AS split,
       '{head}' AS head, CAST(COUNT(*) AS BIGINT) AS n,
       CAST(round(AVG(CASE WHEN pr.pred = t.label THEN 1.0 ELSE 0.0 END), 6) AS DECIMAL(18,6))
         AS accuracy,
       CAST(round(SUM(-(st.score - ls.lse)) / ceil(COUNT(*) / 64.0), 6) AS DECIMAL(18,6)) AS loss
FROM (SELECT doc_id, {col} AS label, is_test FROM d) t
JOIN {p}params pp ON pp.label = t.label
JOIN {p}pred pr ON pr.doc_id = t.doc_id
JOIN {p}sc st ON st.doc_id = t.doc_id AND st.class_idx = pp.class_idx
JOIN (SELECT doc_id, mx + ln(SUM(exp(score - mx))) AS lse
      FROM (SELECT *, MAX(score) OVER (PARTITION BY doc_id) AS mx FROM {p}sc) x
      GROUP BY doc_id, mx) ls ON ls.doc_id = t.doc_id
GROUP BY t.is_test""")
    return (f"""WITH {_docs_sql()}, {_head_sql('lang', 'c_')}, {_head_sql('source', 's_')},
test AS (SELECT doc_id, toks FROM d),
{_score_sql('lang', 'c_')}, {_score_sql('source', 's_')}
""" + "\nUNION ALL\n".join(parts))


@register("evaluate_nb", _eval_sql())
def q_evaluate_nb(spark, sf_dir):
    """Accuracy and batch-averaged cross-entropy of both heads on the training
    and the test split (rows whose true label is a trained class)."""
    prepared = prepared_docs(spark, sf_dir)
    models = nb.fit_heads(prepared.filter(~F.col("is_test")), HEADS, "tokens")
    rows = prepared.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train"))
    return nb.evaluate_heads(models, rows, "doc_id", "tokens", HEADS, split="split")


# --- rows-only learners ----------------------------------------------------

@register("train_lr", None)
def q_train_lr(spark, sf_dir):
    """HashingTF -> IDF -> class-weighted multinomial LogisticRegression
    on the training split; predictions for the test split."""
    from ..operators.logistic import fit_lr, predict_lr
    prepared = prepared_docs(spark, sf_dir)
    model = fit_lr(prepared.filter(~F.col("is_test")), "Category", "tokens")
    test = prepared.filter(F.col("is_test"))
    return predict_lr(model, test).select("doc_id", "pred_label")


@register("train_lr_facts", f"""WITH {_docs_sql()},
train AS (SELECT lang, COUNT(*) AS n FROM d WHERE NOT is_test AND lang IS NOT NULL GROUP BY lang)
SELECT CAST(COUNT(*) AS BIGINT) AS n_test, CAST(COUNT(*) AS BIGINT) AS n_known,
       COUNT(*) = COUNT(DISTINCT doc_id) AS one_label_each, true AS beats_largest_class
FROM d WHERE is_test""")
def q_train_lr_facts(spark, sf_dir):
    """What SQL can state about the second learner: one label per test row, each
    a class of the training rows, right more often than the largest class."""
    from ..operators.logistic import fit_lr, predict_lr
    prepared = prepared_docs(spark, sf_dir)
    train, test = prepared.filter(~F.col("is_test")), prepared.filter(F.col("is_test"))
    preds = predict_lr(fit_lr(train, "Category", "tokens"), test)
    classes = train.select(F.col("Category").alias("pred_label"), F.lit(1).alias("_known")) \
        .dropna().distinct()
    rows = preds.select("doc_id", "Category", "pred_label").join(
        F.broadcast(classes), "pred_label", "left")
    largest = train.groupBy("Category").count().agg(F.max("count")).first()[0] / train.count()
    right = F.avg((F.col("Category") == F.col("pred_label")).cast("double"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_test"), F.count("_known").alias("n_known"),
        (F.count(F.lit(1)) == F.countDistinct("doc_id")).alias("one_label_each"),
        (right >= F.lit(largest)).alias("beats_largest_class"))


UDF_SQL = f"""WITH {_docs_sql()},
train AS (SELECT doc_id, lang, toks FROM d WHERE NOT is_test AND lang IS NOT NULL),
b AS (SELECT lang, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 65536 AS bucket
      FROM (SELECT lang, unnest(toks) AS t FROM train) x),
n AS (SELECT lang, bucket, COUNT(*) AS cnt FROM b GROUP BY 1, 2),
used AS (SELECT COUNT(DISTINCT bucket) AS v FROM n),
cls AS (SELECT t.lang, ln(COUNT(*) / (SELECT COUNT(*) FROM train)) AS prior,
               (SELECT COALESCE(SUM(cnt), 0) FROM n WHERE n.lang = t.lang) + (SELECT v FROM used)
                 AS denom
        FROM train t GROUP BY t.lang),
q AS (SELECT doc_id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 65536 AS bucket
      FROM (SELECT doc_id, unnest(toks) AS t FROM d WHERE is_test) x),
k AS (SELECT doc_id, bucket, COUNT(*) AS c FROM q
      WHERE bucket IN (SELECT bucket FROM n) GROUP BY 1, 2),
s AS (SELECT d.doc_id, cls.lang, any_value(cls.prior)
               + COALESCE(SUM(k.c * ln((COALESCE(n.cnt, 0) + 1.0) / cls.denom)), 0) AS score
      FROM (SELECT doc_id FROM d WHERE is_test) d CROSS JOIN cls
      LEFT JOIN k ON k.doc_id = d.doc_id
      LEFT JOIN n ON n.bucket = k.bucket AND n.lang = cls.lang
      GROUP BY 1, 2)
SELECT doc_id, lang AS pred_label FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, lang) AS rn
  FROM s) x WHERE rn = 1"""


@register("predict_udf", UDF_SQL)
def q_predict_udf(spark, sf_dir):
    """A model object applied batch by batch (64 rows) to hashed token ids of
    whole documents, via ``mapInArrow``."""
    from ..operators.batch import batch_predict, bucket_ids, hashed_nb_predict_fn
    prepared = prepared_docs(spark, sf_dir).withColumn("ids", bucket_ids("tokens"))
    make_fn, labels = hashed_nb_predict_fn(prepared.filter(~F.col("is_test")), "Category", "ids")
    test = prepared.filter(F.col("is_test"))
    preds = batch_predict(test, "doc_id", "ids", make_fn, batch_size=64, out_col="pred_idx")
    names = F.array(*[F.lit(n) for n in labels])
    return preds.select("doc_id", F.element_at(names, F.col("pred_idx") + 1).alias("pred_label"))

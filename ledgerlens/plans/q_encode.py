"""Encoding queries: taxonomy counts, label indices, vocabulary, token ids,
padding, decoding, splits and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import explode_elements
from ..functions.text import clean_tokens, clean_tokens_sql
from ..operators import encode
from ..operators.evaluate import class_weights
from ..operators.dedupe import dedupe_first
from ..operators.split import content_key, split_counts, threshold_hex, train_test_split
from ..sources.scratch import shared_table
from ..sources.tables import docs_ledger, parts_ledger, table
from .catalog import register
from .q_summary import txn_taxonomy
from .sqltext import q

SEED = 42
TEST_SIZE = 0.33
TRAIN_LEN = 50


def _values(rows):
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")"
                     for r in rows)


def _cat_classes():
    return sorted(txn_taxonomy().keys())


def _sub_classes():
    return sorted({s for subs in txn_taxonomy().values() for s in subs})


# --- taxonomy --------------------------------------------------------------

@register("taxonomy_counts", """
WITH pairs AS (SELECT DISTINCT p_type AS c, p_brand AS s FROM part),
subs AS (SELECT s, COUNT(*) AS parents FROM pairs GROUP BY s)
SELECT (SELECT CAST(COUNT(DISTINCT c) AS BIGINT) FROM pairs) AS n_categories,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM pairs) AS n_entries,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM subs) AS n_sub_categories,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM subs WHERE parents > 1) AS n_shared_subs""")
def q_taxonomy_counts(spark, sf_dir):
    """Counts of a taxonomy derived from labelled data (distinct pairs)."""
    pairs = parts_ledger(spark, sf_dir).select(
        F.col("Category").alias("c"), F.col("Sub_Category").alias("s")).distinct()
    per_sub = pairs.groupBy("s").agg(F.count(F.lit(1)).alias("parents"))
    names = ("n_categories", "n_entries", "n_sub_categories", "n_shared_subs")
    long = (pairs.agg(F.countDistinct("c").alias("n_categories"),
                      F.count(F.lit(1)).alias("n_entries"))
            .select(F.inline(F.array(
                F.struct(F.lit("n_categories").alias("k"), F.col("n_categories").alias("v")),
                F.struct(F.lit("n_entries").alias("k"), F.col("n_entries").alias("v")))))
            .unionByName(
                per_sub.agg(F.count(F.lit(1)).alias("n_sub_categories"),
                            F.count(F.when(F.col("parents") > 1, 1)).alias("n_shared_subs"))
                .select(F.inline(F.array(
                    F.struct(F.lit("n_sub_categories").alias("k"),
                             F.col("n_sub_categories").alias("v")),
                    F.struct(F.lit("n_shared_subs").alias("k"),
                             F.col("n_shared_subs").alias("v")))))))
    # four (name, value) rows folded into one row: no join needed
    return long.agg(*[F.max(F.when(F.col("k") == n, F.col("v"))).cast("bigint").alias(n)
                      for n in names])


def _encode_sql(col: str, classes: list[str]) -> str:
    k = len(classes)
    rows = [(n, i) for i, n in enumerate(classes)]
    return f"""
WITH cls(class_name, class_idx) AS (VALUES {_values(rows)})
SELECT p.p_partkey, p.{col} AS label, CAST(c.class_idx AS INTEGER) AS class_idx,
       CASE WHEN c.class_idx IS NULL THEN NULL ELSE
         array_to_string(list_transform(range({k}),
           lambda j: CASE WHEN j = c.class_idx THEN '1' ELSE '0' END), '') END AS one_hot,
       CAST(c.class_idx AS INTEGER) AS decoded_idx
FROM part p LEFT JOIN cls c ON p.{col} = c.class_name"""


def _encode(spark, sf_dir, col, classes):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(col).alias("label"))
    cls = encode.class_table(spark, classes)
    out = encode.encode_labels(part, "label", cls, idx_col="class_idx", vec_col="vec",
                               k=len(classes))
    return out.select(
        "p_partkey", "label", "class_idx",
        F.array_join(F.transform("vec", lambda x: x.cast("int").cast("string")), "")
         .alias("one_hot"),
        encode.argmax_index("vec").alias("decoded_idx"))


@register("encode_category", _encode_sql("p_type", _cat_classes()))
def q_encode_category(spark, sf_dir):
    return _encode(spark, sf_dir, "p_type", _cat_classes())


@register("encode_subcategory", _encode_sql("p_brand", _sub_classes()))
def q_encode_subcategory(spark, sf_dir):
    return _encode(spark, sf_dir, "p_brand", _sub_classes())


# --- vocabulary and ids over whole documents --------------------------------

DOC_TOKENS_SQL = f"d AS (SELECT doc_id, {clean_tokens_sql('text')} AS toks FROM documents)"
VOCAB_SQL = """e AS (SELECT doc_id, unnest(toks) AS token,
                   unnest(generate_series(1, len(toks))) AS pos FROM d),
c AS (SELECT token, COUNT(*) AS cnt FROM e GROUP BY token),
v AS (SELECT token, CAST(100 + row_number() OVER (ORDER BY cnt DESC, token ASC) AS BIGINT)
             AS token_id, CAST(cnt AS BIGINT) AS count FROM c)"""


def doc_tokens(spark, sf_dir, reuse: bool = False):
    """Cleaned tokens of every document; a table when the caller reads them more
    than once (vocabulary, then ids)."""
    docs = docs_ledger(spark, sf_dir)
    toks = docs.select("doc_id", clean_tokens("Description").alias("tokens"))
    if reuse:
        toks = shared_table(toks, "doc-tokens")
    return toks


def doc_vocab(toks):
    return encode.build_vocab(explode_elements(toks, [], "tokens", "token"))


@register("build_vocab", f"WITH {DOC_TOKENS_SQL}, {VOCAB_SQL} SELECT * FROM v")
def q_build_vocab(spark, sf_dir):
    return doc_vocab(doc_tokens(spark, sf_dir))


IDS_SQL = """ids AS (SELECT e.doc_id, string_agg(CAST(v.token_id AS VARCHAR), ' ' ORDER BY e.pos) AS ids
        FROM e JOIN v ON e.token = v.token GROUP BY e.doc_id)"""


@register("token_ids", f"""WITH {DOC_TOKENS_SQL}, {VOCAB_SQL}, {IDS_SQL}
SELECT d.doc_id, COALESCE(ids.ids, '') AS token_ids FROM d LEFT JOIN ids ON d.doc_id = ids.doc_id""")
def q_token_ids(spark, sf_dir):
    toks = doc_tokens(spark, sf_dir, reuse=True)
    out = encode.token_ids(toks, "doc_id", "tokens", doc_vocab(toks))
    return out.select("doc_id", encode.ids_text("token_ids").alias("token_ids"))


@register("decode_tokens", f"""WITH {DOC_TOKENS_SQL}, {VOCAB_SQL},
dec AS (SELECT e.doc_id, string_agg(v.token, ' ' ORDER BY e.pos) AS txt
        FROM e JOIN v ON e.token = v.token GROUP BY e.doc_id)
SELECT d.doc_id, COALESCE(dec.txt, '') AS decoded FROM d LEFT JOIN dec ON d.doc_id = dec.doc_id""")
def q_decode_tokens(spark, sf_dir):
    """Whole documents to ids and back: pads and unknown ids handled."""
    toks = doc_tokens(spark, sf_dir, reuse=True)
    vocab = doc_vocab(toks)
    ids = encode.token_ids(toks, "doc_id", "tokens", vocab)
    return encode.decode_ids(ids, "doc_id", "token_ids", vocab).select("doc_id", "decoded")


@register("max_token_len", f"""WITH {DOC_TOKENS_SQL}
SELECT CAST(MAX(len(toks)) AS BIGINT) AS max_token_len, CAST(COUNT(*) AS BIGINT) AS n_rows FROM d""")
def q_max_token_len(spark, sf_dir):
    toks = doc_tokens(spark, sf_dir)
    return toks.agg(F.max(F.size("tokens")).cast("bigint").alias("max_token_len"),
                    F.count(F.lit(1)).cast("bigint").alias("n_rows"))


TRAIN_VOCAB_SQL = VOCAB_SQL.replace(
    "FROM e GROUP BY token", f"""FROM e WHERE NOT (substr(md5('{SEED}|' || CAST(doc_id AS VARCHAR)),
    1, 8) < '{threshold_hex(TEST_SIZE)}') GROUP BY token""")


@register("token_ids_unknown", f"""WITH {DOC_TOKENS_SQL}, {TRAIN_VOCAB_SQL},
ids AS (SELECT e.doc_id, string_agg(CAST(COALESCE(v.token_id, 100) AS VARCHAR), ' ' ORDER BY e.pos)
          AS ids, COUNT(*) FILTER (WHERE v.token_id IS NULL) AS n_unknown
        FROM e LEFT JOIN v ON e.token = v.token GROUP BY e.doc_id)
SELECT d.doc_id, COALESCE(ids.ids, '') AS token_ids,
       CAST(COALESCE(ids.n_unknown, 0) AS BIGINT) AS n_unknown
FROM d LEFT JOIN ids ON d.doc_id = ids.doc_id""")
def q_token_ids_unknown(spark, sf_dir):
    """Vocabulary of the training split applied to all documents: words of the
    test split alone get the unknown id."""
    toks = doc_tokens(spark, sf_dir, reuse=True)
    train = train_test_split(toks, "doc_id", test_size=TEST_SIZE, seed=SEED)
    vocab = doc_vocab(train.where("not is_test"))
    out = encode.token_ids(toks, "doc_id", "tokens", vocab)
    unknown = F.size(F.filter("token_ids", lambda x: x == encode.UNKNOWN_ID))
    return out.select("doc_id", encode.ids_text("token_ids").alias("token_ids"),
                      unknown.cast("bigint").alias("n_unknown"))


PART_TOKENS_SQL = f"d AS (SELECT p_partkey AS doc_id, {clean_tokens_sql('p_name')} AS toks FROM part)"


@register("pad_tokens", f"""WITH {PART_TOKENS_SQL}, {VOCAB_SQL},
ids AS (SELECT e.doc_id, list(v.token_id ORDER BY e.pos) AS ids
        FROM e JOIN v ON e.token = v.token GROUP BY e.doc_id)
SELECT d.doc_id AS p_partkey,
       array_to_string(list_resize(COALESCE(ids.ids, []), {TRAIN_LEN}, 0), ' ') AS padded
FROM d LEFT JOIN ids ON d.doc_id = ids.doc_id""")
def q_pad_tokens(spark, sf_dir):
    """Short descriptions (part names) to fixed-length id vectors (L=50)."""
    part = parts_ledger(spark, sf_dir).select(
        "p_partkey", clean_tokens("Description").alias("tokens"))
    vocab = encode.build_vocab(explode_elements(part, [], "tokens", "token"))
    ids = encode.token_ids(part, "p_partkey", "tokens", vocab)
    return ids.select("p_partkey",
                      encode.ids_text(encode.pad_ids("token_ids", TRAIN_LEN)).alias("padded"))


@register("decode_padded", f"""WITH {PART_TOKENS_SQL}, {TRAIN_VOCAB_SQL},
w AS (SELECT e.doc_id, string_agg(COALESCE(v.token, '[UNK]'), ' ' ORDER BY e.pos) AS txt
      FROM e LEFT JOIN v ON e.token = v.token WHERE e.pos <= {TRAIN_LEN} GROUP BY e.doc_id)
SELECT d.doc_id AS p_partkey, COALESCE(w.txt, '') AS decoded
FROM d LEFT JOIN w ON d.doc_id = w.doc_id""")
def q_decode_padded(spark, sf_dir):
    """Padded ids back to text: pads dropped, unknown words as [UNK]."""
    part = parts_ledger(spark, sf_dir).select(
        "p_partkey", clean_tokens("Description").alias("tokens"))
    train = train_test_split(part, "p_partkey", test_size=TEST_SIZE, seed=SEED)
    vocab = encode.build_vocab(explode_elements(train.where("not is_test"), [], "tokens",
                                                "token"))
    ids = encode.token_ids(part, "p_partkey", "tokens", vocab)
    padded = ids.select("p_partkey", encode.pad_ids("token_ids", TRAIN_LEN).alias("padded"))
    return encode.decode_ids(padded, "p_partkey", "padded", vocab)


# --- split -----------------------------------------------------------------

SPLIT_SQL = (f"substr(md5('{SEED}|' || CAST(p_partkey AS VARCHAR)), 1, 8) "
             f"< '{threshold_hex(TEST_SIZE)}'")


@register("train_split_content", f"""
WITH first AS (SELECT p_name, p_type FROM part GROUP BY p_name, p_type)
SELECT p_name, p_type,
       substr(md5('{SEED}|' || md5(coalesce('v' || p_name, 'n') || chr(31)
                                   || coalesce('v' || p_type, 'n'))), 1, 8)
         < '{threshold_hex(TEST_SIZE)}' AS is_test
FROM first""")
def q_train_split_content(spark, sf_dir):
    """The training job's split: keep-first rows by (Description, Category),
    flagged by their content alone."""
    part = parts_ledger(spark, sf_dir).select("p_partkey", "Description", "Category")
    first = dedupe_first(part, ["Description", "Category"], "p_partkey")
    keyed = first.withColumn("_key", content_key("Description", "Category"))
    return train_test_split(keyed, "_key", test_size=TEST_SIZE, seed=SEED).select(
        F.col("Description").alias("p_name"), F.col("Category").alias("p_type"), "is_test")


@register("train_split", f"SELECT p_partkey, {SPLIT_SQL} AS is_test FROM part")
def q_train_split(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey")
    return train_test_split(part, "p_partkey", test_size=TEST_SIZE, seed=SEED)


@register("split_counts", f"""
WITH f AS (SELECT {SPLIT_SQL} AS is_test FROM part),
c AS (SELECT COUNT(*) AS n, SUM(CASE WHEN is_test THEN 1 ELSE 0 END) AS t FROM f)
SELECT CAST(n AS BIGINT) AS n_total, CAST(n - t AS BIGINT) AS n_train, CAST(t AS BIGINT) AS n_test,
       CAST(ceil((n - t) / 64.0) AS BIGINT) AS train_batches,
       CAST(ceil(t / 64.0) AS BIGINT) AS test_batches
FROM c""")
def q_split_counts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey")
    return split_counts(train_test_split(part, "p_partkey", test_size=TEST_SIZE, seed=SEED))


@register("split_exact", f"""
WITH h AS (SELECT p_partkey, substr(md5('{SEED}|' || CAST(p_partkey AS VARCHAR)), 1, 8) AS hh
           FROM part),
r AS (SELECT p_partkey, row_number() OVER (ORDER BY hh, p_partkey) AS rn,
             COUNT(*) OVER () AS n FROM h)
SELECT p_partkey, rn <= ceil({TEST_SIZE} * n) AS is_test FROM r""")
def q_split_exact(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey")
    return train_test_split(part, "p_partkey", test_size=TEST_SIZE, seed=SEED, exact=True)


# --- class weights ---------------------------------------------------------

def _weight_classes():
    """Taxonomy categories plus one class no row carries."""
    return sorted([*txn_taxonomy().keys(), "SURPLUS"])


@register("class_weights", f"""
WITH cls(class_name, class_idx) AS (VALUES {_values([(n, i) for i, n in enumerate(_weight_classes())])}),
cnt AS (SELECT p_type AS class_name, COUNT(*) AS n FROM part
        WHERE p_type IN (SELECT class_name FROM cls) GROUP BY 1),
tot AS (SELECT SUM(n) AS total FROM cnt)
SELECT c.class_name, CAST(c.class_idx AS INTEGER) AS class_idx,
       CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n,
       CAST(round((tot.total + {len(_weight_classes())}) / (COALESCE(cnt.n, 0) + 1.0), 6)
            AS DECIMAL(18,6)) AS weight
FROM cls c LEFT JOIN cnt ON c.class_name = cnt.class_name CROSS JOIN tot""")
def q_class_weights(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_type")
    cls = encode.class_table(spark, _weight_classes())
    return class_weights(part, "p_type", cls)

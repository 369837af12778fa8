"""DuckDB twins of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op1_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(w), 10) AS k,
         array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p
        FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
        FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, dw.k, p, item FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op3_minhash"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS p
        FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(other) AS component_id,
       d.doc_id = min(other) AS kept
FROM documents d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id)
GROUP BY d.doc_id, n.n
"""

SQL["op4_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
         AS kept,
       text_sha256
FROM d
"""

# lines from 1; a window is the shortest run of 50 words or more from or to a line;
# words are as in lines.WORD
SQL["op7_lines"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(text, chr(10)) AS l
           FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM t),
y AS (SELECT doc_id, line, p, greatest(len(regexp_extract_all(line,
  '[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]|[^\x20\x09-\x0D\x{2E80}-\x{9FFF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]{1,40}'
             )), 1) AS n FROM x),
c AS (SELECT doc_id, line, p, n,
             sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM y),
w AS (
  SELECT a.doc_id, a.p AS p, min(b.p) AS q FROM c a JOIN c b
    ON a.doc_id = b.doc_id AND b.p >= a.p AND b.p < a.p + 50 AND b.upto - a.upto + a.n >= 50
  GROUP BY 1, 2
  UNION
  SELECT a.doc_id, max(b.p) AS p, a.p AS q FROM c a JOIN c b
    ON a.doc_id = b.doc_id AND b.p <= a.p AND b.p > a.p - 50 AND a.upto - b.upto + b.n >= 50
  GROUP BY a.doc_id, a.p),
k AS (SELECT w.doc_id, w.p, w.q, array_to_string(t.l[w.p:w.q], chr(10)) AS body
      FROM w JOIN t USING (doc_id)),
r AS (SELECT doc_id, p, q,
             row_number() OVER (PARTITION BY body ORDER BY doc_id, p) AS nth FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, q + 1)) AS p FROM r WHERE nth > 1)
SELECT x.doc_id, count(*)::BIGINT AS n_lines, count(gone.p)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(x.line, chr(10) ORDER BY x.p) FILTER (WHERE gone.p IS NULL), ''))
         AS kept_sha256
FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p
GROUP BY x.doc_id
"""

SQL["op9_suffix"] = r"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS body
           FROM documents),
x AS (SELECT doc_id, body, hex(body) AS h, octet_length(body) AS n FROM b),
s AS (SELECT doc_id, p, array_slice(body, p + 1, p + 400) AS string
      FROM (SELECT doc_id, body, unnest(range(0, n - 399)) AS p FROM x WHERE n >= 400)),
k AS (SELECT md5(string) AS m, doc_id, p FROM s),
twice AS (SELECT m FROM k GROUP BY m HAVING count(*) > 1),
hit AS (SELECT doc_id, p FROM k SEMI JOIN twice ON k.m = twice.m),
edge AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM hit),
runs AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > 400 THEN 1 ELSE 0 END)
                OVER (PARTITION BY doc_id ORDER BY p) AS run FROM edge),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS z FROM runs GROUP BY 1, 2),
after AS (SELECT doc_id, run, a, z,
                 coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (
  SELECT x.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a)
           || substr(any_value(h), 2 * max(z) + 1) AS kept,
         sum(z - a) AS gone, count(*) AS n_spans
  FROM after JOIN x USING (doc_id) GROUP BY x.doc_id)
SELECT x.doc_id, x.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM x LEFT JOIN cut USING (doc_id)
"""

SQL["op12_search"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM d),
q AS (SELECT item, term, count(*) AS qtf
      FROM (SELECT item, unnest(w) AS term FROM i) GROUP BY ALL),
t AS (SELECT doc_id, n, term, count(*) AS tf
      FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
g AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
      FROM f, s),
r AS (SELECT item, doc_id, sum(qtf * weight * ((1000000000 * tf) //
               (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
      FROM t JOIN q USING (term) JOIN g USING (term), s GROUP BY item, doc_id),
k AS (SELECT item, doc_id, score,
             row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank
      FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k JOIN i USING (item) WHERE rank <= 10
"""

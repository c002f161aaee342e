"""The registered queries: each runs one operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm import (
    filter_audit, fingerprint, hard_negatives, html_text, jaccard, line_dedup, mixing, nn_descent, packing, pii, quality, secrets, substring_dedup,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), n AS (
  SELECT doc_id, count(sh) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)
), r AS (
  SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.seen
)
SELECT n.doc_id, n.n AS n_shingles, min(r.seen) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Equal lines of any length go.  Lines one edit apart, of 8 code points or more, share a half; of such pairs the lines are compared position by position.
OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents
), t AS (
  SELECT doc_id, line, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS s FROM l
), d AS (
  SELECT s, min(struct_pack(d := doc_id, l := line)) AS first, length(s) AS n FROM t WHERE length(s) >= 1 AND doc_id IS NOT NULL GROUP BY s
), k AS (
  SELECT s, n, first, m, half FROM (
    SELECT s, n, first, n + more AS m, unnest([substr(s, 1, (n + more) // 2), substr(s, n - (n + more - (n + more) // 2) + 1)]) AS half
    FROM d, (SELECT unnest([0, 1]) AS more) WHERE n >= 8)
), p AS (
  SELECT DISTINCT b.s AS s, a.s AS kept, b.n AS n, a.n AS kept_n
  FROM k a JOIN k b ON a.half = b.half AND a.m = b.m AND a.s <> b.s AND a.first < b.first AND abs(a.n - b.n) <= 1
), near AS (
  SELECT DISTINCT s FROM p WHERE CASE
    WHEN n = kept_n THEN len(list_filter(range(1, n + 1), lambda i: substr(s, i, 1) <> substr(kept, i, 1))) = 1
    WHEN n > kept_n THEN len(list_filter(range(0, n), lambda i: substr(s, 1, i) || substr(s, i + 2) = kept)) > 0
    ELSE len(list_filter(range(0, kept_n), lambda i: substr(kept, 1, i) || substr(kept, i + 2) = s)) > 0 END
), gone AS (
  SELECT t.doc_id, t.line FROM t JOIN d USING (s) LEFT JOIN near USING (s)
  WHERE near.s IS NOT NULL OR d.first.d <> t.doc_id OR d.first.l <> t.line
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
         coalesce(string_agg(CASE WHEN g.line IS NULL THEN l.raw END, chr(10) ORDER BY l.line), '') AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g
  FROM w WHERE len(ws) >= 13
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM g) WHERE low < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM r
), word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), kept AS (
  SELECT word.doc_id, count(*) - count(gone.i) AS n, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY word.i) AS kept
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id
)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).select(
        "doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = html_text.extract(pages.select("page_id", "url", "html"), html_text.train(pages))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP11_SQL = r"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, c.id, c.label, CAST(list_inner_product(a.vec, c.vec) AS BIGINT) AS score
  FROM v a JOIN v c ON a.id % 100 = 0 AND c.id <> a.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank,
         id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), low AS (
  SELECT text, min(doc_id) AS low FROM t GROUP BY text
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN low.low < t.doc_id THEN 'E' ELSE '' END AS fails
  FROM t JOIN low USING (text) LEFT JOIN marks USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails, contains(fails, letter) AS hit, length(translate(before, fails, '')) < length(before) AS gone FROM c, s
), q AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = letter), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM q
"""


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_fingerprint": op5_fingerprint,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_html_text": op8_html_text,
    "op9_mixing": op9_mixing,
    "op10_nearest": op10_nearest,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_secrets": op13_secrets,
}
ORACLE_SQL: dict[str, str] = {
    "op1_jaccard": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op11_hard_negatives": OP11_SQL, "op12_filter_audit": OP12_SQL,
}

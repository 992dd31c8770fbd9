"""Queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from secrets import token_hex

from tidemark.llm import balltree, decontamination, langid, mixing, pii, repeats, secrets, simhash, toxicity, warc
from tidemark.llm.store import table


def op1_top_k(spark, sf_dir):
    vectors = balltree.usable(table(spark, sf_dir, "embeddings"))
    return balltree.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op2_scan_secrets(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op3_remove_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_pseudonymise(spark, sf_dir):
    """Under the session's key or, if it has none, one that is drawn for this call and kept nowhere."""
    return pii.digest(table(spark, sf_dir, "documents"), spark.conf.get(pii.KEY_SETTING, None) or token_hex(32))


def op5_score_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op6_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir):
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_identify_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op10_simhash_duplicates(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP8_SQL = r"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 10], ' ') AS win, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), cut AS (
  SELECT doc_id, s, size, array_to_string(w[s + 1 : s + size], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS s FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)
), hit AS (
  SELECT doc_id, s, cut.size, item_id FROM cut JOIN win ON cut.win = win.win AND cut.size = win.size
), pos AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.v, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

# Every quotient of every party is listed and ranked, where the operator builds only those that can decide.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY 1
), s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r, CAST(sum(n) OVER () AS BIGINT) AS t FROM s0
), s2 AS (SELECT *, [5, 2, 1][(r - 1) % 3 + 1] AS w FROM s1
), s3 AS (
  SELECT *, coalesce(sum(n * 3) OVER (ORDER BY n * 3 / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(w) OVER (ORDER BY n * 3 / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM s2
), s4 AS (SELECT *, CAST(t - filled AS DOUBLE) / wl AS lv FROM s3
), s5 AS (SELECT *, max(lv) FILTER (n * 3 / w > lv) OVER () AS level FROM s4
), src AS (
  SELECT source, r, n, t, CASE WHEN n * 3 / w <= lv THEN CAST(n * 3 AS DOUBLE) ELSE least(CAST(n * 3 AS DOUBLE), level * w) END AS target,
         CAST(greatest(1, least(100000, ceil(n / 1048576))) AS BIGINT) AS shards FROM s5
), sq AS (SELECT r, t, k, target / (2 * k - 1) AS q FROM (SELECT *, unnest(range(1, n * 3 // 4 + 1)) AS k FROM src WHERE target > 0)
), seats AS (SELECT r, count(*) AS seats FROM (SELECT *, row_number() OVER (ORDER BY q DESC, r, k) AS i FROM sq) WHERE i <= t // 4 GROUP BY r
), dealt AS (
  SELECT d.doc_id, d.size, src.r, src.n, src.target, coalesce(seats, 0) AS seats,
         CAST('0x' || md5('7:shard' || coalesce(':' || d.doc_id, ''))[1:8] AS BIGINT) % shards AS shard
  FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source LEFT JOIN seats USING (r)
), sh AS (SELECT r, shard, CAST(sum(size) AS BIGINT) AS words, any_value(seats) AS seats FROM dealt GROUP BY 1, 2
), hq AS (SELECT r, shard, seats, k, words / (2 * k - 1) AS q FROM (SELECT *, unnest(range(1, words * 3 // 4 + 1)) AS k FROM sh)
), won AS (SELECT r, shard, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY q DESC, shard, k) AS i FROM hq) WHERE i <= seats GROUP BY 1, 2
), quota AS (
  SELECT r, shard, words, coalesce(won, 0) * 4 AS quota,
         CAST('0x' || md5('7:start:' || r || ':' || shard)[1:8] AS BIGINT) % greatest(1, (words + 3) // 4) * 4 AS start
  FROM sh LEFT JOIN won USING (r, shard)
), placed AS (
  SELECT doc_id, size, n, target, r, shard,
         CAST(sum(size) OVER (PARTITION BY r, shard ORDER BY CAST('0x' || md5('7:order' || coalesce(':' || doc_id, ''))[1:8] AS BIGINT), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM dealt
), cut AS (SELECT *, hi - size AS lo, quota // greatest(1, words) AS passes, quota - quota // greatest(1, words) * words AS rest FROM placed JOIN quota USING (r, shard))
SELECT doc_id, size, n AS source_size, target,
       CAST(passes * size + greatest(0, least(hi, least(start + rest, words)) - greatest(lo, start)) + greatest(0, least(hi, start + rest - words) - greatest(lo, 0)) AS BIGINT) AS taken
FROM cut
"""


def oracle_sql():
    return {"op1_top_k": OP1_SQL, "op7_mix_sources": OP7_SQL, "op8_decontaminate": OP8_SQL}

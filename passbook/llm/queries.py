"""The registered queries of the corpus operators, with their SQL where there is one."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from passbook.llm import (
    audit, decontaminate, exact, lines, mixing, quality, sharding, simhash, spelling, threads, tokens, toxicity, vectors,
)
from passbook.llm.common import documents, table
from passbook.plans.registry import query

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS perm
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w,
         3 * source_size AS most, (sum(source_size) OVER ())::BIGINT AS total
  FROM sums
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY most::DOUBLE / w, source NULLS LAST) AS k,
         total - coalesce(sum(most) OVER o, 0)::BIGINT AS rest,
         (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS share
  FROM weighed
  WINDOW o AS (ORDER BY most::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest, share FROM ordered WHERE most * share >= w * rest ORDER BY k LIMIT 1
), plan AS (
  SELECT source, source_size,
         CASE WHEN most * level.share < w * level.rest THEN most::DOUBLE
              ELSE (w * level.rest)::DOUBLE / level.share::DOUBLE END AS target
  FROM ordered, level
), stream AS (
  SELECT s.*, p.source_size, p.target, floor(p.target + 0.5)::BIGINT AS words,
         (sum(size) OVER (PARTITION BY s.source ORDER BY perm, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (greatest(0, least(size, words - before)) + greatest(0, least(size, words - source_size - before))
        + greatest(0, least(size, words - 2 * source_size - before))
        + greatest(0, least(size, words - 3 * source_size - before)))::BIGINT AS taken
FROM stream
"""

OP9_SQL = r"""
WITH bits AS (SELECT range AS n, 0 AS step, range AS c FROM range(256)),
crc_rounds AS (
  WITH RECURSIVE r AS (
    SELECT n, 0 AS step, n::BIGINT AS c FROM bits
    UNION ALL
    SELECT n, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM r WHERE step < 8
  ) SELECT n, c FROM r WHERE step = 8
), crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_rounds),
texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), crcs AS (
  SELECT doc_id, (length(h) / 2)::BIGINT AS bytes,
         xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(0, (length(h) / 2)::BIGINT), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT AS crc
  FROM texts, crc_table
), draws AS (
  SELECT doc_id, s.range AS shard,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || s.range), 1, 13))::BIGINT AS h
  FROM documents, range(9) s
), picks AS (
  SELECT doc_id, (arg_max(shard, h) FILTER (WHERE shard < 8))::INT AS shard, arg_max(shard, h)::INT AS grown_shard
  FROM draws GROUP BY doc_id
)
SELECT doc_id, bytes + 1 AS size, crc AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM crcs JOIN picks USING (doc_id)
"""


@query("op8_source_mix", OP8_SQL)
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(documents(spark, sf_dir)))


@query("op9_rendezvous_shards", OP9_SQL)
def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


OP4_SQL = r"""
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM texts WINDOW g AS (PARTITION BY t)
"""


@query("op4_block_names", OP4_SQL)
def op4_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


@query("op1_simhash_groups")
def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op6_boosted_quality")
def op6_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op3_toxic_pairs")
def op3_toxic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op2_template_leaks")
def op2_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op5_unigram_tokens")
def op5_unigram_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir))


@query("op7_fuzzy_lines")
def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(documents(spark, sf_dir)))


@query("op10_quote_threads")
def op10_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.chat(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH bits AS (SELECT range AS n, 0 AS step, range AS c FROM range(256)),
crc_rounds AS (
  WITH RECURSIVE r AS (
    SELECT n, 0 AS step, n::BIGINT AS c FROM bits
    UNION ALL
    SELECT n, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM r WHERE step < 8
  ) SELECT n, c FROM r WHERE step = 8
), crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_rounds),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
         translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT doc, run, count(*) AS n, hex(encode(doc || ':' || run)) AS h FROM runs GROUP BY doc, run
), checked AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(0, (length(h) / 2)::BIGINT), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT AS crc
  FROM counted, crc_table
), noisy AS (
  SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n
  FROM checked
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM noisy GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3
), blanked AS (
  SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS blank,
         substr(word, 1, i - 1) || substr(word, i + 1) AS short
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM blanked a JOIN blanked b ON a.blank = b.blank AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM blanked a JOIN words b ON a.short = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM blanked a JOIN words b ON a.short = b.word
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place,
         count(*) OVER (PARTITION BY word) AS n_near
  FROM near
), forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.other_n >= 2 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 2 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), chain AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS last FROM forms
    UNION ALL
    SELECT c.word, f.form FROM c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL
  ) SELECT c.word, c.last FROM c JOIN forms f ON f.word = c.last WHERE f.form IS NULL
)
SELECT word, n, n_near, form, form_n, last AS root FROM forms JOIN chain USING (word)
"""

OP12_SQL = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
  SELECT * FROM vectors
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  WITH RECURSIVE g AS (SELECT r, r AS seen FROM vectors UNION SELECT g.r, l.b FROM g JOIN links l ON l.a = g.seen)
  SELECT g.r, min(v.vec_id) AS component_id FROM g JOIN vectors v ON v.r = g.seen GROUP BY g.r
), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM vectors JOIN reach USING (r) LEFT JOIN degree ON a = r
"""

OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
  FROM documents
), measured AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, len(regexp_extract_all(t, '[A-Z]')) AS upper FROM texts
), flags AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
         + 4 * (100 * upper > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * e::INT AS mask
  FROM measured m LEFT JOIN flags f ON f.doc_id = m.doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY part, mask
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, s.range AS step, bits[s.range] AS bit, coalesce(list_sum(bits[1:s.range - 1]), 0)::INT AS before
  FROM orders, range(1, 6) s
), table_rows AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM table_rows
"""


@query("op11_spelling_variants", OP11_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


@query("op12_near_vectors", OP12_SQL)
def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_filter_audit", OP13_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)

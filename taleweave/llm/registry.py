"""Registered corpus queries: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from taleweave.llm import ann, chat, conversations, frames, hard_negatives, jaccard, mixing, packing, quality, scratch, sharding, sstable, suffix_dedup, toxicity, urltree


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2_jaccard_components, whose SQL has three columns, with each document's number of links."""
    return jaccard.near_duplicate_components(table(spark, sf_dir, "documents"), count_links=True).select("doc_id", "n_shingles", "component_id", "n_links")


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate_substrings(table(spark, sf_dir, "documents"))


def op5_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op7_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_amounts(table(spark, sf_dir, "documents"))


def op8_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.encode_and_read(table(spark, sf_dir, "documents"), scratch.new_path(spark, "sstable"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents")).drop("lang", *frames.KEY)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summary(*conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations"))))


def op12_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, F.col("id") % 7 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_posting_lists, op2_jaccard_components, op2_jaccard_links, op3_ring_shards, op4_suffix_dedup, op5_bin_completion, op6_perspective_rotation, op7_block_mixing, op8_sstable_shards, op9_path_templates, op10_distribution_divergence, op11_conversation_repair, op12_recurrent_toxicity, op13_norm_buckets)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_components": OP2_SQL, "op6_perspective_rotation": OP6_SQL, "op11_conversation_repair": OP11_SQL, "op13_norm_buckets": OP13_SQL}


OP6_SQL = r"""
WITH base AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS position
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker NOT IN ('system', 'tool')),
wide AS (
  SELECT b.*, perspective,
         CASE WHEN speaker IN ('system', 'tool') THEN '<|' || speaker || '|>' || chr(10)
              WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head
  FROM base b JOIN speakers s ON b.conv_id IS NOT DISTINCT FROM s.conv_id),
cut AS (SELECT *, head || text || chr(10) || '<|end|>' || chr(10) AS segment FROM wide),
laid AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY position) AS stop FROM cut)
SELECT conv_id, perspective, position,
       CASE WHEN speaker IN ('system', 'tool') THEN speaker WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
       speaker, segment, CAST(stop - length(segment) AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end",
       CAST(speaker = perspective AS INT) AS mask,
       CASE WHEN speaker = perspective THEN CAST(stop - length(segment) + length(head) AS BIGINT) END AS loss_start,
       CASE WHEN speaker = perspective THEN CAST(stop - 1 AS BIGINT) END AS loss_end
FROM laid
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * common >= 75 * (p.n + q.n - common)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM w
  UNION
  SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach r ON r.doc_id = w.doc_id GROUP BY w.doc_id
"""

OP13_SQL = r"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (
  SELECT anchor, other AS positive_id, score AS ps FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor, positive_id, other, ps, score, row_number() OVER (PARTITION BY p.anchor, positive_id ORDER BY score DESC, other) AS nth
  FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 100 * score BETWEEN 80 * ps AND 100 * ps)
SELECT anchor AS anchor_id, positive_id, CAST(nth AS INT) AS rank, other AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE nth <= 5
"""

OP11_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda crc, x: list_reduce(range(8), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)), xor(crc, x)), 4294967295)) % 20 AS h
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, range(2) t(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
ids AS (SELECT conv_id, row_number() OVER () AS id FROM (SELECT DISTINCT conv_id FROM c)),
r AS (
  SELECT id, turn, role, text, left(role, 1) AS initial, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS before
  FROM d JOIN ids ON d.conv_id IS NOT DISTINCT FROM ids.conv_id WINDOW w AS (PARTITION BY id ORDER BY turn NULLS FIRST, role, text)),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'none' END AS fault
  FROM r),
ins(state, "to", letters, lines) AS (VALUES ('', '', '', ''), ('', 'u', 'I', 'user:~'), ('', 'a', 'II', 'user:~assistant:~'), ('s', 's', '', ''), ('s', 'u', 'I', 'user:~'), ('s', 'a', 'II', 'user:~assistant:~'),
  ('u', 'u', '', ''), ('u', 'a', 'I', 'assistant:~'), ('u', 'u', 'II', 'assistant:~user:~'), ('a', 'a', '', ''), ('a', 'u', 'I', 'user:~'), ('a', 'a', 'II', 'user:~assistant:~')),
ops(edit, state, initial, price) AS (VALUES ('D', NULL, NULL, 4), ('K', '', 's', 0), ('K', '', 'u', 0), ('K', 's', 'u', 0), ('K', 'u', 'a', 0), ('K', 'a', 'u', 0),
  ('R', '', 'u', 3), ('R', 's', 'u', 3), ('R', 'u', 'a', 3), ('R', 'a', 'u', 3)),
moves AS (
  SELECT i.state, edit, coalesce(o.initial, i."to") AS "to", letters || edit AS letters, replace(lines, '~', chr(10)) AS lines, price + 3 * length(letters) AS price
  FROM ins i JOIN ops o ON o.state = i."to" OR edit = 'D'),
dp(id, state, pos, best) USING KEY (id, state) AS (
  SELECT id, '', CAST(0 AS BIGINT), {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''} FROM ids
  UNION
  SELECT p.id, m."to", f.pos, min({'cost': p.best.cost + m.price + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 3 ELSE 0 END, 'audit': p.best.audit || m.letters,
           'lines': p.best.lines || m.lines || CASE edit WHEN 'K' THEN f.role || ':' || f.text || chr(10)
                                                   WHEN 'R' THEN CASE m."to" WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text || chr(10) ELSE '' END})
  FROM dp p JOIN f ON f.id = p.id AND f.pos = p.pos + 1
  JOIN moves m ON m.state = p.state AND (edit <> 'K' OR m."to" = f.initial) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY p.id, m."to", f.pos),
ends AS (
  SELECT dp.id, min({'cost': best.cost + 3 * length(letters), 'audit': best.audit || letters, 'lines': best.lines || replace(i.lines, '~', chr(10))}) AS best
  FROM dp JOIN ins i ON i.state = dp.state AND (i."to" = 'a' OR dp.state = '' AND letters = '')
  WHERE dp.pos = coalesce((SELECT max(pos) FROM f WHERE f.id = dp.id), 0) GROUP BY dp.id),
sums AS (
  SELECT id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.cost AS cost, best.audit AS audit, sha256(left(best.lines, greatest(length(best.lines) - 1, 0))) AS repaired_sha256
FROM ids JOIN ends USING (id) LEFT JOIN sums USING (id)
"""

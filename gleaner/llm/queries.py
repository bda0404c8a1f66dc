"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, filter_audit, kneser_ney, langid, mixing, records, repair, simhash, spotsigs, topk, toxicity, warc
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], rows.schema)
    return chat.digests(rows.unionByName(own))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors.where(topk.every_nth(F.col("vec_id"), 50)), vectors, 5)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs, folds=5))
    return found.select("doc_id", (langid.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs, folds=10)
    found = kneser_ney.score(docs, model).withColumn("held_out", ~kneser_ney.trained(F.col("doc_id"), 10))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.words.tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_comparison(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "shards")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.classify(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), folds=4, held=2))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "passages", "evidence")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Language-ID, cross-parsing and file round trips have no SQL; neither have XXH64, tokenizers or seeded draws.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

FILTER_AUDIT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), d AS (
  SELECT part,
    CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS INTEGER)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INTEGER) AS mask,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM t
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM d GROUP BY part, mask
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (
  SELECT p AS filter_order FROM (SELECT a.f || b.f || c.f || d.f || e.f AS p FROM l a, l b, l c, l d, l e) WHERE len(list_distinct(string_split(p, ''))) = 5
), s AS (
  SELECT filter_order, step, CAST(1 << (ascii(filter_order[step]) - 65) AS INTEGER) AS own,
    CAST(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))) AS INTEGER) AS prior FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
    sum(CASE WHEN mask & (coalesce(prior, 0) | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & coalesce(prior, 0) = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & coalesce(prior, 0) <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & coalesce(prior, 0) = 0 AND mask & own <> 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & coalesce(prior, 0) = 0 AND mask & own <> 0 THEN x ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

#: The four states' best paths as a list, folded over a conversation's rows with whole audits and texts, without a trie.
REPAIR_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc
), k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), f AS (
  SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, b: xor(h >> 8, crc[(xor(h, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS fault FROM k, tab
), a AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM f WHERE fault <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS nr FROM a
), x AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nr) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY nr) || left(role, 1) AS pair FROM o
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list({'i': left(role, 1), 'gone': blank OR again, 'extra': CASE WHEN cut THEN 5 ELSE 0 END, 'r': role, 't': text} ORDER BY nr) AS l FROM x GROUP BY conv_id
), w AS (
  SELECT *, list_reduce(l, lambda v, y: list_transform(range(4), lambda z: list_sort(list_filter(flatten(list_transform(EXPANDED, lambda e: [
      {'s': e.s, 'c': e.c + 2, 'a': e.a || 'D', 't': e.t},
      {'s': CASE WHEN y.gone THEN 9 WHEN e.s = 2 THEN 3 ELSE 2 END, 'c': e.c + 1 + y.extra, 'a': e.a || 'R', 't': e.t || CASE WHEN e.s = 2 THEN 'assistant:' ELSE 'user:' END || y.t || chr(10)},
      {'s': CASE WHEN y.gone THEN 9 WHEN y.i = 's' AND e.s = 0 THEN 1 WHEN y.i = 'u' AND e.s <> 2 THEN 2 WHEN y.i = 'a' AND e.s = 2 THEN 3 ELSE 9 END, 'c': e.c + y.extra, 'a': e.a || 'K', 't': e.t || y.r || ':' || y.t || chr(10)}
    ])), lambda q: q.s = z AND q.c IS NOT NULL))[1]), [{'s': 0, 'c': 0, 'a': '', 't': ''}, NULL, NULL, NULL]) AS v FROM g
), e AS (
  SELECT *, list_sort(list_transform(list_filter(EXPANDED, lambda q: q.c IS NOT NULL AND q.s IN (0, 3)), lambda q: {'c': q.c, 'a': q.a, 't': q.t}))[1] AS b FROM w
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(regexp_replace(coalesce(b.t, ''), '\n\z', '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
""".replace("EXPANDED", """[
      {'s': 0, 'c': v[1].c, 'a': v[1].a, 't': v[1].t}, {'s': 2, 'c': v[1].c + 5, 'a': v[1].a || 'I', 't': v[1].t || 'user:' || chr(10)}, {'s': 3, 'c': v[1].c + 10, 'a': v[1].a || 'II', 't': v[1].t || 'user:' || chr(10) || 'assistant:' || chr(10)},
      {'s': 1, 'c': v[2].c, 'a': v[2].a, 't': v[2].t}, {'s': 2, 'c': v[2].c + 5, 'a': v[2].a || 'I', 't': v[2].t || 'user:' || chr(10)}, {'s': 3, 'c': v[2].c + 10, 'a': v[2].a || 'II', 't': v[2].t || 'user:' || chr(10) || 'assistant:' || chr(10)},
      {'s': 2, 'c': v[3].c, 'a': v[3].a, 't': v[3].t}, {'s': 3, 'c': v[3].c + 5, 'a': v[3].a || 'I', 't': v[3].t || 'assistant:' || chr(10)},
      {'s': 3, 'c': v[4].c, 'a': v[4].a, 't': v[4].t}, {'s': 2, 'c': v[4].c + 5, 'a': v[4].a || 'I', 't': v[4].t || 'user:' || chr(10)}]""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_token_records": op2_token_records,
        "op3_warc": op3_warc,
        "op4_chat_format": op4_chat_format,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_language_id": op6_language_id,
        "op7_kneser_ney": op7_kneser_ney,
        "op8_bpe": op8_bpe,
        "op9_spotsigs": op9_spotsigs,
        "op10_mixing": op10_mixing,
        "op11_toxicity": op11_toxicity,
        "op12_repair": op12_repair,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_top_k": TOP_K_SQL, "op12_repair": REPAIR_SQL, "op13_filter_audit": FILTER_AUDIT_SQL}

"""The queries of this subpackage's operators, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import chat, decontamination, language, neighbours, ngram_join, packing, pii, quality, substrings, toxicity
from tessel.llm.common import fold, read


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read(spark, sf_dir, "conversations"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), packing.tokenizer_path(spark))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.by_text(substrings.repeated_passages(read(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    spans = F.concat_ws(",", F.transform("offences", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", spans.alias("offences"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_packing": op2_packing,
    "op3_neighbours": op3_neighbours,
    "op4_pii": op4_pii,
    "op5_ngram_join": op5_ngram_join,
    "op6_decontamination": op6_decontamination,
    "op7_substrings": op7_substrings,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op1_chat": r"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position FROM d),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY position) AS turns FROM p GROUP BY conv_id),
prefixes AS (SELECT DISTINCT n, turns FROM (SELECT k AS n, turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM c))),
kept AS (SELECT min(conv_id) AS conv_id, n FROM c WHERE NOT EXISTS (SELECT 1 FROM prefixes q WHERE q.n = c.n AND q.turns = c.turns) GROUP BY n, turns)
SELECT p.conv_id, CAST((position - 1) // 64 AS INTEGER) AS part, kept.n AS n_turns,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY position) AS rendered
FROM p JOIN kept ON p.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY p.conv_id, (position - 1) // 64, kept.n
""",
    "op5_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
cells AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM cells a JOIN cells b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach AS (
  SELECT doc_id, doc_id AS r FROM sets
  UNION
  SELECT reach.doc_id, both_ways.v FROM reach JOIN both_ways ON reach.r = both_ways.u)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = sets.doc_id) AS component_id FROM sets
""",
}

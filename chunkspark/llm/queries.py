"""Queries over whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard, langid, licenses, packing, quality, tokencount, topk, toxicity
from .shared import new_path

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(_table(spark, sf_dir, "documents")).drop("first", "one", "two")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = TOKENIZER) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), tokencount.Tokenizer(vocabulary), new_path(spark, "token-cache"))


def token_counts_warm(spark: SparkSession, sf_dir: str, vocabulary: str = TOKENIZER) -> DataFrame:
    """The counts again, once the cache holds all: no text is encoded or shuffled."""
    docs, tokenizer, cache = _table(spark, sf_dir, "documents"), tokencount.Tokenizer(vocabulary), new_path(spark, "token-cache")
    tokencount.count_tokens(docs, tokenizer, cache)
    return tokencount.count_tokens(docs, tokenizer, cache)


def pack_tokens(docs: DataFrame, vocabulary: str = TOKENIZER) -> DataFrame:
    """Windows of 2,048 of the tokenizer's tokens."""
    return packing.pack(tokencount.direct_counts(docs, tokencount.Tokenizer(vocabulary)), F.col("tokens"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(_table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 50 against all rows."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), 10, queries=F.col("vec_id") % 50 == 0)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no file names: each lies in source/lang/thousand of its id, and those of up to 400 characters that speak of a license stand for the license files."""
    short = (F.length("text") <= 400) & F.col("text").rlike("(?i)licen[cs]e")
    name = F.when(short, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    folder = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"))
    return licenses.scan(_table(spark, sf_dir, "documents"), F.concat_ws("/", folder, name))


TOPK_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
s AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_inner_product(a.e, b.e), 6) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank FROM s)
SELECT vec_id, rank, neighbor_id, score FROM r WHERE rank <= 10
"""

CHAT_SQL = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '<(\\*)\|', '<\\\1|', 'g') AS role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
marked AS (
  SELECT *, row_number() OVER w AS k, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS begins
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY conv_id ORDER BY k) AS m FROM marked),
messages AS (
  SELECT conv_id, m, count(*) AS n, '<|' || min(role) || '|>' || chr(10) || string_agg(text, chr(10) ORDER BY k) || '<|end|>' || chr(10) AS message
  FROM numbered GROUP BY conv_id, m)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_turns, count(*) AS n_messages, string_agg(message, '' ORDER BY m) AS chat
FROM messages GROUP BY conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_topk": op7_topk,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "token_counts_warm": token_counts_warm,
}
ORACLES: dict[str, str] = {"op7_topk": TOPK_SQL, "op8_chat_formatting": CHAT_SQL}

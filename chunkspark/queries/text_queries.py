"""Text functions, fingerprints and caches over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import cache
from ..sources.documents import corpus_fingerprint, from_table, proxy_sample
from . import query, table

TOKENS = r"""regexp_extract_all(text, '(\s+|[.,!?;:''"()\[\]{}]|[^\s.,!?;:''"()\[\]{}]+)', 1)"""
COUNT = r"""CAST(len(regexp_extract_all({}, '[.,!?;:''"()\[\]{{}}]|[^\s.,!?;:''"()\[\]{{}}]+')) AS BIGINT)"""
NORMAL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
#: (doc_id, i, s): sentences, numbered from 0
SENTENCES = r"""
stripped AS (SELECT doc_id, trim(text, E' \n\t\r') AS text FROM documents),
cut AS (SELECT doc_id, regexp_extract_all(text, '(?s)(.*?[.!?]\s+|.+$)', 1) AS p FROM stripped),
pieces AS (SELECT doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS k FROM cut),
closed AS (
  SELECT *, CASE WHEN regexp_matches(rtrim(piece, E' \n\t\r'), '(?s)([\w\pL\pN]\.[\w\pL\pN].|[A-Z][a-z]\.|[A-Z]\.)$') THEN 0 ELSE 1 END AS ends FROM pieces),
groups AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM closed),
joined AS (SELECT doc_id, g, trim(string_agg(piece, '' ORDER BY k), E' \n\t\r') AS s FROM groups GROUP BY doc_id, g),
sentences AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS i, s
  FROM joined WHERE s <> '')
"""


@query(f"SELECT doc_id, {COUNT.format('text')} AS n_tokens FROM documents")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


@query(f"SELECT doc_id, CAST(unnest(generate_series(0, len(t) - 1)) AS INTEGER) AS i, unnest(t) AS token FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def get_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("i", "token"))


@query(f"SELECT doc_id, array_to_string({TOKENS}, '') AS text FROM documents")
def decode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.detokenize(T.tokens(F.col("text"))).alias("text"))


@query(f"WITH {SENTENCES} SELECT doc_id, i, s FROM sentences")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))


@query(r"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, '|')) AS h FROM (SELECT doc_id, regexp_extract_all(text, '(\s+|\S+)', 1) AS t FROM documents)")
def whitespace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.whitespace_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, "|")).alias("h"))


@query(rf"SELECT doc_id, {COUNT.format('text')} AS by_token, length(text) AS by_char, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS by_word FROM documents")
def length_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(T.length_by(F.col("text"), m).alias(f"by_{m}") for m in ("token", "char", "word")))


@query(f"SELECT doc_id, {NORMAL.format('text')} AS text FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalized(F.col("text")).alias("text"))


@query(r"""WITH b AS (SELECT page_id, '```html' || chr(10) || html || '```' || chr(10) || '```' || chr(10) || url || '```' AS t FROM pages)
SELECT page_id, CAST(2 AS INTEGER) AS n_blocks, 'html' AS language, CAST(0 AS INTEGER) AS first_start, CAST(length(t) AS INTEGER) AS last_end FROM b""")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences around each page and its address."""
    fenced = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("```html\n"), "html", F.lit("```\n```\n"), "url", F.lit("```")).alias("t"))
    found = fenced.withColumn("b", T.code_blocks(F.col("t")))
    return found.select("page_id", F.size("b").alias("n_blocks"), F.col("b")[0]["language"].alias("language"), F.col("b")[0]["start"].alias("first_start"), F.element_at("b", -1)["end"].alias("last_end"))


@query(f"SELECT doc_id, length(text) AS n, CAST(list_sum(list_transform(t, lambda x, i: (i - 1) * length(x))) AS BIGINT) AS total FROM (SELECT doc_id, text, {TOKENS} AS t FROM documents)")
def char_to_token_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.token_of_character(T.tokens(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", m.alias("m")).select("doc_id", F.size("m").cast("bigint").alias("n"), F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").cast("bigint").alias("doc_id"), "hash")


@query("SELECT sha256(string_agg(h, '' ORDER BY h)) AS corpus_hash FROM (SELECT sha256(text) AS h FROM documents)")
def fingerprint_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_fingerprint(from_table(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query("""WITH n AS (SELECT greatest(2, CAST(floor(count(*) * 10 / 100) AS BIGINT)) AS k FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), CAST(doc_id AS VARCHAR)) AS r FROM documents)
SELECT doc_id FROM r, n WHERE r <= k""")
def proxy_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = from_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    return proxy_sample(docs, percent=10, seed=42).select(F.col("id").cast("bigint").alias("doc_id"))


@query("SELECT DISTINCT sha256(d.text) AS hash FROM documents d WHERE sha256(d.text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that aren't cached yet, where the labelled ones are."""
    docs = table(spark, sf_dir, "documents").withColumn("hash", T.content_hash(F.col("text")))
    cached = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("hash")
    return cache.misses(docs, cached, "hash").select("hash").distinct()


@query("SELECT page_id, html AS raw_text FROM pages")
def html_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("raw_text"))

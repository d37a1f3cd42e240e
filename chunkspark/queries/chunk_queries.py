"""Chunking operators over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunkers as C
from ..sources.documents import html_to_text
from . import query, table
from .text_queries import COUNT, SENTENCES, TOKENS

SHOWN = ["doc_id", "chunk_index", "text", "token_count"]


def _shown(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("doc_id").cast("bigint").alias("doc_id"), "chunk_index", "text", "token_count")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def fixed_sql(base: int, overlap: int, last: str = "len(t) - 1") -> str:
    step = base - overlap
    return f"""SELECT doc_id, CAST(o / {step} AS INTEGER) AS chunk_index, array_to_string(list_slice(t, o + 1, o + {base}), '') AS text,
  CAST(least({base}, len(t) - o) AS INTEGER) AS token_count
FROM (SELECT doc_id, t, unnest(generate_series(0, {last}, {step})) AS o FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE len(t) > 0)"""


@query(fixed_sql(512, 64))
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.fixed_length(_docs(spark, sf_dir), 512, 64))


SWEEP = [(256, 0.1), (256, 0.2), (512, 0.1), (512, 0.2)]


@query(" UNION ALL ".join(f"SELECT '{b}|{r}' AS cand, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS n_tokens FROM ({fixed_sql(b, int(b * r))})" for b, r in SWEEP))
def chunk_fixed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by overlap ratios."""
    docs, out = _docs(spark, sf_dir), None
    for b, r in SWEEP:
        one = C.fixed_length(docs, b, int(b * r)).agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens")).select(F.lit(f"{b}|{r}").alias("cand"), "n_chunks", "n_tokens")
        out = one if out is None else out.unionByName(one)
    return out


@query(fixed_sql(512, 64, "CAST(greatest(0, ceil((len(t) - 512) / 448.0)) * 448 AS BIGINT)"))
def chunk_token_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.token_windows(_docs(spark, sf_dir), 512, 64))


@query(f"WITH {SENTENCES} SELECT doc_id, i AS chunk_index, s AS text, CAST({COUNT.format('s')} AS INTEGER) AS token_count FROM sentences")
def chunk_proposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.proposition(_docs(spark, sf_dir)))


@query(f"""WITH {SENTENCES}, g AS (SELECT doc_id, CAST(i // 5 AS INTEGER) AS chunk_index, string_agg(s, ' ' ORDER BY i) AS text FROM sentences GROUP BY ALL)
SELECT doc_id, chunk_index, text, CAST({COUNT.format("text")} AS INTEGER) AS token_count FROM g""")
def chunk_agentic_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.agentic_every(_docs(spark, sf_dir)))


@query()
def chunk_sentence_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.sentence_aware(_docs(spark, sf_dir), 512, 64))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.recursive_character(_docs(spark, sf_dir), 512, 64))


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.semantic_local(_docs(spark, sf_dir)))


@query()
def chunk_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.hybrid_semantic_stat(_docs(spark, sf_dir)))


@query()
def chunk_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.parent_child(_docs(spark, sf_dir)).select("doc_id", "chunk_id", "chunk_index", "text", F.col("meta")["parent_id"].alias("parent_id"))


@query()
def chunk_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.layout_aware(_docs(spark, sf_dir)))


@query()
def chunk_contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.contextual_retrieval(_docs(spark, sf_dir)))


@query()
def chunk_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.html_section(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))))


@query()
def html_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_to_text(table(spark, sf_dir, "pages")).select("page_id", "text")


@query()
def chunk_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.python_ast(_docs(spark, sf_dir)))


@query()
def bridge_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.langchain_recursive(_docs(spark, sf_dir)))


@query()
def bridge_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.langchain_character(_docs(spark, sf_dir)))


@query()
def bridge_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.langchain_markdown(_docs(spark, sf_dir)))


@query()
def bridge_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.langchain_python(_docs(spark, sf_dir)))


@query()
def bridge_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.langchain_html(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))))


@query()
def bridge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.langchain_json(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("text"))))

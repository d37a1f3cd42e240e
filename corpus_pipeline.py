"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and reads whole texts. All but the last
return the columns that they got. Rows with null ids and documents without a decision against them stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkspark.llm import decontam, jaccard, langid, quality
from chunkspark.llm.queries import pack_tokens
from chunkspark.llm.shared import materialize, quoted, small_side


def _accepted(docs: DataFrame, decide: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Rows that the operator accepts; under neutral names, since its own columns could clash with others."""
    neutral = {c: c if c in ("doc_id", "text") else f"__{k}" for k, c in enumerate(docs.columns)}
    kept = decide(docs.select(*(quoted(c).alias(n) for c, n in neutral.items())), list(neutral.values())).where("accepted")
    return kept.select(*(F.col(n).alias(c) for c, n in neutral.items()))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without these ids; their list is written, then broadcast if it is small and shuffled if not."""
    gone = materialize(ids.select(F.col(ids.columns[0]).alias("doc_id")).distinct(), "ids")
    return docs.join(small_side(gone), "doc_id", "left_anti").select(*(quoted(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, or that are too short to tell; texts without a letter go."""
    prototypes = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return _accepted(docs, lambda d, keep: langid.identify(d, prototypes, keep=keep))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _accepted(docs, lambda d, keep: quality.score(d, model, keep=keep))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the lowest id of each class of near copies, which pairs of a Jaccard similarity of 0.5 connect.

    Rows with null ids stay, as do texts without words. Of equal rows one stays; of rows with one id whose texts have the
    same n-grams that with the lowest JSON; different texts with one id each stand for themselves.
    """
    classes = materialize(jaccard.similarity_classes(docs), "classes")
    repeated = materialize(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    kept = _without(docs, classes.where("not first").select("doc_id").unionByName(repeated))
    if repeated.isEmpty():
        return kept
    # ids with several rows: one row of each text that is the first of its class
    neutral = [f"__{k}" for k in range(len(docs.columns))]
    again = docs.join(small_side(repeated), "doc_id", "left_semi").select(*map(quoted, docs.columns)).toDF(*neutral)
    named = {c: n for c, n in zip(docs.columns, neutral, strict=True)}
    hashed = jaccard.digest_rows(again, named["doc_id"], named["text"])
    once = hashed.groupBy(named["doc_id"], "one", "two").agg(F.min_by(F.struct(*neutral), F.to_json(F.struct(*neutral))).alias("r"))
    first = classes.where("first").select(F.col("doc_id").alias(named["doc_id"]), "one", "two")
    once = once.join(first, [named["doc_id"], "one", "two"], "left_semi").select(*(F.col(f"r.{n}").alias(c) for c, n in named.items()))
    return kept.unionByName(once)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with other numbers, names and units."""
    return _without(docs, decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of at most 2,048 tokens; null texts count none, null ids and repeated rows are packed each."""
    return pack_tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", language),
    ("quality classifier", good),
    ("n-gram jaccard join", single),
    ("benchmark decontamination", uncontaminated),
    ("packing", windows),
]
#: Trained models and approximate joins have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs

"""Token counts with a digest cache.

A text's key is the SHA-256 of its normalised content; a tokenizer's is the SHA-256 of its kind and vocabulary file.
Counts that the cache holds are joined; only the distinct texts it misses are encoded, once each, and appended to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_text, materialize, quoted, small_side

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE = re.compile(r"\S(?= \S)")
CACHE = "tokenizer string, digest binary, tokens bigint"


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file on a path that every executor has: kind is tiktoken, tokenizers or sentencepiece."""

    path: str
    kind: str = "tiktoken"
    pattern: str = PATTERN

    def version(self) -> str:
        return hashlib.sha256(b"\0".join((self.kind.encode(), self.pattern.encode(), Path(self.path).read_bytes()))).hexdigest()

    def counter(self):
        """A function from a list of texts to their token counts; special tokens' strings are ordinary text."""
        if self.kind == "tiktoken":
            import tiktoken

            with open(self.path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            if self.pattern != PATTERN:
                return lambda texts: [len(own.encode_ordinary(t)) for t in texts]
            return lambda texts: [sum(len(own.encode_ordinary(p)) for p in safe_pieces(t)) for t in texts]
        if self.kind == "tokenizers":
            from tokenizers import Tokenizer as Loaded

            loaded = Loaded.from_file(self.path)
            loaded.encode_special_tokens = True
            return lambda texts: [len(e) for e in loaded.encode_batch(texts, add_special_tokens=False)]
        if self.kind == "sentencepiece":
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=self.path)
            return lambda texts: [len(e) for e in pieces.encode(texts, num_threads=1)]
        raise ValueError(f"unknown kind of tokenizer: {self.kind}")


def safe_pieces(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The text in pieces of about ``most`` characters, cut where PATTERN starts a token in any case: before a single blank between two characters that aren't white space."""
    start = 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most - 1)
        if cut is None:
            break
        yield text[start : cut.start() + 1]
        start = cut.start() + 1
    yield text[start:]


def normalised(text: Column) -> Column:
    """Content without byte-order mark and with line feeds alone as line ends."""
    return F.replace(F.replace(F.replace(text, F.lit("﻿"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, tokens) that the cache holds for one tokenizer version; none if there is no cache yet. Rows that retried appends repeat count once."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "digest binary, tokens bigint")
    return spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("tokens").alias("tokens"))


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text: (id, digest, tokens, cached); ``cached`` tells whether the count was stored before this call.

    A null text has a null digest and null tokens; an empty one has 0. Every row gives a row: null ids and repeated rows
    stay, rows of equal content share one count, other columns are ignored; an empty table gives an empty table and leaves
    the cache as it is. Texts of any length are encoded whole. One text is encoded for each digest that the cache lacks, that of the lowest id.

    Up to half a million missing digests travel to the texts, which then aren't shuffled; more are joined by a shuffle.
    """
    spark, version = docs.sparkSession, tokenizer.version()
    text = normalised(quoted(text_col))
    keyed = docs.select(quoted(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    thin = materialize(keyed, "digests")
    stored = read_cache(spark, cache, version)
    each = thin.where("digest is not null").groupBy("digest", "id").agg(F.count("*").alias("n"))
    first = each.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "n")).alias("f")).select("digest", "f.id", "f.n")
    missing = materialize(first.join(stored, "digest", "left_anti"), "missing")
    texts = docs.select(quoted(id_col).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    def of(wanted: DataFrame) -> DataFrame:
        wanted = small_side(wanted.select("digest", "id"), 500_000)
        return texts.join(wanted, (texts["digest"] == wanted["digest"]) & texts["id"].eqNullSafe(wanted["id"]), "left_semi").select("digest", "text")

    picked, repeated = of(missing.where("n = 1")), missing.where("n > 1")
    if not repeated.isEmpty():  # rows of one id and text: any of them will do
        picked = picked.unionByName(of(repeated).groupBy("digest").agg(F.min("text").alias("text")))
    encoded = map_text(picked, ["digest"], "text", lambda: _encode(tokenizer), "tokens bigint", lower=False)
    fresh = materialize(encoded, "counts")
    known = stored.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))
    known = materialize(known.join(thin.select("digest").distinct(), "digest", "left_semi"), "known")  # before the append: the cache that this call found
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "tokens").write.mode("append").parquet(cache)
    return thin.join(known, "digest", "left").select(F.col("id").alias(id_col), F.lower(F.hex("digest")).alias("digest"), "tokens", "cached")


def _encode(tokenizer: Tokenizer) -> Callable[[pa.Array], list]:
    count = tokenizer.counter()
    return lambda texts: [pa.array(count(texts.to_pylist()), pa.int64())]


def direct_counts(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens) of every row in one pass, without a cache or a shuffle; a null text has null tokens."""

    named = docs.select(quoted(id_col).alias("id"), normalised(quoted(text_col)).alias("text")).withColumn("null", F.col("text").isNull())
    counted = map_text(named, ["id", "null"], "text", lambda: _encode(tokenizer), "tokens bigint", lower=False)
    return counted.select(F.col("id").alias(id_col), F.when(~F.col("null"), F.col("tokens")).alias("tokens"))

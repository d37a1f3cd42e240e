"""Vector functions and the hashing embedding, as Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.folder import materialize, small_batches
from .text import word_list


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, added in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bucket(word: Column, dim: int) -> Column:
    """Coordinate of a word: its MD5, as a number, modulo ``dim``, which divides 256."""
    if 256 % dim:
        raise ValueError("dim must divide 256 here; use embed.hashing_arrow for others")
    return F.conv(F.substring(F.md5(word), 31, 2), 16, 10).cast("int") % dim


def sign(word: Column) -> Column:
    """1 if the second lowest bit of the word's MD5 is set, else -1."""
    return F.when(F.conv(F.substring(F.md5(word), 31, 2), 16, 10).cast("int").bitwiseAND(2) != 0, 1.0).otherwise(-1.0)


def hashing_sparse(df: DataFrame, id_col: str, text: Column, dim: int = 256) -> DataFrame:
    """Unit hashing vectors as rows (id, idx, v) of their coordinates other than 0; a text whose vector is 0 has no row.

    Rows with one id count as one text. Only these are shuffled, the others stay in their tasks.
    """
    named = df.select(id_col, text.alias("__text"))
    single, repeated = split_repeated(named, id_col)
    rows = _sparse_rows(single, id_col, dim)
    return rows if repeated is None else rows.unionByName(_sparse_shuffled(repeated, id_col, F.col("__text"), dim))


def split_repeated(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose id is theirs alone, rows of repeated ids or None)."""
    again = materialize(df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(F.col(id_col).alias("__id")), "repeated")
    if again.isEmpty():
        return df, None
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


_OTHER_BLANKS = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def words(low: str) -> list[str]:
    """Words of a text as in word_list, which knows fewer blanks than str.split."""
    return [w for w in _BLANKS.split(low) if w] if _OTHER_BLANKS.search(low) else low.split()


def hashing_dense(df: DataFrame, id_col: str, text: Column, dim: int = 256) -> DataFrame:
    """The same as rows (id, vec); a text whose vector is 0 has one of zeros, unless its id is repeated."""
    single, repeated = split_repeated(df.select(id_col, text.alias("__text")), id_col)

    def made(ids: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        flat = (sums / np.where(norm > 0, norm, 1)).ravel()
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, np.int32)), pa.array(flat))], [id_col, "vec"])

    rows = _hashed(single, id_col, dim, made, "vec array<double>")
    return rows if repeated is None else rows.unionByName(dense(_sparse_shuffled(repeated, id_col, F.col("__text"), dim), id_col, dim))


def _sparse_rows(df: DataFrame, id_col: str, dim: int) -> DataFrame:
    def made(ids: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        row, idx = np.nonzero(sums)
        v = sums[row, idx] / np.sqrt((sums * sums).sum(1))[row]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(idx.astype(np.int32)), pa.array(v)], [id_col, "idx", "v"])

    return _hashed(df, id_col, dim, made, "idx int, v double")


def _hashed(df: DataFrame, id_col: str, dim: int, made: Callable[[pa.Array, np.ndarray], pa.RecordBatch], ddl: str) -> DataFrame:
    """What is made of ids and their texts' signed counts, some texts at a time."""
    if 256 % dim:
        raise ValueError("dim must divide 256 here; use embed.hashing_arrow for others")
    from ..operators.splitters import word_sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                yield made(part.column(0), word_sums([words(t or "") for t in part.column(1).to_pylist()], dim))

    small_batches(df.sparkSession)
    schema = StructType([df.schema[id_col], *StructType.fromDDL(ddl).fields])
    return df.select(id_col, F.lower("__text").alias("__text")).mapInArrow(run, schema)


def _sparse_shuffled(df: DataFrame, id_col: str, text: Column, dim: int) -> DataFrame:
    words = df.select(id_col, F.explode(word_list(F.lower(text))).alias("w"))
    # one row for each distinct word of a text, before the hash and the sum
    distinct = words.groupBy(id_col, "w").agg(F.count("*").alias("n"))
    raw = distinct.select(id_col, bucket(F.col("w"), dim).alias("idx"), (sign(F.col("w")) * F.col("n")).alias("s")).groupBy(id_col, "idx").agg(F.sum("s").alias("s"))
    packed = raw.where("s <> 0").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "s"))).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x["s"] * x["s"]))
    return packed.select(id_col, norm.alias("norm"), F.explode("e").alias("e")).select(id_col, "e.idx", (F.col("e.s") / F.col("norm")).alias("v"))


def dense(df: DataFrame, id_col: str, dim: int = 256) -> DataFrame:
    """Sparse rows (id, idx, v) as (id, vec), arrays of ``dim`` numbers."""

    @F.pandas_udf("array<double>")
    def fill(idx: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros((len(idx), dim))
        if len(idx):
            out[np.repeat(np.arange(len(idx)), idx.map(len)), np.concatenate(idx.to_numpy())] = np.concatenate(v.to_numpy())
        return pd.Series(list(out))

    packed = df.groupBy(id_col).agg(F.collect_list(F.struct("idx", "v")).alias("e"))
    return packed.select(id_col, fill(F.col("e.idx"), F.col("e.v")).alias("vec"))

"""Exact top-k search by cosine: tiled matrix products, partial selection in each tile, tree merging of the lists.

Vectors are packed into shards of some megabytes, which stay where they are. Queries travel to them in blocks of bounded
bytes, one pass over the shards for each block; a task keeps each query's best k of its shards, tile by tile, and
the tasks' lists are merged ``fan`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, new_path, quoted, small_batches, small_side

LISTS = "q int, part int, ids binary, neighbors binary, scores binary"
LIST_ROWS = 8192  # queries whose lists are one row


def best(row: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row, by falling score and then by id, sorted by row."""
    order = np.lexsort((ident, -score, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return order[place < k]


def tile_search(qid: np.ndarray, q: np.ndarray, sid: np.ndarray, s: np.ndarray, k: int, rows: int = 512, columns: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, neighbor id, score rounded to 6 places) of each query's k best; a row isn't its own neighbor."""
    parts = []
    for a in range(0, len(q), rows):
        block, own = q[a : a + rows], qid[a : a + rows]
        row, near, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(len(block), -np.inf)
        for b in range(0, len(s), columns):
            product = block @ s[b : b + columns].T
            if b == 0 and product.shape[1] > k + 1:  # one more: the row itself may be among them
                floor = np.partition(product, product.shape[1] - k - 1, axis=1)[:, product.shape[1] - k - 1]
            r, c = np.nonzero(product >= floor[:, None] - 2e-6)
            value, ident = np.round(product[r, c], 6), sid[b + c]
            other = ident != own[r]
            row, near, score = np.concatenate((row, r[other])), np.concatenate((near, ident[other])), np.concatenate((score, value[other]))
            keep = best(row, score, near, k)
            row, near, score = row[keep], near[keep], score[keep]
            full = np.bincount(row, minlength=len(block)) >= k
            last = np.searchsorted(row, np.arange(len(block)), "right") - 1
            floor = np.where(full, np.maximum(floor, score[last] if len(score) else -np.inf), floor)
        parts.append((row + a, near, score))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(vectors: DataFrame, width: int, kind: str, most: int = 4 << 20) -> DataFrame:
    """(ids, v): shards of about ``most`` bytes from rows (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, rows = [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["ids", "v"])

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("id").to_numpy().astype(np.int64))
                parts.append(batch.column("v").flatten().to_numpy().astype(kind))
                rows += batch.num_rows
            if rows * width * np.dtype(kind).itemsize >= most:
                yield shard()
                ids, parts, rows = [], [], 0
        if rows:
            yield shard()

    return small_batches(vectors, most).select("id", "v").mapInArrow(run, "ids binary, v binary")


def top_k(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None, block_bytes: int = 32 << 20, fan: int = 8, dim: int | None = None) -> DataFrame:
    """The k nearest other rows of every query by cosine: (id, rank from 1, neighbor_id, score to 6 places).

    ``queries`` tells which rows are queries (all if not given; false where it is null); every row is a possible
    neighbor. Ties go to the lower id; fewer than k other rows give shorter lists. A null id, a null, empty or zero
    vector, one with a null or non-finite element, and one whose length differs from ``dim`` (the longest if not given)
    are neither queries nor neighbors. Repeated rows count once; of different vectors with one id the smallest array
    counts, and the id is a query if one of its rows is. Ids are integers. Other columns are ignored; an empty table, or
    one without queries, gives an empty table.

    No vector is shuffled unless its id is repeated; queries are collected and sent in blocks of about ``block_bytes``.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    wanted = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    named = vectors.select(quoted(id_col).cast("bigint").alias("id"), quoted(vector_col).alias("v"), wanted.alias("query")).where("id is not null and size(v) > 0")
    clean = named.where("forall(v, x -> x is not null and not isnan(x) and abs(double(x)) < double('Infinity')) and exists(v, x -> x <> 0)")
    repeated = materialize(clean.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if repeated.isEmpty():
        single = clean
    else:
        again = clean.join(small_side(repeated), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"), F.max("query").alias("query"))
        single = clean.join(small_side(repeated), "id", "left_anti").unionByName(again)
    width = dim or single.agg(F.max(F.size("v")).alias("dim")).first().dim or 1
    single = single.where(F.size("v") == width)
    element = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    shards = materialize(_pack(single, width, element), "shards")
    asked = single.where("query")
    blocks = max(1, -(-asked.count() * width * 8 // block_bytes))
    path = new_path(spark, "queries")
    asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).write.partitionBy("block").parquet(path)
    asked = spark.read.schema(f"id bigint, v array<{'float' if element == '<f4' else 'double'}>, block bigint").parquet(path)
    found = None
    for b in range(blocks):
        one = _one_block(asked.where(F.col("block") == b).select("id", "v"), shards, k, width, element, fan)
        if blocks > 1:  # one block's queries and lists at a time
            one = materialize(one, "found")
        found = one if found is None else found.unionByName(one)
    return found.select(F.col("id").cast(kind).alias(id_col), "rank", F.col("neighbor_id").cast(kind).alias("neighbor_id"), "score")


def _one_block(asked: DataFrame, shards: DataFrame, k: int, width: int, element: str, fan: int) -> DataFrame:
    table = asked.toArrow()  # at most about block_bytes
    ids = table["id"].to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    flat = np.concatenate([np.zeros(0, element), *(c.flatten().to_numpy() for c in table["v"].chunks)]).astype(element)
    sent = asked.sparkSession.sparkContext.broadcast((ids[order], flat.reshape(-1, width)[order]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, raw = sent.value
        if not len(qid):
            return
        q = _unit(raw)
        row, near, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for packed, v in zip(batch.column("ids").to_pylist(), batch.column("v").to_pylist(), strict=True):
                found = tile_search(qid, q, np.frombuffer(packed, np.int64), _unit(np.frombuffer(v, element).reshape(-1, width)), k)
                row, near, score = (np.concatenate(x) for x in zip((row, near, score), found, strict=True))
                keep = best(row, score, near, k)
                row, near, score = row[keep], near[keep], score[keep]
        part = TaskContext.get().partitionId()
        for a in range(0, len(qid), LIST_ROWS):
            lo, hi = np.searchsorted(row, (a, a + LIST_ROWS))
            yield packed_lists(a // LIST_ROWS, part, qid[row[lo:hi]], near[lo:hi], score[lo:hi]).to_batches()[0]

    def packed_lists(q: int, part: int, ids: np.ndarray, near: np.ndarray, score: np.ndarray) -> pa.Table:
        return pa.table({"q": pa.array([q], pa.int32()), "part": pa.array([part], pa.int32()), "ids": [ids.tobytes()], "neighbors": [near.tobytes()], "scores": [score.tobytes()]})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        qid, near, score = (np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in (("ids", np.int64), ("neighbors", np.int64), ("scores", np.float64)))
        keep = best(qid, score, near, k)
        return packed_lists(key[0].as_py(), key[1].as_py(), qid[keep], near[keep], score[keep])

    lists, parts = shards.mapInArrow(search, LISTS), shards.rdd.getNumPartitions()
    while parts > 1:
        lists = lists.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("q", "part").applyInArrow(merge, LISTS)
        parts = -(-parts // fan)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid = np.frombuffer(row["ids"], np.int64)
                first = np.concatenate(([True], qid[1:] != qid[:-1])) if len(qid) else np.zeros(0, bool)
                rank = np.arange(len(qid)) - np.maximum.accumulate(np.where(first, np.arange(len(qid)), 0)) + 1
                arrays = [qid, rank.astype(np.int32), np.frombuffer(row["neighbors"], np.int64), np.frombuffer(row["scores"], np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["id", "rank", "neighbor_id", "score"])

    return lists.mapInArrow(unpack, "id bigint, rank int, neighbor_id bigint, score double")

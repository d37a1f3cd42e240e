"""Packing of texts into windows by Karmarkar-Karp multiway differencing.

Texts are dealt by hash into shards of bounded size. A shard starts with as many windows as its tokens need. Each text
is a partial partition with one filled window; the two partial partitions with the largest differences between
their fullest and emptiest windows are merged, fullest with emptiest, until one is left. If its fullest window exceeds
the capacity, the shard takes more windows and starts again.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, quoted


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window of each item: Karmarkar-Karp differencing into k near-equal windows. Ties go by position."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, np.int64)
    left, right = [np.full(n, -1, np.int64)], [np.full(n, -1, np.int64)]
    made = n
    # a node: (sums of its filled windows, falling; the tree node of each)
    nodes = {i: (sizes[i : i + 1].astype(np.int64), np.array([i])) for i in range(n)}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        a_sum, a_id = nodes.pop(heapq.heappop(heap)[1])
        b_sum, b_id = nodes.pop(heapq.heappop(heap)[1])
        over = len(a_sum) + len(b_sum) - k
        if over <= 0:
            total, ident = np.concatenate((a_sum, b_sum)), np.concatenate((a_id, b_id))
        else:  # the smallest windows of one side meet the largest of the other
            b_sum, b_id = b_sum[::-1], b_id[::-1]
            at = k - len(b_sum)  # windows of a beyond this one meet windows of b
            total = np.concatenate((a_sum, np.zeros(k - len(a_sum), np.int64)))
            total[at:] += b_sum
            ident = np.concatenate((a_id, np.full(k - len(a_id), -1)))
            mine = ident[at:]
            both = mine >= 0
            left.append(mine[both]), right.append(b_id[both])
            merged = np.where(both, made + np.cumsum(both) - 1, b_id)
            ident[at:] = merged
            made += int(both.sum())
        order = np.argsort(-total, kind="stable")
        total, ident = total[order], ident[order]
        nodes[serial] = (total, ident)
        least = int(total[-1]) if len(total) == k else 0
        heapq.heappush(heap, (least - int(total[0]), serial))
        serial += 1
    _, roots = nodes[heap[0][1]]
    window = np.zeros(made, np.int64)
    window[roots] = np.arange(len(roots))
    stop = made
    for a, b in zip(reversed(left[1:]), reversed(right[1:]), strict=True):
        own = window[stop - len(a) : stop]
        window[a], window[b] = own, own
        stop -= len(a)
    return window[:n]


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item of at most ``capacity``; the number of windows rises until none is over it."""
    if len(sizes) == 0:
        return np.zeros(0, np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, k)
        fullest = np.bincount(window, weights=sizes).max()
        if fullest <= capacity:
            return window
        # as many windows as fit if the fullest is as far above the mean again; one more at least
        k = max(k + 1, -(-int(sizes.sum()) // max(1, int(capacity - fullest + sizes.sum() / k))))


def pack(docs: DataFrame, tokens: Column, id_col: str = "doc_id", capacity: int = 2048, shard_rows: int = 2048) -> DataFrame:
    """Windows of at most ``capacity`` tokens: (id, piece, start, tokens, window_id, window_tokens).

    ``tokens`` gives a text's length; null counts as 0. The row stands for the text's tokens from number ``start`` on,
    ``tokens`` of them, in the tokenizer that counted them. A text beyond the capacity is cut: its full pieces are windows
    of their own, the rest is packed. Every row is in the result: empty texts take a window's place without tokens, null
    ids stay, repeated rows are packed each. Equal lengths are ordered by id, piece and number of the repeated row. Other
    columns are ignored; an empty table gives an empty table.

    Rows are dealt into shards of about ``shard_rows`` texts by hash of id, length and number among the rows
    that are equal in both, so that null ids and repeated rows spread too and tasks never grow.
    """
    sized = materialize(docs.select(quoted(id_col).alias("id"), F.coalesce(tokens, F.lit(0)).cast("bigint").alias("n")), "sizes")
    shards = max(1, -(-sized.count() // shard_rows))
    each = sized.groupBy("id", "n").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    each = each.withColumn("shard", F.pmod(F.xxhash64("id", "n", "copy"), F.lit(shards)))
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1))))
    pieces = pieces.withColumn("start", F.col("piece").cast("bigint") * capacity).withColumn("tokens", F.least(F.lit(capacity), F.col("n") - F.col("start")))
    pieces = pieces.select("id", "copy", "shard", "piece", "start", "tokens")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "id", "piece", "copy"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        size = pdf["tokens"].to_numpy(np.int64)
        full = size == capacity
        window = np.arange(len(size), dtype=np.int64)
        window[~full] = full.sum() + pack_sizes(size[~full], capacity)
        total = np.bincount(window, weights=size).astype(np.int64)
        return pdf.drop(columns=["shard", "copy"]).assign(window_id=(int(key[0]) << 32) + window, window_tokens=total[window])

    kind = sized.schema["id"].dataType.simpleString()
    # rows are few bytes and much work: partitions by number, which aren't merged by their bytes
    spread = pieces.repartition(min(shards, 64 + shards // 64), "shard")
    packed = spread.groupBy("shard").applyInPandas(run, f"id {kind}, piece int, start bigint, tokens bigint, window_id bigint, window_tokens bigint")
    return packed.withColumnRenamed("id", id_col)

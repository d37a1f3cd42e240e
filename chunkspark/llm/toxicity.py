"""Toxicity scores from logistic regression that is trained with FTRL-proximal.

Features are hashed words, word pairs and skip pairs (one word left out), as presence in the text. FTRL-proximal keeps
per-coordinate learning rates and an L1 penalty, so that few weights differ from 0: they are broadcast as two short
arrays, and only a text's occurrences of those features are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import map_text, quoted, sample_by_hash, stable_order

_SKIP, _PAIR = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Weights:
    """The non-zero weights by feature, and the bias; features are hashes below 2**bits."""

    index: np.ndarray
    value: np.ndarray
    bias: float
    bits: int


def _codes(h: np.ndarray, doc: np.ndarray | None, bits: int) -> tuple[np.ndarray | None, np.ndarray]:
    docs, code = [doc], [h]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            pair = K.mix(h[:-gap] * salt + h[gap:])
            if doc is not None:
                ok = doc[gap:] == doc[:-gap]
                docs.append(doc[gap:][ok])
                pair = pair[ok]
            code.append(pair)
    return None if doc is None else np.concatenate(docs), (np.concatenate(code) >> np.uint64(64 - bits)).astype(np.int64)


def occurrences(texts: pa.Array, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, pair and skip pair of lower-case texts, of those only for which ``wanted`` is not 0; not distinct."""
    if K.is_long(texts):
        seen = np.zeros(1 << bits, bool)
        for h in K.hash_parts(texts, 2):
            seen[_codes(h, None, bits)[1]] = True
        code = np.flatnonzero(seen if wanted is None else seen & (wanted != 0))
        return np.zeros(len(code), np.int64), code
    w = K.words(*K.buffers(texts))
    doc, code = _codes(w.hash, w.doc, bits)
    if wanted is not None:
        there = wanted[code] != 0
        doc, code = doc[there], code[there]
    return doc, code


def ftrl(rows: list[np.ndarray], y: np.ndarray, bits: int, alpha: float = 0.2, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0, epochs: int = 2) -> Weights:
    """FTRL-proximal (McMahan et al., 2013) over rows of distinct feature numbers, one row after the other."""
    size = (1 << bits) + 1  # the last coordinate is the bias, without penalty
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(z[i]) <= l1] = 0
        if len(i) and i[-1] == size - 1:
            w[-1] = -z[-1] / ((beta + np.sqrt(n[-1])) / alpha)
        return w

    rows = [np.append(r, size - 1) for r in rows]
    for _ in range(epochs):
        for i, label in zip(rows, y, strict=True):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size))
    index = np.flatnonzero(w[:-1])
    return Weights(index, w[index], float(w[-1]), bits)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = 6000, bits: int = 20, seed: int = 5, **training: float) -> Weights:
    """Train on at most ``rows`` labelled texts, half of them of each label as far as there are so many (a bound on fitting only).

    Rows with a null id, text or label are left out; an id that has both labels counts as toxic; of several texts with one id the lowest counts. Without labelled texts
    no weight differs from 0 and the bias is -1, so that nothing is flagged. One task trains; its weights go to the driver.
    """
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    # rows bounds what is broadcast, and one text for each id what is trained on
    chosen = F.broadcast(sample_by_hash(known, ["y"], "id", rows // 2, seed))
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).where("text is not null")
    texts = texts.join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        order = stable_order(table["id"], table["text"])
        lower, y, features = K.plain(table["text"].take(pa.array(order))), table["y"].to_numpy()[order], []
        for a, b in K.slices(lower):
            doc, code = occurrences(lower[a:b], bits)
            key = np.unique((doc << bits) | code)
            features += np.split(key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(1, b - a)))
        w = ftrl(features, y, bits, **training)
        yield pa.RecordBatch.from_pydict({"i": pa.array([w.index.tolist()], pa.list_(pa.int64())), "w": pa.array([w.value.tolist()], pa.list_(pa.float64())), "b": [w.bias]})

    sample = texts.select(F.xxhash64("id").alias("id"), "y", "text").repartition(1)
    got = sample.mapInArrow(train, "i array<bigint>, w array<double>, b double").collect()
    return Weights(np.array(got[0].i, np.int64), np.array(got[0].w), got[0].b, bits) if got else Weights(np.zeros(0, np.int64), np.zeros(0), -1.0, bits)


def score(df: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Probability that each text is toxic: (id, toxicity, toxic).

    A null or empty text has no features and gets the bias alone. Rows are scored one by one over their whole text:
    null ids and repeated rows stay, other columns are dropped unless named in ``keep``, an empty table gives an empty
    table. A score equal to the threshold counts as toxic.
    """

    def make():
        table = np.zeros(1 << weights.bits, np.float32)
        table[weights.index] = weights.value

        def run(texts: pa.Array) -> list:
            doc, code = occurrences(texts, weights.bits, table)
            key = np.unique((doc << weights.bits) | code)
            total = np.bincount(key >> weights.bits, weights=table[key & ((1 << weights.bits) - 1)], minlength=len(texts)) + weights.bias
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            return [p, p >= threshold]

        return run

    others = [c for c in keep or [] if c != id_col]
    return map_text(df, [id_col, *others], text_col, make, "toxicity double, toxic boolean")

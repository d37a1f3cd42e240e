"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. A letter trigram's vector binds (multiplies) the
vectors of its letters, the first two permuted (rotated) by two and one places; a document's
vector bundles (adds) its trigrams' vectors; a language's prototype bundles the unit vectors of
its sample documents. Documents and prototypes are compared by cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import map_text, quoted, sample_by_hash

SYMBOLS = 64
GROUP = 1 << 18  # letters that are counted at once


class Space:
    """Letter vectors and a growing table of trigram vectors, the same in every process."""

    def __init__(self, dim: int = 1024, seed: int = 7, table: int = 1 << 15):
        rng = np.random.default_rng(seed)
        base = rng.integers(0, 2, (SYMBOLS, dim), np.int8) * 2 - 1
        self.dim, self.base, self.most = dim, [np.roll(base, k, axis=1).astype(np.int8) for k in (2, 1, 0)], table
        self.row, self.vectors, self.used = np.full(SYMBOLS**3, -1, np.int32), np.zeros((1024, dim), np.int8), 0

    def trigrams(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of distinct trigram codes."""
        new = codes[self.row[codes] < 0]
        if self.used + len(new) > self.most:  # begin the table anew; a request beyond it is not kept
            self.row[:], self.used = -1, 0
            new = codes
        if len(new):
            a, b, c = new // SYMBOLS**2, new // SYMBOLS % SYMBOLS, new % SYMBOLS
            made = self.base[0][a] * self.base[1][b] * self.base[2][c]
            if len(new) > self.most:
                return made
            while self.used + len(new) > len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
            self.vectors[self.used : self.used + len(new)] = made
            self.row[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return self.vectors[self.row[codes]]

    def bundle(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(document vectors, number of trigrams) of lower-case texts."""
        out, count = np.zeros((len(texts), self.dim), np.float32), np.zeros(len(texts), np.int64)
        if K.is_long(texts):
            return self._long(texts, out, count)
        doc, sym = K.letters(texts)
        if len(sym) < 3:
            return out, count
        ok = (doc[:-2] == doc[2:]) & (sym[1:-1] > 0)
        s = sym.astype(np.int32)
        code, doc = (s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:])[ok], doc[:-2][ok]
        count = np.bincount(doc, minlength=len(texts))
        ends, start = np.cumsum(count), 0
        while start < len(texts):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + 64, int(np.searchsorted(ends, done + GROUP, "right"))))
            own = code[done : ends[stop - 1]]
            if len(own):
                there = np.zeros(SYMBOLS**3, bool)
                there[own] = True
                distinct = np.flatnonzero(there)
                place = np.cumsum(there) - 1
                cell = (doc[done : ends[stop - 1]] - start) * len(distinct) + place[own]
                counts = np.bincount(cell, minlength=(stop - start) * len(distinct)).reshape(stop - start, -1).astype(np.float32)
                for k in range(0, len(distinct), 8192):
                    out[start:stop] += counts[:, k : k + 8192] @ self.trigrams(distinct[k : k + 8192]).astype(np.float32)
            start = stop
        return out, count


    def _long(self, text: pa.Array, out: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        times, tail = np.zeros(SYMBOLS**3, np.int64), np.zeros(0, np.int64)
        for part in K.letter_parts(text):
            s = np.concatenate((tail, part.astype(np.int64)))
            code = (s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:])[s[1:-1] > 0]
            times += np.bincount(code, minlength=SYMBOLS**3)
            tail = s[-2:]
        distinct = np.flatnonzero(times)
        for k in range(0, len(distinct), 8192):
            out[0] += times[distinct[k : k + 8192]].astype(np.float32) @ self.trigrams(distinct[k : k + 8192]).astype(np.float32)
        count[0] = times.sum()
        return out, count


@dataclass(frozen=True)
class Profiles:
    """Language prototypes, and how the cosine of a text to its own language grows with its trigrams: ``full / sqrt(1 + half / trigrams)``."""

    prototypes: dict[str, np.ndarray]
    full: float = 1.0
    half: float = 0.0

    def expected(self, trigrams: np.ndarray) -> np.ndarray:
        return self.full / np.sqrt(1 + self.half / np.maximum(1, trigrams))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, dim: int = 1024, seed: int = 7, min_trigrams: int = 60) -> Profiles:
    """Language prototypes from at most ``per_language`` labelled documents of each language (a bound on fitting only).

    Rows without a language, text or id are left out; of several texts with one id and language the lowest counts. There
    is a vector of ``dim`` numbers for each language. The same documents tell how high cosines to the own language are for
    a number of trigrams: ``full`` is their 98 % quantile and ``half`` the median that fits, over texts of at least ``min_trigrams``.
    """
    rows = labelled.select(quoted(id_col).alias("id"), quoted(lang_col).alias("lang")).where("id is not null and lang is not null").distinct()
    chosen = sample_by_hash(rows, ["lang"], "id", per_language, seed)
    texts = labelled.select(quoted(id_col).alias("id"), quoted(lang_col).alias("lang"), quoted(text_col).alias("text")).where("text is not null")
    # per_language ids for each language bound what is broadcast, and one text for each id what is fitted
    picked = texts.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))

    def bundle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        space, parts, counts = Space(dim, seed), [], []
        lower = K.plain(pa.array(pdf["text"].sort_values(), pa.string()))
        for a, b in K.slices(lower):
            vectors, count = space.bundle(lower[a:b])
            parts.append(_unit(vectors.astype(np.float64)))
            counts.append(count)
        own, n = np.concatenate(parts), np.concatenate(counts)
        v = _unit(own.sum(0))
        enough = n >= min_trigrams
        return pd.DataFrame({"lang": [key[0]], "v": [v.tolist()], "cosine": [(own[enough] @ v).tolist()], "n": [n[enough].tolist()]})

    found = picked.groupBy("lang").applyInPandas(bundle, "lang string, v array<double>, cosine array<double>, n array<bigint>").collect()
    found = sorted((r for r in found if np.any(r.v)), key=lambda r: r.lang)
    cosine, n = (np.concatenate([np.zeros(0), *(r[c] for r in found)]) for c in ("cosine", "n"))
    made = {r.lang: np.array(r.v) for r in found}
    if not len(cosine):
        return Profiles(made)
    full = float(np.quantile(cosine, 0.98))
    return Profiles(made, full, float(np.median(n * np.maximum(0, (full / np.maximum(cosine, 1e-6)) ** 2 - 1))))


def identify(
    df: DataFrame,
    profiles: Profiles,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_share: float = 0.5,
    min_trigrams: int = 60,
    seed: int = 7,
    keep: list[str] | None = None,
) -> DataFrame:
    """Language of every document: (id, lang, cosine, margin, trigrams, accepted).

    ``margin`` is the distance to the second language's cosine. A document is rejected if it has no letter, or if it
    has ``min_trigrams`` trigrams or more (enough evidence) and its best cosine is below ``min_share`` of what texts of
    so many trigrams have in their language; a cosine of just that share is accepted. A text that is null,
    empty or without letters has a null language, cosine 0 and is rejected; ties go to the first language by name.
    Rows are scored one by one: repeated rows and null ids stay, other columns are dropped unless named in ``keep``,
    and an empty table gives an empty table. Texts of any length are read whole, long ones in parts.
    """
    prototypes = profiles.prototypes
    names = sorted(prototypes)
    dim = len(prototypes[names[0]]) if names else 1024
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), dim)

    def make():
        space = Space(dim, seed)

        def score(lower: pa.Array) -> list:
            vectors, count = space.bundle(lower)
            rows = np.arange(len(lower))
            cosine = _unit(vectors) @ matrix.T if names else np.zeros((len(lower), 1), np.float32)
            best = cosine.argmax(1)
            top = cosine[rows, best].astype(np.float64)
            second = np.partition(cosine, -2, 1)[:, -2] if len(names) > 1 else np.zeros(len(lower))
            known = (count > 0) & bool(names)
            lang = pa.array([names[k] if ok else None for k, ok in zip(best, known, strict=True)], pa.string())
            accepted = known & ((count < min_trigrams) | (top >= min_share * profiles.expected(count)))
            return [lang, np.where(known, top, 0.0), np.where(known, top - second, 0.0).astype(np.float64), count.astype(np.int64), accepted]

        return score

    others = [c for c in keep or [] if c != id_col]
    return map_text(df, [id_col, *others], text_col, make, "lang_id string, cosine double, margin double, trigrams bigint, accepted boolean")

"""License scans: sparse TF-IDF cosine of lines, blocks, windows of lines and files to license notices, then inheritance along paths."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import map_text, materialize, quoted, small_batches, small_side

_DATA = json.loads(Path(__file__).with_name("licenses.json").read_text(encoding="utf-8"))
EXACT = 0.97  # the cosine that identifiers need: those of other licenses differ in a word or two
#: (license, notice)
TEMPLATES = [(name, text) for name, notices in _DATA["notices"].items() for text in notices]
#: SPDX lines, which count only where nothing but comment marks and the like differs
IDENTIFIERS = [(name, f"SPDX-License-Identifier: {name}") for name in _DATA["identifiers"]]
WINDOWS = (4, 8, 16, 32)  # lines
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"


def _words(texts: list[str]) -> list[np.ndarray]:
    arr = K.plain(pa.array(texts, pa.string()))
    w = K.words(*K.buffers(arr))
    return [w.hash[w.doc == i] for i in range(len(texts))]


def vocabulary(templates: list[tuple[str, str]]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_words([t for _, t in templates])]))


def _look(h: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Number of each word in the vocabulary, or -1."""
    if not len(vocab):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    return np.where(vocab[at] == h, at, -1)


def document_frequencies(docs: DataFrame, text_col: str, vocab: np.ndarray) -> tuple[int, np.ndarray]:
    """(texts, texts that hold each vocabulary word) over the whole table; partial counts of each task are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(vocab), np.int64), 0
        for batch in batches:
            texts = K.plain(batch.column(0))
            rows += len(texts)
            for a, b in K.slices(texts):
                if K.is_long(texts[a:b]):
                    seen = np.zeros(len(vocab) + 1, bool)
                    for h in K.hash_parts(texts[a:b], 0):
                        seen[_look(h, vocab)] = True
                    total += seen[:-1]
                    continue
                w = K.words(*K.buffers(texts[a:b]))
                at = _look(w.hash, vocab)
                key = np.unique(w.doc[at >= 0] * len(vocab) + at[at >= 0])
                total += np.bincount(key % len(vocab), minlength=len(vocab))
        word = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.append(total[word[:-1]], rows))], ["word", "n"])

    df = np.zeros(len(vocab) + 1, np.int64)
    for r in small_batches(docs).select(quoted(text_col).cast("string").alias("t")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row for each vocabulary word
        df[r.word] = r.n
    return int(df[-1]), df[:-1]


class Scorer:
    """TF-IDF cosines of segments of texts to the templates. A segment's words outside the vocabulary count with ``other``."""

    def __init__(self, templates: list[tuple[str, str]], least: np.ndarray, vocab: np.ndarray, idf: np.ndarray, other: float):
        self.names, self.least, self.vocab, self.idf, self.other = [x for x, _ in templates], least, vocab, idf, other
        self.parts = []  # (words, weights) of each template
        for h in _words([x for _, x in templates]):
            word, times = np.unique(_look(h, vocab), return_counts=True)
            value = times * idf[word]
            self.parts.append((word, value / max(np.linalg.norm(value), 1e-12)))
        self.floor = float(least.min()) if len(least) else 2.0

    def best(self, seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, cosine, template) of the segments that reach a template's floor: the best one of each; seg is the rising number of each word's segment, at its word or -1."""
        count, inside, n = int(seg[-1]) + 1, at >= 0, len(self.vocab)
        key, times = np.unique(seg[inside] * n + at[inside], return_counts=True)
        return self.best_of(count, key // n, key % n, times, np.bincount(seg[~inside], minlength=count))

    def best_of(self, count: int, s: np.ndarray, word: np.ndarray, times: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from the times that each segment has each word, and words outside the vocabulary."""
        value = times * self.idf[word]
        own = np.bincount(s, weights=value**2, minlength=count)
        norm = np.sqrt(own + self.other**2 * outside)
        able = np.sqrt(own) >= self.floor * norm - 1e-9  # no cosine is above the vocabulary's share
        able &= own > 0
        left = able[s]
        s, word, value, which = s[left], word[left], value[left], np.flatnonzero(able)
        place = np.cumsum(able) - 1
        s = place[s]
        top, found = np.zeros(len(which)), np.full(len(which), -1)
        for t, (words, weights) in enumerate(self.parts):
            if not len(which):
                break
            weight = np.zeros(len(self.vocab))
            weight[words] = weights
            w = weight[word]
            there = w > 0
            c = np.bincount(s[there], weights=value[there] * w[there], minlength=len(which)) / np.maximum(norm[which], 1e-12)
            better = (c > top + 1e-9) & (c >= self.least[t] - 1e-9)
            top, found = np.where(better, c, top), np.where(better, t, found)
        ok = found >= 0
        return which[ok], top[ok], found[ok]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, template or -1) of the best segment of each lower-case text: its lines, its blocks between lines without words, the whole, and windows of lines that overlap by half. A long text is cut in parts between blocks where it can be; windows begin anew in each part."""
        if not K.is_long(texts) or not self.names:
            return self._score(texts)
        top, which, times, outside = np.zeros(1), np.full(1, -1), np.zeros(len(self.vocab), np.int64), 0
        for part in K.text_parts(texts, at_blank_lines=True):
            high, pick = self._score(part, whole=False)
            if high[0] > top[0] + 1e-9:
                top, which = high, pick
            at = _look(K.words(*K.buffers(part)).hash, self.vocab)
            times += np.bincount(at[at >= 0], minlength=len(times))
            outside += int((at < 0).sum())
        word = np.flatnonzero(times)
        _, high, pick = self.best_of(1, np.zeros(len(word), np.int64), word, times[word], np.array([outside]))
        return (np.round(high, 9), pick) if len(high) and high[0] > top[0] + 1e-9 else (top, which)

    def _score(self, texts: pa.Array, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = K.buffers(texts)
        w = K.words(data, offsets)
        rows = len(texts)
        top, which = np.zeros(rows), np.full(rows, -1)
        if not len(w.hash) or not self.names:
            return top, which
        line = np.concatenate(([0], np.cumsum(data == 10)))[w.start]
        at = _look(w.hash, self.vocab)
        fresh = np.concatenate(([True], w.doc[1:] != w.doc[:-1]))
        step = np.concatenate(([0], np.diff(line)))
        line -= np.repeat(line[fresh], np.diff(np.append(np.flatnonzero(fresh), len(line))))  # within the text

        def offer(new: np.ndarray, picked: np.ndarray | None = None) -> None:
            nonlocal top, which
            mine = at if picked is None else at[picked]
            doc = w.doc if picked is None else w.doc[picked]
            seg = np.cumsum(new) - 1
            s, cosine, t = self.best(seg, mine)
            row = doc[np.flatnonzero(new)][s]
            order = np.lexsort((-t, cosine))  # the best is written last, of equal ones the first template
            high, pick = np.zeros(rows), np.full(rows, -1)
            high[row[order]], pick[row[order]] = cosine[order], t[order]
            better = high > top + 1e-9
            top, which = np.where(better, high, top), np.where(better, pick, which)

        offer(fresh | (step > 0))
        offer(fresh | (step > 1))
        if whole:
            offer(fresh)
        rich = np.bincount(w.doc[at >= 0], minlength=rows) >= 12  # windows are for notices of several lines
        picked = np.flatnonzero(rich[w.doc])
        if len(picked):
            first, mine = fresh[picked], line[picked]
            for size in WINDOWS:
                for shift in (0, size // 2):
                    number = (mine + shift) // size
                    offer(first | np.concatenate(([True], number[1:] != number[:-1])), picked)
        return np.round(top, 9), which


def scorer(docs: DataFrame, text_col: str, templates: list[tuple[str, str]], identifiers: list[tuple[str, str]], floor: float) -> Scorer:
    """Templates with idf from the whole table."""
    both = sorted([(name, text, floor) for name, text in templates] + [(name, text, max(floor, EXACT)) for name, text in identifiers])
    named = [(name, text) for name, text, _ in both]
    vocab = vocabulary(named)
    n, df = document_frequencies(docs, text_col, vocab)
    idf = np.log((1 + n) / (1 + df)) + 1
    other = float(np.median(idf)) if len(idf) else 1.0  # for words outside the vocabulary
    return Scorer(named, np.array([x for *_, x in both]), vocab, idf, other)


def best_notice(docs: DataFrame, keep: list[str], text_col: str, scores: Scorer) -> DataFrame:
    """Best license and its cosine for each text; null and 0 where no segment reaches a template's floor."""

    def make():
        def run(texts: pa.Array) -> list:
            top, which = scores.score(texts)
            return [pa.array([scores.names[k] if k >= 0 else None for k in which], pa.string()), top]

        return run

    return map_text(docs, keep, text_col, make, "own string, cosine double")


def scan(
    files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", floor: float = 0.6, templates: list[tuple[str, str]] | None = None, identifiers: list[tuple[str, str]] | None = None
) -> DataFrame:
    """License of every file: (id, path, license, cosine, origin).

    ``origin`` is own where a line, a block, a window of lines or the whole text reaches the cosine ``floor`` to a notice
    (or 0.97 to an SPDX line); inherited where the nearest directory above (its own included) has a license file
    (LICENSE, COPYING, NOTICE and the like by name) with an own license; otherwise null, as is the license. ``cosine`` is
    that of the own license, else 0. Of several license files in one directory the best cosine counts, then
    the first license by name. A null or empty text has cosine 0 and can inherit; a null path inherits nothing. Every row
    stays: null ids and repeated rows too; other columns are ignored; an empty table gives an empty table. A segment with
    several notices has the license of the best one, ties to the first by name. Texts are read whole and scored once.
    """
    placed = files.select(quoted(id_col).alias("id"), path.alias("path"), quoted(text_col).alias("text"))
    scores = scorer(placed, "text", TEMPLATES if templates is None else templates, IDENTIFIERS if templates is None and identifiers is None else identifiers or [], floor)
    found = best_notice(placed, ["id", "path"], "text", scores)
    parts = F.split("path", "/")
    found = materialize(found.withColumn("dir", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")), "notices")
    owners = found.where(F.col("own").isNotNull() & F.element_at(parts, -1).rlike(LICENSE_FILE))
    owners = materialize(owners.groupBy("dir").agg(F.min_by("own", F.struct(-F.col("cosine"), "own")).alias("inherited")), "owners")
    steps = F.split("dir", "/")
    above = found.select("dir").where("dir is not null").distinct()
    above = above.select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).withColumn("above", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = above.join(small_side(owners.withColumnRenamed("dir", "above"), 500_000), "above").groupBy("dir").agg(F.max_by("inherited", "depth").alias("inherited"))
    # few directories hold most files: their list is counted and travels to the rows
    out = found.join(small_side(materialize(nearest, "nearest"), 500_000), "dir", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited")
    return out.select(F.col("id").alias(id_col), "path", F.coalesce("own", "inherited").alias("license"), "cosine", origin.alias("origin"))

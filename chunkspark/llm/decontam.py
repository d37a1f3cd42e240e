"""Benchmark decontamination by template windows.

Every text gives three streams of tokens: its lower-case words, its template, where numbers, names (capitalised
words) and units (after a number) are typed placeholders, and its short template, where a run of number or name words
is one placeholder, so that values may have other word counts. Windows of all streams are hash-joined with those of
the benchmark. Along each alignment of a document with an item, the names that fill the placeholders must map one to
one, unless verbatim windows are enough; so a question with other numbers and names is caught, and a chance match of
templates is not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import extend, materialize, quoted, small_batches

UNITS = "mm cm m km mg g kg t ml l inch inches foot feet ft yard yards mile miles ounce ounces oz pound pounds lb lbs second seconds minute minutes min hour hours h day days week weeks month months year years dollar dollars usd euro euros eur cent cents percent degrees meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres mph kmh"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_NUM, _NAME, _UNIT = 1, 2, 3
_WORDS, _TEMPLATE, _SHORT = 0, 1, 2
_GLUE = np.zeros(256, bool)  # bytes between the words of one name
_GLUE[list(b" -'")] = True
NEIGHBOURS = 3  # shifts of one alignment differ by this many tokens at most from one to the next


class Lexicon:
    def __init__(self) -> None:
        self.units = np.sort(np.array([K.word_hash(x) for x in UNITS.split()], np.uint64))
        self.numbers = np.sort(np.array([K.word_hash(x) for x in NUMBERS.split()], np.uint64))

    @staticmethod
    def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
        return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def tokens(raw: pa.Array, lexicon: Lexicon, number_before: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word hash, type, whether it goes on with the number or name of the word before) of the words of texts in their own case; type 0 is a literal. ``number_before`` tells whether a number comes before the first word."""
    lower = pc.utf8_lower(raw)
    data, offsets = K.buffers(raw)
    small, small_offsets = K.buffers(lower)
    if not np.array_equal(offsets, small_offsets):  # lower case changes the length of a rare letter: fold ASCII only
        small = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    w = K.words(small, offsets)
    if len(w.hash) == 0:
        return w.doc, w.hash, np.zeros(0, np.int8), np.zeros(0, bool)
    capital = np.concatenate(([0], np.cumsum(data != small, dtype=np.int32)))
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data], dtype=np.int32)))
    head = np.minimum(w.start + np.where(data[w.start] >= 0x80, 2, 1), w.end)
    first, all_capitals = capital[head] > capital[w.start], capital[w.end] - capital[head]
    kind = np.where(first & (all_capitals == 0), _NAME, 0).astype(np.int8)
    number = (digits[w.end] > digits[w.start]) | lexicon.among(w.hash, lexicon.numbers)
    kind[number] = _NUM
    after = np.zeros(len(kind), bool)
    after[0], after[1:] = number_before, number[:-1] & (w.doc[1:] == w.doc[:-1])
    kind[after & ~number & lexicon.among(w.hash, lexicon.units)] = _UNIT
    on = np.zeros(len(kind), bool)
    gap, between = w.start[1:] - w.end[:-1], data[np.minimum(w.end[:-1], len(data) - 1)]
    joins = np.where(kind[1:] == _NUM, between != 10, (kind[1:] == _NAME) & _GLUE[between])
    on[1:] = (kind[1:] == kind[:-1]) & (w.doc[1:] == w.doc[:-1]) & (gap == 1) & joins
    return w.doc, w.hash, kind, on


def shortened(doc: np.ndarray, h: np.ndarray, kind: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, type) with each run of number or name words as one token; a token of one word keeps its hash."""
    start = np.flatnonzero(~on)
    if not len(start):
        return doc, h, kind
    place = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    return doc[start], np.add.reduceat(np.where(place > 0, K.mix(h + place.astype(np.uint64)), h), start), kind[start]


_HOLD = K.mix(np.array([11, 12, 13, 14], np.uint64))


def windows(doc: np.ndarray, h: np.ndarray, kind: np.ndarray, size: int, streams: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(stream, first token, window hash): of every window of words, of windows of the template that have a placeholder, and of all windows of the short one; templates need ``least_literals``."""
    m = len(h) - size + 1
    if m <= 0:
        return
    same = doc[:m] == doc[size - 1 :]
    held = np.concatenate(([0], np.cumsum(kind > 0)))
    slots = held[size:][:m] - held[:m]
    enough = same & (size - slots >= least_literals(size))
    template = np.where(kind > 0, _HOLD[kind], h)
    for stream in streams:
        tokens, at = (h if stream == _WORDS else template), np.flatnonzero(same if stream == _WORDS else enough & (slots > 0) if stream == _TEMPLATE else enough)
        acc = tokens[at]
        for k in range(1, size):
            acc = acc * K._GRAM + tokens[at + k]
        yield stream, at, K.mix(acc ^ np.uint64(size * 4 + stream))


def least_literals(size: int) -> int:
    """Words besides placeholders that a window of templates has at least."""
    return max(2, -(-size // 3))


def _emitter(size: int, lengths: list[int], wanted: np.ndarray | None, whole_short: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of (id, text) to batches of windows."""
    kinds = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        if wanted is not None:
            seen = np.zeros(1 << 22, bool)
            seen[wanted >> np.uint64(42)] = True

        def found(ids: pa.Array, doc: np.ndarray, h: np.ndarray, kind: np.ndarray, streams: tuple[int, ...], begin: np.ndarray, old: int = 0) -> Iterator[pa.RecordBatch]:
            """Windows whose last token isn't among the first ``old`` ones; begin has the number of each row's first token."""
            total = np.bincount(doc, minlength=len(ids))
            for n in lengths:
                for stream, at, g in windows(doc, h, kind, n, streams):
                    if whole_short:  # a text shorter than the window size is one window of its own length
                        there = np.flatnonzero((total[doc[at]] == n) if n < size else (total[doc[at]] >= size))
                    else:
                        there = np.flatnonzero(seen[g >> np.uint64(42)]) if wanted is not None else np.arange(len(g))
                        if wanted is not None:
                            there = there[Lexicon.among(g[there], wanted)]
                    there = there[at[there] + n > old]
                    if not len(there):
                        continue
                    at, g = at[there], g[there]
                    if stream != _WORDS:
                        grid = at[:, None] + np.arange(n)
                        value = np.where(kind[grid] > 0, (h[grid] & ~np.uint64(3) | kind[grid].astype(np.uint64)).view(np.int64), 0)
                        slots = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n), pa.array(value.ravel())).cast(kinds)
                    else:
                        slots = pa.nulls(len(at), kinds)
                    row = doc[at]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row)), *(pa.array(np.full(len(at), x, np.int32)) for x in (stream, n)), pa.array(g.view(np.int64)), pa.array((at - begin[row]).astype(np.int32)), slots, pa.array(total[row].astype(np.int32))],
                        ["id", "stream", "n", "h", "pos", "slots", "words"],
                    )

        def in_parts(ids: pa.Array, raw: pa.Array) -> Iterator[pa.RecordBatch]:
            """The same of one long text: each part is led by the last tokens before it."""
            number, none = False, (np.zeros(0, np.uint64), np.zeros(0, np.int8))
            tails, counts = [none, none], [0, 0]
            for part in K.text_parts(raw):
                words = tokens(part, lexicon, number)
                number = bool(words[2][-1] == _NUM) if len(words[2]) else number
                for k, ((_, h, kind), streams) in enumerate(((words[:3], (_WORDS, _TEMPLATE)), (shortened(*words), (_SHORT,)))):
                    old = len(tails[k][0])
                    h, kind = np.concatenate((tails[k][0], h)), np.concatenate((tails[k][1], kind))
                    yield from found(ids, np.zeros(len(h), np.int64), h, kind, streams, np.array([old - counts[k]]), old)
                    counts[k] += len(h) - old
                    keep = max(0, len(h) - size + 1)
                    tails[k] = h[keep:], kind[keep:]

        for batch in batches:
            raw = K.plain(batch.column(1), lower=False)
            for a, b in K.slices(raw):
                ids = batch.column(0).slice(a, b - a)
                if K.is_long(raw[a:b]) and not whole_short:
                    yield from in_parts(ids, raw[a:b])
                    continue
                words = tokens(raw[a:b], lexicon)
                for (doc, h, kind), streams in ((words[:3], (_WORDS, _TEMPLATE)), (shortened(*words), (_SHORT,))):
                    begin = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=b - a))))
                    yield from found(ids, doc, h, kind, streams, begin)
        K.release()

    return run


def _emit(df: DataFrame, id_col: str, text_col: str, size: int, lengths: list[int], wanted: np.ndarray | None, whole_short: bool) -> DataFrame:
    """Windows as (id, stream, n, h, pos, slots, words), pos and words in tokens of their stream: slots has the words at placeholders, their type in the low two bits, 0 elsewhere, for templates, else null."""
    head = df.select(quoted(id_col).alias("id"))
    schema = extend(head, "stream int, n int, h bigint, pos int, slots array<bigint>, words int")

    return small_batches(df).select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).mapInArrow(_emitter(size, lengths, wanted, whole_short), schema)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = 8,
    literals: int = 5,
    min_coverage: float = 0.5,
    min_item: int = 4,
    most_windows: int = 500_000,
) -> DataFrame:
    """Documents that hold a benchmark item: (id, item id, coverage, changed_slots, kind).

    An item counts as held where windows along one alignment, or along neighbouring ones together, cover
    ``min_coverage`` of its words (a run of number or name words being one) and either windows of words alone do so, or the names in placeholders map one to one (equal numbers and units may be chance, in the item
    as in the document) and ``literals`` other words, or a third of a shorter item, are covered; ``kind`` is exact, or reparameterised where a value differs. An item of fewer than ``window``
    words is one window; one of fewer than ``min_item`` words, a null or an empty one is never found. One row for each
    document and item, from the alignment of the largest coverage. Documents with null ids, null or empty texts give no
    rows; repeated rows give the rows of one; other columns are ignored; an empty table on either side gives no rows.

    Up to ``most_windows`` benchmark windows (counted with their items and places) travel to the tasks, which drop a document's other windows at once.
    Beyond that all windows are shuffled by hash: the same result.
    """
    items = benchmark.where(quoted(item_col).isNotNull()).select(quoted(item_col).alias("item"), quoted(item_text).alias("text"))
    lengths = list(range(min_item, window + 1))
    ours = _emit(items, "item", "text", window, lengths, None, True).withColumnRenamed("id", "item").withColumnRenamed("pos", "item_pos").withColumnRenamed("slots", "item_slots").withColumnRenamed("words", "item_words").distinct()
    ours = materialize(ours, "windows")
    there = ours.select("n", "h").distinct()
    small = ours.count() <= most_windows  # of what travels: each row is a window of up to ``window`` words
    if small:
        got = there.toPandas()
        wanted, lengths = np.sort(got["h"].to_numpy(np.int64).view(np.uint64)), sorted(int(n) for n in got["n"].unique())
    else:
        wanted, lengths = None, [r.n for r in there.select("n").distinct().collect()]
    named = docs.where(quoted(id_col).isNotNull())
    if small and len(wanted) == 0:
        wanted, lengths = np.zeros(1, np.uint64), []
    theirs = _emit(named, id_col, text_col, window, lengths, wanted, False).drop("words", "stream")
    hits = theirs.join(F.broadcast(ours) if small else ours, ["n", "h"])
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda x: x["i"] != 0)
    at = F.sequence("item_pos", F.col("item_pos") + F.col("n") - 1)
    exact = F.col("item_slots").isNull()
    plain = F.when(exact, at).otherwise(F.filter(at, lambda p: F.get("item_slots", p - F.col("item_pos")) == 0))
    along = hits.select(
        "id", "item", (F.col("stream") == _SHORT).alias("short"), "item_words", (F.col("pos") - F.col("item_pos")).alias("shift"), at.alias("covered"), F.when(exact, at).alias("verbatim"), plain.alias("plain"),
        F.coalesce(pairs, F.expr("cast(array() as array<struct<i:bigint,d:bigint>>)")).alias("pairs"),
    )
    sets = ("covered", "verbatim", "plain", "pairs")
    runs = along.groupBy("id", "item", "short", "shift").agg(*(F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in sets), F.max("item_words").alias("item_words"))
    # each shift by itself, and neighbouring ones together
    order = Window.partitionBy("id", "item", "short").orderBy("shift")
    far = F.when(F.col("shift") - F.lag("shift").over(order) <= NEIGHBOURS, 0).otherwise(1)
    runs = runs.withColumn("far", far).withColumn("group", F.sum("far").over(order))
    runs = runs.groupBy("id", "item", "short", "group").agg(F.collect_list(F.struct("shift", *sets, "item_words")).alias("r"))
    pooled = F.struct(F.array_min("r.shift").alias("shift"), *(F.array_distinct(F.flatten(f"r.{c}")).alias(c) for c in sets), F.array_max("r.item_words").alias("item_words"))
    runs = runs.select("id", "item", F.explode(F.when(F.size("r") > 1, F.concat("r", F.array(pooled))).otherwise(F.col("r"))).alias("r")).select("id", "item", "r.*")

    names = F.filter("pairs", lambda x: x["i"].bitwiseAND(3) == _NAME)

    def distinct(side: str) -> Column:
        return F.size(F.array_distinct(F.transform(names, lambda x: x[side])))

    one_to_one = (distinct("i") == F.size(names)) & (distinct("d") == F.size(names))
    words = F.col("item_words")
    enough = F.size("plain") >= F.least(F.lit(literals), F.ceil(words / 3))
    found = runs.withColumn("coverage", F.size("covered") / words).where((F.col("coverage") >= min_coverage) & ((F.size("verbatim") / words >= min_coverage) | (one_to_one & enough)))
    changed = F.size(F.filter("pairs", lambda x: x["i"] != x["d"]))
    best = found.withColumn("changed_slots", changed).groupBy("id", "item").agg(F.min_by(F.struct("coverage", "changed_slots"), F.struct(-F.col("coverage"), F.col("changed_slots"), "shift")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.coverage", "b.changed_slots", F.when(F.col("b.changed_slots") == 0, "exact").otherwise("reparameterised").alias("kind"))

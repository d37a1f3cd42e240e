"""Vectorised text kernels: they work on Arrow string buffers, never on one row at a time.

A *word* is a maximal run of ASCII letters and digits and of bytes from 0x80 on; every
character of the wide scripts (lead byte 0xE3 to 0xED or 0xF0 on) is a word of its own.
Texts are split in blocks of about ``BLOCK`` bytes, so that memory doesn't follow the batch; one long text is
worked on in parts where a kernel says so.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_WORD = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _WORD[_c] = True
_WORD[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def plain(texts: pa.Array | pa.ChunkedArray, lower: bool = True) -> pa.Array:
    """The column as one string array; null becomes the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.string()), "")
    return pc.utf8_lower(texts) if lower else texts


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets; the offsets begin with 0."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, budget: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``budget`` bytes, one row at least."""
    _, offsets = buffers(texts)
    start, n = 0, len(texts)
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + budget, "right")) - 1
        stop = min(n, max(start + 1, stop))
        yield start, stop
        start = stop


_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("pow")
    if have is None or len(have) < n:
        n = max(n, BLOCK + 1)
        for name, base in (("pow", _R), ("inv", pow(_R, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["pow"], _tables["inv"]


class Words(NamedTuple):
    doc: np.ndarray  # row of each word
    hash: np.ndarray  # uint64
    start: np.ndarray  # byte offsets
    end: np.ndarray


def word_parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[Words]:
    """All words of the rows, in order, those of about ``BLOCK`` bytes at once; no word is cut."""
    n, b0 = len(data), 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    while b0 < n:
        b1 = min(n, b0 + BLOCK)
        if b1 < n:
            gaps = np.flatnonzero(~_WORD[data[b0:b1]])
            if len(gaps):
                b1 = b0 + int(gaps[-1]) + 1
            else:  # no separator within the block: go on to the next one
                while b1 < n and _WORD[data[b1]] and not edge[b1]:
                    b1 += 1
        d, e = data[b0:b1], edge[b0 : b1 + 1].copy()
        e[0] = e[-1] = True
        isw = _WORD[d]
        if len(d) and d.max() >= 0xE3:
            lead = np.flatnonzero(((d >= 0xE3) & (d <= 0xED)) | (d >= 0xF0))
            e[lead] = True
            e[np.minimum(lead + np.where(d[lead] >= 0xF0, 4, 3), len(d))] = True
        inner = isw[1:] & isw[:-1] & ~e[1:-1]  # joins with the byte before
        joined = np.concatenate(([False], inner, [False]))
        starts = np.flatnonzero(isw & ~joined[:-1])
        ends = np.flatnonzero(isw & ~joined[1:]) + 1
        power, inverse = _powers(len(d) + 1)
        sums = np.zeros(len(d) + 1, np.uint64)
        np.cumsum((d.astype(np.uint64) + np.uint64(1)) * power[: len(d)], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * inverse[starts])
        yield Words(np.searchsorted(offsets, starts + b0, "right") - 1, h, starts + b0, ends + b0)
        b0 = b1


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """All words of the rows, in order."""
    parts = list(word_parts(data, offsets))
    if not parts:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty.astype(np.uint64), empty, empty)
    return parts[0] if len(parts) == 1 else Words(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def is_long(texts: pa.Array) -> bool:
    """Whether this slice is one text of several blocks, to be worked on in parts."""
    return len(texts) == 1 and len(buffers(texts)[0]) > 2 * BLOCK


def hash_parts(texts: pa.Array, before: int) -> Iterator[np.ndarray]:
    """Word hashes of one long text in parts, each led by the last ``before`` ones of those before it."""
    tail = np.zeros(0, np.uint64)
    for w in word_parts(*buffers(texts)):
        h = np.concatenate((tail, w.hash))
        yield h
        tail = h[max(0, len(h) - before) :] if before else h[:0]


def text_parts(text: pa.Array, at_blank_lines: bool = False) -> Iterator[pa.Array]:
    """One long text in parts of about ``BLOCK`` bytes, cut after a line feed or between two bytes that belong to no word; with ``at_blank_lines`` after a line without words, if there is one within eight blocks, else as before."""
    data, _ = buffers(text)
    a = 0
    while a < len(data):
        b, cut = min(len(data), a + BLOCK), 0
        while b < len(data) and not cut:
            d = data[a:b]
            feed = np.flatnonzero(d == 10) + 1
            if at_blank_lines and b - a < 8 * BLOCK:
                before = np.concatenate(([0], np.cumsum(_WORD[d], dtype=np.int32)))
                feed = feed[1:][before[feed[1:]] == before[feed[:-1]]]
                cut = int(feed[-1]) if len(feed) else 0
            else:
                apart = np.flatnonzero(~_WORD[d[1:]] & ~_WORD[d[:-1]]) + 1
                cut = max(int(feed[-1]) if len(feed) else 0, int(apart[-1]) if len(apart) else 0)
            if not cut:
                b = min(len(data), b + BLOCK)
        b = a + cut if cut else b
        yield pa.array([data[a:b].tobytes()], pa.binary()).cast(pa.string())
        a = b


def word_hash(word: str) -> int:
    """The hash that ``words`` gives to this lower-case word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words(data, np.array([0, len(data)])).hash[0])


def grams(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of n words within a row."""
    m = len(h) - n + 1
    if m <= 0:
        return doc[:0], h[:0]
    acc = h[:m].copy()
    for k in range(1, n):
        acc = acc * _GRAM + h[k : k + m]
    ok = doc[:m] == doc[n - 1 :]
    return doc[:m][ok], mix(acc[ok])


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash of 32 or 44 bits) of the distinct n-grams, sorted by both; a row of fewer than n words has one gram of all its words."""
    rows, found = len(offsets) - 1, []
    tail = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    count, short = np.zeros(rows, np.int64), []
    for w in word_parts(data, offsets):
        count += np.bincount(w.doc, minlength=rows)
        doc, h = np.concatenate((tail[0], w.doc)), np.concatenate((tail[1], w.hash))
        row, g = grams(doc, h, n)
        found.append(np.unique((row.astype(np.uint64) << np.uint64(bits)) | (g >> np.uint64(64 - bits))))
        if rows > 1 or count[0] - len(w.hash) < n:  # the words of rows that may have few
            short.append((w.doc, w.hash))
        keep = max(0, len(h) - n + 1)
        tail = doc[keep:], h[keep:]
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        doc, h = (np.concatenate(x) for x in zip(*short, strict=True))
        first = np.searchsorted(doc, few)
        acc = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            at = np.minimum(first + k, len(h) - 1)
            acc = np.where(k < count[few], acc * _GRAM + h[at] + np.uint64(k + 1), acc)
        found.append((few.astype(np.uint64) << np.uint64(bits)) | (mix(acc) >> np.uint64(64 - bits)))
    key = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.uint32 if bits == 32 else np.uint64)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Symbol of every code point: 1 to 26 a letter from a to z, 27 to 63 another letter, 0 the rest."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if 0xD800 <= c <= 0xDFFF:
            continue
        if chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 27 + (c * 2654435761 >> 7) % 37
    return table


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, symbol) of the letters of lower-case texts; a run of anything else is one 0."""
    data, _ = buffers(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    sym = letter_table()[points]
    keep = sym > 0
    keep[1:] |= sym[:-1] > 0
    return doc[keep], sym[keep]


def letter_parts(text: pa.Array) -> Iterator[np.ndarray]:
    """The symbols that ``letters`` gives for one lower-case text, in parts."""
    data, _ = buffers(text)
    a, before = 0, 0
    while a < len(data):
        b = min(len(data), a + BLOCK)
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        sym = letter_table()[np.frombuffer(data[a:b].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        yield sym[(sym > 0) | (np.concatenate(([before], sym[:-1])) > 0)]
        a, before = b, int(sym[-1])


def release() -> None:
    """Give memory that a task no longer needs back to the machine: its worker waits for the next one."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)

"""N-gram Jaccard join by chosen paths.

A text is the set of its word n-grams, embedded as ``WIDTH`` MinHash tokens. Starting from a root for each run, a set
follows every token that shared randomness picks (one in ``threshold * WIDTH`` on average), so that similar sets meet in
the same bucket; buckets that are too large are split again on further tokens, small ones are compared by brute force,
as are sets that are close to most of a bucket. The number of runs follows from the target recall. Every pair that
the tokens suggest is verified on the whole n-gram sets.

Groups of many similar sets would have pairs by the square of their size. Each such group is a hub: no path suggests pairs of
its members, which are all compared with each other in tiles, by products of matrices, as is a set that the paths suggest
for one of its members with the whole hub. Of a tile only the counts of links and a tree of its similar sets are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import map_text, materialize, quoted, small_batches, small_side

WIDTH = 64
_rng = np.random.default_rng(20170404)
_MUL, _XOR = _rng.integers(0, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 1 << 63, WIDTH, np.uint64)
HOME_ROWS = 1024  # rows of a bucket on either side of what one task verifies at once
HOME_GRAMS = 1 << 20  # grams of a hub's rows on either side
HUB_ROWS, HUB_RUNS, HUB_TRIES = 64, 4, 16  # least members that a bucket gives a hub, runs whose buckets are looked at, groups that are looked for in a bucket
GRAM_BITS = 44  # wide enough for paths: buckets of unrelated texts must not fill up as the corpus grows
_RUN = np.uint64(63)
_STEP, _PICK = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def digests(rows: int, row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two digests) of each row's set, from sorted (row, gram)."""
    size = np.bincount(row, minlength=rows)
    there = np.flatnonzero(size)
    one, two = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    if len(there):
        start = np.concatenate(([0], np.cumsum(size[there])[:-1]))
        wide = K.mix(gram + np.uint64(1))
        one[there], two[there] = np.add.reduceat(wide, start), np.add.reduceat(K.mix(wide), start)
    return size, one.view(np.int64), two.view(np.int64)


def minima(rows: int, row: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """MinHash values (rows, WIDTH) of each row's set; 0 for an empty one."""
    values, size = np.zeros((rows, WIDTH), np.uint64), np.bincount(row, minlength=rows)
    there = np.flatnonzero(size)
    if len(there):
        start = np.concatenate(([0], np.cumsum(size[there])[:-1]))
        for i in range(WIDTH):
            values[there, i] = np.minimum.reduceat((gram ^ _XOR[i]) * _MUL[i], start)
    return K.mix(values.ravel()).reshape(values.shape)


def children(key: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(position in key, child's key) of the tokens that are followed from each bucket; tokens of 8 bits, or wider ones for the roots."""
    place = np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    limit = np.uint64(min(2**64 - 1, int(2**64 / (threshold * WIDTH))))
    out_row, out_key = [], []
    for a in range(0, len(key), 4096):
        child = K.mix(key[a : a + 4096, None] * _STEP + (place + tokens[a : a + 4096]))
        row, column = np.nonzero(K.mix(child ^ _PICK) < limit)
        out_row.append(row + a)
        out_key.append(child[row, column])
    return (np.concatenate(out_row), np.concatenate(out_key)) if out_row else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def close(tokens: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, most: np.ndarray | int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of positions that share enough tokens, and not more than ``most`` of them."""
    equal = [np.count_nonzero(tokens[a[k : k + 65536]] == tokens[b[k : k + 65536]], axis=1) for k in range(0, len(a), 65536)]
    equal = np.concatenate(equal) if equal else np.zeros(0, np.int64)
    ok = (equal >= least * WIDTH) & (equal <= most)
    return a[ok], b[ok]


def split_bucket(key: np.uint64, member: np.ndarray, tokens: np.ndarray, threshold: float, least: float, limit: int, depth: int, most: int = WIDTH, hub: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members that a bucket suggests: by brute force if it is small or the last, else from its children. Not those of one hub (-1: none)."""
    if hub is None:
        hub = np.full(len(tokens), -1)
    if len(member) and hub[member[0]] >= 0 and (hub[member] == hub[member[0]]).all():
        return
    own = tokens[member]

    def against(one: int, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = rest[hub[rest] != hub[one]] if hub[one] >= 0 else rest
        return close(tokens, np.full(len(rest), one), rest, least, most)

    if len(member) <= limit or depth <= 0:
        for i in range(len(member) - 1):
            yield against(member[i], member[i + 1 :])
        return
    share = np.zeros(len(member))
    for i in range(WIDTH):
        _, inverse, count = np.unique(own[:, i], return_inverse=True, return_counts=True)
        share += count[inverse]
    near = share / (WIDTH * len(member)) >= 0.9 * threshold  # close to most of the bucket: more paths wouldn't part them
    for i in np.flatnonzero(near):
        yield against(member[i], member[(~near) | (np.arange(len(member)) > i)])
    left = member[~near]
    row, child = children(np.full(len(left), key), tokens[left], threshold)
    order = np.argsort(child, kind="stable")
    row, child = row[order], child[order]
    for k in np.split(np.arange(len(child)), np.flatnonzero(child[1:] != child[:-1]) + 1):
        if len(k) > 1:
            yield from split_bucket(child[k[0]], left[row[k]], tokens, threshold, least, limit, depth - 1, most, hub)


def meeting(equal: int, levels: int, threshold: float) -> float:
    """Probability that two texts with so many equal tokens meet on all these levels of one run."""
    follow, meet = 1 / (threshold * WIDTH), 1.0
    for _ in range(levels):
        meet = 1 - (1 - follow * meet) ** equal
    return meet


def runs_enough(levels: int, threshold: float, miss: float = 1e-3) -> np.ndarray:
    """For each number of equal tokens the runs after which all but ``miss`` of such pairs have met; later ones needn't suggest them again."""
    meet = np.array([meeting(k, levels, threshold) for k in range(WIDTH + 1)])
    return np.ceil(np.log(miss) / np.log1p(-np.clip(meet, 1e-9, 1 - 1e-12))).astype(np.int64)


def chance(runs: int, levels: int, threshold: float, slack: float) -> float:
    """Probability that a pair at the threshold is found, if it must meet on this many levels: over the spread of its equal tokens, of which it needs ``threshold - slack``."""
    total, enough = 0.0, runs_enough(levels, threshold)
    for k in range(math.ceil((threshold - slack) * WIDTH), WIDTH + 1):
        found = 1 - (1 - meeting(k, levels, threshold)) ** min(runs, int(enough[k]))
        total += math.comb(WIDTH, k) * threshold**k * (1 - threshold) ** (WIDTH - k) * found
    return total


def runs_for(recall: float, depth: int, threshold: float = 0.5, slack: float = 0.16) -> int:
    """Runs after which a pair at the threshold is found with this probability on the deepest path: the root, ``depth - 1`` splits by shuffles and as many within a task."""
    for runs in range(1, int(_RUN) + 1):
        if chance(runs, 2 * depth - 1, threshold, slack) >= recall:
            return runs
    raise ValueError(f"recall {recall} is out of reach with slack {slack}")


def of_run(key: np.ndarray, run: np.ndarray | int) -> np.ndarray:
    """Keys with the number of their run in the lowest bits."""
    return key & ~_RUN | np.asarray(run, np.uint64)


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Runs of whole groups of the sorted first column, as many as a few batches hold."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        key = now[0]
        cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
        if cut or (held and held[-1][0][-1] != key[-1]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in now], strict=True)]
            held = []
        held.append([c[cut:] for c in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _tokens(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, WIDTH)


def _suggested(key: np.ndarray, tokens: np.ndarray, hub: np.ndarray, threshold: float, slack: float, limit: int, depth: int, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, first, second) of the pairs of positions that whole buckets of sorted keys suggest."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size, least = np.diff(np.append(start, len(key))), threshold - slack
    bucket = np.repeat(np.arange(len(start)), size)
    # of pairs that are so similar that earlier runs have found them this run is silent
    enough = runs_enough(levels, threshold)
    top = np.array([np.flatnonzero(enough > r)[-1] for r in range(int(_RUN) + 1)])
    most = top[key.view(np.uint64) & _RUN]
    for n in np.unique(size[(size > 1) & (size <= limit)]):
        x, y = np.triu_indices(n, 1)
        for k in range(0, len(own := start[size == n]), step := max(1, 200_000 // len(x))):
            first, second = (own[k : k + step, None] + x).ravel(), (own[k : k + step, None] + y).ravel()
            apart = (hub[first] != hub[second]) | (hub[first] < 0)
            first, second = first[apart], second[apart]
            a, b = close(tokens, first, second, least, most[first])
            yield bucket[a], a, b
    for s, n in zip(start[size > limit], size[size > limit], strict=True):
        for a, b in split_bucket(key[s].view(np.uint64), np.arange(s, s + n), tokens, threshold, least, limit, depth, int(most[s]), hub):
            yield bucket[a], a, b


def _candidates(buckets: DataFrame, threshold: float, slack: float, limit: int, depth: int, levels: int) -> DataFrame:
    """(a, b, home) from rows (key, id, tokens, hub): pairs, and the bucket, or a tile of a large one, that suggests them. If one or both are in hubs, the lower hub h as -1 - h, the other's id, and 0."""

    def flush(held: list[tuple[np.ndarray, ...]], key: np.ndarray, ident: np.ndarray, hub: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        bucket, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        free = (hub[a] < 0) & (hub[b] < 0)
        c, d = a[~free], b[~free]
        host = (hub[c] >= 0) & ((hub[d] < 0) | (hub[c] < hub[d]))
        guests = np.unique(np.stack([-1 - np.where(host, hub[c], hub[d]), np.where(host, ident[d], ident[c])]), axis=1)
        bucket, a, b = bucket[free], a[free], b[free]
        low, high = np.minimum(ident[a], ident[b]), np.maximum(ident[a], ident[b])
        tiles = (-(-size // HOME_ROWS))[bucket].astype(np.uint64)
        of = [K.mix(x.view(np.uint64)) % tiles for x in (low, high)]
        home = key[first[bucket]].view(np.uint64) + of[0] * np.uint64(0x9E3779B97F4A7C15) + of[1] * np.uint64(0xC2B2AE3D27D4EB4F)
        unique = np.unique(np.stack([low, high, home.view(np.int64)]), axis=1)
        unique = np.concatenate([unique, np.stack([*guests, np.zeros(guests.shape[1], np.int64)])], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in unique], ["a", "b", "home"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ident, packed, hub in _grouped(batches, ["key", "id", "tokens", "hub"]):
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size, held, rows = np.diff(np.append(first, len(key))), [], 0
            for found in _suggested(key, _tokens(packed), hub, threshold, slack, limit, depth, levels):
                held.append(found)
                rows += len(found[0])
                if rows >= 1 << 18:  # however many pairs a bucket has, few are held at once
                    yield flush(held, key, ident, hub, first, size)
                    held, rows = [], 0
            if rows:
                yield flush(held, key, ident, hub, first, size)
        K.release()

    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint, home bigint")


def gather(tokens: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Positions of each of the largest groups of a bucket: the sets that share enough tokens with one whose tokens are the most frequent, again and again among the rest."""
    left = np.arange(len(tokens))
    for _ in range(HUB_TRIES):
        if len(left) < HUB_ROWS:
            return
        own = tokens[left]
        share = sum(np.bincount(own[:, i], minlength=256)[own[:, i]] for i in range(WIDTH))
        found = np.count_nonzero(own == own[np.argmax(share)], axis=1) >= least * WIDTH
        if np.count_nonzero(found) >= HUB_ROWS:
            yield left[found]
        left = left[~found]


def _hubs(met: DataFrame, sets: DataFrame, least: float, bucket_rows: int) -> DataFrame:
    """(id, hub) of sets in large groups. Which they are changes the work, but no result: large buckets are looked at in parts."""
    large = met.where((F.col("rows") >= HUB_ROWS) & (F.col("key").bitwiseAND(F.lit(int(_RUN))) < HUB_RUNS))
    part = F.pmod(F.xxhash64("id", F.lit(6)), F.ceil(F.col("rows") / bucket_rows))
    rows = small_batches(large.select(F.xxhash64("key", part).alias("key"), "id").join(sets, "id")).select("key", "id", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ident, packed in _grouped(batches, ["key", "id", "tokens"]):
            tokens = _tokens(packed)
            for k in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                for group in gather(tokens[k], least):
                    found = ident[k[group]]
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), found.min()))], ["id", "hub"])

    found = materialize(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id bigint, hub bigint").distinct(), "gathered")
    best = found.join(found.groupBy("hub").count(), "hub").groupBy("id").agg(F.max(F.struct("count", "hub")).alias("m"))
    return materialize(best.select("id", F.col("m.hub").alias("hub")), "hubs")


def _blocks(hubs: DataFrame, guests: DataFrame, sizes: DataFrame) -> DataFrame:
    """(home, id, side) of the tiles of hubs, from (id, hub) of members and of guests, and (id, size): every two tiles of members, as sides -2 and -3, each of them with itself, as -4, and with each tile of guests."""
    rows = hubs.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1))).join(sizes, "id")
    tiles = F.ceil(F.greatest(F.count("*") / F.lit(HOME_ROWS), F.sum("size") / F.lit(HOME_GRAMS)))
    count = rows.groupBy("hub", "guest").agg(tiles.alias("n"))
    count = count.groupBy("hub").agg(F.sum(F.expr("if(guest = 0, n, 0)")).alias("n"), F.sum(F.expr("if(guest = 1, n, 0)")).alias("g"))
    rows = materialize(rows.join(count, "hub").withColumn("t", F.pmod(F.xxhash64("id", F.lit(7)), F.expr("if(guest = 0, n, g)"))), "tiles")
    inner = "transform(sequence(0L, n - 1), s -> (least(s, t) as i, greatest(s, t) as j, 0 as kind, case when s < t then -3L when s > t then -2L else -4L end as side))"
    outer = "if(g > 0, transform(sequence(0L, g - 1), s -> (t as i, s as j, 1 as kind, -2L as side)), array())"
    invited = "transform(sequence(0L, n - 1), s -> (s as i, t as j, 1 as kind, -3L as side))"
    block = F.expr(f"explode(if(guest = 0, concat({inner}, {outer}), {invited}))")
    return rows.select("id", "hub", block.alias("b")).select(F.xxhash64("hub", "b.i", "b.j", "b.kind").alias("home"), "id", F.col("b.side").alias("side"))


def overlaps(parts: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common grams of these positions, as a matrix: frequent grams by a product, rare ones by their pairs."""
    number = np.unique(np.concatenate(parts), return_inverse=True)[1]
    size = np.array([len(x) for x in parts])
    ends = np.cumsum(size)
    shape, total = (len(left), len(right)), int(number.max()) + 1 if len(number) else 1

    def entries(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(of)), size[of])
        gram = np.concatenate([number[ends[p] - size[p] : ends[p]] for p in of])
        order = np.argsort(gram, kind="stable")
        return row[order], gram[order], np.bincount(gram, minlength=total)

    (row_l, gram_l, in_l), (row_r, gram_r, in_r) = entries(left), entries(right)
    work, shared = in_l * in_r, np.zeros(shape, np.float32)
    often = np.flatnonzero(work > 4096)
    place = np.full(total, -1)
    for k in range(0, len(often), 1024):
        now = often[k : k + 1024]
        place[now] = np.arange(len(now))
        sides = []
        for n, row, gram in ((shape[0], row_l, gram_l), (shape[1], row_r, gram_r)):
            column = place[gram]
            x = np.zeros((n, len(now)), np.float32)
            x[row[column >= 0], column[column >= 0]] = 1
            sides.append(x)
        shared += sides[0] @ sides[1].T
        place[now] = -1
    shared = shared.astype(np.int64)
    start = np.cumsum(in_r) - in_r
    rare = (work[gram_l] > 0) & (work[gram_l] <= 4096)
    row_l, gram_l = row_l[rare], gram_l[rare]
    times = in_r[gram_l]
    upto = np.cumsum(times)
    for a, b in _stretches(upto, 1 << 20):
        n = times[a:b]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[gram_l[a:b]], n)
        shared += np.bincount(np.repeat(row_l[a:b], n) * shape[1] + row_r[at], minlength=shape[0] * shape[1]).reshape(shape)
    return shared


def _stretches(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches that take about ``most`` of what is counted up to each position."""
    a = 0
    while a < len(upto):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most)))
        yield a, b
        a = b


def tree(similar: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the matrix connects: the lowest id of each component with each of its others."""
    new, a, b = similar.any(axis=1), [], []
    while new.any():
        rows, columns = np.zeros(len(left), bool), np.zeros(len(right), bool)
        fresh = np.zeros(len(left), bool)
        fresh[np.argmax(new)] = True
        while fresh.any():
            rows |= fresh
            columns |= (more := similar[fresh].any(axis=0) & ~columns)
            fresh = similar[:, more].any(axis=1) & ~rows
        new &= ~rows
        ids = np.unique(np.concatenate((left[rows], right[columns])))
        a.append(np.full(len(ids) - 1, ids[0]))
        b.append(ids[1:])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _tiled(met: DataFrame, bucket_rows: int) -> DataFrame:
    """(key, id) of buckets that no path splits any more, cut in blocks of half of ``bucket_rows``: every two blocks of a bucket are a bucket of their own, so that all its pairs meet and no task gets more rows."""
    blocks = F.ceil(F.col("rows") / (bucket_rows / 2)).cast("int")
    own = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.expr("filter(sequence(0, blocks - 1), k -> k <> block)")))
    tile = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return other.select(tile.bitwiseAND(F.lit(~int(_RUN))).bitwiseOR(F.col("key").bitwiseAND(F.lit(int(_RUN)))).alias("key"), "id")


def _verified(pairs: DataFrame, blocks: DataFrame | None, sets: DataFrame, threshold: float, expand: bool) -> DataFrame:
    """(a, b, jaccard, links) of the pairs that reach the threshold; pairs has (a, b, home), blocks (home, id, side), sets (id, gram). The pairs of blocks only if ``expand``; else rows (a, -1) with the links of a, and rows (a, b) with none that connect the same ids."""
    ends = pairs.select("home", F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("side", F.lit(-1).cast("bigint"))
    ends = ends.unionByName(blocks) if blocks else ends
    rows = ends.join(sets, "id").select("home", F.col("id").alias("a"), F.col("side").alias("b"), "gram")
    rows = rows.unionByName(pairs.select("home", "a", "b", F.lit(None).cast("binary").alias("gram")))

    def check(a: np.ndarray, b: np.ndarray, gram: np.ndarray, pair: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((b[pair], a[pair]))
        left, right = a[pair][order], b[pair][order]
        at = {v: k for k, v in enumerate(a[~pair].tolist())}
        mark = np.zeros(int(gram.max()) + 1 if len(gram) else 1, bool)
        shared = np.zeros(len(left), np.int64)
        place_r = np.array([at[v] for v in right.tolist()])
        for k in np.split(np.arange(len(left)), np.flatnonzero(left[1:] != left[:-1]) + 1):
            p = at[int(left[k[0]])]
            mine = gram[start[p] : start[p] + size[p]]
            mark[mine] = True
            for q in k:
                r = place_r[q]
                shared[q] = np.count_nonzero(mark[gram[start[r] : start[r] + size[r]]])
            mark[mine] = False
        place_l = np.array([at[v] for v in left.tolist()])
        return left, right, shared / (size[place_l] + size[place_r] - shared)

    def compare(ident: np.ndarray, side: np.ndarray, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = bool((side == -4).any())
        left, right = (np.flatnonzero(side == (-4 if own else x)) for x in (-2, -3))
        if not (len(left) and len(right)):
            return
        shared, size = overlaps(parts, left, right), np.array([len(x) for x in parts])
        j = shared / (size[left][:, None] + size[right] - shared)
        similar = j >= threshold
        if own:
            np.fill_diagonal(similar, False)
        if expand:
            x, y = np.nonzero(np.triu(similar) if own else similar)
            p, q = ident[left[x]], ident[right[y]]
            yield batch(np.minimum(p, q), np.maximum(p, q), j[x, y], np.ones(len(x), np.int64))
            return
        x, y = tree(similar, ident[left], ident[right])
        yield batch(x, y, np.ones(len(x)), np.zeros(len(x), np.int64))
        for at, count in [(left, similar.sum(axis=1)), *[(right, similar.sum(axis=0))] * (not own)]:
            at, count = at[count > 0], count[count > 0]
            yield batch(ident[at], np.full(len(at), -1), np.ones(len(at)), count.astype(np.int64))

    def batch(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "jaccard", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, a, b, grams in _grouped(batches, ["home", "a", "b", "gram"]):
            for k in np.split(np.arange(len(home)), np.flatnonzero(home[1:] != home[:-1]) + 1) if len(home) else []:
                if b[k[0]] < -1:
                    yield from compare(a[k], b[k], [np.frombuffer(g, np.uint32) for g in grams[k]])
                    continue
                pair = np.array([g is None for g in grams[k]])
                parts = [np.frombuffer(g, np.uint32) for g in grams[k][~pair]]
                size = np.array([len(x) for x in parts], np.int64)
                number = np.unique(np.concatenate(parts), return_inverse=True)[1]
                x, y, j = check(a[k], b[k], number, pair, np.cumsum(size) - size, size)
                ok = j >= threshold
                yield batch(x[ok].astype(np.int64), y[ok].astype(np.int64), j[ok], np.ones(np.count_nonzero(ok), np.int64))
        K.release()

    return small_batches(rows.repartition("home").sortWithinPartitions("home")).mapInArrow(run, "a bigint, b bigint, jaccard double, links bigint")


def _links(docs: DataFrame, id_col: str, text_col: str, threshold: float, n: int, recall: float, slack: float, limit: int, depth: int, bucket_rows: int, expand: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, nodes, near, wordless): the distinct (id, one, two) of texts with words, where one and two are their set's digests; (one, two, node, low, members) of each distinct set, by a number of its own and its lowest id; (a, b, jaccard, links) of the similar nodes, as in ``_verified``; ids of texts without words."""
    named = docs.where(quoted(id_col).isNotNull()).select(quoted(id_col).cast("bigint").alias("id"), quoted(text_col).alias("text"))
    runs = runs_for(recall, depth, threshold, slack)

    def make_signatures():
        def run(texts: pa.Array) -> list:
            row, gram = K.gram_sets(*K.buffers(texts), n, GRAM_BITS)
            size, one, two = digests(len(texts), row, gram)
            wide = minima(len(texts), row, gram)
            there = np.flatnonzero(size)
            found = [children(K.mix(np.full(len(there), r + 1, np.uint64)), wide[there], threshold) for r in range(runs)]
            found = [(at, of_run(key, r)) for r, (at, key) in enumerate(found)]
            at, key = (np.concatenate(x) for x in zip(*found, strict=True))
            at = there[at]
            order = np.argsort(at, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(texts))))).astype(np.int32)
            paths = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order].view(np.int64)))
            tokens = (wide >> np.uint64(56)).astype(np.uint8)
            return [size, one, two, pa.array([t.tobytes() for t in tokens], pa.binary()), paths]

        return run

    signed = map_text(named, ["id"], "text", make_signatures, "size bigint, one bigint, two bigint, tokens binary, paths array<bigint>")
    # numbers of rows are unique whatever a retried task does, and stay as they were written
    signed = materialize(signed.withColumn("node", F.monotonically_increasing_id()), "signatures")
    members = materialize(signed.where("size > 0").groupBy("one", "two", "id").agg(F.min("node").alias("node")), "members")
    nodes = members.groupBy("one", "two").agg(F.min(F.struct("id", "node")).alias("s"), F.count("*").alias("members"))
    nodes = materialize(nodes.select("one", "two", "s.node", F.col("s.id").alias("low"), "members"), "nodes")
    wordless = signed.where("size = 0").select("id").distinct()
    each = signed.join(small_side(nodes.select("node")), "node", "left_semi")
    sets, hubs = each.select(F.col("node").alias("id"), "tokens"), None

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key = batch.column("key").to_numpy().view(np.uint64)
            row, child = children(key, _tokens(batch.column("tokens").to_pylist()), threshold)
            child = of_run(child, key[row] & _RUN)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("id").take(pa.array(row))], ["key", "id"])

    level, buckets = materialize(each.select(F.explode("paths").alias("key"), F.col("node").alias("id")), "paths"), None
    for left in range(depth - 1, -1, -1):
        sizes = level.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
        met = materialize(level.join(sizes, "key"), "met")
        if hubs is None:
            hubs = _hubs(met, sets, threshold - slack, bucket_rows)
        done = met.where(F.col("rows") <= bucket_rows).select("key", "id")
        buckets = done if buckets is None else buckets.unionByName(done)
        large = met.where(F.col("rows") > bucket_rows)
        if large.isEmpty():
            break
        if left:
            level = materialize(small_batches(large).join(sets, "id").select("key", "id", "tokens").mapInArrow(follow, "key bigint, id bigint"), "paths")
        else:
            buckets = buckets.unionByName(_tiled(large, bucket_rows))
    hubbed = sets.join(small_side(hubs), "id", "left").withColumn("hub", F.coalesce("hub", F.lit(-1)))
    found = _candidates(buckets.join(hubbed, "id"), threshold, slack, limit, depth - 1, 2 * depth - 1)
    found = materialize(found.groupBy("a", "b").agg(F.min("home").alias("home")), "pairs")
    pairs, blocks = found.where("a >= 0"), None
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    if not hubs.isEmpty():
        guests = found.where("a < 0").select(F.col("b").alias("id"), (-1 - F.col("a")).alias("hub"))
        blocks = _blocks(hubs, guests, each.select(F.col("node").alias("id"), "size"))
        ends = ends.union(hubs.select("id")).union(guests.select("id"))

    def make_sets():
        def run(texts: pa.Array) -> list:
            row, gram = K.gram_sets(*K.buffers(texts), n, GRAM_BITS)
            _, one, two = digests(len(texts), row, gram)
            gram, at = (gram >> np.uint64(GRAM_BITS - 32)).astype(np.uint32), np.searchsorted(row, np.arange(len(texts) + 1))
            return [one, two, pa.array([gram[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())]

        return run

    wanted = materialize(ends.distinct().join(nodes, "node").select("node", "one", "two", F.col("low").alias("id")), "wanted")
    texts = named.join(small_side(wanted.select("id").distinct()), "id", "left_semi")
    grams = map_text(texts, ["id"], "text", make_sets, "one bigint, two bigint, gram binary")
    grams = grams.join(small_side(wanted), ["id", "one", "two"]).dropDuplicates(["node"]).select(F.col("node").alias("id"), "gram")
    return members, nodes, materialize(_verified(pairs, blocks, grams, threshold, expand), "near"), wordless


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    n: int = 3,
    recall: float = 0.98,
    slack: float = 0.16,
    limit: int = 64,
    depth: int = 3,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """Pairs of texts whose word n-gram sets have at least this Jaccard similarity: (doc_a, doc_b, jaccard), doc_a < doc_b.

    Texts with equal sets are one node, named by its lowest id: each other member has one row with the node, of
    similarity 1; pairs of different sets are between nodes. So (x, y) is similar just where their nodes are equal or
    paired, and a group of thousands of copies takes as many rows, not their square. Every pair of nodes at the
    threshold is found with probability ``recall`` at least; what is reported is verified on whole sets of 32-bit hashes.

    Rows with null ids and texts without words (null and empty ones too) are in no pair; a text of fewer than n words has
    one gram of all its words. Equal rows count once; different texts with one id are nodes of their own, but no pair
    names one id twice. Other columns are ignored; an empty table gives an empty table. Buckets over ``bucket_rows`` are
    split by further shuffles, smaller ones within a task, each at most ``depth - 1`` times; larger ones that are left
    over are compared in full, in tiles of two blocks each.
    """
    members, nodes, near, _ = _links(docs, id_col, text_col, threshold, n, recall, slack, limit, depth, bucket_rows)
    equal = members.select("id", "one", "two").join(nodes.where("members > 1"), ["one", "two"]).where("id <> low")
    equal = equal.select(F.col("low").alias("doc_a"), F.col("id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    low = nodes.select("node", "low")
    named = near.join(low.select(F.col("node").alias("a"), F.col("low").alias("x")), "a").join(low.select(F.col("node").alias("b"), F.col("low").alias("y")), "b")
    pairs = named.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    return equal.unionByName(pairs.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard")))


def similarity_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    n: int = 3,
    recall: float = 0.98,
    slack: float = 0.16,
    limit: int = 64,
    depth: int = 3,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """The join as one row for each document: (id, class_id, copies, links, first, one, two).

    ``class_id`` is the lowest id of all documents that pairs of at least the threshold connect with this one, its own
    if there is none; ``copies`` counts the other documents with an equal n-gram set, ``links`` the other sets that are
    similar to this one, each found and verified as in ``jaccard_join``. ``first`` is true for one document of each
    class, that with the lowest (id, digests); ``one`` and ``two`` are the digests of the set. So the result grows with the
    documents, however many copies a group has.

    Rows with null ids are left out; repeated rows give one row; different texts with one id give a row each, and are of
    one class only if they are similar. Texts without words (null and empty ones too) are alone in their class, with digests of 0. Ties
    don't occur: equal (id, digests) are one row. Other columns are ignored; an empty table gives an empty table.
    """
    members, nodes, near, wordless = _links(docs, id_col, text_col, threshold, n, recall, slack, limit, depth, bucket_rows, expand=False)
    kind = docs.schema[id_col].dataType.simpleString()
    links = near.where("links > 0").select(F.explode(F.array("a", "b")).alias("node"), "links").groupBy("node").agg(F.sum("links").alias("links"))
    root = components(near.where("b >= 0").select("a", "b")).withColumnRenamed("id", "node")
    placed = materialize(nodes.join(root, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    first = placed.groupBy("root").agg(F.min(F.struct("low", "one", "two")).alias("first"))
    node = placed.join(first, "root").select("one", "two", F.col("members") - 1, F.coalesce("links", F.lit(0)), "first").toDF("one", "two", "copies", "links", "f")
    is_first = (F.col("id") == F.col("f.low")) & (F.col("one") == F.col("f.one")) & (F.col("two") == F.col("f.two"))
    out = members.select("id", "one", "two").join(node, ["one", "two"]).select("id", F.col("f.low").alias("class_id"), "copies", "links", is_first.alias("first"), "one", "two")
    zero = F.lit(0).cast("bigint")
    alone = wordless.select("id", F.col("id").alias("class_id"), zero.alias("copies"), zero.alias("links"), F.lit(True).alias("first"), zero.alias("one"), zero.alias("two"))
    named = out.unionByName(alone)
    return named.select(F.col("id").cast(kind).alias(id_col), F.col("class_id").cast(kind).alias("class_id"), *named.columns[2:])


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """docs with the digests (one, two) of each text's n-gram set, as in ``similarity_classes``."""

    def make():
        def run(texts: pa.Array) -> list:
            row, gram = K.gram_sets(*K.buffers(texts), n, GRAM_BITS)
            return list(digests(len(texts), row, gram)[1:])

        return run

    return map_text(docs, docs.columns, text_col, make, "one bigint, two bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): lowest id of each node's connected component, for nodes that aren't it; edges has bigint (a, b), a <> b.

    Alternating large-star and small-star steps (Kiveris et al., 2014) on written tables, until nothing changes.
    """
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))  # large has a > b
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small, "stars")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now

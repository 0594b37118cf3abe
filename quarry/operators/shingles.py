"""Pairs of sets that share much, counted by blocks of sets in numpy.

A set is a row of keys with weights. Keys that are in the very same sets are one key with their
weights added up, so that a passage of many runs that stands in many texts is looked at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Keys of a pair's sets that are looked up as bits instead of being joined, and pairs at one time.
HOT, CHUNK = 128, 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on all of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _whole(batches, *names: str) -> list[np.ndarray] | None:
    got = [b for b in batches if b.num_rows]
    return [t.column(n).to_numpy() for t in [pa.Table.from_batches(got)] for n in names] if got else None


def shared_lists(batches) -> Iterator[pa.RecordBatch]:
    """(c, key, weight) of all rows (s, c) of some items s. The key stands for the list of sets that an item is
    in; the weight is the number of these items of the task. Items of one set alone are left out: they are in no overlap."""
    whole = _whole(batches, "s", "c")
    if whole is None:
        return
    s, c = whole
    order = np.argsort(s, kind="stable")
    s, c = s[order], c[order]
    at = _starts(s)
    n = np.diff(np.append(at, len(s)))
    c = c[np.repeat(n > 1, n)]
    n = n[n > 1]
    if not len(n):
        return
    at = np.cumsum(n) - n
    key = mix(np.add.reduceat(mix(c.view(np.uint64) + np.uint64(0x5851F42D4C957F2D)), at) + n.astype(np.uint64))  # the order doesn't matter
    key, one, weight = np.unique(key, return_index=True, return_counts=True)
    n, at = n[one], at[one]
    rows = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array(c[rows]), pa.array(np.repeat(key, n).view(np.int64)), pa.array(np.repeat(weight, n).astype(np.int32))], names=["c", "key", "weight"])


def gathered(least: int):
    """(c, n, keys, weights) of each set from its rows (c, key, weight), if it can share ``least``."""

    def run(batches):
        whole = _whole(batches, "c", "key", "weight")
        if whole is None:
            return
        c, key, weight = whole
        order = np.lexsort((key, c))
        c, key, weight = c[order], key[order], weight[order]
        at = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (key[1:] != key[:-1])))
        c, key, weight = c[at], key[at], np.add.reduceat(weight, at)
        at = _starts(c)
        ends = np.append(at[1:], len(c))
        enough = np.flatnonzero(np.add.reduceat(weight.astype(np.int64), at) >= least)
        for k in range(0, len(enough), 10_000):
            rows = [slice(at[i], ends[i]) for i in enough[k : k + 10_000]]
            yield pa.RecordBatch.from_arrays([
                pa.array([c[r.start] for r in rows], pa.int64()), pa.array([r.stop - r.start for r in rows], pa.int32()),
                pa.array([key[r].tobytes() for r in rows], pa.binary()), pa.array([weight[r].astype(np.int32).tobytes() for r in rows], pa.binary()),
            ], names=["c", "n", "keys", "weights"])

    return run


def tile_pairs(doc: np.ndarray, side: np.ndarray, key: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, shared) of sets i and j that share ``least``: i of side 0 and j of side 1 or, if there is no side 1, i < j.

    doc, key, weight: a row for each key of a set. side: of each set. Keys are ordered from rare to common. Sets that share
    enough share a key among all but the commonest of their own, which weigh less than ``least``. The HOT commonest keys are joined
    on these only, and are counted as bits; all other keys are joined in full, which adds up their weights."""
    two = bool(side.any())
    for _ in range(3):  # keys that meet nothing, and sets that are left with too little, drop out
        _, key, n = np.unique(key, return_inverse=True, return_counts=True)
        met = n > 1
        if two:
            ones = np.bincount(key, side[doc], len(n))
            met &= (ones > 0) & (ones < n)
        stays = met[key]
        stays &= np.bincount(doc[stays], weight[stays], len(side))[doc] >= least
        if stays.all():
            break
        doc, key, weight = doc[stays], key[stays], weight[stays]
    if not len(doc):
        return
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(len(n))
    key = rank[key]
    order = np.lexsort((key, doc))
    doc, key, weight = doc[order], key[order], weight[order].astype(np.int64)
    at = _starts(doc)
    sums = np.cumsum(weight)
    many = np.diff(np.append(at, len(doc)))
    behind = np.repeat(sums[np.append(at[1:], len(doc)) - 1], many) - sums + weight  # weight of this key and all commoner ones
    first = max(0, len(n) - HOT)
    hot = key >= first
    weights = np.zeros(-(-HOT // 8) * 8)
    weights[key[hot] - first] = weight[hot]
    of_byte = np.array([weights[k : k + 8] @ ((np.arange(256) >> np.arange(8)[:, None]) & 1) for k in range(0, len(weights), 8)])
    sets, doc = doc[at], np.repeat(np.arange(len(at)), many)
    bits = np.zeros((len(sets), len(of_byte)), np.uint8)
    np.bitwise_or.at(bits, (doc[hot], (key[hot] - first) // 8), (1 << ((key[hot] - first) % 8)).astype(np.uint8))
    heat = np.bincount(doc[hot], weight[hot], len(sets))
    joined = ~hot | (behind >= least)
    doc, key, weight, mine = doc[joined], key[joined], np.where(hot, 0, weight)[joined], side[sets[doc[joined]]]
    # the right side by key; of a set's rows on the left, how many partners each has
    right = np.flatnonzero(mine == 1) if two else np.arange(len(doc))
    right = right[np.lexsort((doc[right], key[right]))]
    left = np.flatnonzero(mine == 0)
    stop = np.searchsorted(key[right], key[left], side="right")
    if two:
        start = np.searchsorted(key[right], key[left], side="left")
    else:  # partners are the sets behind
        place = np.empty(len(doc), np.int64)
        place[right] = np.arange(len(right))
        start = place[left] + 1
    size = stop - start
    upto = np.cumsum(size)
    bounds = np.append(_starts(doc[left]), len(left)) if len(left) else np.zeros(1, np.int64)
    work = np.append(0, upto)[bounds]
    width = len(sets)
    k = 0
    while k < len(bounds) - 1:  # whole sets, so that a pair is met in one chunk only
        e = max(k + 1, int(np.searchsorted(work, work[k] + CHUNK, side="right")) - 1)
        a, b = bounds[k], bounds[e]
        k = e
        some, total = size[a:b], int(upto[b - 1] - upto[a] + size[a])
        if not total:
            continue
        partner = doc[right[np.repeat(start[a:b] - (np.cumsum(some) - some), some) + np.arange(total)]]
        low = doc[left[a]]
        code = np.repeat((doc[left[a:b]] - low) * width, some) + partner
        each = np.repeat(weight[left[a:b]], some)
        cells = int(doc[left[b - 1]] - low + 1) * width
        if cells <= 8 * total:
            found = np.bincount(code, each + 2.0**-24, cells)  # a pair met at hot keys alone isn't zero
            pair = np.flatnonzero(found)
            got = np.floor(found[pair])
        else:
            pair, inverse = np.unique(code, return_inverse=True)
            got = np.bincount(inverse, each, len(pair))
        i, j = pair // width + low, pair % width
        may = got + np.minimum(heat[i], heat[j]) >= least
        i, j, got = i[may], j[may], got[may]
        got += sum(of_byte[w][bits[i, w] & bits[j, w]] for w in range(len(of_byte)))
        ok = got >= least
        if ok.any():
            yield sets[i[ok]], sets[j[ok]], got[ok].astype(np.int64)


def tiles_of(blocks: int):
    """The sets (c, keys, weights), each for the tiles of its block and any block."""

    def run(batches):
        for b in batches:
            own = (mix(b.column(0).to_numpy().view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            other = np.tile(np.arange(blocks), len(own))
            own, rows = np.repeat(own, blocks), np.repeat(np.arange(len(own)), blocks)
            low, high = np.minimum(own, other), np.maximum(own, other)
            tile = low * blocks - low * (low + 1) // 2 + high  # numbered without gaps
            for k in range(0, len(rows), 10_000):
                r = b.take(pa.array(rows[k : k + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(tile[k : k + 10_000]), pa.array((own > other)[k : k + 10_000]), *r.columns], names=["tile", "side", *r.schema.names])

    return run


def pairs_of_tiles(least: int):
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        tile, side, c = (t.column(n).to_numpy() for n in ("tile", "side", "c"))
        keys, weights = (t.column(n).to_pylist() for n in ("keys", "weights"))
        del t, got
        for one in np.unique(tile).tolist():
            rows = np.flatnonzero(tile == one)
            rows = rows[np.argsort(c[rows])]
            n = np.array([len(keys[r]) // 8 for r in rows])
            key = np.frombuffer(b"".join(keys[r] for r in rows), np.uint64)
            weight = np.frombuffer(b"".join(weights[r] for r in rows), np.int32)
            ids = c[rows]
            for i, j, shared in tile_pairs(np.repeat(np.arange(len(rows)), n), side[rows].astype(np.int64), key, weight, least):
                a, b = ids[i], ids[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(shared)], names=["class_a", "class_b", "shared"])

    return run

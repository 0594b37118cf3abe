"""Near-duplicate source texts: size-banded tiles with hashed bitmap signatures.

Two texts are alike if the sets of their shingles (see ``code_tokens``) have a Jaccard
similarity of at least ``threshold``. The steps, each over all texts:

1. Shingle every text. Texts with the same set are one *class* from here on, so copies
   are never compared with each other. Count how common every shingle is (``rarity``).
2. All shingles are in one order, from rare to common. Alike sets share at least ``threshold`` of either one's shingles, so they
   share one among those of each that come before its commonest ``ceil(threshold * size) - 1``: each class goes to the *tiles* of all
   these. No pair is missed, and no tile, key or candidate is capped. A class is sent once to each task, with the numbers of its tiles there.
   A tile whose key is common may be large (a third of all rows may be near copies):
   it is cut into blocks by a hash of the class, and each pair of blocks is a tile of its own.
3. Within a tile, rows are in order of size, and each meets those of its size band: the rows behind it
   that are not too large to be alike. A pair is looked at once, in however many tiles of a task it meets. Bitmaps
   of 2 to 4 bits per shingle bound the overlap from above: a shingle whose bit the
   other's map lacks is in no overlap. The longer map is folded onto the shorter one.
4. Pairs that survive are put together with the texts, and the overlap is counted exactly
   by intersection of the sorted arrays.

Defined cases: null, empty and blank texts and texts of comments alone are alike to none and get no
class. Texts of one or two tokens are alike to those with the same tokens only. Extra
columns of the input are left out. Empty input gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import rarity
from .code_tokens import mix, shingles, token_hashes
from .components import components

#: Postings in one task of the tile stage, pairs at one time, and classes in one block of a large tile.
TASK_ROWS, PAIRS, BLOCK = 4_000_000, 1 << 21, 2048
SALT = np.uint64(0x5851F42D4C957F2D)


def unpivot(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, text): one row per text that is not null; field is an index into fields."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("field"), F.col(f"`{f}`").alias("text")) for i, f in enumerate(fields)]))
    return df.select(F.col(f"`{id_col}`").alias("id"), pairs.alias("x")).select("id", "x.field", "x.text").where("text is not null")


def class_id(items: np.ndarray, field: int) -> np.uint64:
    """A 64-bit digest of a set of shingles of one field."""
    with np.errstate(over="ignore"):
        return mix(np.sum(mix(items ^ SALT), keepdims=True, dtype=np.uint64) + np.uint64(len(items) * 31 + field))[0]


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, field, shingles) of the batch's texts that have any token."""
    fields = batch.column(1).to_pylist()
    for i, tokens in token_hashes(batch.column(2).to_pylist()):
        if len(tokens):
            yield i, fields[i], shingles(tokens)


def _first_pass(batches):
    """Rows of two kinds: (id, field, class, size) of each text, and at the end the task's counters."""
    counts = np.zeros(rarity.BUCKETS, np.uint32)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    names = ["id", "field", "class", "size", "slice", "counts"]
    for batch in batches:
        rows, fields, classes, items = [], [], [], []
        for i, f, s in _sets(batch):
            rows.append(i)
            fields.append(f)
            classes.append(class_id(s, f))
            items.append(s)
        if rows:
            counts += np.bincount(rarity.bucket(np.concatenate(items)), minlength=rarity.BUCKETS).astype(np.uint32)
            none = pa.nulls(len(rows), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(fields, pa.int32()), pa.array(np.array(classes, np.uint64).view(np.int64)), pa.array([len(s) for s in items], pa.int32()), none, pa.nulls(len(rows), pa.binary())], names=names)
    for k, c in rarity.slices(counts):
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, kinds[2]), pa.nulls(1, kinds[3]), pa.array([k], pa.int32()), pa.array([c], pa.binary())], names=names)


def bitmap_bits(size: int) -> int:
    """A power of two from two to four times the size, 64 at least."""
    return max(64, 1 << (2 * size - 1).bit_length())


def bitmap(items: np.ndarray) -> bytes:
    bits = bitmap_bits(len(items))
    on = np.zeros(bits, np.uint8)
    on[(items & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(on, bitorder="little").tobytes()


def _tile(key: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """The tile of a key and a pair of blocks, as one number."""
    return mix(key + mix(b1.astype(np.uint64) * np.uint64(1 << 32) + b2.astype(np.uint64)))


def prefix(items: np.ndarray, order: np.ndarray, threshold: float) -> np.ndarray:
    """Where the items are of which a set that is alike has one: all but the last ceil(threshold * size) - 1 in ``order``, ties by hash."""
    n = len(items) - math.ceil(threshold * len(items) - 1e-9) + 1
    rank = (order.astype(np.uint64) << np.uint64(56)) | (mix(items ^ SALT) >> np.uint64(8))
    return np.argsort(rank)[:n]


def _postings(rare, threshold: float, width: int, block: int):
    """(part, class, size, bits, tiles, places): a class once for each part of its tiles, with their numbers in it and how far on in the class's
    order each is, in parts of 256. Two tiles may get one number, which brings more rows together and loses none."""

    def run(batches):
        known: set[int] = set()
        for batch in batches:
            keys, common, classes, sizes, maps, many = [], [], [], [], [], []
            for _, f, s in _sets(batch):
                c = int(class_id(s, f))
                if c in known:  # a copy of a text of this task: its class has been sent
                    continue
                known.add(c)
                order = rare.value.order[rarity.bucket(s)]
                first = prefix(s, order, threshold)
                keys.append(s[first] ^ mix(np.array([f + 1], np.uint64)))
                common.append(order[first])
                classes.append(c)
                sizes.append(len(s))
                maps.append(bitmap(s))
                many.append(len(first))
            if not keys:
                continue
            key, text = np.concatenate(keys), np.repeat(np.arange(len(many)), many)
            blocks = np.maximum(1, np.ceil(rare.value.above(np.concatenate(common)) / block)).astype(np.int64)
            # a class meets each block of its key's tile in a tile of the two blocks
            at = np.repeat(np.arange(len(key)), blocks)
            other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            place = np.concatenate([(np.arange(m) * 256 // n).astype(np.uint8) for m, n in zip(many, sizes)])[at]
            text, c = text[at], np.array(classes, np.uint64)
            own = (c[text] % blocks[at].astype(np.uint64)).astype(np.int64)
            tile = _tile(key[at], np.minimum(own, other), np.maximum(own, other))
            to = text * width + (tile % np.uint64(width)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to, tile = to[order], np.ascontiguousarray((tile >> np.uint64(32)).astype(np.uint32)[order])
            at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            text, part = np.divmod(to[at], width)
            ends = pa.py_buffer(np.append(at, len(to)).astype(np.int32) * 4)
            tiles = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(tile)])
            ends = pa.py_buffer(np.append(at, len(to)).astype(np.int32))
            places = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(np.ascontiguousarray(place[order]))])
            bits = pa.array(maps, pa.binary()).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(c.view(np.int64)[text]), pa.array(np.array(sizes, np.int32)[text]), bits, tiles, places], names=["part", "class", "size", "bits", "tiles", "places"])

    return run


class Bitmaps:
    """Bitmaps of several lengths, side by side by length."""

    def __init__(self, maps: pa.BinaryArray | list[bytes]):
        maps = pa.array(maps, pa.binary()) if isinstance(maps, list) else maps
        ends = np.frombuffer(maps.buffers()[1], np.int32)[maps.offset : maps.offset + len(maps) + 1].astype(np.int64)
        data = np.frombuffer(maps.buffers()[2], np.uint8)
        self.words = (ends[1:] - ends[:-1]) // 8
        self.row = np.zeros(len(maps), np.int64)
        self.of = {}
        for w in np.unique(self.words).tolist():
            mine = np.flatnonzero(self.words == w)
            self.row[mine] = np.arange(len(mine))
            self.of[w] = np.ascontiguousarray(data[ends[:-1][mine][:, None] + np.arange(8 * w)]).view(np.uint64)

    def lacking(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of maps, how many bits of each the other lacks. Those of i are not the longer ones."""
        a, b = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        shape = self.words[i] * (1 << 32) + self.words[j]
        for s in np.unique(shape).tolist():
            at = np.flatnonzero(shape == s)
            short, long = s >> 32, s & 0xFFFFFFFF
            x, y = self.of[short][self.row[i[at]]], self.of[long][self.row[j[at]]]
            if long > short:
                y = np.bitwise_or.reduce(y.reshape(len(at), long // short, short), axis=1)
            a[at] = np.bitwise_count(x & ~y).sum(axis=1)
            b[at] = np.bitwise_count(y & ~x).sum(axis=1)
        return a, b


def tile_pairs(tile: np.ndarray, row: np.ndarray, place: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (the smaller set first) that meet in a tile and can be alike by their sizes and places, each once or, if there are
    more than PAIRS of them, a few times. Rows are numbered in order of size.

    In the first tile in which a pair meets, all that it shares is at its places there or behind them. So the part of a row from a
    place on says how large a set can be that is alike and meets the row there first."""
    at = (tile.astype(np.uint64) << np.uint64(32)) | row.astype(np.uint64)
    order = np.argsort(at, kind="stable")
    order = order[np.append(True, at[order][1:] != at[order][:-1])]
    at, row = at[order], row[order]
    most = size[row] * (1 - place[order] / 256) * (1 + threshold) / threshold - size[row] + 1e-6
    beyond = np.searchsorted(size, np.minimum(size[row] / threshold + 1e-9, most), side="right")  # rows from here on are too large
    stop = np.searchsorted(at, (at >> np.uint64(32) << np.uint64(32)) | beyond.astype(np.uint64))
    many = np.maximum(stop - np.arange(len(at)) - 1, 0)
    upto = np.append(0, np.cumsum(many))
    n, k, got, waiting = len(size), 0, [], 0
    while k < len(at):
        e = max(k + 1, int(np.searchsorted(upto, upto[k] + PAIRS, side="right")) - 1)
        some = many[k:e]
        j = np.repeat(np.arange(k, e) + 1 - (upto[k:e] - upto[k]), some) + np.arange(int(some.sum()))
        i = np.repeat(row[k:e], some)
        fit = size[i] <= most[j]
        got.append(i[fit] * n + row[j[fit]])
        waiting += len(got[-1])
        k = e
        if waiting > 2 * PAIRS or k == len(at):
            pairs = np.unique(np.concatenate(got))
            got, waiting = [pairs], len(pairs)
            if waiting > PAIRS or k == len(at):
                yield pairs // n, pairs % n
                got, waiting = [], 0


def _candidates(threshold: float):
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        del got
        c, size = t.column("class").to_numpy(), t.column("size").to_numpy()
        order = np.lexsort((c, size))
        new = np.ones(len(c), bool)  # the same class may come from several tasks
        new[1:] = c[order][1:] != c[order][:-1]
        row = np.empty(len(c), np.int64)
        row[order] = np.cumsum(new) - 1
        order = order[new]
        tiles = t.column("tiles").combine_chunks()
        ends = np.frombuffer(tiles.buffers()[1], np.int32)[tiles.offset : tiles.offset + len(tiles) + 1].astype(np.int64)
        tile = np.frombuffer(tiles.buffers()[2], np.uint32)[ends[0] // 4 : ends[-1] // 4]
        places = t.column("places").combine_chunks()
        place = np.frombuffer(places.buffers()[2], np.uint8)[ends[0] // 4 : ends[-1] // 4]
        maps = Bitmaps(t.column("bits").combine_chunks().take(pa.array(order)))
        row = np.repeat(row, np.diff(ends) // 4)
        c, size = c[order], size[order].astype(np.int64)
        for i, j in tile_pairs(tile, row, place, size, threshold):
            for k in range(0, len(i), 1 << 15):
                p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                lacks_p, lacks_q = maps.lacking(p, q)
                most = np.minimum(size[p] - lacks_p, size[q] - lacks_q)
                ok = most * (1 + threshold) >= threshold * (size[p] + size[q]) - 1e-9
                if ok.any():
                    a, b = c[p[ok]], c[q[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["class_a", "class_b"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (id_a, id_b, ...) of rows of texts (id, text), those that are alike: the overlap
    is counted exactly. The texts are shuffled by id once; the second join reads the same shuffle."""
    names = [c for c in pairs.columns if c not in ("id_a", "id_b")]
    a = pairs.join(texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a")
    both = a.join(texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b").select("id_a", "id_b", *names, "text_a", "text_b")
    n = len(names) + 2

    def run(batches):
        last: tuple[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ta, tb = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            sa = dict(token_hashes(ta))
            fresh = [t if (i == 0 or t != tb[i - 1]) else None for i, t in enumerate(tb)]  # rows come sorted by id_b
            sb = dict(token_hashes(fresh))
            sim = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                if i in sb:
                    last = (tb[i], shingles(sb[i]))
                x, y = shingles(sa[i]), last[1]
                if len(x) and len(y):
                    merged = np.concatenate([x, y])
                    merged.sort()
                    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
                    sim[i] = both / (len(merged) - both)
            keep = pa.array(sim >= threshold)
            out = pa.RecordBatch.from_arrays([batch.column(k) for k in range(n)] + [pa.array(sim)], names=["id_a", "id_b", *names, "similarity"]).filter(keep)
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields[:n]) + ", similarity double"
    return both.mapInArrow(run, schema)


class NearDuplicates:
    """Classes of equal texts, and pairs of classes that are alike.

    members: (id, field, class), one row per text with tokens. pairs: (class_a, class_b,
    field, similarity). Both are tables in the shared folder or plans on top of them."""

    def __init__(self, df: DataFrame, id_col: str, fields: list[str], threshold: float = 0.5):
        spark = df.sparkSession
        self.fields = fields
        rows = unpivot(df, id_col, fields)
        first = cut(rows.mapInArrow(_first_pass, "id bigint, field int, class bigint, size int, slice int, counts binary"), "nd-first")
        self.members = first.where("class is not null").select("id", "field", "class")
        counts = rarity.total(first.where("slice is not null").select("slice", "counts"))
        rare = spark.sparkContext.broadcast(rarity.Rarity(counts))
        postings = (1 - threshold) * (first.agg(F.sum("size")).first()[0] or 0) + self.members.count()
        width = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 3, math.ceil(postings / TASK_ROWS), 1)
        posts = rows.mapInArrow(_postings(rare, threshold, width, BLOCK), "part int, class bigint, size int, bits binary, tiles binary, places binary")
        candidates = posts.repartitionById(width, "part").mapInArrow(_candidates(threshold), "class_a bigint, class_b bigint").distinct()
        self.representatives = self.members.groupBy("class", "field").agg(F.min("id").alias("rep"))
        r = self.representatives
        by_rep = candidates.join(r.select(F.col("class").alias("class_a"), F.col("rep").alias("rep_a"), "field"), "class_a").join(r.select(F.col("class").alias("class_b"), F.col("rep").alias("rep_b")), "class_b")
        # one key for a text of either field, so that one shuffle of the texts serves both
        key = lambda c: F.struct(F.col(c).alias("id"), F.col("field").alias("field"))
        texts = rows.select(F.struct("id", "field").alias("id"), "text")
        checked = verify(by_rep.select(key("rep_a").alias("id_a"), key("rep_b").alias("id_b"), "class_a", "class_b"), texts, threshold)
        self.pairs = cut(checked.select("class_a", "class_b", F.col("id_a.field").alias("field"), F.col("id_a.id").alias("rep_a"), F.col("id_b.id").alias("rep_b"), "similarity"), "nd-pairs")
        self._first = first


def found_pairs(nd: NearDuplicates) -> DataFrame:
    """(id_a, id_b, field) of all alike rows: pairs of classes spread over their members, and the pairs
    within classes of copies. The number of rows is that of the result asked for."""
    m = nd.members.select("id", "class")
    across = nd.pairs.select("class_a", "class_b", "field").join(m.select(F.col("class").alias("class_a"), F.col("id").alias("a")), "class_a").join(m.select(F.col("class").alias("class_b"), F.col("id").alias("b")), "class_b")
    copies = nd.members.join(nd.members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1"), "class")
    within = copies.select("class", "field", F.col("id").alias("a")).join(copies.select("class", F.col("id").alias("b")), "class").where("a < b")
    both = across.select("a", "b", "field").unionByName(within.select("a", "b", "field"))
    names = F.element_at(F.array(*[F.lit(f) for f in nd.fields]), F.col("field") + 1)
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), names.alias("field"))


def grouped(nd: NearDuplicates) -> DataFrame:
    """(id, field, group_id, links): one row per text with tokens. Texts linked through others are one group, named by
    its least id; links counts the other classes that the text's own class is alike to."""
    linked = components(nd.pairs, "class_a", "class_b")
    ends = nd.pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    classes = nd.representatives.join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = classes.groupBy("component").agg(F.min("rep").alias("group_id"))
    named = classes.join(least, "component").join(ends, "class", "left").select("class", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
    field = F.element_at(F.array(*[F.lit(f) for f in nd.fields]), F.col("field") + 1)
    return nd.members.join(named, "class").select("id", field.alias("field"), "group_id", "links")

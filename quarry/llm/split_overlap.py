"""Records of evaluation splits that are also, exactly or almost, in the training split.

Content-defined chunks: a record's text is normalised to its sequence of code tokens, and
cut behind every window of three tokens whose rolling hash has CUT_BITS low zero bits, so an
edit moves the cuts only near itself. Chunk digests are joined across the splits, and the
lengths of the chunks that two records share are added up into the part of the longer record
that they cover. What a record repeats counts once, as similarity is one of sets. Records of under SHORT tokens have few chunks, and are joined by their shingles too. Pairs above MIN_SHARE are put together with their texts, and similarity is counted
exactly on the sets of shingles.

Records with the same token sequence are one class, so copies are never joined with each other,
and a class is sent once by a task. Digests are drawn by commonness, rare ones first, until those left
over are less than nine twentieths of the record's (``rarity``), with all digests of each class of commonness
that is reached, however long the record: all rare chunks are joined, and idioms
such as ``return 0;`` only where a record, or a family of near copies, has little else. The shared part is
measured against the drawn chunks, as only these can be shared. Large tiles are cut into blocks; none is capped.

Defined cases. A split is read trimmed and in lower case: ``train`` is training, null or blank is in no
split, all else is evaluation data. Null, empty and blank texts and texts of comments alone are in no pair.
A class with members on both sides is a pair of each with each. Extra columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import rarity
from .code_tokens import R, mix, shingles, token_hashes
from .near_duplicates import BLOCK, verify

CUT_BITS, MIN_SHARE, REST = 2, 0.05, 0.45
TASK_ROWS, SHORT, LONG = 600_000, 96, 32
TRAIN, EVAL = 1, 2


def normal_split(split="split"):
    return F.lower(F.regexp_replace(F.col(split), r"(?U)^\s+|\s+$", ""))


def _pieces(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, start, tokens) of one text's chunks in order."""
    n = len(tokens)
    ends = np.array([n])
    if n > 3:
        w = mix(tokens[:-2] * np.uint64(3) + tokens[1:-1] * np.uint64(5) + tokens[2:] * np.uint64(7))
        ends = np.append(np.flatnonzero((w[:-1] & np.uint64((1 << CUT_BITS) - 1)) == 0) + 3, n)
    starts = np.append(0, ends[:-1])
    size = ends - starts
    place = np.arange(n, dtype=np.uint64) - np.repeat(starts, size).astype(np.uint64)
    parts = mix(tokens + place * np.uint64(R))
    return mix(np.add.reduceat(parts, starts) + size.astype(np.uint64)), starts, size


def chunks(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct digests, tokens they cover) of one text's chunks."""
    digest, _, size = _pieces(tokens)
    u, inverse = np.unique(digest, return_inverse=True)
    return u, np.bincount(inverse, weights=size).astype(np.int64)


def weights(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct digests, their lengths): a chunk that is repeated counts once, and within a
    LONG one, such as a table of zeros without a cut, only the distinct shingles count."""
    digest, starts, size = _pieces(tokens)
    u, first = np.unique(digest, return_index=True)
    length = size[first]
    for k in np.flatnonzero(length > LONG):
        start = starts[first[k]]
        length[k] = len(shingles(tokens[start : start + length[k]])) + 2
    return u, length


def join_items(tokens: np.ndarray, s: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What a record is joined by: its chunks, and its shingles s too if it is SHORT and has few chunks."""
    d, covers = weights(tokens)
    if len(tokens) >= SHORT:
        return d, covers
    s = shingles(tokens) if s is None else s
    s = s[~np.isin(s, d)]
    both, more = np.concatenate([d, s]), np.concatenate([covers, np.ones(len(s), np.int64)])
    o = np.argsort(both)
    return both[o], more[o]


def sequence_class(tokens: np.ndarray) -> int:
    place = np.arange(len(tokens), dtype=np.uint64)
    return int(mix(np.sum(mix(tokens + place * np.uint64(R)), keepdims=True, dtype=np.uint64) + np.uint64(len(tokens)))[0].view(np.int64))


def _first_pass(batches):
    counts = np.zeros(rarity.BUCKETS, np.uint32)
    names = ["id", "side", "class", "slice", "counts"]
    for batch in batches:
        rows, classes = [], []
        for i, t in token_hashes(batch.column(2).to_pylist()):
            if len(t):
                rows.append(i)
                classes.append(sequence_class(t))
                np.add.at(counts, rarity.bucket(join_items(t)[0]), 1)
        if rows:
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(classes, pa.int64()), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names=names)
    for k, c in rarity.slices(counts):
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([c], pa.binary())], names=names)


def _postings(rare):
    def run(batches):
        known: set = set()
        for batch in batches:
            sides = batch.column(1).to_pylist()
            parts: list[list[np.ndarray]] = [[], [], [], [], [], [], [], []]
            for i, t in token_hashes(batch.column(2).to_pylist()):
                if not len(t):
                    continue
                c = sequence_class(t)
                if (c, sides[i]) in known:
                    continue
                known.add((c, sides[i]))
                s = shingles(t)
                digest, covers = join_items(t, s)
                drawn, klass = rare.value.keys(digest, len(digest), digest, REST)
                covers = covers[np.searchsorted(digest, drawn)]
                blocks = np.maximum(1, np.ceil(rare.value.limit * (1 << klass.astype(np.int64)) / BLOCK)).astype(np.int64)
                # blocks of one side meet all blocks of the other: a row is sent once for each
                at = np.repeat(np.arange(len(drawn)), blocks)
                other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                own = np.abs(c) % blocks[at]
                train = sides[i] == TRAIN
                n = len(at)
                for p, x in zip(parts, (drawn[at].view(np.int64), own if train else other, other if train else own, np.full(n, sides[i]), np.full(n, c), covers[at], np.full(n, len(s)), np.full(n, min(len(t), covers.sum())))):
                    p.append(x)
            if parts[0]:
                kinds = [np.int64, np.int32, np.int32, np.int32, np.int64, np.int32, np.int32, np.int32]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(k)) for p, k in zip(parts, kinds)], names=["digest", "b1", "b2", "side", "class", "covers", "size", "length"])

    return run


def _join(threshold: float):
    """Pairs (train class, evaluation class) of a task's tiles with the lengths they share there."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        digest, b1, b2, side, c, covers, size, length = (t.column(i).to_numpy() for i in range(8))
        cell = mix(digest.view(np.uint64) + mix(b1.astype(np.uint64) * np.uint64(1 << 32) + b2.astype(np.uint64)))
        order = np.lexsort((c, side, cell))
        cell, side, c, covers, size, length = cell[order], side[order], c[order], covers[order], size[order], length[order]
        keep = np.ones(len(c), bool)
        keep[1:] = (cell[1:] != cell[:-1]) | (c[1:] != c[:-1]) | (side[1:] != side[:-1])
        cell, side, c, covers, size, length = cell[keep], side[keep], c[keep], covers[keep], size[keep], length[keep]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        last = np.append(first[1:], len(cell))
        trains = np.add.reduceat((side == TRAIN).astype(np.int64), first)
        evals = last - first - trains
        at = np.flatnonzero((trains > 0) & (evals > 0))
        sums: list[np.ndarray] = []
        held = 0

        def packed():
            a = np.concatenate([s[0] for s in sums])
            b = np.concatenate([s[1] for s in sums])
            w = np.concatenate([s[2] for s in sums])
            n = np.concatenate([s[3] for s in sums])
            o = np.lexsort((b, a))
            a, b, w, n = a[o], b[o], w[o], n[o]
            start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(a[start]), pa.array(b[start]), pa.array(np.add.reduceat(w, start).astype(np.int32)), pa.array(n[start])], names=["train", "eval", "shared", "longer"])

        for k in range(0, len(at), 4096):
            some = at[k : k + 4096]
            while len(some):  # as many tiles at once as make some million pairs
                many = np.cumsum(trains[some] * evals[some])
                upto = max(1, int(np.searchsorted(many, 2_000_000)))
                tiles, some = some[:upto], some[upto:]
                n = trains[tiles] * evals[tiles]
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                tile = np.repeat(tiles, n)
                i = first[tile] + within // evals[tile]
                j = first[tile] + trains[tile] + within % evals[tile]
                # sets of alike records are at least half as large as each other; size counts distinct shingles
                ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
                i, j = i[ok], j[ok]
                sums.append((c[i], c[j], np.minimum(covers[i], covers[j]).astype(np.int64), np.maximum(length[i], length[j])))
                held += len(i)
                if held > 2_000_000:
                    yield packed()
                    sums, held = [], 0
        if held:
            yield packed()

    return run


class SplitOverlap:
    """members: (id, side, class) of every record in a split with code. pairs: (rep_a, rep_b, train,
    eval, similarity) of alike classes on the two sides; classes on both sides are not listed."""

    def __init__(self, df: DataFrame, id_col: str, text: str, split: str = "split", threshold: float = 0.5):
        spark = df.sparkSession
        s = normal_split(split)
        side = F.when(s == "train", TRAIN).when(s != "", EVAL).cast("int")
        rows = df.select(F.col(id_col).alias("id"), side.alias("side"), F.col(text).alias("text")).where("side is not null and text is not null")
        first = cut(rows.mapInArrow(_first_pass, "id bigint, side int, class bigint, slice int, counts binary"), "so-first")
        self.members = first.where("class is not null").select("id", "side", "class")
        counts = rarity.total(first.where("slice is not null").select("slice", "counts"))
        rare = spark.sparkContext.broadcast(rarity.Rarity(counts))
        width = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 2, math.ceil(int(counts.sum()) / TASK_ROWS), 1)
        posts = rows.mapInArrow(_postings(rare), "digest bigint, b1 int, b2 int, side int, class bigint, covers int, size int, length int")
        joined = posts.repartition(width, "digest", "b1", "b2").mapInArrow(_join(threshold), "train bigint, eval bigint, shared int, longer int")
        shared = joined.where("train <> eval").groupBy("train", "eval").agg(F.sum("shared").alias("shared"), F.max("longer").alias("longer")).where(F.col("shared") >= MIN_SHARE * F.col("longer"))
        reps = self.members.groupBy("class").agg(F.min("id").alias("rep"))
        pairs = shared.join(reps.select(F.col("class").alias("train"), F.col("rep").alias("id_a")), "train").join(reps.select(F.col("class").alias("eval"), F.col("rep").alias("id_b")), "eval")
        checked = verify(pairs.select("id_a", "id_b", "train", "eval", (F.col("shared") / F.col("longer")).alias("share")), rows.select("id", "text"), threshold)
        self.pairs = cut(checked, "so-pairs")


def found_pairs(so: SplitOverlap) -> DataFrame:
    """(train_id, eval_id, similarity, share) of all alike records on the two sides."""
    train = so.members.where(F.col("side") == TRAIN).select(F.col("class").alias("train"), F.col("id").alias("train_id"))
    other = so.members.where(F.col("side") == EVAL).select(F.col("class").alias("eval"), F.col("id").alias("eval_id"))
    near = so.pairs.select("train", "eval", "similarity", "share").join(train, "train").join(other, "eval").select("train_id", "eval_id", "similarity", "share")
    same = train.join(other, train["train"] == other["eval"]).select("train_id", "eval_id", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("share"))
    return near.unionByName(same)


def report(so: SplitOverlap, df: DataFrame, id_col: str, by: list[str]) -> DataFrame:
    """Per group of evaluation records: how many there are, how many are also in the
    training split, and how many pairs there are. ``by`` names columns of df, read in normal form."""
    # counted from classes: of each, its members in training and those of the classes it is alike to, so no pair is made
    trained = so.members.where(F.col("side") == TRAIN).groupBy("class").agg(F.count("*").alias("k"))
    near = so.pairs.select("train", F.col("eval").alias("class"), "similarity").join(trained.withColumnRenamed("class", "train"), "train").select("class", "k", "similarity")
    met = near.unionByName(trained.withColumn("similarity", F.lit(1.0))).groupBy("class").agg(F.sum("k").alias("n"), F.max("similarity").alias("most"))
    hits = so.members.where(F.col("side") == EVAL).join(met, "class").select(F.col("id").alias("eval_id"), "n", "most")
    rows = df.select(F.col(id_col).alias("id"), normal_split().alias("split"), *[F.lower(F.trim(F.col(c))).alias(c) for c in by if c != "split"]).where("split <> 'train' and split <> ''")
    j = rows.join(hits, rows["id"] == hits["eval_id"], "left")
    return j.groupBy("split", *[c for c in by if c != "split"]).agg(
        F.count("*").alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count(F.when(F.col("most") >= 1 - 1e-12, 1)).alias("same_sets")
    )

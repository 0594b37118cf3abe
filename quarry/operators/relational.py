"""Joins, preference and order: the operators that Spark has no single word for."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import shingles

_WORDS = re.compile(r"[a-z0-9_]+")

#: A side is broadcast only if its plan's estimated bytes, or its counted rows, stay below these.
BROADCAST_ROWS, FEW_BANDS = 100_000, 64


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column], keep: list[str] | None = None) -> DataFrame:
    """The first row of each key in ``order``, as an aggregate: a hot key is combined before the shuffle,
    where a window would sort all its rows in one task. ``order`` must tell all rows of a key apart."""
    keep = keep or df.columns
    o = [F.col(c) if isinstance(c, str) else c for c in order]
    best = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(o)], F.struct(*keep).alias("row")))
    return df.groupBy(*keys).agg(best.alias("best")).select("best.row.*")


def ranked_join(left: DataFrame, right: DataFrame, on: list[str], id_cols: list[str], rank: Column, tie: list[str], take: list[str]) -> DataFrame:
    """Left join that keeps the preferred match: least ``rank``, then ``tie``. Rows without a match keep nulls."""
    pairs = left.join(right, on, "left")
    best = F.min(F.struct(rank.alias("rank"), *tie, *[c for c in take if c not in tie]))
    return pairs.groupBy(*id_cols).agg(best.alias("best")).select(*id_cols, *[F.col(f"best.{c}").alias(c) for c in take])


#: Ranges of time that an as-of join is cut into.
RANGES, MANY_RANGES = 32, 256


def _ordinal(c: Column, kind: str) -> Column:
    """A number in the order of a column."""
    return F.unix_micros(c.cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else c.cast("double")


def _range_of(c: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are not above the value: halved again and again, so few are looked at."""
    if not bounds:
        return F.lit(0)
    mid = len(bounds) // 2
    return F.when(c >= F.lit(float(bounds[mid])), _range_of(c, bounds[mid + 1 :]) + (mid + 1)).otherwise(_range_of(c, bounds[:mid]))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str], tie: str, direction: str = "backward", ranges: int = RANGES) -> DataFrame:
    """Each left row with the last right row of the same key at or before it (or the first at or after it): one union, one
    shuffle, one window that carries the last right row on. ``tie`` orders right rows of the same time.

    Backward, the rows of a key are cut into ranges of the order column, at quantiles of the right side, so that a hot
    or constant key is many tasks. Of each range the last right row is carried over to the ranges behind it up to the next one
    that has any."""
    kind, row, cell = "_kind", "_row", "_cell"
    if direction == "backward" and ranges > 1:
        order = lambda d: _ordinal(F.col(at), d.schema[at].dataType.simpleString())
        quantiles = F.percentile_approx(order(right), F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(1000))
        bounds = sorted(set(right.agg(quantiles.alias("q")).first()["q"] or []))  # a number for each range
        if bounds:
            place = lambda d: d.withColumn(cell, F.coalesce(_range_of(order(d), bounds), F.lit(0)))
            left, right = place(left), place(right)
            last = F.max(F.struct(F.col(at), F.col(tie).isNull(), F.col(tie), F.struct(*right.columns).alias("all")))["all"]
            ends = right.groupBy(*by, cell).agg(last.alias("e"))  # a row for each range of a key
            upto = F.coalesce(F.lead(cell).over(Window.partitionBy(*by).orderBy(cell)), F.lit(len(bounds)))
            on = ends.withColumn("_upto", upto).where(F.col(cell) < len(bounds)).select(F.explode(F.sequence(F.col(cell) + 1, "_upto")).alias("_to"), "e.*")
            right = right.unionByName(on.withColumn(cell, F.col("_to")).drop("_to"))
            return asof_join(left, right, [*by, cell], at, take, tie, direction, 1).drop(cell)
    sign = 1 if direction == "backward" else -1
    names = left.columns
    a = left.select(*names, F.lit(1).alias(kind), F.lit(None).cast(right.select(F.struct(*take).alias(row)).schema[row].dataType).alias(row), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"))
    b = right.select(*[F.col(c) if c in (*by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], F.lit(0).alias(kind), F.struct(*take).alias(row), F.col(tie).alias("_tie"))
    order = [F.col(at).asc() if sign > 0 else F.col(at).desc(), F.col(kind), F.col("_tie").asc_nulls_last()]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("_last", F.last(row, ignorenulls=True).over(w))
    return seen.where(F.col(kind) == 1).select(*names, *[F.col(f"_last.{c}").alias(f"asof_{c}") for c in take])


def range_lookup(df: DataFrame, value: str, bands: DataFrame, low: str, high: str, take: list[str], how: str = "left") -> DataFrame:
    """Rows with the band [low, high) that holds the value. Bands must not overlap; bounds are compared as doubles.

    A few bands are a broadcast condition. Up to BROADCAST_ROWS of them each row's band is found by binary search
    among the lower bounds, and joined by its number; beyond, by as-of on the lower bounds, in ranges. So no row is
    compared with more than FEW_BANDS bands."""
    number = lambda d, c: d.withColumn("_at", F.col(c).cast("double"))
    count = bands.limit(BROADCAST_ROWS + 1).count()
    inside = (F.col(value) >= F.col("_low")) & (F.col(value) < F.col("_high"))
    if count <= min(FEW_BANDS, BROADCAST_ROWS):
        b = F.broadcast(bands.select(F.col(low).alias("_low"), F.col(high).alias("_high"), *take))
        return df.join(b, inside, how).drop("_low", "_high")
    if count <= BROADCAST_ROWS:
        lows = np.sort(np.array([r["_at"] for r in number(bands, low).select("_at").where("_at is not null").collect()]))  # BROADCAST_ROWS numbers at most

        @F.pandas_udf("int")
        def place(v: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(lows, v.to_numpy(np.float64), side="right").astype(np.int32))

        b = number(bands, low).select(place("_at").alias("_band"), F.col(low).alias("_low"), F.col(high).alias("_high"), *take)
        d = number(df, value).withColumn("_place", place("_at")).drop("_at")
        return d.join(F.broadcast(b), (F.col("_place") == F.col("_band")) & inside, how).drop("_low", "_high", "_band", "_place")
    key = lambda d, c: number(d, c).withColumn("_one", F.lit(0))
    out = asof_join(key(df, value), key(bands, low), ["_one"], "_at", [low, high, *take], low, ranges=MANY_RANGES)
    within = F.col(value) < F.col(f"asof_{high}")
    out = out.select(*df.columns, *[F.when(within, F.col(f"asof_{c}")).alias(c) for c in take])
    return out if how == "left" else out.where(F.col(take[0]).isNotNull())


def first_match(df: DataFrame, text: str, rules: list[tuple], default: tuple, names: list[str]) -> DataFrame:
    """Columns of the first rule whose word the text contains, or the default: a stated, ordered, short table, so
    that it folds into one expression and needs no join."""
    out = df
    for i, n in enumerate(names, 1):
        e = F.lit(default[i - 1])
        for r in reversed(rules):
            e = F.when(F.col(text).contains(r[0]), F.lit(r[i])).otherwise(e)
        out = out.withColumn(n, e)
    return out


class _Words(dict):
    """The hash of each word, made once."""

    def __missing__(self, word: str) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


def _run_sets(texts, k: int) -> Iterator[np.ndarray | None]:
    """The sorted distinct hashes of each text's runs of k successive words; None if it has fewer words."""
    known = _Words()
    for t in texts:
        words = _WORDS.findall(t.lower()) if t else []
        if len(words) < k:
            yield None
            continue
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        total = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            total = (total ^ h[i : len(total) + i]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        yield np.unique(total).view(np.int64)
        if len(known) > 200_000:
            known.clear()


def word_runs(text: str | Column, k: int) -> Column:
    """The distinct hashes of all runs of k successive words (letters, digits, underscores, in lower case)."""

    @F.pandas_udf("array<bigint>")
    def runs(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_run_sets(texts, k)), dtype=object)

    return runs(text)


#: Needles in one automaton: so many rows, or so many characters, whichever is less.
NEEDLES, NEEDLE_CHARS = 50_000, 4_000_000


def _search(needles: list[str], text: str, to: str):
    """The rows of all occurrences, by one automaton of all needles: a row's columns and the needle found."""

    def run(batches):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, n in enumerate(needles):
            a.add_word(n, k)
        a.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                hits = sorted({k for _, k in a.iter(t)}) if t else []
                at += [i] * len(hits)
                found += hits
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([needles[k] for k in found], pa.string())], names=[*batch.schema.names, to])

    return run


def contains_join(needles: DataFrame, hay: DataFrame, needle: str, text: str, k: int = 4) -> DataFrame:
    """Rows of needles and hay where text contains needle, case and all. Null and empty needles are in nothing; the two
    sides' columns must have different names.

    A needle with k whole words inside (its first and last may be parts of words) meets only the texts that have
    such a run, however many needles there are. Shorter ones are searched by automata of bounded size, so that a text is
    read once for each block of NEEDLES of them and no needle is compared with a text by itself."""
    n = needles.where(F.length(needle) > 0)
    inner = F.regexp_replace(F.regexp_replace(F.lower(needle), r"\A[a-z0-9_]+", ""), r"[a-z0-9_]+\z", "")
    runs = n.withColumn("_runs", word_runs(inner, k))
    long = runs.where("_runs is not null").withColumn("_key", F.element_at("_runs", 1)).drop("_runs")
    out = long.join(hay.withColumn("_key", F.explode(word_runs(text, k))), "_key").where(F.contains(F.col(text), F.col(needle))).drop("_key")
    short = runs.where("_runs is null").select(needle).distinct()
    size = short.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(needle)), F.lit(0)).alias("c")).first()
    blocks = max(-(-size["n"] // NEEDLES), -(-size["c"] // NEEDLE_CHARS))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hay.schema.fields) + ", _needle string"
    for b in range(blocks):
        mine = sorted(r[0] for r in short.where(F.pmod(F.xxhash64(needle), F.lit(blocks)) == b).collect())  # a block of stated size
        if not mine:
            continue
        found = hay.mapInArrow(_search(mine, text, "_needle"), schema)
        out = out.unionByName(n.join(found, n[needle] == found["_needle"]).drop("_needle"))
    return out


#: Runs in one task, by the length of the texts, and keys of the sets in one block.
TASK_RUNS, BLOCK_KEYS = 1_500_000, 1_000_000


def shared_shingles(df: DataFrame, id_col: str, text: str, k: int, least: int) -> DataFrame:
    """(class_a, class_b, shared) of distinct texts that share at least ``least`` word runs; a class is the least id
    of equal texts (whole numbers).

    Each run meets its texts in one task, where runs of one text alone are dropped and runs of the same texts are put
    together as one key with a weight. What is left of the texts' sets is small, and is compared by blocks: each pair of blocks of
    sets is a task, which joins them on their keys and counts (see ``shingles``). So no pair is shuffled, and none travels with its sets."""

    def runs(batches):
        for b in batches:
            got = [(c, s) for c, s in zip(b.column(0).to_numpy(), _run_sets(b.column(1).to_pylist(), k)) if s is not None and len(s) >= least]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s for _, s in got])), pa.array(np.repeat([c for c, _ in got], [len(s) for _, s in got]))], names=["s", "c"])

    spark = df.sparkSession
    texts = df.where(F.col(text).isNotNull())
    chars = texts.agg(F.sum(F.length(text))).first()[0] or 0
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), chars // 5 // TASK_RUNS)
    classes = texts.groupBy(text).agg(F.min(id_col).cast("bigint").alias("c")).select("c", text)
    lists = classes.mapInArrow(runs, "s bigint, c bigint").repartition(width, "s").mapInArrow(shingles.shared_lists, "c bigint, key bigint, weight int")
    sets = cut(lists.repartition(width, "c").mapInArrow(shingles.gathered(least), "c bigint, n int, keys binary, weights binary"), "runs")
    blocks = max(1, -(-(sets.agg(F.sum("n")).first()[0] or 0) // BLOCK_KEYS))
    tiles = sets.mapInArrow(shingles.tiles_of(blocks), "tile bigint, side boolean, c bigint, n int, keys binary, weights binary")
    one_each = tiles.repartitionById(blocks * (blocks + 1) // 2, F.col("tile").cast("int"))
    return one_each.mapInArrow(shingles.pairs_of_tiles(least), "class_a bigint, class_b bigint, shared bigint")


def first_of(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """(by, firsts): the n smallest distinct values of each key. A hot key is cut into parts, of which each keeps its n first,
    before they meet in one task."""
    part = df.select(*by, value).distinct().withColumn("_part", F.pmod(F.xxhash64(value), F.lit(64)))
    rank = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(value))
    few = part.withColumn("_rank", rank).where(F.col("_rank") <= n)  # 64 n rows of a key at most
    return few.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(value)), 1, n).alias("firsts"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, change) of rows that are added, removed or changed between two snapshots."""
    b = before.select(key, F.struct(*values).alias("b"))
    a = after.select(key, F.struct(*values).alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return b.join(a, key, "full").select(key, change.alias("change")).where("change is not null")


def streaks(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, value, length, first) of each run of equal values in order."""
    w, v = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by, value).orderBy(*order)
    island = F.row_number().over(w) - F.row_number().over(v)
    return df.withColumn("_i", island).groupBy(*by, value, "_i").agg(F.count("*").alias("length"), F.min(order[0]).alias("first")).drop("_i")


def reachable(edges: DataFrame, roots: DataFrame, src: str = "caller", dst: str = "callee", most: int | None = None, rounds: int = 10_000) -> DataFrame:
    """(node, depth) of everything that can be reached, or reached in ``most`` steps, each node at its least depth. Cycles
    end the search: a round goes on only from nodes that are new. The frontier stays a table; only its size comes to
    the driver. A search without ``most`` that has not ended after ``rounds`` raises."""
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("node")).where("_s is not null and node is not null").distinct()
    seen = cut(roots.select(F.col(roots.columns[0]).alias("node"), F.lit(0).alias("depth")).where("node is not null").distinct(), "reach")
    front = seen
    for depth in range(1, (rounds if most is None else most) + 1):
        step = front.join(e, front["node"] == e["_s"]).select(e["node"]).distinct()
        front = cut(step.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")), "reach")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if depth % 16 == 0:
            seen = cut(seen, "reach")
    if most is None:
        raise RuntimeError(f"the search did not end in {rounds} rounds")
    return seen

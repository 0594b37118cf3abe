"""How common a hashed item is in the whole corpus, in a table of fixed size.

Counts of all items are kept in BUCKETS counters (4 MB in all, whatever the corpus): each
task counts its own rows in numpy, the counters are added up in SLICES groups by Spark,
and the sum goes to the tasks as one broadcast. A bucket's count is an upper bound of the
count of any item in it, so what counts as rare never hides a common item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, SLICES, FAN = 1 << 20, 64, 1024
_SHIFT = np.uint64(64 - 20)


def bucket(items: np.ndarray) -> np.ndarray:
    return (items >> _SHIFT).astype(np.int64)


def slices(counts: np.ndarray) -> list[tuple[int, bytes]]:
    """The counters as SLICES rows, without those that are empty."""
    per = BUCKETS // SLICES
    return [(k, part.tobytes()) for k in range(SLICES) if (part := counts[k * per : (k + 1) * per]).any()]


def total(rows: DataFrame) -> np.ndarray:
    """The sum of (slice, counts) rows of all tasks: SLICES rows come to the driver.

    Where more than FAN tasks have counted, their rows are added up in two steps, some FAN of a slice at a time (64 MB)."""

    def add(kind):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            s = np.sum([np.frombuffer(x, kind) for x in pdf["counts"]], axis=0, dtype=np.int64)
            return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [s.tobytes()]})

        return run

    kind = np.uint32
    tasks = rows.groupBy("slice").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if (parts := -(-tasks // FAN)) > 1:
        part = F.pmod(F.xxhash64("counts"), F.lit(parts))
        rows, kind = rows.groupBy("slice", part.alias("part")).applyInPandas(add(kind), "slice int, counts binary"), np.int64
    out = np.zeros(BUCKETS, np.int64)
    per = BUCKETS // SLICES
    for r in rows.groupBy("slice").applyInPandas(add(kind), "slice int, counts binary").collect():
        out[r["slice"] * per : (r["slice"] + 1) * per] = np.frombuffer(r["counts"], np.int64)
    return out


class Rarity:
    """Items in classes of commonness: 0 for the rare ones, then by powers of two."""

    def __init__(self, counts: np.ndarray, least: int = 64):
        self.limit = max(least, int(1.5 * counts.mean()))
        self.klass = np.maximum(0, np.ceil(np.log2(np.maximum(counts, 1) / self.limit))).astype(np.uint8)
        #: Buckets in steps of an eighth of a power of two, to put items in order.
        self.order = np.minimum(255, np.ceil(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)

    def above(self, order: np.ndarray) -> np.ndarray:
        """How common an item of such a bucket is, less what other items in the bucket make up on average: for the size of blocks only."""
        return np.maximum(2.0 ** (order / 8) - self.limit, 0)

    def keys(self, items: np.ndarray, each: int, mixed: np.ndarray, rest: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each class, from the rare ones on, the ``each`` items with the smallest hash, until the
        items of all classes left are no more than the share ``rest``; and the classes of these items.

        So sets that share more than ``rest`` of their items share some in a class that is drawn from: the
        rare ones as a rule, and those as common as a family of near copies is large within that family."""
        k = self.klass[bucket(items)]
        left, drawn, n = len(items), [], 0
        while left and (not drawn or left > rest * len(items)):
            mine = np.flatnonzero(k == n)
            if len(mine):
                left -= len(mine)
                drawn.append(mine[np.argpartition(mixed[mine], each)[:each]] if len(mine) > each else mine)
            n += 1
        at = np.concatenate(drawn) if drawn else np.zeros(0, np.int64)
        return items[at], k[at]

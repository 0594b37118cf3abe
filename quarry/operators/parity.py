"""Checks of two states against each other: counts that must agree, and operations that were undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_parity(built: DataFrame, expected: DataFrame, keys: list[str], count: str) -> DataFrame:
    """(keys, built, expected, same) of what both sides have, by exact key."""
    j = built.select(*keys, F.col(count).alias("built")).join(expected.select(*keys, F.col(count).alias("expected")), keys)
    return j.withColumn("same", F.col("built") == F.col("expected"))


def size_residual(built: DataFrame, expected: DataFrame, by: str, size: str) -> DataFrame:
    """(by, built, expected, residual): sizes summed on each side before they meet; a side without the group counts 0."""
    one = lambda d, name: d.groupBy(by).agg(F.sum(size).alias(name))
    j = one(built, "built").join(one(expected, "expected"), by, "full")
    a, b = (F.coalesce(x, F.lit(0)) for x in ("built", "expected"))
    return j.select(by, a.alias("built"), b.alias("expected"), (a - b).alias("residual"))


def contaminated(rows: DataFrame, by: list[str], same: Column, included: Column, body: Column) -> DataFrame:
    """(by, rows, includes, bodies, all_same, contaminated): groups that look finished though nothing in them was written: all digests are
    equal, something is still included as assembly, and there is no body."""
    g = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(included).alias("includes"), F.count_if(body).alias("bodies"), F.coalesce(F.bool_and(same), F.lit(False)).alias("all_same"))
    return g.withColumn("contaminated", F.col("all_same") & (F.col("includes") > 0) & (F.col("bodies") == 0))


def co_located(parts: DataFrame, by: list[str], place: str) -> DataFrame:
    """(by, places, together): whether all parts of a group are in one place. Places are made distinct before they move."""
    return parts.where(F.col(place).isNotNull()).select(*by, place).distinct().groupBy(*by).agg(F.count("*").alias("places")).withColumn("together", F.col("places") == 1)


def undone(log: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Logged operations whose subject is in the current state (again), each once."""
    return log.select(*keys).distinct().join(state.select(*keys), keys, "left_semi")

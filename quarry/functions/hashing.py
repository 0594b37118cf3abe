"""Deterministic hash splits."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import col


def md5_unit(value: str | Column) -> Column:
    """The first 32 bits of the md5 as a part of one: all in the JVM, and sayable in SQL."""
    return F.conv(F.substring(F.md5(col(value)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


@F.pandas_udf(DoubleType())
def blake2s_unit(values: pd.Series) -> pd.Series:
    """The 8-byte blake2s digest, big-endian, as a part of one."""
    return values.map(lambda v: None if v is None else int.from_bytes(hashlib.blake2s(v.encode(), digest_size=8).digest(), "big") / 2**64)


def split_of(unit: Column, eval_ratio: float) -> Column:
    return F.when(unit < eval_ratio, "eval").otherwise("train")

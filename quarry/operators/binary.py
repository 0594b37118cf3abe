"""Binary images as rows of big-endian words, and comparisons by position and by key."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def word_at(content: str | Column, at: Column) -> Column:
    """The big-endian word at a byte offset, widened; null beyond the end."""
    part = F.substring(T.col(content), (at + 1).cast("int"), F.lit(4))
    return F.when(F.length(part) == 4, F.conv(F.hex(part), 16, 10).cast("bigint"))


def words(images: DataFrame, key: str = "path", content: str = "content", step: int = 4) -> DataFrame:
    """(key, idx, word) of every whole word."""
    n = F.floor(F.length(content) / 4).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step // 4 or 1))).otherwise(F.array().cast("array<int>")))
    return images.select(key, content, at.alias("idx")).select(key, "idx", word_at(content, F.col("idx") * 4).alias("word"))


#: Bytes in one block of an image.
BLOCK = 1 << 16


def blocks(images: DataFrame, name: str, content: str = "content") -> DataFrame:
    """(block, bytes as ``name``) of an image, cut where it is read."""

    def run(batches):
        for batch in batches:
            for image in batch.column(0):
                data = image.as_buffer() if image.is_valid else b""
                for k in range(0, len(data), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int64()), pa.array([bytes(data[k : k + BLOCK])], pa.binary())], names=["block", name])

    return images.select(content).mapInArrow(run, f"block bigint, `{name}` binary")


def compare_images(a: Column, b: Column) -> Column:
    """(same, differing): unequal sizes are a mismatch before any byte is read; one differing byte at most is a match."""
    n = F.length(a)
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    diff = F.when(F.length(a) == F.length(b), F.size(F.filter(idx, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))))
    return F.struct(F.coalesce(diff <= 1, F.lit(False)).alias("same"), diff.alias("differing"))


def word_diffs(base: DataFrame, built: DataFrame, key: str) -> DataFrame:
    """(key, idx, base, built) where words differ: both sides are words() rows, joined by key and position. Words that
    only the longer side has differ from null; a key that only one side has is not compared."""
    keys = base.select(key).distinct().join(built.select(key).distinct(), key)
    side = lambda d, to: d.join(keys, key, "left_semi").select(key, "idx", F.col("word").alias(to))
    return side(base, "base").join(side(built, "built"), [key, "idx"], "full").where(~F.col("base").eqNullSafe(F.col("built")))


def keyed_compare(symbols: DataFrame, base: str = "base", built: str = "built") -> DataFrame:
    """(name, state): same, differs or missing of symbols present in both images by exact name; each row holds
    the symbol's own bytes of both images. Alias names are not symbols."""
    s = symbols.where(~F.col("name").endswith(".NON_MATCHING"))
    state = F.when(F.col(base).isNull() | F.col(built).isNull(), "missing").when(F.col(base) == F.col(built), "same").otherwise("differs")
    return s.select("name", state.alias("state"))


def slice_bytes(content: str | Column, offset: Column, size: Column) -> Column:
    return F.substring(T.col(content), (offset + 1).cast("int"), size.cast("int"))


def opcode_histogram(images: DataFrame, key: str = "path", content: str = "content", stride: int = 4) -> DataFrame:
    """(key, op, n, share): the leading bytes of words at a stride of 4 or 8 bytes."""
    w = words(images, key, content, stride).select(key, F.shiftrightunsigned("word", 24).alias("op"))
    n = w.groupBy(key, "op").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def blob_checks(images: DataFrame, key: str = "path", content: str = "content", least: int = 16384, returns: int = 20) -> DataFrame:
    """(key, large, returns, code_like): size, number of return words, and both tests together."""
    n = F.floor(F.length(content) / 4).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    count = F.size(F.filter(idx, lambda i: F.substring(F.col(content), i * 4 + 1, F.lit(4)) == F.unhex(F.lit("03E00008"))))
    return images.select(key, (F.length(content) >= least).alias("large"), count.alias("returns"), ((F.length(content) >= least) & (count >= returns)).alias("code_like"))


def marker_window(content: str | Column, marker: str, before: int, size: int) -> Column:
    """The bytes from a fixed distance before the first marker; null without one."""
    at = F.position(F.lit(marker).cast("binary"), T.col(content))
    return F.when(at > before, F.substring(T.col(content), (at - before).cast("int"), F.lit(size)))


def patch_spec(diffs: DataFrame, key: str) -> DataFrame:
    """(key, spec): ``offset:word`` of every differing word, in order; null unless both sides have as many words."""
    items = F.array_sort(F.collect_list(F.struct("idx", "built")))
    equal = F.bool_and(F.col("base").isNotNull() & F.col("built").isNotNull())
    return diffs.groupBy(key).agg(F.when(equal, F.array_join(F.transform(items, lambda x: F.concat(F.lower(F.hex(x["idx"] * 4)), F.lit(":"), F.format_string("%08X", x["built"]))), ",")).alias("spec"))


def window_hashes(images: DataFrame, key: str, content: str, size: int = 64, step: int = 4) -> DataFrame:
    """(key, at, h) of every window of ``size`` bytes at a step."""
    last = F.length(content) - size
    at = F.explode(F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>")))
    return images.select(key, content, at.alias("at")).select(key, "at", F.xxhash64(F.substring(F.col(content), F.col("at") + 1, F.lit(size))).alias("h"))


def shifts(a: DataFrame, b: DataFrame, most: int = 700) -> DataFrame:
    """(at, shift) where a window of one image occurs in the other nearby: an equi-join on the content."""
    j = a.select("h", F.col("at").alias("at")).join(b.select("h", F.col("at").alias("to")), "h")
    return j.select("at", (F.col("to") - F.col("at")).alias("shift")).where(F.abs("shift") <= most)


def shift_changes(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The offsets at which the shift changes from that before, of each pair of images (``by``)."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("at", "shift")
    return found.groupBy(*(by or []), "at").agg(F.min("shift").alias("shift")).withColumn("before", F.lag("shift").over(w)).where("before is null or before <> shift")

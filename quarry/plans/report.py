"""Progress of decompilation: by segment and in all, from units or from images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import binary


def latest_units(units: DataFrame) -> DataFrame:
    """One row per project, unit and function: that measured last, then the largest size; missing percents lose ties."""
    order = F.max(F.struct("measured_at", F.coalesce("fuzzy_match_percent", F.lit(-1.0)).alias("p"), "size", "fuzzy_match_percent"))
    return units.groupBy("project", "unit", "function").agg(order.alias("r")).select("project", "unit", "function", "r.size", "r.fuzzy_match_percent")


def rollup(rows: DataFrame, by: str, size: str, matched) -> DataFrame:
    """A row per group and one for all: functions and code, matched and in all, with percentages (0 of 0 is 0)."""
    m = F.coalesce(matched, F.lit(False))
    g = rows.rollup(by).agg(
        F.grouping(by).cast("int").alias("total"), F.count("*").alias("functions"), F.count_if(m).alias("matched_functions"),
        F.coalesce(F.sum(size), F.lit(0)).alias("code"), F.coalesce(F.sum(F.when(m, F.col(size))), F.lit(0)).alias("matched_code"),
    )
    pct = lambda a, b: F.round(T.percent_of(F.col(a), F.col(b)), 6)
    return g.withColumn("function_percent", pct("matched_functions", "functions")).withColumn("code_percent", pct("matched_code", "code"))


def from_images(listings: DataFrame, segments: DataFrame, sources: DataFrame, base: DataFrame, built: DataFrame, asm_path: str = "asm") -> DataFrame:
    """(segment, name, size, decompiled, matched) of each function of a project, from listings (path, text),
    segments (dir_name, rom_start, vram, src_path), sources (path, text) and two images (content).

    Names without an address, and functions outside the base image, are left out. A function is decompiled if
    its INCLUDE_ASM line is gone and it has a body, and matched if then all its bytes are equal. The images are cut into
    blocks in the tasks that read them, and functions meet the blocks they cover. More or fewer than one image
    on either side raises."""
    if base.limit(2).count() != 1 or built.limit(2).count() != 1:
        raise ValueError("a report compares one base image with one built image")
    f = listings.select(F.element_at(T.path_parts("path"), -2).alias("dir_name"), T.stem("path").alias("name"), (T.instruction_count_words("text") * 4).alias("size")).where("size > 0")
    f = f.withColumn("at", T.symbol_address("name")).where("at is not null").join(segments, "dir_name")
    f = f.withColumn("rom_off", F.col("rom_start") + F.col("at") - F.col("vram"))
    length = base.select(F.length("content")).first()[0]
    f = f.join(sources.select(F.col("path").alias("src_path"), F.col("text").alias("src")), "src_path", "left").withColumn("src", F.coalesce("src", F.lit("")))
    f = f.where((F.col("rom_off") >= 0) & (F.col("rom_off") + F.col("size") <= length))
    line = F.concat(F.lit(f'INCLUDE_ASM("{asm_path}/nonmatchings/'), "dir_name", F.lit('", '), "name", F.lit(")"))
    body = F.regexp_like("src", F.concat("name", F.lit(r"\s*\([^)]*\)\s*\{")))
    done = ~F.contains(F.col("src"), line) & body
    spans = f.select("dir_name", "name", "size", done.alias("done"), "rom_off", F.monotonically_increasing_id().alias("_f"))
    covers = F.sequence(F.floor(F.col("rom_off") / binary.BLOCK), F.floor((F.col("rom_off") + F.col("size") - 1) / binary.BLOCK))
    j = spans.withColumn("block", F.explode(covers)).join(binary.blocks(base, "base"), "block", "left").join(binary.blocks(built, "built"), "block", "left")
    low = F.greatest(F.col("rom_off") - F.col("block") * binary.BLOCK, F.lit(0))
    high = F.least(F.col("rom_off") + F.col("size") - F.col("block") * binary.BLOCK, F.lit(binary.BLOCK))
    same = F.coalesce(binary.slice_bytes("base", low, high - low) == binary.slice_bytes("built", low, high - low), F.lit(False))
    g = j.groupBy("_f", "dir_name", "name", "size", "done").agg(F.bool_and(same).alias("same"))
    return g.select(F.col("dir_name").alias("segment"), "name", "size", F.col("done").alias("decompiled"), (F.col("done") & F.col("same")).alias("matched"))


def text_report(progress: DataFrame, by: str, title: str) -> DataFrame:
    """The lines of a printed report, in order."""
    line = F.when(F.col("total") == 1, F.format_string("Code:      %8d / %8d bytes (%.2f%%)", "matched_code", "code", "code_percent")).otherwise(F.format_string("  src/%-16s %4d/%-5d functions  (%.2f%% code)", by, "matched_functions", "functions", "code_percent"))
    head = progress.sparkSession.createDataFrame([(0, "", f"{title} Decompilation Progress")], "ord int, name string, line string")
    return head.unionByName(progress.select(F.when(F.col("total") == 1, 1).otherwise(2).alias("ord"), F.coalesce(by, F.lit("")).alias("name"), line.alias("line"))).orderBy("ord", "name")


def drift(snapshots: DataFrame, at: str, value: str, most: float, by: list[str] | None = None) -> DataFrame:
    """Each measurement with the change since the one before it, and whether that is more than allowed."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(at)
    d = snapshots.withColumn("change", F.col(value) - F.lag(value).over(w))
    return d.withColumn("alert", F.coalesce(F.abs("change") > most, F.lit(False)))

"""One surviving record for each group of records of the same thing, field by field.

Single-valued fields come from the record that deserves most trust by a stated order of
preference (:func:`preferred`): aggregates of sort keys, so a group of any size is combined before the
shuffle and nothing is collected.

Multi-valued fields keep every value judged true by a latent model of two-sided quality
(:class:`TwoSided`): each source of a group either claims a value or, though it has something to
say on that field, does not. A source has a sensitivity (how often it claims a true value)
and a specificity (how often it leaves a false one out); whether a value is true is latent. Expectation
maximisation alternates between the two, over counts of distinct patterns of claims.

Defined cases. Project and function name are compared in normal form; records without one of them are in
no group. Outcomes are read by their letters alone; unknown ones count as none. Percents are valid from 0
to 100. Times without offset are UTC, digits alone are epoch seconds or milliseconds;
unreadable times count as missing. Missing values lose to all others; ties go to the lowest id. Where no
record has a valid value the id is -1. Records without a source are claims of the source ``?``.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .group_splits import ALIAS, normal_name, normal_project, parse_metadata, source_file

OUTCOMES = ("match", "partial", "fail", "incomplete")


def outcome_rank(c: str | Column) -> Column:
    """0 match, 1 partial, 2 failed, 3 incomplete, 4 none."""
    letters = F.regexp_replace(F.lower(c), "[^a-z]", "")
    rank = F.lit(len(OUTCOMES))
    for k in reversed(range(len(OUTCOMES))):
        rank = F.when(letters.startswith(OUTCOMES[k]), k).otherwise(rank)
    return rank


def valid_percent(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & c.between(0, 100), c)


def epoch_micros(c: str) -> Column:
    """Microseconds since 1970 of a time in one of several notations, or null."""
    t = F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    digits = t.rlike(r"^\d{1,16}$")
    n = F.when(digits, t).try_cast("bigint")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*(Z|UTC|[+-]\d{2}(:?\d{2})?)?)?$"), F.regexp_replace(F.regexp_replace(F.regexp_replace(t, ",", "."), r"\s*(Z|UTC)$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2"))
    iso = F.regexp_replace(iso, r"(:\d{2}(?:\.\d+)?\s*[+-]\d{2})$", "$1:00")
    return F.when(digits, F.when(n >= 100_000_000_000, n * 1000).otherwise(n * 1_000_000)).otherwise(F.unix_micros(iso.try_cast("timestamp")))


def normal_columns(df: DataFrame) -> DataFrame:
    """The record's project and function_name in normal form, as p and f; rows without one are left out."""
    strip = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")), r"(?U)\s*" + ALIAS.replace(".", r"\.") + "$" if c == "function_name" else "$^", "")
    return df.withColumn("p", strip("project")).withColumn("f", strip("function_name")).where("p <> '' and f <> ''")


def preferred(df: DataFrame) -> DataFrame:
    """(p, f, n, keep_id, percent_id, end_id) of each project and function name."""
    rows = normal_columns(df.select("episode_id", "project", "function_name", "outcome", "best_match_percent", "end_time")).select(
        "p", "f", "episode_id", outcome_rank("outcome").alias("rank"), (-F.coalesce(valid_percent("best_match_percent"), F.lit(-1.0))).alias("lack"),
        F.coalesce(-epoch_micros("end_time"), F.lit(2**62)).alias("age"),
    )
    best = F.min(F.struct("rank", "lack", "age", "episode_id"))["episode_id"]
    percent = F.min(F.when(F.col("lack") <= 0, F.struct("lack", "episode_id")))["episode_id"]
    end = F.min(F.when(F.col("age") < 2**62, F.struct("age", "episode_id")))["episode_id"]
    minus = lambda c: F.coalesce(c, F.lit(-1).cast("bigint"))
    return rows.groupBy("p", "f").agg(F.count("*").alias("n"), best.alias("keep_id"), minus(percent).alias("percent_id"), minus(end).alias("end_id"))


MULTI = ("segment", "compiler", "source_file", "tags")


def claims(df: DataFrame) -> DataFrame:
    """(p, f, source, field, value): what each episode's metadata says on the multi-valued fields."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for f, p, model, text in zip(*(c.to_pylist() for c in batch.columns)):
                p, f = normal_project(p), normal_name(f)
                if not p or not f:
                    continue
                v, source = parse_metadata(text), (model or "").strip().lower() or "?"
                src = v.get("source")
                path = source_file(v.get("source_path"), p) or source_file(src.get("path") if isinstance(src, dict) else None, p)
                said = {"segment": [v.get("segment")], "compiler": [v.get("compiler")], "source_file": [path], "tags": v.get("tags") if isinstance(v.get("tags"), list) else []}
                out += {(p, f, source, k, x.strip() if isinstance(x, str) else json.dumps(x)) for k in MULTI for x in said[k] if x is not None and x != ""}
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 5)], names=["p", "f", "source", "field", "value"])

    return df.select("function_name", "project", "model", "metadata").mapInArrow(run, "p string, f string, source string, field string, value string")


class TwoSided:
    """The latent model of two-sided quality of sources.

    claims: rows (entity columns, source, field, value). facts: each claimed value with the probability that it
    is true; quality: each source with its sensitivity and specificity per field. Priors keep sources of few
    claims near the middle: ``alpha`` (true, false) pseudo-counts for sensitivity, ``beta`` for specificity."""

    def __init__(self, claims: DataFrame, entity: list[str], prior: float = 0.5, alpha=(4.0, 4.0), beta=(9.0, 1.0), rounds: int = 12, tolerance: float = 1e-3):
        said = cut(claims.select(*entity, "source", "field", "value").distinct(), "claims")
        covers = said.select(*entity, "field", "source").distinct()
        facts = said.select(*entity, "field", "value").distinct()
        # every source of an entity has a say on every value claimed of it: a row per fact and source
        mine = said.withColumn("said", F.lit(1))
        seats = facts.join(covers, [*entity, "field"]).join(mine, [*entity, "field", "value", "source"], "left").withColumn("said", F.coalesce("said", F.lit(0)))
        # facts with the same pattern of claims are one row with a count from here on
        pattern = F.array_sort(F.collect_list(F.struct("source", "said")))
        shaped = cut(seats.groupBy(*entity, "field", "value").agg(pattern.alias("pattern")).withColumn("shape", F.xxhash64("field", "pattern")), "facts")
        shapes = cut(shaped.groupBy("shape", "field").agg(F.first("pattern").alias("pattern"), F.count("*").alias("n")), "shapes")
        seats = shapes.select("shape", "field", "n", F.explode("pattern").alias("x")).select("shape", "field", "n", "x.source", "x.said")
        quality = seats.select("source", "field").distinct().select("source", "field", F.lit(0.6).alias("sensitivity"), F.lit(0.9).alias("specificity"))
        before, self.settled = None, False  # settled: whether the rounds have come to rest
        for _ in range(rounds):
            odds = F.sum(F.when(F.col("said") == 1, F.log(F.col("sensitivity") / (1 - F.col("specificity")))).otherwise(F.log((1 - F.col("sensitivity")) / F.col("specificity"))))
            truth = seats.join(quality, ["source", "field"]).groupBy("shape", "field").agg(odds.alias("odds")).select("shape", (1 / (1 + F.exp(-F.col("odds") - F.log(F.lit(prior / (1 - prior)))))).alias("p"))
            both = seats.join(truth, "shape")
            w, s = F.col("n") * F.col("p"), F.col("said")
            v = F.col("n") * (1 - F.col("p"))
            quality = cut(
                both.groupBy("source", "field").agg(
                    ((F.sum(w * s) + alpha[0]) / (F.sum(w) + sum(alpha))).alias("sensitivity"),
                    ((F.sum(v * (1 - s)) + beta[0]) / (F.sum(v) + sum(beta))).alias("specificity"),
                ), "quality",
            )
            now = quality.agg(F.avg("sensitivity"), F.avg("specificity"), F.stddev_pop("sensitivity")).first()
            self.settled = before is not None and now[0] is not None and max(abs((a or 0) - (b or 0)) for a, b in zip(now, before)) < tolerance
            if self.settled:
                break
            before = now
        self.quality = quality
        odds = F.sum(F.when(F.col("said") == 1, F.log(F.col("sensitivity") / (1 - F.col("specificity")))).otherwise(F.log((1 - F.col("sensitivity")) / F.col("specificity"))))
        truth = seats.join(quality, ["source", "field"]).groupBy("shape").agg(odds.alias("odds")).select("shape", (1 / (1 + F.exp(-F.col("odds") - F.log(F.lit(prior / (1 - prior)))))).alias("p_true"))
        self.facts = shaped.join(truth, "shape").select(*entity, "field", "value", F.size("pattern").alias("sources"), "p_true")


def best_records(episodes: DataFrame, least: float = 0.5) -> DataFrame:
    """One record per project and function name of two or more episodes: the ids that its single-valued
    fields come from, and of each multi-valued field the values judged true (the likeliest one if none is)."""
    kept = preferred(episodes).where("n > 1")
    model = TwoSided(claims(episodes), ["p", "f"])
    top = F.max("p_true").over(Window.partitionBy("p", "f", "field"))
    true = model.facts.withColumn("top", top).where((F.col("p_true") >= least) | (F.col("p_true") == F.col("top")))
    values = true.groupBy("p", "f").agg(*[F.array_sort(F.collect_list(F.when(F.col("field") == m, F.col("value")))).alias(m) for m in MULTI])
    return kept.join(values, ["p", "f"], "left").select(F.col("p").alias("project"), F.col("f").alias("function_name"), F.col("n").alias("episodes"), "keep_id", "percent_id", "end_id", *[F.coalesce(m, F.array().cast("array<string>")).alias(m) for m in MULTI])

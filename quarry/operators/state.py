"""The state of an ordered sequence of attempts, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_percent


def running(df: DataFrame, by: list[str], order: list[str | Column], score: str, tokens: str | None = None) -> DataFrame:
    """seq, best (running maximum from 0), final (last score that is not null) and, if asked for, running tokens."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("seq", F.row_number().over(w))
    out = out.withColumn("best", F.greatest(F.lit(0.0), F.coalesce(F.max(score).over(upto), F.lit(0.0))))
    out = out.withColumn("final", F.last(score, ignorenulls=True).over(upto))
    return out.withColumn("total_tokens", F.coalesce(F.sum(tokens).over(upto), F.lit(0)).cast("bigint")) if tokens else out


def until_first(df: DataFrame, by: list[str], order: list[str | Column], hit: Column) -> DataFrame:
    """The rows up to and with the first hit of each key."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_hits", F.coalesce(F.max(hit.cast("int")).over(before), F.lit(0))).where("_hits = 0").drop("_hits")


def outcome(matched: Column, best: Column, failed: Column | None = None) -> Column:
    """match, or partial if anything scored, or failed; an error leaves failed."""
    e = F.when(matched, "match")
    if failed is not None:
        e = e.when(failed, "failed")
    return e.when(best > 0, "partial").otherwise("failed")


def call_score(calls: str | Column = "tool_calls") -> Column:
    """Of a step's calls in order: the score of the last one that verifies. FULL MATCH is 100; a
    mismatch or a match line gives its first percentage; any other output leaves the score before it."""
    c = F.col(calls) if isinstance(calls, str) else calls

    def next_score(score: Column, call: Column) -> Column:
        out = call["output"]
        number = F.when(out.contains("MISMATCH") | out.contains("Match:"), first_percent(out))
        return F.when(call["name"].isin("verify_rom", "diff"), F.when(out.contains("FULL MATCH"), F.lit(100.0)).otherwise(F.coalesce(number, score))).otherwise(score)

    return F.aggregate(F.filter(c, lambda x: x.isNotNull()), F.lit(None).cast("double"), next_score)


def call_compiled(calls: str | Column = "tool_calls") -> Column:
    """Whether the last compile of a step succeeded; null if it had none."""
    c = F.col(calls) if isinstance(calls, str) else calls
    done = F.filter(c, lambda x: x["name"] == "compile")
    return F.when(F.size(done) > 0, F.coalesce(F.element_at(done, -1)["output"].contains("SUCCESS"), F.lit(False)))


def episode_state(episodes: DataFrame) -> DataFrame:
    """(episode_id, steps, best, final, tokens, stop_at, outcome) folded from each episode's own steps, in array order.

    An episode is one row, so the fold is a higher-order function within the row: nothing is shuffled."""
    steps = F.filter("steps", lambda s: s.isNotNull())
    scores = F.transform(steps, lambda s: F.when(~F.isnan(s["match_percent"]), s["match_percent"]))
    hit = F.array_position(F.transform(scores, lambda x: F.coalesce(x == 100.0, F.lit(False))), F.lit(True))
    kept = F.when(hit > 0, F.slice(scores, F.lit(1), hit.cast("int"))).otherwise(scores)
    real = F.filter(kept, lambda x: x.isNotNull())
    used = F.transform(steps, lambda s: F.coalesce(s["token_usage"]["input_tokens"], F.lit(0)) + F.coalesce(s["token_usage"]["output_tokens"], F.lit(0)))
    best = F.greatest(F.lit(0.0), F.coalesce(F.array_max(real), F.lit(0.0)))
    return episodes.select(
        "episode_id", F.coalesce(F.size(kept), F.lit(0)).alias("steps"), best.alias("best"), F.try_element_at(real, F.lit(-1)).alias("final"),
        F.coalesce(F.aggregate(used, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).alias("tokens"), F.coalesce(F.nullif(hit, F.lit(0)), F.lit(-1)).alias("stop_at"),
        outcome(F.coalesce(hit > 0, F.lit(False)), best).alias("outcome"),
    )

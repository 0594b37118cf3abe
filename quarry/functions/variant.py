"""JSON text as Variant columns: parsed once in the JVM, with types asked for by name."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import col

PAIRS = "map<string,variant>"
ITEMS = "array<variant>"


@F.pandas_udf(StringType())
def _plainer(texts: pd.Series) -> pd.Series:
    """JSON that repeats keys (the last counts) or has NaN and infinities (null from here on), without these; else null."""

    def one(t):
        try:
            return None if t is None else json.dumps(json.loads(t, parse_constant=lambda _: None))
        except (ValueError, RecursionError):
            return None

    return pd.Series([one(t) for t in texts], dtype=object)


def once(c: Column) -> Column:
    """A costly column that is evaluated where it is defined: the optimizer copies a deterministic one into every use of it."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _strict(df: DataFrame, text: Column, to: str) -> DataFrame:
    # an item behind the text shows whether all of it was read: the parser stops at the end of a value
    both = df.withColumn("_both", once(F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]")))))
    whole = (F.try_variant_get("_both", "$[1]", "int") == 0) & F.try_variant_get("_both", "$[2]", "variant").isNull()
    return both.withColumn(to, once(F.when(whole, F.try_variant_get("_both", "$[0]", "variant")))).drop("_both")


def with_json(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with the value of a JSON text, null if it is none. Only texts that the JVM's parser refuses go to Python."""
    strict = _strict(df, F.col(text), to)
    rest = strict.withColumn("_plainer", _plainer(F.when(F.col(to).isNull(), F.col(text))))
    again = _strict(rest, F.col("_plainer"), "_again")
    return again.withColumn(to, F.coalesce(to, "_again")).drop("_plainer", "_again")


def get(v: str | Column, key: str, kind: str = "variant") -> Column:
    """The value under a key: null if it is absent; a JSON null is a variant of its own."""
    return F.try_variant_get(col(v), f"$.{key}", kind)


def has(v: str | Column, *keys: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & get(v, k).isNotNull()
    return out


def as_type(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def string(v: Column) -> Column:
    """The value if it is a string."""
    return F.when(is_string(v), as_type(v, "string"))


def boolean(v: Column) -> Column:
    """The value if it is a boolean."""
    return F.when(F.schema_of_variant(v) == "BOOLEAN", as_type(v, "boolean"))


def number(v: Column) -> Column:
    """The value if it is a number; a boolean is none."""
    return F.when(F.schema_of_variant(v).rlike(r"\A(?:BIGINT|INT|DECIMAL|DOUBLE|FLOAT)"), as_type(v, "double"))


def is_object(v: Column) -> Column:
    return as_type(v, PAIRS).isNotNull()


def filled(v: Column) -> Column:
    """Whether a value counts as true: not null, false, zero, or empty."""
    text = as_type(v, "string")
    return F.coalesce(F.when(text.isin("false", "0", "0.0", "-0.0", "[]", "{}"), is_string(v)).otherwise(text != ""), F.lit(False))


def shown(v: Column) -> Column:
    """A scalar as text, an array or object as JSON."""
    return as_type(v, "string")


def null() -> Column:
    return F.parse_json(F.lit("null"))


def items(v: Column) -> Column:
    """The elements of an array; of anything else none."""
    return F.coalesce(as_type(v, ITEMS), F.array().cast(ITEMS))


def object_json(own: dict[str, Column], base: Column | None = None) -> Column:
    """The JSON text of an object, keys in order: own values over those of base, a map of variants. An own
    column that is null leaves its key as it is; ``null()`` writes a JSON null."""
    mine = F.array(*[F.when(own[k].isNotNull(), F.struct(F.lit(k).alias("key"), own[k].alias("value"))) for k in sorted(own)])
    entries = F.filter(mine, lambda x: x.isNotNull())
    if base is not None:
        rest = F.filter(F.map_entries(base), lambda x: ~x["key"].isin(*own))
        entries = F.array_sort(F.concat(entries, rest), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    return F.to_json(F.map_from_entries(entries))

"""Queries of the general record operators: nested records (p1) and drifting schemas (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import drift, shred
from ..session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return shred.episode_leaves(table(spark, sf, "episodes", shred.LEAF_SCHEMA), values=False)


def p1_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """The same with kind and value of each leaf."""
    return shred.episode_leaves(table(spark, sf, "episodes", shred.LEAF_SCHEMA))


def p1_steps(spark: SparkSession, sf: str) -> DataFrame:
    return shred.episode_steps(table(spark, sf, "episodes").select("episode_id", "steps"))


def p1_calls(spark: SparkSession, sf: str) -> DataFrame:
    return shred.episode_calls(table(spark, sf, "episodes").select("episode_id", "steps"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.deviations(table(spark, sf, "raw_episodes")).select("file_id", "field", "change")


def p4_union_schema(spark: SparkSession, sf: str) -> DataFrame:
    return drift.union_schema(table(spark, sf, "raw_episodes"))


def p4_table(spark: SparkSession, sf: str) -> DataFrame:
    return drift.cast_files(table(spark, sf, "raw_episodes"))


def p4_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return drift.rejects(table(spark, sf, "raw_episodes"))


QUERIES = {f.__name__: f for f in (p1_found, p1_leaves, p1_steps, p1_calls, p4_found, p4_union_schema, p4_table, p4_rejects)}

SQL = {
    "p1_steps": """
        SELECT episode_id, CAST(i AS INT) AS step_ord, steps[i] IS NOT NULL AS present, steps[i].step_number AS step_number, steps[i]."timestamp" AS "timestamp",
               steps[i].assistant_text AS assistant_text, steps[i].match_percent AS match_percent, steps[i].compiled AS compiled,
               steps[i].token_usage.input_tokens AS token_usage_input_tokens, steps[i].token_usage.output_tokens AS token_usage_output_tokens
        FROM episodes, UNNEST(range(1, len(steps) + 1)) AS u(i)""",
    "p1_calls": """
        WITH s AS (SELECT episode_id, i AS step_ord, steps[i].tool_calls AS calls FROM episodes, UNNEST(range(1, len(steps) + 1)) AS u(i))
        SELECT episode_id, CAST(step_ord AS INT) AS step_ord, CAST(j AS INT) AS call_ord, calls[j] IS NOT NULL AS present, calls[j].name AS name,
               calls[j].input AS input, calls[j].output AS output, calls[j].duration_ms AS duration_ms
        FROM s, UNNEST(range(1, len(calls) + 1)) AS u(j)""",
    "p1_found": """
        WITH RECURSIVE doc AS (
            SELECT episode_id, 0 AS step_ord, 0 AS call_ord, metadata AS body FROM episodes
            UNION ALL
            SELECT episode_id, step_ord, j, calls[j].input FROM (
                SELECT episode_id, i AS step_ord, steps[i].tool_calls AS calls FROM episodes, UNNEST(range(1, len(steps) + 1)) AS u(i)), UNNEST(range(1, len(calls) + 1)) AS v(j)),
        opened AS (
            SELECT episode_id, step_ord, call_ord, CASE WHEN json_type(body) = 'VARCHAR' THEN CASE WHEN json_valid(body ->> '$') THEN CAST(body ->> '$' AS JSON) END ELSE CAST(body AS JSON) END AS body
            FROM (SELECT episode_id, step_ord, call_ord, CASE WHEN json_valid(body) THEN body END AS body FROM doc)),
        walk AS (
            SELECT episode_id, step_ord, call_ord, '' AS path, body AS v FROM opened WHERE json_type(body) = 'OBJECT'
            UNION ALL
            SELECT episode_id, step_ord, call_ord,
                   CASE WHEN json_type(v) = 'ARRAY' THEN path || '[' || CAST(k AS VARCHAR) || ']' WHEN path = '' THEN key ELSE path || '.' || key END,
                   CASE WHEN json_type(v) = 'ARRAY' THEN v -> ('$[' || CAST(k AS VARCHAR) || ']') ELSE v -> ('$."' || key || '"') END
            FROM (SELECT *, CASE WHEN json_type(v) = 'ARRAY' THEN NULL ELSE keys[k + 1] END AS key
                  FROM (SELECT *, UNNEST(range(CASE WHEN json_type(v) = 'ARRAY' THEN CAST(json_array_length(v) AS BIGINT) ELSE len(keys) END)) AS k
                        FROM (SELECT *, CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) END AS keys FROM walk WHERE json_type(v) IN ('OBJECT', 'ARRAY')))))
        SELECT episode_id, CAST(step_ord AS INT) AS step_ord, CAST(call_ord AS INT) AS call_ord, path AS leaf_path FROM walk WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')""",
    "p4_union_schema": """
        WITH raw AS (SELECT CASE WHEN json_valid(b) THEN CAST(b AS JSON) END AS j FROM (SELECT regexp_replace(body, ':\\s*(NaN|-?Infinity)', ': 0.5', 'g') AS b FROM raw_episodes)),
        k AS (SELECT CASE WHEN json_exists(j, '$.game') THEN 'legacy' ELSE 'canonical' END AS schema, j, unnest(list_distinct(json_keys(j))) AS field FROM raw WHERE json_type(j) = 'OBJECT'),
        t AS (SELECT schema, field, CASE json_type(json_extract(j, '$."' || field || '"')) WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END AS kind FROM k),
        g AS (SELECT schema, field, count(*) AS files, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types, list_sort(list(DISTINCT kind) FILTER (kind <> 'null')) AS seen FROM t GROUP BY ALL)
        SELECT schema, field, CASE WHEN coalesce(len(seen), 0) = 0 THEN 'null' WHEN len(seen) = 1 THEN seen[1] WHEN seen = ['integer', 'number'] THEN 'number' ELSE 'variant' END AS type, files, types FROM g""",
    "p4_rejects": """
        SELECT file_id, CASE WHEN body IS NULL THEN 'null' WHEN trim(body, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty'
                             WHEN NOT json_valid(strict) THEN 'unreadable' ELSE 'no object' END AS reason
        FROM (SELECT *, regexp_replace(body, ':\\s*(NaN|-?Infinity)', ': 0', 'g') AS strict FROM raw_episodes)
        WHERE body IS NULL OR NOT json_valid(strict) OR json_type(CASE WHEN json_valid(strict) THEN strict END) <> 'OBJECT'""",
}

_LAST = "path AS leaf_path FROM walk WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')"
assert _LAST in SQL["p1_found"]
SQL["p1_leaves"] = SQL["p1_found"].replace(
    _LAST,
    """path AS leaf_path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
               CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'DOUBLE' THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE v ->> '$' END AS value FROM walk WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')""",
)

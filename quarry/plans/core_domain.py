"""Queries of the operators on episodes, listings and sources, over the raw files and episodes of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.code import HEAD, definition_of, function_bodies, with_function
from ..operators import assembly, relational, state
from ..session import table
from . import export, quality

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Bodies as JSON for DuckDB, which does not know NaN and the infinities.
_RAW = r"""raw AS (SELECT file_id, project, path, loaded_at, CASE WHEN json_valid(b) THEN CAST(b AS JSON) END AS j FROM (SELECT *, regexp_replace(body, ':\s*(NaN|-?Infinity)', ': 0', 'g') AS b FROM raw_episodes)),
    files AS (SELECT * FROM raw WHERE json_type(j) = 'OBJECT'),
    listing AS (SELECT file_id, j ->> '$.function_name' AS name, j ->> '$.asm_text' AS asm FROM files WHERE json_type(j, '$.asm_text') = 'VARCHAR')"""
_LINES = r"SELECT file_id, l, trim(l, ' ' || chr(9) || chr(13)) AS s FROM (SELECT file_id, unnest(string_split(asm, chr(10))) AS l FROM listing)"


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, path, name, text) of the listings inside the raw files."""
    j = table(spark, sf, "raw_episodes").select("file_id", F.try_parse_json(F.regexp_replace("body", r":\s*(NaN|-?Infinity)", ": 0")).alias("j"))
    get = lambda k: F.try_variant_get("j", f"$.{k}", "string")
    asm = F.schema_of_variant(F.try_variant_get("j", "$.asm_text", "variant")) == "STRING"
    return j.where(asm).select("file_id", get("function_name").alias("name"), get("asm_text").alias("text"), F.coalesce(get("segment"), F.lit("")).alias("segment"))


@query(rf"""
    WITH {_RAW}, x AS ({_LINES})
    SELECT file_id, count(*) FILTER (s <> '' AND s NOT LIKE '.%' AND s NOT LIKE '#%' AND s NOT LIKE '%:' AND s NOT LIKE 'glabel%') AS listed,
           count(*) FILTER (contains(l, '/*') AND contains(l, '*/')) AS words,
           count(*) FILTER (contains(l, '/*') AND contains(l, '*/') AND NOT contains(l, 'glabel') AND trim(regexp_extract(l, '.*\*/(.*)$', 1)) <> ''
                            AND NOT regexp_matches(trim(regexp_extract(l, '.*\*/(.*)$', 1)), '^(\.|endlabel|nonmatching|enddlabel)')) AS code
    FROM x GROUP BY file_id""")
def d01_instruction_counts(spark, sf):
    """The three counts of a listing, which differ."""
    return listings(spark, sf).select("file_id", T.instruction_count_listing("text").alias("listed"), T.instruction_count_words("text").alias("words"), T.instruction_count_code("text").alias("code"))


@query(rf"""
    WITH {_RAW}, x AS (SELECT file_id, lines[i] AS l, i FROM (SELECT file_id, string_split(asm, chr(10)) AS lines FROM listing), UNNEST(range(1, len(lines) + 1)) AS u(i)),
    c AS (SELECT file_id, regexp_extract(l, 'jal\s+(func_[0-9A-Fa-f]+|[A-Za-z_]\w*)', 1) AS callee, min(i) AS pos FROM x GROUP BY 1, 2)
    SELECT file_id, string_agg(callee, ',' ORDER BY pos) AS called, count(*) AS n FROM c WHERE callee <> '' GROUP BY file_id""")
def d02_call_targets(spark, sf):
    c = T.call_targets("text")
    return listings(spark, sf).select("file_id", F.array_join(c, ",").alias("called"), F.size(c).cast("bigint").alias("n")).where("n > 0")


@query(rf"""
    WITH {_RAW} SELECT file_id, contains(asm, '.L') AS has_branches, contains(asm, 'jal') AS has_calls FROM listing""")
def d03_flags(spark, sf):
    return listings(spark, sf).select("file_id", F.contains("text", F.lit(".L")).alias("has_branches"), F.contains("text", F.lit("jal")).alias("has_calls"))


_EXPORTED = rf"""
    {_RAW},
    k AS (SELECT *, CASE WHEN json_exists(j, '$.steps') AND json_exists(j, '$.outcome') AND json_exists(j, '$.final_source') THEN 'canonical_v2'
                         WHEN (json_exists(j, '$.attempts') AND (json_exists(j, '$.final_c') OR json_exists(j, '$.asm_text'))) OR (json_type(j, '$.matched') = 'BOOLEAN' AND (j ->> '$.matched') = 'true' AND json_exists(j, '$.final_c')) THEN 'legacy_v1' ELSE 'unknown' END AS schema FROM files),
    g AS (SELECT file_id, project AS dir, path, schema, j, j ->> '$.function_name' AS name,
                 CASE WHEN schema = 'legacy_v1' THEN CASE WHEN json_type(j, '$.final_c') = 'VARCHAR' THEN j ->> '$.final_c' END ELSE CASE WHEN json_type(j, '$.final_source') = 'VARCHAR' THEN j ->> '$.final_source' END END AS src,
                 CASE WHEN schema = 'legacy_v1' THEN j ->> '$.segment' ELSE CASE WHEN json_type(j, '$.metadata.segment') = 'VARCHAR' THEN j ->> '$.metadata.segment' END END AS segment,
                 CASE WHEN schema = 'legacy_v1' THEN (j ->> '$.matched') = 'true' ELSE (j ->> '$.outcome') = 'match' AND TRY_CAST(j ->> '$.final_match_percent' AS DOUBLE) = 100 END AS ok
          FROM k WHERE schema <> 'unknown'),
    r AS (SELECT *, CASE WHEN schema = 'legacy_v1' OR coalesce(j ->> '$.project', '') = '' THEN lower(trim(coalesce(dir, ''))) ELSE j ->> '$.project' END AS project FROM g WHERE ok AND name <> '' AND src <> ''),
    t AS (SELECT *, project || '/' || CASE WHEN segment <> '' THEN segment || '/' ELSE '' END || name AS task_id FROM r),
    d AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY coalesce(dir, ''), path NULLS FIRST, file_id) AS rn FROM t)"""


@query(rf"""
    WITH {_EXPORTED}
    SELECT task_id, schema AS source_schema, project, name AS function_name, CAST(coalesce(TRY_CAST(j ->> '$.instruction_count' AS BIGINT), 0) AS BIGINT) AS instruction_count, md5(rtrim(src, ' ' || chr(9) || chr(10) || chr(13)) || chr(10)) AS final_digest,
           CASE WHEN CAST('0x' || substr(md5('export-split-v1:' || task_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.1 THEN 'eval' ELSE 'train' END AS split
    FROM d WHERE rn = 1""")
def d04_export(spark, sf):
    """Raw files of both schemas to one record per task, split by md5."""
    out = export.export(table(spark, sf, "raw_episodes"), exact_hash=False)
    return out.select("task_id", "source_schema", "project", "function_name", "instruction_count", F.md5("final_source").alias("final_digest"), "split")


#: The lines of the prompt, for DuckDB.
_PROMPT = r"""'Decompile the following N64 function to exact-match C.' || chr(10) || 'Project: ' || project || chr(10) || 'Function: ' || name || chr(10)
    || CASE WHEN coalesce(seg, '') NOT IN ('', '0') THEN 'Segment: ' || seg || chr(10) ELSE '' END || CASE WHEN n <> 0 THEN 'Instruction count: ' || CAST(n AS VARCHAR) || chr(10) ELSE '' END
    || CASE WHEN comp <> '' THEN 'Compiler: ' || comp || chr(10) ELSE '' END || CASE WHEN flags <> '' THEN 'Compiler flags: ' || flags || chr(10) ELSE '' END
    || CASE WHEN assembly <> '' THEN chr(10) || 'Assembly:' || chr(10) || rtrim(assembly, chr(10)) || chr(10) ELSE '' END || CASE WHEN draft <> '' THEN chr(10) || 'Initial m2c output:' || chr(10) || rtrim(draft, chr(10)) || chr(10) ELSE '' END
    || chr(10) || 'Return only the decompiled C for the target function.' || chr(10)"""
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _text_of(field: str) -> str:
    return f"CASE WHEN json_type(j, '$.{field}') = 'VARCHAR' THEN CASE WHEN (j ->> '$.{field}') = '' THEN '' ELSE rtrim(j ->> '$.{field}', {_SPACES}) || chr(10) END END"


@query(rf"""
    WITH {_EXPORTED},
    x AS (SELECT task_id, schema AS source_schema, project, name, CAST(coalesce(TRY_CAST(j ->> '$.instruction_count' AS BIGINT), 0) AS BIGINT) AS n,
                 CASE WHEN schema = 'legacy_v1' THEN {_text_of("asm_text")} END AS assembly, CASE WHEN schema = 'legacy_v1' THEN {_text_of("m2c_output")} ELSE {_text_of("initial_m2c_source")} END AS draft,
                 rtrim(src, {_SPACES}) || chr(10) AS final_source, CASE WHEN schema = 'legacy_v1' THEN j ->> '$.segment' ELSE j ->> '$.metadata.segment' END AS seg,
                 CASE WHEN schema = 'legacy_v1' THEN j ->> '$.compiler' ELSE j ->> '$.metadata.compiler' END AS comp, CASE WHEN schema = 'legacy_v1' THEN j ->> '$.compiler_flags' ELSE j ->> '$.metadata.compiler_flags' END AS flags FROM d WHERE rn = 1)
    SELECT 1 AS schema_version, 'sft_exact_match' AS dataset_type, source_schema, CASE WHEN CAST('0x' || substr(md5('export-split-v1:' || task_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.1 THEN 'eval' ELSE 'train' END AS split,
           task_id, project, name AS function_name, n AS instruction_count, md5(assembly) AS assembly, md5(draft) AS initial_m2c_source, md5(final_source) AS final_source, md5({_PROMPT}) AS prompt, CASE WHEN source_schema = 'legacy_v1' THEN md5(final_source) END AS target_c
    FROM x""")
def d05_export_records(spark, sf):
    """The records' fields, long texts as digests. A canonical record's target is cut from its source (d05b)."""
    out = export.export(table(spark, sf, "raw_episodes"), exact_hash=False)
    digests = [F.md5(c).alias(c) for c in ("assembly", "initial_m2c_source", "final_source", "prompt")]
    target = F.when(F.col("source_schema") == "legacy_v1", F.md5("target_c"))
    return out.select("schema_version", "dataset_type", "source_schema", "split", "task_id", "project", "function_name", "instruction_count", *digests, target.alias("target_c"))


@query()
def d05b_exact_records(spark, sf):
    """All 15 fields, split by the exact hash."""
    return export.export(table(spark, sf, "raw_episodes"))


@query(rf"""
    WITH {_EXPORTED}
    SELECT split, count(*) AS n FROM (SELECT CASE WHEN CAST('0x' || substr(md5('export-split-v1:' || task_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.1 THEN 'eval' ELSE 'train' END AS split FROM d WHERE rn = 1) GROUP BY split""")
def d06_export_counts(spark, sf):
    return export.export(table(spark, sf, "raw_episodes"), exact_hash=False).groupBy("split").agg(F.count("*").alias("n"))


@query(rf"""
    WITH {_RAW}
    SELECT file_id, path, CASE WHEN j IS NULL THEN CASE WHEN coalesce((SELECT body FROM raw_episodes e WHERE e.file_id = raw.file_id), '') = '' THEN 'no object' ELSE 'invalid JSON' END
                               WHEN json_type(j) <> 'OBJECT' THEN 'no object' ELSE 'unknown schema' END AS reason
    FROM raw WHERE j IS NULL OR json_type(j) <> 'OBJECT' OR NOT ((json_exists(j, '$.steps') AND json_exists(j, '$.outcome') AND json_exists(j, '$.final_source'))
        OR (json_exists(j, '$.attempts') AND (json_exists(j, '$.final_c') OR json_exists(j, '$.asm_text'))) OR (json_type(j, '$.matched') = 'BOOLEAN' AND (j ->> '$.matched') = 'true' AND json_exists(j, '$.final_c')))""")
def d07_export_rejects(spark, sf):
    return export.rejects(export.parse(table(spark, sf, "raw_episodes")))


@query("""
    WITH s AS (SELECT episode_id, steps[i] AS s, i FROM episodes, UNNEST(range(1, len(steps) + 1)) AS u(i)),
    t AS (SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY i) AS k, CASE WHEN NOT isnan(s.match_percent) THEN s.match_percent END AS p, coalesce(s.token_usage.input_tokens, 0) + coalesce(s.token_usage.output_tokens, 0) AS tokens FROM s WHERE s IS NOT NULL),
    h AS (SELECT episode_id, min(k) FILTER (p = 100) AS hit, CAST(sum(tokens) AS BIGINT) AS tokens FROM t GROUP BY 1),
    f AS (SELECT episode_id, CAST(count(*) AS INT) AS steps, greatest(0.0, coalesce(max(p), 0.0)) AS best, last(p ORDER BY k) FILTER (p IS NOT NULL) AS final FROM t JOIN h USING (episode_id) WHERE hit IS NULL OR k <= hit GROUP BY 1)
    SELECT e.episode_id, coalesce(f.steps, 0) AS steps, coalesce(best, 0.0) AS best, final, coalesce(tokens, 0) AS tokens, coalesce(hit, -1) AS stop_at,
           CASE WHEN hit IS NOT NULL THEN 'match' WHEN coalesce(best, 0.0) > 0 THEN 'partial' ELSE 'failed' END AS outcome
    FROM episodes e LEFT JOIN f USING (episode_id) LEFT JOIN h USING (episode_id)""")
def d09_episode_state(spark, sf):
    """Each episode's steps folded up to the first exact match."""
    return state.episode_state(table(spark, sf, "episodes").select("episode_id", "steps"))


@query(r"""
    WITH s AS (SELECT episode_id, i AS step_ord, steps[i].tool_calls AS calls FROM episodes, UNNEST(range(1, len(steps) + 1)) AS u(i) WHERE steps[i].tool_calls IS NOT NULL),
    c AS (SELECT episode_id, step_ord, j, calls[j].name AS name, calls[j].output AS o FROM s, UNNEST(range(1, len(calls) + 1)) AS u(j) WHERE calls[j] IS NOT NULL),
    v AS (SELECT *, CASE WHEN contains(o, 'FULL MATCH') THEN 100.0 WHEN contains(o, 'MISMATCH') OR contains(o, 'Match:') THEN TRY_CAST(nullif(regexp_extract(o, '(\d+(?:\.\d+)?)%', 1), '') AS DOUBLE) END AS p FROM c WHERE name IN ('verify_rom', 'diff'))
    SELECT s.episode_id, CAST(s.step_ord AS INT) AS step_ord, last(p ORDER BY j) FILTER (p IS NOT NULL) AS score
    FROM s LEFT JOIN v ON s.episode_id = v.episode_id AND s.step_ord = v.step_ord GROUP BY ALL""")
def d10_call_scores(spark, sf):
    """The score of each step from the outputs of its calls: the last that verifies counts."""
    e = table(spark, sf, "episodes").select("episode_id", F.posexplode("steps").alias("k", "s")).where("s.tool_calls is not null")
    return e.select("episode_id", (F.col("k") + 1).alias("step_ord"), state.call_score(F.col("s.tool_calls")).alias("score"))


@query()
def d11_definitions(spark, sf):
    """The definition of each episode's function in its source, with balanced brackets."""
    e = table(spark, sf, "episodes").select("episode_id", "final_source", F.regexp_replace(F.trim("function_name"), r"\.NON_MATCHING$", "").alias("name"))
    return e.where("final_source is not null and name is not null").select("episode_id", definition_of("final_source", "name").alias("definition"))


@query()
def d12_bodies(spark, sf):
    """All functions with a typed result in C documents."""
    d = table(spark, sf, "documents").where(F.col("text").rlike(HEAD)).select("doc_id", F.explode(function_bodies("text")).alias("b"))
    return d.select("doc_id", "b.name", "b.body")


@query()
def d13_replaced(spark, sf):
    """Each record's source with its function replaced by the target."""
    r = table(spark, sf, "export_records").select("record_id", "function_name", with_function("final_source", "function_name", "target_c").alias("text"))
    return r.where("text is not null")


@query(rf"""
    WITH {_RAW}, x AS (SELECT file_id, name, unnest(regexp_extract_all(asm, '/\*\s*[0-9A-Fa-f]+\s+[0-9A-Fa-f]{{8}}\s+([0-9A-Fa-f]{{8}})\s*\*/', 1)) AS w FROM listing)
    SELECT CAST('0x' || substr(w, 1, 2) AS BIGINT) AS op, count(*) AS n FROM x GROUP BY 1""")
def d14_opcodes(spark, sf):
    """How often each leading byte occurs among the words of all listings."""
    l = assembly.lines(listings(spark, sf).select(F.concat(F.col("file_id").cast("string"), F.lit("/"), F.coalesce("name", F.lit("")), F.lit(".s")).alias("path"), "text"))
    return l.groupBy(F.shiftrightunsigned("word", 24).alias("op")).agg(F.count("*").alias("n"))


@query("""
    SELECT project, unit, count(*) AS functions, max(fuzzy_match_percent) AS best, count(*) FILTER (fuzzy_match_percent IS NULL) AS unmeasured FROM report_units GROUP BY ALL""")
def d15_units(spark, sf):
    """What the report says of each unit, as it stands."""
    return table(spark, sf, "report_units").groupBy("project", "unit").agg(F.count("*").alias("functions"), F.max("fuzzy_match_percent").alias("best"), F.count_if(F.col("fuzzy_match_percent").isNull()).alias("unmeasured"))


@query("""
    WITH e AS (SELECT DISTINCT lower(trim(function_name)) AS f, lower(trim(project)) AS p FROM episodes WHERE function_name IS NOT NULL AND project IS NOT NULL)
    SELECT DISTINCT project, function FROM report_units u WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.f = lower(trim(u.function)) AND e.p = lower(trim(u.project)))""")
def d16_backfill(spark, sf):
    """Functions of the report without an episode."""
    norm = lambda a, b: [F.lower(F.trim(a)).alias("f"), F.lower(F.trim(b)).alias("p")]
    e = table(spark, sf, "episodes").select(*norm("function_name", "project")).distinct()
    u = table(spark, sf, "report_units").select("project", "function", *norm("function", "project"))
    return u.join(e, ["f", "p"], "left_anti").select("project", "function").distinct()


@query("""
    WITH g AS (SELECT function_name, project, count(*) AS n FROM episodes WHERE function_name IS NOT NULL AND project IS NOT NULL GROUP BY ALL)
    SELECT function_name, project, n FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, function_name) AS rn FROM g) WHERE rn <= 3""")
def d17_top_functions(spark, sf):
    """The three functions of each project with most episodes."""
    g = table(spark, sf, "episodes").where("function_name is not null and project is not null").groupBy("function_name", "project").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "function_name"))
    return g.withColumn("rn", rn).where("rn <= 3").drop("rn")


@query("""
    SELECT a.function_name, count(DISTINCT b.function_name) AS siblings FROM (SELECT DISTINCT lower(trim(project)) AS p, lower(trim(function_name)) AS function_name, json_extract_string(metadata, '$.segment') AS s FROM (SELECT *, 1 FROM episodes WHERE json_valid(metadata))) a
    JOIN (SELECT DISTINCT lower(trim(project)) AS p, lower(trim(function_name)) AS function_name, json_extract_string(metadata, '$.segment') AS s FROM (SELECT *, 1 FROM episodes WHERE json_valid(metadata))) b ON a.p = b.p AND a.s = b.s AND a.function_name <> b.function_name GROUP BY 1""")
def d18_siblings(spark, sf):
    """How many other functions share a segment with each. Functions of the same segments are one row, so that what is joined
    is sets of segments and not functions."""
    e = table(spark, sf, "episodes").select(F.lower(F.trim("project")).alias("p"), F.lower(F.trim("function_name")).alias("function_name"), F.try_variant_get(F.try_parse_json("metadata"), "$.segment", "string").alias("s"))
    e = e.where("p is not null and function_name is not null and s is not null").distinct()
    of = e.groupBy("function_name").agg(F.array_sort(F.collect_set(F.struct("p", "s"))).alias("set"))
    sets = of.groupBy("set").agg(F.count("*").alias("n"))
    places = sets.select("set", "n", F.explode("set").alias("at"))
    met = places.select("at", "set").join(places.select("at", F.col("set").alias("other"), "n"), "at").select("set", "other", "n").distinct()
    others = met.groupBy("set").agg((F.sum("n") - 1).alias("siblings"))
    return of.join(others, "set").select("function_name", "siblings").where("siblings > 0")

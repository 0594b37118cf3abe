"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship, table
from . import group_splits, mixing, near_duplicates, spam_pages, split_overlap, survivors, tokenizer

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


SOURCES = ["final_source", "initial_m2c_source"]


def _near_duplicates(spark: SparkSession, sf: str) -> near_duplicates.NearDuplicates:
    ship(spark)
    return near_duplicates.NearDuplicates(table(spark, sf, "episodes").select("episode_id", *SOURCES), "episode_id", SOURCES)


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.found_pairs(_near_duplicates(spark, sf))


@query
def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.grouped(_near_duplicates(spark, sf)).withColumnRenamed("id", "episode_id")


def _split_overlap(spark: SparkSession, sf: str) -> split_overlap.SplitOverlap:
    ship(spark)
    return split_overlap.SplitOverlap(table(spark, sf, "export_records").select("record_id", "split", "final_source"), "record_id", "final_source")


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = split_overlap.found_pairs(_split_overlap(spark, sf))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


@query
def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "export_records").select("record_id", "split", "source_schema", "project")
    return split_overlap.report(_split_overlap(spark, sf), records, "record_id", ["split", "source_schema", "project"])


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return group_splits.found_groups(table(spark, sf, "episodes").select("episode_id", "function_name", "project", "metadata"))


@query
def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    shares = [(r["split_name"], r["share"]) for r in table(spark, sf, "split_shares").orderBy(F.desc("share"), "split_name").collect()]
    return group_splits.assign(table(spark, sf, "episodes").select("episode_id", "function_name", "project", "metadata"), shares)


@query
def p2_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The rows and share of each split beside the share asked for."""
    got = p2_splits(spark, sf).groupBy("split_name").agg(F.count("*").alias("rows"))
    want = table(spark, sf, "split_shares").select("split_name", "share")
    total = F.sum("rows").over(Window.partitionBy(F.lit(1)))  # a row per split
    return want.join(got, "split_name", "left").select("split_name", "share", F.coalesce("rows", F.lit(0)).alias("rows")).withColumn("reached", F.col("rows") / total)


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return survivors.best_records(table(spark, sf, "episodes")).select("project", "function_name", "keep_id", "percent_id", "end_id")


@query
def p5_records(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return survivors.best_records(table(spark, sf, "episodes"))


@query
def p5_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sensitivity and specificity of each source of episodes, by field."""
    ship(spark)
    q = survivors.TwoSided(survivors.claims(table(spark, sf, "episodes")), ["p", "f"]).quality
    return q.select("source", "field", F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"))


# Names and files as nodes, reached from each other; a path is normalised by taking out its parts before dots.
SQL["p2_found"] = r"""
    WITH RECURSIVE j AS (SELECT episode_id, lower(regexp_replace(project, '^\s+|\s+$', '', 'g')) AS p, regexp_replace(lower(regexp_replace(function_name, '^\s+|\s+$', '', 'g')), '\s*\.non_matching$', '') AS f,
               CASE WHEN json_valid(metadata) THEN CASE WHEN json_type(metadata) = 'VARCHAR' THEN CASE WHEN json_valid(metadata ->> '$') THEN metadata ->> '$' END ELSE metadata END END AS m FROM episodes),
    e AS (SELECT episode_id, p, p || '/' || f AS key, f, CASE WHEN json_type(m) = 'OBJECT' THEN CAST(m AS JSON) END AS m FROM j WHERE p <> '' AND f <> ''),
    said AS (SELECT key, p, f, unnest(list_concat([CASE WHEN json_type(m, '$.' || k) = 'VARCHAR' THEN m ->> ('$.' || k) END], CASE WHEN json_type(m, '$.' || k) = 'ARRAY' THEN list_transform(list_filter(CAST(json_extract(m, '$.' || k) AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$') ELSE [] END)) AS x
             FROM e, (VALUES ('former_name'), ('symbol_name'), ('previous_names')) AS v(k)),
    names AS (SELECT DISTINCT key, p || '/' || regexp_replace(lower(regexp_replace(x, '^\s+|\s+$', '', 'g')), '\s*\.non_matching$', '') AS other FROM said WHERE x IS NOT NULL),
    paths AS (SELECT DISTINCT key, p, regexp_replace(replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), chr(92), '/'), '/+', '/', 'g') AS x FROM (
        SELECT key, p, CASE WHEN json_type(m, '$.source_path') = 'VARCHAR' THEN m ->> '$.source_path' END AS x FROM e UNION ALL SELECT key, p, CASE WHEN json_type(m, '$.source.path') = 'VARCHAR' THEN m ->> '$.source.path' END FROM e) WHERE x <> ''),
    below AS (SELECT key, p, CASE WHEN regexp_matches(x, '(?i)(^|/)projects/[^/]+') THEN CASE WHEN lower(regexp_extract(x, '(?i)^(?:.*/)?projects/([^/]+)', 1)) = p THEN regexp_extract(x, '(?i)^(?:.*/)?projects/[^/]+/?(.*)$', 1) END ELSE x END AS x FROM paths),
    flat AS (SELECT key, p, 0 AS k, regexp_replace(x, '(^|/)(\./)+', '\1', 'g') AS x FROM below WHERE x <> '' UNION ALL SELECT key, p, k + 1, regexp_replace(x, '(^|/)([^/.][^/]*|\.[^/.][^/]*|\.\.[^/]+)/\.\.(/|$)', '\1') FROM flat WHERE k < 8),
    files AS (SELECT DISTINCT key, p || '/' || regexp_replace(x, '/$', '') AS other FROM flat WHERE k = 8 AND x NOT IN ('', '.') AND NOT starts_with(x, '/') AND NOT starts_with(x, '..') AND NOT regexp_matches(x, '^[A-Za-z]:')),
    edge AS (SELECT key AS a, 'n' || other AS b FROM names WHERE other IN (SELECT key FROM e) UNION SELECT key, 'f' || other FROM files),
    step AS (SELECT 'n' || a AS a, b FROM edge UNION SELECT b, 'n' || a FROM edge),
    reach AS (SELECT DISTINCT 'n' || key AS a, 'n' || key AS b FROM e UNION SELECT reach.a, step.b FROM reach JOIN step ON step.a = reach.b),
    g AS (SELECT a, min(b) AS least FROM reach WHERE b LIKE 'n%' GROUP BY a),
    rows AS (SELECT episode_id, substr(least, 2) AS group_key, count(*) OVER (PARTITION BY least) AS n FROM e JOIN g ON g.a = 'n' || e.key)
    SELECT episode_id, group_key FROM rows WHERE n > 1"""
SQL["p5_found"] = """
    WITH norm AS (
        SELECT *, lower(regexp_replace(project, '^\\s+|\\s+$', '', 'g')) AS p,
               regexp_replace(lower(regexp_replace(function_name, '^\\s+|\\s+$', '', 'g')), '\\s*\\.non_matching$', '') AS f,
               regexp_replace(lower(outcome), '[^a-z]', '', 'g') AS o, trim(end_time) AS t,
               CASE WHEN NOT isnan(best_match_percent) AND best_match_percent BETWEEN 0 AND 100 THEN best_match_percent END AS pct
        FROM episodes),
    rows AS (
        SELECT p, f, episode_id, pct,
               CASE WHEN o LIKE 'match%' THEN 0 WHEN o LIKE 'partial%' THEN 1 WHEN o LIKE 'fail%' THEN 2 WHEN o LIKE 'incomplete%' THEN 3 ELSE 4 END AS rank,
               CASE WHEN regexp_full_match(t, '[0-9]{1,16}') THEN CASE WHEN length(t) >= 12 THEN CAST(t AS HUGEINT) * 1000 ELSE CAST(t AS HUGEINT) * 1000000 END
                    WHEN t LIKE '____-__-__%' THEN epoch_us(TRY_CAST(CASE WHEN regexp_matches(t, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN t ELSE t || '+00:00' END AS TIMESTAMPTZ)) END AS ended
        FROM norm WHERE p <> '' AND f <> '')
    SELECT p AS project, f AS function_name,
           first(episode_id ORDER BY rank, coalesce(pct, -1) DESC, ended DESC NULLS LAST, episode_id) AS keep_id,
           coalesce(first(episode_id ORDER BY pct DESC, episode_id) FILTER (pct IS NOT NULL), -1) AS percent_id,
           coalesce(first(episode_id ORDER BY ended DESC, episode_id) FILTER (ended IS NOT NULL), -1) AS end_id
    FROM rows GROUP BY p, f HAVING count(*) > 1"""


# Tokens of code for DuckDB: identifiers, numbers, single other characters; comments and white space are left out.
_W, _L = r"0-9A-Za-z_\x{80}-\x{10FFFF}", r"A-Za-z_\x{80}-\x{10FFFF}"
_TOKEN = rf"[{_L}][{_W}]*|[0-9][{_W}]*(?:\.[0-9][{_W}]*)*(?:\.(?:[{_L}][{_W}]*)?)?|[^\x00-\x20\x7f{_W}]"
_ODD = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NOTE = r"""("(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])*'')|/\*.*?(?:\*/|\z)|//[^\n]*"""


def _sets(texts: str) -> str:
    """SQL of the sets of three successive tokens of the texts t of a table, a row for each."""
    return rf"""w AS (SELECT * EXCLUDE (t), regexp_extract_all(regexp_replace(regexp_replace(t, '{_ODD}', ' ', 'g'), '{_NOTE}', '\1 ', 'gs'), '{_TOKEN}') AS w FROM {texts} WHERE t IS NOT NULL),
    s AS (SELECT DISTINCT * EXCLUDE (w, i), CASE WHEN len(w) < 3 THEN hash(len(w), w) ELSE hash(w[i], w[i + 1], w[i + 2]) END AS h FROM w, UNNEST(range(1, greatest(len(w) - 1, 2))) AS u(i) WHERE len(w) > 0)"""


_ALIKE3 = rf"""r AS (SELECT episode_id AS id, 'final_source' AS field, final_source AS t FROM episodes UNION ALL SELECT episode_id, 'initial_m2c_source', initial_m2c_source FROM episodes),
    {_sets("r")}, n AS (SELECT id, field, count(*) AS n, hash(list_sort(list(h))) AS class FROM s GROUP BY id, field),
    p AS (SELECT a.id AS x, b.id AS y, a.field, count(*) AS b FROM s a JOIN s b ON a.h = b.h AND a.field = b.field AND a.id < b.id GROUP BY ALL),
    alike AS (SELECT x, y, p.field, nx.class AS cx, ny.class AS cy FROM p JOIN n nx ON nx.id = x AND nx.field = p.field JOIN n ny ON ny.id = y AND ny.field = p.field WHERE 2 * p.b >= nx.n + ny.n - p.b)"""
SQL["p3_found"] = f"WITH {_ALIKE3} SELECT x AS id_a, y AS id_b, field FROM alike"
SQL["p3_groups"] = f"""
    WITH RECURSIVE {_ALIKE3}, e AS (SELECT x, y, field, cx, cy FROM alike UNION ALL SELECT y, x, field, cy, cx FROM alike),
    reach AS (SELECT id, field, id AS other FROM n UNION SELECT reach.id, reach.field, e.y FROM reach JOIN e ON e.x = reach.other AND e.field = reach.field),
    least AS (SELECT id, field, min(other) AS group_id FROM reach GROUP BY ALL), k AS (SELECT x AS id, field, count(DISTINCT cy) FILTER (cx <> cy) AS links FROM e GROUP BY ALL)
    SELECT id AS episode_id, field, group_id, coalesce(links, 0) AS links FROM least LEFT JOIN k USING (id, field)"""
_SPLIT = r"lower(regexp_replace(split, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'))"
_ALIKE6 = rf"""r AS (SELECT record_id AS id, CASE WHEN {_SPLIT} = 'train' THEN 1 WHEN {_SPLIT} <> '' THEN 2 END AS side, final_source AS t FROM export_records), k AS (SELECT * FROM r WHERE side IS NOT NULL),
    {_sets("k")}, n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    p AS (SELECT a.id AS x, b.id AS y, count(*) AS b FROM s a JOIN s b ON a.h = b.h AND a.side = 1 AND b.side = 2 GROUP BY ALL),
    alike AS (SELECT x, y, p.b = nx.n AND p.b = ny.n AS same FROM p JOIN n nx ON nx.id = x JOIN n ny ON ny.id = y WHERE 2 * p.b >= nx.n + ny.n - p.b)"""
SQL["p6_found"] = f"WITH {_ALIKE6} SELECT least(x, y) AS id_a, greatest(x, y) AS id_b FROM alike"
SQL["p6_report"] = f"""
    WITH {_ALIKE6}, hits AS (SELECT y AS id, count(*) AS n, bool_or(same) AS same FROM alike GROUP BY y)
    SELECT {_SPLIT} AS split, lower(trim(source_schema)) AS source_schema, lower(trim(project)) AS project, count(*) AS records, count(hits.n) AS overlapping, CAST(coalesce(sum(hits.n), 0) AS BIGINT) AS pairs, count(*) FILTER (hits.same) AS same_sets
    FROM export_records LEFT JOIN hits ON hits.id = record_id WHERE {_SPLIT} NOT IN ('train', '') GROUP BY 1, 2, 3"""


@query
def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return tokenizer.encode_column(table(spark, sf, "documents"), "doc_id", "text", tokenizer.vocabulary("byte_bpe_50k"))


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return spam_pages.judged(table(spark, sf, "documents")).where("spam").select("doc_id")


@query
def p9_figures(spark: SparkSession, sf: str) -> DataFrame:
    """The figures of every page with text."""
    ship(spark)
    out = spam_pages.judged(table(spark, sf, "documents"))
    return out.select("doc_id", *[F.round(k, 6).alias(k) for k in spam_pages.FIGURES], "sentences", "links", "left", "candidate", "spam")


def _mixture(spark: SparkSession, sf: str) -> mixing.Mixture:
    ship(spark)
    targets = [tuple(r) for r in table(spark, sf, "mix_targets").select("source", "target_share", "max_repeats").orderBy("source").collect()]
    return mixing.Mixture(table(spark, sf, "documents").select("doc_id", "text", "source"), targets, tokenizer.vocabulary("byte_bpe_50k"))


@query
def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).documents.select("doc_id", "source", "tokens", "copies")


@query
def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of all tokens that each source has reached, beside its target."""
    schema = "source string, target_share double, available_tokens bigint, documents bigint, tokens bigint, share double, attainable_share double, expected_share double, mixed_share double, most_copies int"
    return spark.createDataFrame([tuple(r.values()) for r in _mixture(spark, sf).shares], schema)

"""Queries of the relational operators over the tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import blake2s_unit, md5_unit, split_of
from ..operators import relational as R
from ..operators import state
from ..session import table
from . import report

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Trailing white space as Python strips it, for DuckDB.
_SP = r"[\s\x0B\x1C-\x1F\x85\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NORM = f"CASE WHEN text = '' THEN '' ELSE regexp_replace(text, '{_SP}+\\z', '') || chr(10) END"


@query(f"""
    WITH n AS (SELECT doc_id, lower(trim(lang)) AS lang, {_NORM} AS t FROM documents),
    f AS (SELECT t, min(doc_id) AS id FROM n WHERE t <> '' GROUP BY t),
    s AS (SELECT n.lang, CAST('0x' || substr(md5('split-v1:' || CAST(n.doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.1 AS e FROM n JOIN f ON n.doc_id = f.id)
    SELECT lang, CASE WHEN e THEN 'eval' ELSE 'train' END AS split, count(*) AS docs FROM s GROUP BY ALL""")
def q01_export_split(spark: SparkSession, sf: str) -> DataFrame:
    """Normalise, first wins by text, split by hash, count."""
    d = table(spark, sf, "documents").select("doc_id", F.lower(F.trim("lang")).alias("lang"), T.normalize_text("text").alias("t")).where("t <> ''")
    first = R.first_wins(d.withColumn("h", F.sha2("t", 256)).drop("t"), ["h"], ["doc_id"], ["doc_id", "lang"])
    unit = md5_unit(F.concat(F.lit("split-v1:"), F.col("doc_id").cast("string")))
    return first.withColumn("split", split_of(unit, 0.1)).groupBy("lang", "split").agg(F.count("*").alias("docs"))


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def q02_first_wins(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").withColumn("digest", F.md5("text"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id, CAST('0x' || substr(md5('seed:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.1 AS is_eval FROM documents")
def q03_md5_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (md5_unit(F.concat(F.lit("seed:"), F.col("doc_id").cast("string"))) < 0.1).alias("is_eval"))


@query()
def q04_blake2s_split(spark, sf):
    d = table(spark, sf, "export_records").select("record_id", "task_id")
    return d.select("record_id", "task_id", split_of(blake2s_unit(F.concat(F.lit("export-split-v1:"), "task_id")), 0.1).alias("split"))


@query(f"""
    SELECT doc_id, length({_NORM}) AS chars, CASE WHEN text = '' THEN 0 ELSE
        len(regexp_split_to_array(regexp_replace(text, '(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{0085}}\\x{{2028}}\\x{{2029}}])\\z', ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{0085}}\\x{{2028}}\\x{{2029}}]')) END AS lines
    FROM documents WHERE text IS NOT NULL""")
def q05_normalize_lines(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.length(T.normalize_text("text")).cast("bigint").alias("chars"), F.size(T.split_lines("text")).cast("bigint").alias("lines"))


@query("""
    WITH u AS (SELECT *, row_number() OVER (PARTITION BY project, unit, function ORDER BY measured_at DESC, coalesce(fuzzy_match_percent, -1) DESC, size DESC) AS rn FROM report_units)
    SELECT project, CAST(grouping(project) AS INT) AS total, count(*) AS functions, count(*) FILTER (fuzzy_match_percent = 100) AS matched_functions,
           coalesce(CAST(sum(size) AS BIGINT), 0) AS code, coalesce(CAST(sum(size) FILTER (fuzzy_match_percent = 100) AS BIGINT), 0) AS matched_code,
           round(CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (fuzzy_match_percent = 100) / count(*) * 100 END, 6) AS function_percent,
           round(CASE WHEN coalesce(sum(size), 0) = 0 THEN 0.0 ELSE coalesce(sum(size) FILTER (fuzzy_match_percent = 100), 0) / sum(size) * 100 END, 6) AS code_percent
    FROM u WHERE rn = 1 GROUP BY ROLLUP (project)""")
def q06_progress_rollup(spark, sf):
    return report.rollup(report.latest_units(table(spark, sf, "report_units")), "project", "size", F.col("fuzzy_match_percent") == 100.0)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q07_anti_discover(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def q08_semi_discover(spark, sf):
    return table(spark, sf, "part").join(table(spark, sf, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query("""
    WITH m AS (SELECT min(s_suppkey) AS any_s FROM supplier), n AS (SELECT s_nationkey, min(s_suppkey) AS s FROM supplier GROUP BY 1),
    r AS (SELECT n_regionkey, min(s_suppkey) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT c_custkey, CASE WHEN n.s IS NOT NULL THEN 0 WHEN r.s IS NOT NULL THEN 1 ELSE 2 END AS rank, coalesce(n.s, r.s, any_s) AS s_suppkey
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN n ON n.s_nationkey = c_nationkey LEFT JOIN r ON r.n_regionkey = nation.n_regionkey, m""")
def q09_ranked_join(spark, sf):
    """Each customer's supplier: of the same nation, else of the same region, else any; the least key."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    by_nation = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s0"))
    by_region = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.min("s_suppkey").alias("s1"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    j = c.join(by_nation, F.col("c_nationkey") == F.col("s_nationkey"), "left").join(by_region, "n_regionkey", "left")
    least = s.agg(F.min("s_suppkey").alias("s2"))
    rank = F.when(F.col("s0").isNotNull(), 0).when(F.col("s1").isNotNull(), 1).otherwise(2)
    return j.join(F.broadcast(least)).select("c_custkey", rank.alias("rank"), F.coalesce("s0", "s1", "s2").alias("s_suppkey"))


@query("""
    SELECT event_id, CASE WHEN event_type LIKE '%pur%' THEN 'sale' WHEN event_type LIKE '%i%' THEN 'visit' ELSE 'other' END AS family,
           CASE WHEN event_type LIKE '%pur%' THEN 3.0 WHEN event_type LIKE '%i%' THEN 1.0 ELSE 0.5 END AS weight FROM events""")
def q10_theta_first(spark, sf):
    rules = [("pur", "sale", 3.0), ("i", "visit", 1.0)]
    return R.first_match(table(spark, sf, "events").select("event_id", "event_type"), "event_type", rules, ("other", 0.5), ["family", "weight"]).drop("event_type")


_BANDS = [("small", 0.0, 10.0), ("medium", 10.0, 25.0), ("large", 25.0, 40.0), ("huge", 40.0, 1e9)]


@query(f"""
    SELECT band, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem
    JOIN (VALUES {", ".join(str(b) for b in _BANDS)}) AS b(band, low, high) ON l_quantity >= low AND l_quantity < high GROUP BY band""")
def q11_range_lookup(spark, sf):
    bands = spark.createDataFrame(_BANDS, "band string, low double, high double")
    j = R.range_lookup(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", bands, "low", "high", ["band"], "inner")
    return j.groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""
    WITH p AS (SELECT user_id, ts, max(event_id) AS pid FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
    SELECT e.event_id, p.pid AS last_purchase, p.ts AS purchased_at FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def q12_asof(spark, sf):
    """Each event with its user's last purchase at or before it."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    p = table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("pid"), F.col("ts").alias("pts"))
    return R.asof_join(e, p, ["user_id"], "ts", ["pid", "pts"], "pid").select("event_id", F.col("asof_pid").alias("last_purchase"), F.col("asof_pts").alias("purchased_at"))


@query("""
    WITH n AS (SELECT DISTINCT dir_name AS name FROM segments),
    w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS name FROM documents)
    SELECT name, count(*) AS docs, min(doc_id) AS first_doc FROM w JOIN n USING (name) GROUP BY name""")
def q13_mentions(spark, sf):
    """Segments that documents mention: containment as an equi-join on words."""
    n = table(spark, sf, "segments").select(F.col("dir_name").alias("name")).distinct()
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("name"))
    return w.join(n, "name").groupBy("name").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("""
    WITH c AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
    w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM c),
    r AS (SELECT DISTINCT id, array_to_string(w[i:i + 7], ' ') AS run FROM w, UNNEST(range(1, len(w) - 6)) AS u(i)),
    n AS (SELECT id, hash(run) AS run FROM r WHERE run IN (SELECT run FROM r GROUP BY run HAVING count(*) > 1))
    SELECT a.id AS class_a, b.id AS class_b, count(*) AS shared FROM n a JOIN n b ON a.run = b.run AND a.id < b.id GROUP BY ALL HAVING count(*) >= 20""")
def q14_shingle_join(spark, sf):
    """Distinct documents that share 20 runs of eight words or more."""
    return R.shared_shingles(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 8, 20)


@query("""
    WITH a AS (SELECT function, project, max(size) AS s1 FROM report_units GROUP BY 1, 2),
    e AS (SELECT function_name, project, max(instruction_count * 4) AS s2 FROM episodes WHERE function_name IS NOT NULL AND project IS NOT NULL GROUP BY 1, 2)
    SELECT project, state, count(*) AS n FROM (
        SELECT coalesce(a.project, e.project) AS project, CASE WHEN a.function IS NULL OR function_name IS NULL THEN 'missing' WHEN s1 = s2 THEN 'same' ELSE 'differs' END AS state
        FROM (SELECT * FROM a WHERE function IS NOT NULL AND project IS NOT NULL) a FULL JOIN e ON a.function = e.function_name AND a.project = e.project) GROUP BY ALL""")
def q15_keyed_compare(spark, sf):
    """Sizes of functions in the report against those of their episodes, by exact key."""
    a = table(spark, sf, "report_units").where("function is not null and project is not null").groupBy("function", "project").agg(F.max("size").alias("s1"))
    e = table(spark, sf, "episodes").where("function_name is not null and project is not null").groupBy(F.col("function_name").alias("function"), "project").agg(F.max(F.col("instruction_count") * 4).alias("s2"))
    j = a.withColumn("in_a", F.lit(1)).join(e.withColumn("in_e", F.lit(1)), ["function", "project"], "full")
    st = F.when(F.col("in_a").isNull() | F.col("in_e").isNull(), "missing").when(F.col("s1") == F.col("s2"), "same").otherwise("differs")
    return j.groupBy("project", st.alias("state")).agg(F.count("*").alias("n"))


@query("""
    SELECT event_id, row_number() OVER w AS seq, greatest(0.0, max(value) OVER w) AS best, round(sum(value) OVER w, 4) AS total
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def q16_running_best(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return state.running(e, ["user_id"], ["ts", "event_id"], "value").select("event_id", "seq", "best", F.round(F.sum("value").over(w), 4).alias("total"))


@query("""
    SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER w AS final, first_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER w AS first
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def q17_last_nonnull(spark, sf):
    v = F.when(F.col("event_type") != "error", F.col("value"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_id", F.last(v, ignorenulls=True).over(w).alias("final"), F.first(v, ignorenulls=True).over(w).alias("first"))


@query("""
    WITH e AS (SELECT *, coalesce(max(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hits FROM events)
    SELECT user_id, count(*) AS steps, CASE WHEN bool_or(event_type = 'purchase') THEN 'match' WHEN greatest(0.0, max(value)) > 0 THEN 'partial' ELSE 'failed' END AS outcome
    FROM e WHERE hits = 0 GROUP BY user_id""")
def q18_outcome(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    cut = state.until_first(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase")
    return cut.groupBy("user_id").agg(F.count("*").alias("steps"), state.outcome(F.bool_or(F.col("event_type") == "purchase"), F.greatest(F.lit(0.0), F.max("value"))).alias("outcome"))


@query("SELECT p_partkey, p_retailprice, (SELECT count(*) FROM part) AS total FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def q19_topk(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    total = p.agg(F.count("*").alias("total"))
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).join(F.broadcast(total))


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5")
def q20_limit_per_key(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn")).where("rn <= 5")


@query("""
    WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1), l AS (SELECT *, lag(n) OVER (ORDER BY day) AS p FROM d)
    SELECT day, n, n - p AS change, coalesce(abs(n - p) > 0.1 * p, false) AS alert FROM l""")
def q21_drift(spark, sf):
    d = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day")  # a row per day
    p = F.lag("n").over(w)
    return d.select("day", "n", (F.col("n") - p).alias("change"), F.coalesce(F.abs(F.col("n") - p) > p * 0.1, F.lit(False)).alias("alert"))


@query("""
    WITH i AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
    SELECT user_id, event_type, max(n) AS longest FROM (SELECT user_id, event_type, k, count(*) AS n FROM i GROUP BY ALL) GROUP BY ALL""")
def q22_streaks(spark, sf):
    s = R.streaks(table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return s.groupBy("user_id", "event_type").agg(F.max("length").alias("longest"))


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 3")
def q23_family(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders")).where("orders >= 3")


_CALLS = "SELECT lower(regexp_extract(x, '(\\w+)\\s*\\(', 1)) AS callee, f AS caller FROM (SELECT f, unnest(regexp_extract_all(s, 'func_[0-9A-Fa-f]{8}\\s*\\(')) AS x FROM (SELECT lower(trim(function_name)) AS f, final_source AS s FROM episodes WHERE function_name IS NOT NULL)) WHERE lower(regexp_extract(x, '(\\w+)\\s*\\(', 1)) <> f"


@query(f"WITH c AS ({_CALLS}) SELECT callee, count(DISTINCT caller) AS callers FROM c GROUP BY callee HAVING count(DISTINCT caller) >= 3")
def q23b_callers(spark, sf):
    """Functions that three others or more call."""
    return _calls(spark, sf).groupBy("callee").agg(F.countDistinct("caller").alias("callers")).where("callers >= 3")


def _calls(spark, sf):
    e = table(spark, sf, "episodes").select(F.lower(F.trim("function_name")).alias("caller"), "final_source")
    c = e.where("caller is not null").select("caller", F.explode(F.regexp_extract_all("final_source", F.lit(r"(func_[0-9A-Fa-f]{8})\s*\("), F.lit(1))).alias("callee"))
    return c.select("caller", F.lower("callee").alias("callee")).where("caller <> callee")


@query(f"""
    WITH RECURSIVE c AS (SELECT DISTINCT caller, callee FROM ({_CALLS})),
    r AS (SELECT DISTINCT caller AS node, 0 AS depth FROM c WHERE caller NOT IN (SELECT callee FROM c) UNION SELECT callee, depth + 1 FROM r JOIN c ON node = caller WHERE depth < 20)
    SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node""")
def q24_graph(spark, sf):
    """What can be reached by calls, in 20 steps, from the functions that nobody calls, at the least depth."""
    c = _calls(spark, sf)
    roots = c.select(F.col("caller").alias("node")).distinct().join(c.select(F.col("callee").alias("node")).distinct(), "node", "left_anti")
    return R.reachable(c, roots, most=20)


@query("""
    SELECT * FROM (
      SELECT 'documents' AS src, doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE regexp_matches(text, 'delay slot')
      UNION ALL SELECT 'episodes', episode_id, row_number() OVER (ORDER BY episode_id) FROM episodes WHERE regexp_matches(final_source, 'switch \\(')
      UNION ALL SELECT 'records', record_id, row_number() OVER (ORDER BY record_id) FROM export_records WHERE regexp_matches(target_c, 'do \\{')) WHERE rn <= 20""")
def q25_union_search(spark, sf):
    """Labelled hits of three sources, the first 20 of each."""
    parts = [("documents", "documents", "doc_id", "text", "delay slot"), ("episodes", "episodes", "episode_id", "final_source", r"switch \("), ("records", "export_records", "record_id", "target_c", r"do \{")]
    out = None
    for label, name, key, text, pat in parts:
        hit = table(spark, sf, name).where(F.col(text).rlike(pat)).select(F.lit(label).alias("src"), F.col(key).alias("id")).orderBy("id").limit(20)
        hit = hit.withColumn("rn", F.row_number().over(Window.orderBy("id")))  # 20 rows
        out = hit if out is None else out.unionByName(hit)
    return out


@query("""
    WITH a AS (SELECT chr(CAST(i AS INT)) AS letter FROM range(97, 123) t(i)),
    u AS (SELECT lower(substr(p_name, 1, 1)) AS letter FROM part UNION SELECT lower(substr(c_mktsegment, 1, 1)) FROM customer)
    SELECT letter, letter = min(letter) OVER () AS next FROM a WHERE letter NOT IN (SELECT letter FROM u WHERE letter IS NOT NULL)""")
def q26_set_diff(spark, sf):
    """Letters that no name uses; the first of them is next."""
    a = spark.range(97, 123).select(F.chr("id").alias("letter"))
    first = lambda t, c: table(spark, sf, t).select(F.lower(F.substring(c, 1, 1)).alias("letter"))
    free = a.join(first("part", "p_name").union(first("customer", "c_mktsegment")).distinct(), "letter", "left_anti")
    return free.select("letter", (F.col("letter") == F.min("letter").over(Window.partitionBy(F.lit(1)))).alias("next"))


@query("""
    WITH h AS (SELECT doc_id, regexp_extract_all(text, 'https?://([A-Za-z0-9.-]+)', 1) AS h FROM documents),
    p AS (SELECT doc_id, h[i] AS host, min(i) AS pos FROM h, UNNEST(range(1, len(h) + 1)) AS u(i) GROUP BY 1, 2)
    SELECT doc_id, string_agg(host, ',' ORDER BY pos) AS hosts FROM p GROUP BY doc_id""")
def q27_regex_extract(spark, sf):
    h = F.array_distinct(F.regexp_extract_all("text", F.lit("https?://([A-Za-z0-9.-]+)"), F.lit(1)))
    return table(spark, sf, "documents").select("doc_id", F.array_join(h, ",").alias("hosts")).where("hosts <> ''")


@query("SELECT event_id, CASE WHEN json_valid(props) THEN props ->> '$.k' END AS k FROM events")
def q28_json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))


@query("""
    SELECT record_id, 'Project: ' || coalesce(project, '') || chr(10) || 'Function: ' || coalesce(function_name, '') || chr(10)
        || CASE WHEN instruction_count <> 0 THEN 'Instruction count: ' || CAST(instruction_count AS VARCHAR) || chr(10) ELSE '' END
        || CASE WHEN initial_m2c_source <> '' THEN md5(initial_m2c_source) || chr(10) ELSE '' END AS prompt FROM export_records""")
def q29_prompt_build(spark, sf):
    """Ordered lines, some of them optional."""
    c = lambda n: F.coalesce(n, F.lit(""))
    return table(spark, sf, "export_records").select("record_id", T.prompt([
        F.concat(F.lit("Project: "), c("project")), F.concat(F.lit("Function: "), c("function_name")),
        F.when(F.col("instruction_count") != 0, F.concat(F.lit("Instruction count: "), F.col("instruction_count").cast("string"))),
        F.when(F.col("initial_m2c_source") != "", F.md5("initial_m2c_source")),
    ]).alias("prompt"))


@query("""
    SELECT episode_id, concat_ws(';', CASE WHEN function_name IS NULL OR trim(function_name) = '' THEN 'name' END, CASE WHEN project IS NULL OR trim(project) = '' THEN 'project' END,
        CASE WHEN outcome IS NULL OR outcome NOT IN ('match', 'partial', 'failed', 'incomplete') THEN 'outcome' END,
        CASE WHEN best_match_percent IS NULL OR isnan(best_match_percent) OR best_match_percent NOT BETWEEN 0 AND 100 THEN 'percent' END, CASE WHEN steps IS NULL THEN 'steps' END) AS errors
    FROM episodes""")
def q30_dq_rules(spark, sf):
    """Each episode with what is wrong with it."""
    bad = lambda cond, label: F.when(cond, label)
    p = F.col("best_match_percent")
    rules = [
        bad(F.col("function_name").isNull() | (F.trim("function_name") == ""), "name"), bad(F.col("project").isNull() | (F.trim("project") == ""), "project"),
        bad(F.col("outcome").isNull() | ~F.col("outcome").isin("match", "partial", "failed", "incomplete"), "outcome"), bad(p.isNull() | F.isnan(p) | ~p.between(0, 100), "percent"), bad(F.col("steps").isNull(), "steps"),
    ]
    return table(spark, sf, "episodes").select("episode_id", F.array_join(F.array_compact(F.array(*rules)), ";").alias("errors"))


@query("""
    SELECT function, project, unit, measured_at, size, fuzzy_match_percent IS NULL AS unmeasured, coalesce(fuzzy_match_percent = 100, false) OR coalesce(size = 8, false) AS lands FROM report_units""")
def q31_three_valued(spark, sf):
    u = table(spark, sf, "report_units")
    return u.select("function", "project", "unit", "measured_at", "size", F.col("fuzzy_match_percent").isNull().alias("unmeasured"), T.is_exact("fuzzy_match_percent", F.col("size") == 8).alias("lands"))


@query("""
    WITH c AS (SELECT lower(trim(source)) AS source, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z]', 'a', 'g'), '[0-9]', 'd', 'g'), '[^ad]', 'o', 'g'), '')) AS class FROM documents)
    SELECT source, class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 9) AS share FROM c WHERE class <> '' GROUP BY source, class""")
def q32_histogram(spark, sf):
    """Letters, digits and others of each source's texts: lengths are counted per text, so nothing is exploded."""
    n = F.length("text").cast("bigint")
    a, d = F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("bigint"), F.length(F.regexp_replace("text", "[^0-9]", "")).cast("bigint")
    g = table(spark, sf, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum(a).alias("a"), F.sum(d).alias("d"), F.sum(n - a - d).alias("o"))
    return g.select("source", F.expr("stack(3, 'a', a, 'd', d, 'o', o) as (class, n)"), (F.col("a") + F.col("d") + F.col("o")).alias("t")).where("n > 0").select("source", "class", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))


@query("""
    SELECT doc_id, substr(text, CAST(strpos(text, 'delay slot') AS INT) - 16, 48) AS part FROM documents WHERE strpos(text, 'delay slot') > 16""")
def q33_window_slice(spark, sf):
    at = F.locate("delay slot", F.col("text"))
    return table(spark, sf, "documents").where(at > 16).select("doc_id", F.substring("text", at - 16, F.lit(48)).alias("part"))


@query("SELECT lower(trim(source)) AS source, count(*) AS docs, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY 1")
def q35_digest_distinct(spark, sf):
    d = table(spark, sf, "documents").select(F.lower(F.trim("source")).alias("source"), F.md5("text").alias("h"))
    g = d.groupBy("source", "h").agg(F.count("*").alias("n"))  # copies of a hot source meet before they move
    return g.groupBy("source").agg(F.sum("n").alias("docs"), F.count("h").alias("texts"))


@query("""
    WITH a AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
    b AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1)
    SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.n <> b.n""")
def q36_snapshot_diff(spark, sf):
    o = table(spark, sf, "orders")
    at = lambda day: o.where(F.col("o_orderdate") < F.lit(day).cast("timestamp_ntz")).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return R.snapshot_diff(at("1996-01-01"), at("1997-01-01"), "o_custkey", ["n"])


@query("""
    SELECT CASE WHEN s IS NULL THEN 'none' WHEN s > 95 THEN 'near' WHEN s > 80 THEN 'close' WHEN s > 50 THEN 'half' ELSE 'far' END AS band, count(*) AS n, min(s) AS least
    FROM (SELECT CASE WHEN NOT isnan(best_match_percent) THEN best_match_percent END AS s FROM episodes) GROUP BY 1""")
def q37_score_bands(spark, sf):
    s = F.when(~F.isnan("best_match_percent"), F.col("best_match_percent"))
    e = table(spark, sf, "episodes").select(s.alias("s"))
    return e.groupBy(T.band("s", [(95, "near"), (80, "close"), (50, "half")], "far").alias("band")).agg(F.count("*").alias("n"), F.min("s").alias("least"))


@query("""
    WITH f AS (SELECT project, dir_name, rom_start, vram, lead(vram) OVER (PARTITION BY project ORDER BY vram, dir_name) AS next FROM segments),
    u AS (SELECT DISTINCT project, function, TRY_CAST('0x' || nullif(regexp_extract(function, 'func_([0-9A-Fa-f]{8})', 1), '') AS BIGINT) AS addr FROM report_units)
    SELECT u.project, function, CASE WHEN addr IS NULL THEN 'none' WHEN addr = vram THEN 'start' WHEN dir_name IS NOT NULL THEN 'inside' ELSE 'outside' END AS kind, dir_name, rom_start + addr - vram AS rom_off
    FROM u LEFT JOIN (SELECT * FROM f WHERE next IS NULL OR next > vram) f ON u.project = f.project AND addr >= vram AND (addr < next OR next IS NULL)""")
def q38_target_resolution(spark, sf):
    """Which segment a function's address lies in, and where in the image that is."""
    u = table(spark, sf, "report_units").select("project", "function", T.hex_number(F.regexp_extract("function", "func_([0-9A-Fa-f]{8})", 1)).alias("at")).distinct()
    s = table(spark, sf, "segments").select("project", F.col("vram").alias("at"), "dir_name", "rom_start", "vram")
    known = R.asof_join(u.where("at is not null"), s, ["project"], "at", ["dir_name", "rom_start", "vram"], "dir_name")
    none = u.where("at is null").select("project", "function", "at", F.lit(None).cast("string").alias("asof_dir_name"), F.lit(None).cast("bigint").alias("asof_rom_start"), F.lit(None).cast("bigint").alias("asof_vram"))
    kind = F.when(F.col("at").isNull(), "none").when(F.col("at") == F.col("asof_vram"), "start").when(F.col("asof_dir_name").isNotNull(), "inside").otherwise("outside")
    return known.unionByName(none).select("project", "function", kind.alias("kind"), F.col("asof_dir_name").alias("dir_name"), (F.col("asof_rom_start") + F.col("at") - F.col("asof_vram")).alias("rom_off"))

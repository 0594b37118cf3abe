"""Queries of discovery, boundaries, parity and hygiene, over the listings, sources and reports inside the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly, parity, relational
from ..session import table
from . import quality
from .core_domain import _RAW, listings

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- listings ----------------------------------------------------------------------------

_RETURN = "/* 000000 80000000 03E00008 */  jr $ra"
_HEX = r"/\*\s*([0-9A-Fa-f]+)\s+([0-9A-Fa-f]{8})\s+([0-9A-Fa-f]{8})\s*\*/\s*(.*)"
#: Lines of listings that carry a word; framed listings end in a return if they call anything.
_CODE = rf"""{_RAW},
    codelines AS (SELECT file_id, l, i AS line_no FROM (SELECT file_id, string_split(asm, chr(10)) AS ls FROM listing), UNNEST(ls) WITH ORDINALITY AS u(l, i)),
    code AS (SELECT file_id, CAST('0x' || regexp_extract(l, '{_HEX}', 2) AS BIGINT) AS vram, CAST('0x' || regexp_extract(l, '{_HEX}', 3) AS BIGINT) AS word, trim(regexp_extract(l, '{_HEX}', 4)) AS text, line_no
             FROM codelines WHERE regexp_matches(l, '{_HEX}')),
    funcs AS (SELECT file_id, min(vram) AS start, max(vram) + 4 AS "end", list(text ORDER BY vram, text) AS insns FROM code GROUP BY file_id),
    framed AS (SELECT file_id, name, CASE WHEN contains(asm, 'jal') THEN asm || '{_RETURN}' || chr(10) ELSE asm END AS text FROM listing)"""


def framed(spark: SparkSession, sf: str) -> DataFrame:
    l = listings(spark, sf)
    return l.withColumn("text", F.when(F.contains("text", F.lit("jal")), F.concat("text", F.lit(_RETURN + "\n"))).otherwise(F.col("text")))


def code(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.lines(listings(spark, sf).select(F.concat(F.col("file_id").cast("string"), F.lit(".s")).alias("path"), "text"))


def by_project(spark: SparkSession, sf: str, funcs: DataFrame) -> DataFrame:
    """Functions of listings (func is the file's id) with their project and name."""
    p = table(spark, sf, "raw_episodes").select(F.col("file_id").cast("string").alias("func"), F.coalesce(F.lower(F.trim("project")), F.lit("")).alias("project"))
    names = listings(spark, sf).select(F.col("file_id").cast("string").alias("func"), "name")
    return funcs.join(p, "func").join(names, "func")


_CANDIDATE = r"""
    insns AS (SELECT file_id, name, text, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda s: contains(s, '/*') AND contains(s, '*/') AND NOT contains(s, 'glabel')), lambda s: trim(regexp_extract(s, '.*\*/(.*)$', 1))),
              lambda s: s <> '' AND NOT regexp_matches(s, '^(\.|endlabel|nonmatching|enddlabel)')) AS body FROM framed),
    kept AS (SELECT file_id, name, text, NOT contains(text, 'Handwritten') AND (len(body) = 0 OR (contains(body[1], 'addiu') AND contains(body[1], '$sp') AND contains(body[1], '-0x')) OR len(list_filter(body, lambda s: contains(s, 'jr') AND contains(s, '$ra'))) > 0) AS candidate FROM insns)"""


@query(rf"WITH {_CODE}, {_CANDIDATE} SELECT file_id, candidate FROM kept")
def e01_candidates(spark, sf):
    """Which listings are functions of their own: not handwritten, not tiny, no fragments."""
    return framed(spark, sf).select("file_id", assembly.is_candidate("text").alias("candidate"))


@query(rf"""
    WITH {_CODE}, {_CANDIDATE},
    f AS (SELECT DISTINCT k.name, j ->> '$.segment' AS segment, 'asm/nonmatchings/' || (j ->> '$.segment') || '/' || k.name || '.s' AS asm_path FROM kept k JOIN files USING (file_id) WHERE candidate AND (j ->> '$.segment') <> '' AND k.name <> ''),
    inc AS (SELECT DISTINCT trim(function) AS name, unit || '.c' AS src_path FROM report_units WHERE coalesce(fuzzy_match_percent, 0) < 100 AND function IS NOT NULL AND unit IS NOT NULL),
    deep AS (SELECT DISTINCT src_path, regexp_extract(src_path, '^src/(.+)/[^/]+\.c$', 1) AS s FROM inc),
    cand AS (SELECT src_path, array_to_string(string_split(s, '/')[1:i], '/') AS segment FROM deep, UNNEST(range(1, len(string_split(s, '/')) + 1)) AS u(i) WHERE s <> ''),
    hit AS (SELECT f.name, f.asm_path, min(cand.src_path) AS src_path FROM f JOIN cand ON cand.segment = f.segment JOIN inc ON inc.name = f.name AND inc.src_path = cand.src_path GROUP BY ALL)
    SELECT f.name, f.asm_path, f.segment, hit.src_path FROM f LEFT JOIN hit ON f.name = hit.name AND f.asm_path = hit.asm_path WHERE hit.src_path IS NOT NULL OR f.segment NOT IN (SELECT segment FROM cand)""")
def e02_discover(spark, sf):
    """Functions still to be written: listings whose segment's sources include them, or that have no source."""
    path = F.concat(F.lit("asm/nonmatchings/"), "segment", F.lit("/"), "name", F.lit(".s"))
    l = framed(spark, sf).where("segment <> '' and name <> ''").select(path.alias("path"), "text")
    line = F.concat(F.lit('INCLUDE_ASM("asm", '), F.trim("function"), F.lit(");"))
    open_ = table(spark, sf, "report_units").where("coalesce(fuzzy_match_percent, 0) < 100 and function is not null and unit is not null")
    src = open_.groupBy(F.concat("unit", F.lit(".c")).alias("path")).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("text"))
    return assembly.discover(l, src).select("name", "asm_path", "segment", "src_path").distinct()


_T = r"\$(t\d)"


@query(rf"""
    WITH {_CODE},
    p AS (SELECT f.*, coalesce(lower(trim(raw.project)), '') AS project FROM funcs f JOIN raw USING (file_id)),
    r AS (SELECT *, len(list_filter(insns, lambda s: regexp_matches(s, '^jr\s+\$ra\b'))) AS returns,
                 coalesce(lag("end") OVER w = start, false) AS below, len(list_filter(insns[1:3], lambda s: regexp_matches(s, '^addiu\s+\$sp,\s*\$sp,\s*-'))) > 0 AS frame
          FROM p WINDOW w AS (PARTITION BY project ORDER BY start, CAST(file_id AS VARCHAR)))
    SELECT project, CAST(file_id AS VARCHAR) AS func, CAST(returns AS INT) AS returns, below, frame FROM r""")
def e03_edges(spark, sf):
    """How each function lies beside the one above it: contiguous or not, its frame, its returns."""
    f = by_project(spark, sf, assembly.functions(code(spark, sf)))
    w = Window.partitionBy("project").orderBy("start", "func")
    returns = F.size(F.filter("insns", lambda s: s.rlike(r"\Ajr\s+\$ra\b")))
    frame = F.exists(F.slice("insns", 1, 3), lambda s: s.rlike(r"\Aaddiu\s+\$sp,\s*\$sp,\s*-"))
    return f.select("project", "func", returns.alias("returns"), F.coalesce(F.lag("end").over(w) == F.col("start"), F.lit(False)).alias("below"), frame.alias("frame"))


@query()
def e04_defects(spark, sf):
    """What is wrong with the edges of functions; the rules are tested on made listings."""
    return assembly.boundary_defects(by_project(spark, sf, assembly.functions(code(spark, sf))), ["project"]).where("direction is not null")


@query(rf"""
    WITH {_CODE},
    p AS (SELECT f.file_id, f.start, l.name, array_to_string(insns, chr(10)) || chr(10) AS body, coalesce(lower(trim(raw.project)), '') AS project FROM funcs f JOIN raw USING (file_id) JOIN listing l USING (file_id)),
    n AS (SELECT *, lead(body) OVER w AS next, lead(file_id) OVER w AS of FROM p WINDOW w AS (PARTITION BY project ORDER BY start, CAST(file_id AS VARCHAR))),
    called AS (SELECT DISTINCT regexp_extract(text, '^jal\s+(\w+)', 1) AS name FROM code)
    SELECT project, CAST(file_id AS VARCHAR) AS func, name, CAST(of AS VARCHAR) AS of FROM n WHERE starts_with(next, body) AND name IS NOT NULL AND name NOT IN (SELECT name FROM called) OR starts_with(next, body) AND name IS NULL""")
def e05_prefix_orphans(spark, sf):
    """Functions that only repeat the beginning of the next one, and that nothing calls."""
    c = code(spark, sf)
    calls = c.select(F.regexp_extract("text", r"\Ajal\s+(\w+)", 1).alias("callee"))
    return assembly.prefix_orphans(by_project(spark, sf, assembly.functions(c)), calls, ["project"])


@query(rf"""
    WITH {_CODE},
    good AS (SELECT DISTINCT vram FROM (SELECT vram, text, lag(text) OVER (PARTITION BY file_id ORDER BY vram, line_no) AS before FROM code) WHERE regexp_matches(text, '^(addiu|lui|lw)\b') AND (before IS NULL OR regexp_matches(before, '^(nop|jr)\b'))),
    labels AS (SELECT DISTINCT name, CAST('0x' || nullif(regexp_extract(name, '^func_([0-9A-Fa-f]{{8}})$', 1), '') AS BIGINT) AS place FROM listing)
    SELECT name, place FROM labels WHERE place IN (SELECT vram FROM good)
    UNION SELECT CAST(file_id AS VARCHAR), start FROM funcs WHERE start IN (SELECT vram FROM good)""")
def e06_valid_labels(spark, sf):
    """Names and starts that land on an instruction which can open a function."""
    c = code(spark, sf)
    names = listings(spark, sf).select("name", T.hex_number(F.regexp_extract("name", r"\Afunc_([0-9A-Fa-f]{8})\z", 1)).alias("at"))
    starts = c.groupBy("func").agg(F.min("vram").alias("at")).select(F.col("func").alias("name"), "at")
    labels = names.where("at is not null").unionByName(starts).distinct()
    return assembly.valid_labels(labels, c, r"\A(?:addiu|lui|lw)\b", r"\A(?:nop|jr)\b").select("name", F.col("at").alias("place"))


@query(rf"""
    WITH {_CODE}, calls AS (SELECT file_id, vram, (word & 67108863) * 4 AS low FROM code WHERE (word >> 26) = 3),
    starts AS (SELECT DISTINCT start, CAST(min(file_id) OVER (PARTITION BY start) AS VARCHAR) AS func FROM funcs)
    SELECT CAST(file_id AS VARCHAR) AS func, vram, low + 2147483648 AS target, CASE WHEN low = 0 THEN 'placeholder' WHEN starts.func IS NOT NULL THEN 'function' ELSE 'inside' END AS kind,
           CASE WHEN low = 0 THEN NULL WHEN starts.func IS NOT NULL THEN starts.func ELSE printf('at_%08X', low + 2147483648) END AS symbol
    FROM calls LEFT JOIN starts ON starts.start = low + 2147483648""")
def e07_resolve(spark, sf):
    """Encoded calls: to nothing yet, to a function, or into the middle of something."""
    c = code(spark, sf)
    starts = c.groupBy("func").agg(F.min("vram").alias("start")).groupBy("start").agg(F.min(F.col("func").cast("bigint")).cast("string").alias("func"))
    return assembly.resolve_targets(c, starts)


@query(rf"""
    WITH {_CODE}, w AS (SELECT file_id, word >> 24 AS op, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS i FROM code),
    s AS (SELECT 4 AS stride, file_id, op FROM w UNION ALL SELECT 8, file_id, op FROM w WHERE i % 2 = 0)
    SELECT stride, file_id, count(*) AS words, count(*) FILTER (op IN (0, 36, 39, 140, 172, 175)) / count(*) > 0.02 AS loads, count(*) FILTER (op IN (12, 3, 8)) / count(*) > 0.01 AS jumps FROM s GROUP BY ALL""")
def e08_opcode_shares(spark, sf):
    """Of each listing's words, at every word and every second one, whether two families of leading bytes pass their shares."""
    w = code(spark, sf).select(F.col("func").cast("bigint").alias("file_id"), F.shiftrightunsigned("word", 24).alias("op"), (F.row_number().over(Window.partitionBy("func").orderBy("line_no")) - 1).alias("i"))
    both = w.select(F.explode(F.when(F.col("i") % 2 == 0, F.array(F.lit(4), F.lit(8))).otherwise(F.array(F.lit(4)))).alias("stride"), "file_id", "op")
    part = lambda ops: F.count_if(F.col("op").isin(*ops)) / F.count("*")
    return both.groupBy("stride", "file_id").agg(F.count("*").alias("words"), (part((0, 36, 39, 140, 172, 175)) > 0.02).alias("loads"), (part((12, 3, 8)) > 0.01).alias("jumps"))


# --- parity ------------------------------------------------------------------------------

_BOTH = rf"""{_RAW},
    one AS (SELECT l.*, lower(trim(raw.project)) AS project, row_number() OVER (PARTITION BY lower(trim(raw.project)), name ORDER BY file_id) AS rn FROM listing l JOIN raw USING (file_id) WHERE name IS NOT NULL AND raw.project IS NOT NULL),
    two AS (SELECT record_id, lower(trim(project)) AS project, function_name AS name, assembly, row_number() OVER (PARTITION BY lower(trim(project)), function_name ORDER BY record_id) AS rn FROM export_records WHERE assembly IS NOT NULL AND project IS NOT NULL AND function_name IS NOT NULL)"""


def _pair(spark, sf):
    """The first listing of each project and function among the raw files, and among the records."""
    p = table(spark, sf, "raw_episodes").select("file_id", F.lower(F.trim("project")).alias("project"))
    a = listings(spark, sf).join(p, "file_id").where("name is not null and project is not null").groupBy("project", "name").agg(F.min_by("text", "file_id").alias("text"))
    r = table(spark, sf, "export_records").where("assembly is not null and project is not null and function_name is not null")
    b = r.groupBy(F.lower(F.trim("project")).alias("project"), F.col("function_name").alias("name")).agg(F.min_by("assembly", "record_id").alias("text"))
    return a, b


@query(rf"""
    WITH {_BOTH}, n AS (SELECT project, name, len(list_filter(string_split(asm, chr(10)), lambda s: contains(s, '/*') AND contains(s, '*/'))) AS c FROM one WHERE rn = 1),
    m AS (SELECT project, name, len(list_filter(string_split(assembly, chr(10)), lambda s: contains(s, '/*') AND contains(s, '*/'))) AS c FROM two WHERE rn = 1)
    SELECT project, name, m.c AS built, n.c AS expected, m.c = n.c AS same FROM m JOIN n USING (project, name)""")
def e10_count_parity(spark, sf):
    """Instruction counts of the same function on both sides."""
    a, b = _pair(spark, sf)
    n = lambda d: d.select("project", "name", T.instruction_count_words("text").alias("n"))
    return parity.count_parity(n(b), n(a), ["project", "name"], "n")


@query(r"""
    SELECT record_id, CAST(len(regexp_extract_all(assembly, '\bjal\s')) AS INT) AS encoded, CAST(len(regexp_extract_all(target_c, '\b(func_[0-9A-Fa-f]{8})\s*\(')) AS INT) AS written,
           len(regexp_extract_all(assembly, '\bjal\s')) = len(regexp_extract_all(target_c, '\b(func_[0-9A-Fa-f]{8})\s*\(')) AS same FROM export_records WHERE assembly IS NOT NULL AND target_c IS NOT NULL""")
def e11_call_parity(spark, sf):
    """Calls in a record's assembly against calls in its C."""
    a, b = F.regexp_count("assembly", F.lit(r"\bjal\s")), F.regexp_count("target_c", F.lit(r"\bfunc_[0-9A-Fa-f]{8}\s*\("))
    return table(spark, sf, "export_records").where("assembly is not null and target_c is not null").select("record_id", a.alias("encoded"), b.alias("written"), (a == b).alias("same"))


@query("""
    WITH u AS (SELECT *, row_number() OVER (PARTITION BY project, unit, function ORDER BY measured_at DESC, coalesce(fuzzy_match_percent, -1) DESC, size DESC) AS rn FROM report_units),
    a AS (SELECT lower(trim(project)) AS project, CAST(sum(size) AS BIGINT) AS built FROM u WHERE rn = 1 AND project IS NOT NULL GROUP BY 1),
    e AS (SELECT lower(trim(project)) AS project, CAST(sum(instruction_count * 4) AS BIGINT) AS expected FROM export_records WHERE project IS NOT NULL AND instruction_count IS NOT NULL GROUP BY 1)
    SELECT project, coalesce(built, 0) AS built, coalesce(expected, 0) AS expected, coalesce(built, 0) - coalesce(expected, 0) AS residual FROM a FULL JOIN e USING (project)""")
def e12_size_residual(spark, sf):
    """The code that the report has of each project less that of its records."""
    from .report import latest_units

    built = latest_units(table(spark, sf, "report_units")).where("project is not null").select(F.lower(F.trim("project")).alias("project"), "size")
    wanted = table(spark, sf, "export_records").where("project is not null and instruction_count is not null").select(F.lower(F.trim("project")).alias("project"), (F.col("instruction_count") * 4).alias("size"))
    return parity.size_residual(built, wanted, "project", "size")


@query(r"""
    SELECT lower(trim(project)) AS project, count(*) AS rows, count(*) FILTER (contains(final_source, 'INCLUDE_ASM')) AS includes, count(*) FILTER (regexp_matches(final_source, '\)\s*\{')) AS bodies,
           coalesce(bool_and(md5(target_c) = md5(final_source)), false) AS all_same, coalesce(bool_and(md5(target_c) = md5(final_source)), false) AND count(*) FILTER (contains(final_source, 'INCLUDE_ASM')) > 0 AND count(*) FILTER (regexp_matches(final_source, '\)\s*\{')) = 0 AS contaminated
    FROM export_records GROUP BY 1""")
def e13_contaminated(spark, sf):
    r = table(spark, sf, "export_records").withColumn("project", F.lower(F.trim("project")))
    return parity.contaminated(r, ["project"], F.md5("target_c") == F.md5("final_source"), F.contains("final_source", F.lit("INCLUDE_ASM")), F.col("final_source").rlike(r"\)\s*\{"))


@query("SELECT project, function, count(DISTINCT unit) AS places, count(DISTINCT unit) = 1 AS together FROM report_units WHERE unit IS NOT NULL GROUP BY project, function")
def e14_co_located(spark, sf):
    return parity.co_located(table(spark, sf, "report_units"), ["project", "function"], "unit")


@query("""
    SELECT DISTINCT lower(trim(e.project)) AS project, lower(trim(e.function_name)) AS name FROM episodes e WHERE lower(trim(outcome)) = 'match'
        AND EXISTS (SELECT 1 FROM report_units u WHERE lower(trim(u.project)) = lower(trim(e.project)) AND lower(trim(u.function)) = lower(trim(e.function_name)) AND coalesce(u.fuzzy_match_percent, 0) < 100)""")
def e15_undone(spark, sf):
    """Functions that an episode has solved and that the report has as unsolved."""
    norm = lambda c, to: F.lower(F.trim(c)).alias(to)
    log = table(spark, sf, "episodes").where(F.lower(F.trim("outcome")) == "match").select(norm("project", "project"), norm("function_name", "name"))
    now = table(spark, sf, "report_units").where("coalesce(fuzzy_match_percent, 0) < 100").select(norm("project", "project"), norm("function", "name"))
    return parity.undone(log, now, ["project", "name"])


@query(rf"""
    WITH {_BOTH}, x AS (SELECT project, name, regexp_extract_all(asm, '/\*\s*[0-9A-Fa-f]+\s+[0-9A-Fa-f]{{8}}\s+([0-9A-Fa-f]{{8}})\s*\*/', 1) AS w FROM one WHERE rn = 1),
    y AS (SELECT project, name, regexp_extract_all(assembly, '/\*\s*[0-9A-Fa-f]+\s+[0-9A-Fa-f]{{8}}\s+([0-9A-Fa-f]{{8}})\s*\*/', 1) AS w FROM two WHERE rn = 1),
    z AS (SELECT project, name, x.w AS a, y.w AS b, greatest(len(x.w), len(y.w)) AS n FROM x JOIN y USING (project, name))
    SELECT project, name, CAST(n AS INT) AS words, CAST(len(list_filter(range(1, n + 1), lambda i: a[i] IS DISTINCT FROM b[i])) AS INT) AS differ,
           round(CASE WHEN n = 0 THEN 0.0 ELSE (1 - len(list_filter(range(1, n + 1), lambda i: a[i] IS DISTINCT FROM b[i])) / n) * 100 END, 6) AS ratio FROM z""")
def e16_word_ratio(spark, sf):
    """Words of the same function compared by position; those beyond the shorter side differ."""
    a, b = _pair(spark, sf)
    words = F.regexp_extract_all("text", F.lit(r"/\*\s*[0-9A-Fa-f]+\s+[0-9A-Fa-f]{8}\s+([0-9A-Fa-f]{8})\s*\*/"), F.lit(1))
    j = a.select("project", "name", words.alias("a")).join(b.select("project", "name", words.alias("b")), ["project", "name"])
    differ = F.size(F.filter(F.zip_with("a", "b", lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    n = F.greatest(F.size("a"), F.size("b"))
    return j.select("project", "name", n.alias("words"), differ.alias("differ"), F.round(T.percent_of(n - differ, n), 6).alias("ratio"))


# --- hygiene and search ------------------------------------------------------------------


@query(r"""
    SELECT lower(trim(project)) AS project, count(*) FILTER (contains(final_source, '#ifdef NON_MATCHING')) AS wrapped, count(*) FILTER (regexp_matches(final_source, '#ifdef NON_MATCHING[^#]*#ifdef NON_MATCHING')) AS stacked FROM export_records GROUP BY 1""")
def e20_stacked_wraps(spark, sf):
    """Sources with a wrapped block, and those with a wrap directly inside another."""
    wrap = "#ifdef NON_MATCHING"
    return table(spark, sf, "export_records").groupBy(F.lower(F.trim("project")).alias("project")).agg(
        F.count_if(F.contains("final_source", F.lit(wrap))).alias("wrapped"), F.count_if(F.col("final_source").rlike(f"{wrap}[^#]*{wrap}")).alias("stacked")
    )


@query(r"""
    SELECT lower(trim(source)) AS source, count(*) AS lacking, count(*) > 10 AS alert FROM documents WHERE NOT regexp_matches(text, '(^|\n)_[^_\n]+_(\n|$)') GROUP BY 1""")
def e21_lacking_line(spark, sf):
    """Texts without a line of a stated form, with an alert where there are more than ten."""
    d = table(spark, sf, "documents").where(~F.col("text").rlike(r"(?:\A|\n)_[^_\n]+_(?:\n|\z)"))
    return d.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("lacking")).withColumn("alert", F.col("lacking") > 10)


_MODES = [("symbol", "episodes", "episode_id", "final_source", r"\bfunc_80[0-9A-F]{2}00[0-9A-F]{2}\b"), ("extern", "export_records", "record_id", "target_c", r"^extern +s16\b"), ("asm", "export_records", "record_id", "assembly", r"\bjal +func_80[0-9]")]


@query(" UNION ALL ".join(rf"""SELECT * FROM (SELECT '{m}' AS mode, {k} AS id, i AS line_no, l AS line FROM (SELECT {k}, string_split(replace({c}, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM {t} WHERE {c} IS NOT NULL), UNNEST(ls) WITH ORDINALITY AS u(l, i)
    WHERE regexp_matches(l, '{p}') ORDER BY id, line_no LIMIT 20)""" for m, t, k, c, p in _MODES))
def e22_search_lines(spark, sf):
    """Three modes of search with the lines found, the first 20 of each."""
    out = None
    for mode, name, key, text, pattern in _MODES:
        found = table(spark, sf, name).select(F.lit(mode).alias("mode"), F.col(key).alias("id"), F.explode(T.hits(text, pattern)).alias("h")).select("mode", "id", F.col("h.line_no").cast("bigint").alias("line_no"), "h.line")
        found = found.orderBy("id", "line_no").limit(20)
        out = found if out is None else out.unionByName(found)
    return out


@query("""
    WITH n AS (SELECT DISTINCT trim(function) AS needle FROM report_units WHERE trim(function) <> '' UNION SELECT DISTINCT dir_name FROM segments WHERE dir_name <> '')
    SELECT needle, count(*) AS docs, min(doc_id) AS first_doc FROM n JOIN documents ON contains(text, needle) GROUP BY needle""")
def e23_contains(spark, sf):
    """Functions and segments that documents mention, as parts of words too."""
    n = table(spark, sf, "report_units").select(F.trim("function").alias("needle")).union(table(spark, sf, "segments").select("dir_name")).where("needle <> ''").distinct()
    j = relational.contains_join(n, table(spark, sf, "documents").select("doc_id", "text"), "needle", "text")
    return j.groupBy("needle").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("""
    SELECT doc_id, trim(regexp_extract(e, '^([^\n]*)', 1)) AS title, nullif(regexp_extract(b, '^\n*_([^_\n]+)_[ ]*(\n|$)', 1), '') AS summary,
           replace(regexp_replace(lower(trim(regexp_extract(e, '^([^\n]*)', 1))), '[^a-z0-9 -]', '', 'g'), ' ', '-') AS anchor, CAST(length(b) AS INT) AS chars
    FROM (SELECT doc_id, e, CASE WHEN contains(e, chr(10)) THEN substr(e, strpos(e, chr(10)) + 1) ELSE '' END AS b FROM (SELECT doc_id, unnest(string_split(chr(10) || text, chr(10) || '## ')[2:]) AS e FROM documents))""")
def e24_entries(spark, sf):
    """The entries of the documents, with summary and anchor."""
    e = table(spark, sf, "documents").where(F.contains("text", F.lit("## "))).select("doc_id", F.explode(T.entries("text")).alias("e"))
    return e.select("doc_id", "e.*")


@query(r"""
    WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_]\w*: [0-9.]+% -> [0-9.]+%')) AS s FROM documents),
    p AS (SELECT doc_id, regexp_extract(s, '^(\w+)', 1) AS name, TRY_CAST(regexp_extract(s, ': ([0-9.]+)%', 1) AS DOUBLE) AS was, TRY_CAST(regexp_extract(s, '-> ([0-9.]+)%', 1) AS DOUBLE) AS said FROM d),
    u AS (SELECT function AS name, max(fuzzy_match_percent) AS measured FROM report_units WHERE fuzzy_match_percent IS NOT NULL GROUP BY 1)
    SELECT doc_id, name, said, measured, round(said - coalesce(measured, was), 6) AS off, abs(said - coalesce(measured, was)) > 5 AS stale FROM p LEFT JOIN u USING (name)""")
def e25_stale(spark, sf):
    """Percentages that documents state against those measured (or else those stated before), stale beyond five points."""
    s = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*: [0-9.]+% -> [0-9.]+%"), F.lit(0)))
    d = table(spark, sf, "documents").where(F.contains("text", F.lit("% -> "))).select("doc_id", s.alias("s"))
    n = lambda p: F.nullif(F.regexp_extract("s", p, 1), F.lit("")).try_cast("double")
    p = d.select("doc_id", F.regexp_extract("s", r"\A(\w+)", 1).alias("name"), n(r": ([0-9.]+)%").alias("was"), n(r"-> ([0-9.]+)%").alias("said"))
    u = table(spark, sf, "report_units").where("fuzzy_match_percent is not null").groupBy(F.col("function").alias("name")).agg(F.max("fuzzy_match_percent").alias("measured"))
    off = F.col("said") - F.coalesce("measured", "was")
    return p.join(u, "name", "left").select("doc_id", "name", "said", "measured", F.round(off, 6).alias("off"), (F.abs(off) > 5).alias("stale"))


# --- scalars -----------------------------------------------------------------------------


@query("SELECT doc_id, sha1(text) AS digest FROM documents WHERE text IS NOT NULL")
def e30_sha1(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha1("text").alias("digest"))


_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"


@query(rf"""
    WITH t AS (SELECT episode_id, CASE WHEN regexp_matches(trim(start_time), '{_ISO}') THEN TRY_CAST(CASE WHEN regexp_matches(trim(start_time), '(Z|[+-]\d{{2}}:\d{{2}})$') THEN trim(start_time) ELSE trim(start_time) || '+00:00' END AS TIMESTAMPTZ) END AS a,
                      CASE WHEN regexp_matches(trim(end_time), '{_ISO}') THEN TRY_CAST(CASE WHEN regexp_matches(trim(end_time), '(Z|[+-]\d{{2}}:\d{{2}})$') THEN trim(end_time) ELSE trim(end_time) || '+00:00' END AS TIMESTAMPTZ) END AS b FROM episodes)
    SELECT episode_id, strftime(make_timestamp(epoch_us(a)), '%Y%m%d_%H%M%S') AS stamp, CAST(floor((epoch_us(b) - epoch_us(a)) / 1000.0) AS BIGINT) AS elapsed_ms FROM t""")
def e31_times(spark, sf):
    """The stamp of an episode's start, and how long it took."""
    a, b = T.time_of("start_time"), T.time_of("end_time")
    return table(spark, sf, "episodes").select("episode_id", T.stamp(a).alias("stamp"), T.elapsed_ms(a, b).alias("elapsed_ms"))


@query("""
    WITH p AS (SELECT p_partkey, p_brand, CAST(floor(floor(log2(p_size)) * p_size / p_retailprice * 10000 * 2) AS BIGINT) AS priority FROM part WHERE p_size > 0 AND p_retailprice > 0)
    SELECT p_partkey, p_brand, priority, row_number() OVER (PARTITION BY p_brand ORDER BY priority DESC, p_partkey) AS place FROM p""")
def e32_priority(spark, sf):
    """Things by priority within their group, ties by id."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", T.register_priority("p_size", "p_retailprice", F.lit(2)).alias("priority")).where("priority is not null")
    return p.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("priority"), "p_partkey")))


@query("""
    WITH RECURSIVE c AS (SELECT DISTINCT 'r' || n_regionkey AS caller, 'n' || n_nationkey AS callee FROM nation UNION SELECT DISTINCT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
    w AS (SELECT DISTINCT caller AS node, 0 AS depth, [caller] AS path FROM c WHERE caller NOT IN (SELECT callee FROM c) UNION ALL SELECT callee, depth + 1, list_append(path, callee) FROM w JOIN c ON node = caller WHERE depth < 8 AND NOT list_contains(path, callee)),
    f AS (SELECT node, first(depth ORDER BY path) AS depth, min(path) AS path FROM w GROUP BY node)
    SELECT node, depth, array_to_string(path, '/') AS way, row_number() OVER (ORDER BY path) AS place FROM f""")
def e33_depth_first(spark, sf):
    """A graph of regions, nations and suppliers in depth-first order."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("caller"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("callee"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("caller"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("callee"))
    e = n.unionByName(s).distinct()
    roots = e.select(F.col("caller").alias("node")).distinct().join(e.select(F.col("callee").alias("node")), "node", "left_anti")
    d = assembly.depth_first(e, roots)
    return d.select("node", "depth", F.array_join("path", "/").alias("way"), F.row_number().over(Window.orderBy("path")).cast("bigint").alias("place"))  # places of one printed list


@query("""
    SELECT project, function, unit FROM (SELECT DISTINCT project, function, unit, row_number() OVER (PARTITION BY project ORDER BY md5('pick:' || function || '/' || unit), function, unit) AS rn
        FROM (SELECT DISTINCT project, function, unit FROM report_units WHERE function IS NOT NULL AND unit IS NOT NULL)) WHERE rn <= 5""")
def e34_pick(spark, sf):
    """Five functions of each project at random, by a seeded hash, so that the choice can be repeated."""
    u = table(spark, sf, "report_units").where("function is not null and unit is not null").select("project", "function", "unit").distinct()
    w = Window.partitionBy("project").orderBy(F.md5(F.concat(F.lit("pick:"), "function", F.lit("/"), "unit")), "function", "unit")
    return u.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@query("""
    WITH f AS (SELECT DISTINCT project, unit, function FROM report_units WHERE function IS NOT NULL AND unit IS NOT NULL AND project IS NOT NULL),
    p AS (SELECT a.project, a.unit, a.function, b.function AS near, row_number() OVER (PARTITION BY a.project, a.unit, a.function ORDER BY b.function) AS place FROM f a JOIN f b ON a.project = b.project AND a.unit = b.unit AND a.function <> b.function)
    SELECT project, unit, function, near, place FROM p WHERE place <= 5""")
def e35_nearby(spark, sf):
    """The first five other functions of the same file: each function meets the first six of its file, however many there are."""
    f = table(spark, sf, "report_units").where("function is not null and unit is not null and project is not null").select("project", "unit", "function").distinct()
    six = relational.first_of(f, ["project", "unit"], "function", 6)
    near = F.filter("firsts", lambda x: x != F.col("function"))
    return f.join(six, ["project", "unit"]).select("project", "unit", "function", F.posexplode(F.slice(near, 1, 5)).alias("i", "near")).select("project", "unit", "function", "near", (F.col("i") + 1).cast("bigint").alias("place"))


@query(rf"""
    WITH {_CODE} SELECT CAST(file_id AS VARCHAR) AS func, vram, word & 4294901760 AS masked, (word & 67108863) * 4 AS target, printf('at_%08X', (word & 67108863) * 4) AS symbol FROM code""")
def e36_words(spark, sf):
    """Each word without its immediate, and the call it would encode."""
    return code(spark, sf).select("func", "vram", T.without_immediate("word").alias("masked"), T.call_target("word").alias("target"), T.absolute_symbol(T.call_target("word"), "at_").alias("symbol"))


@query("""
    WITH s AS (SELECT episode_id, i AS step_ord, steps[i].tool_calls AS calls FROM episodes, UNNEST(range(1, len(steps) + 1)) AS u(i)),
    c AS (SELECT episode_id, step_ord, j AS call_ord, calls[j].input AS input, calls[j].output AS output FROM s, UNNEST(range(1, len(calls) + 1)) AS v(j))
    SELECT episode_id, CAST(step_ord AS INT) AS step_ord, CAST(call_ord AS INT) AS call_ord, CASE WHEN length(input) > 50 THEN substr(input, 1, 50) || '...' ELSE input END AS input, right(output, 20) AS tail, left(output, 30) AS head FROM c""")
def e37_summaries(spark, sf):
    """Each call's input and output as they are shown: shortened."""
    s = table(spark, sf, "episodes").select("episode_id", F.posexplode("steps").alias("i", "s")).select("episode_id", (F.col("i") + 1).alias("step_ord"), F.posexplode("s.tool_calls").alias("j", "c"))
    return s.select("episode_id", "step_ord", (F.col("j") + 1).alias("call_ord"), T.shorten(F.col("c.input"), 50).alias("input"), T.tail(F.col("c.output"), 20).alias("tail"), T.head(F.col("c.output"), 30).alias("head"))


@query(r"""
    SELECT doc_id, regexp_replace(list_last(string_split(path, '/')), '(.)\.[^.]*$', '\1') AS stem, coalesce(nullif(lower(trim(regexp_replace(trim(site), '[^\p{L}\p{N}]', '_', 'g'), '_')), ''), 'game') AS name FROM documents""")
def e38_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.stem("path").alias("stem"), T.base_name("site").alias("name"))


@query(rf"""
    WITH {_RAW}, s AS (SELECT file_id, unnest(regexp_extract_all(asm, '\bD_[0-9A-Fa-f]{{8}}\b|\bfunc_[0-9A-Fa-f]{{8}}\b')) AS symbol FROM listing)
    SELECT symbol, array_to_string(list_sort(list(DISTINCT file_id)), ',') AS files, count(DISTINCT file_id) AS n FROM s GROUP BY symbol""")
def e39_where_used(spark, sf):
    """Each symbol with the files whose listings name it."""
    s = listings(spark, sf).select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\bD_[0-9A-Fa-f]{8}\b|\bfunc_[0-9A-Fa-f]{8}\b"), F.lit(0)))).alias("symbol"))
    return s.groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_set("file_id")), lambda x: x.cast("string")), ",").alias("files"), F.count("*").alias("n"))


# --- validation --------------------------------------------------------------------------

_KIND = "CASE json_type({}) WHEN 'NULL' THEN 'NoneType' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END"


def _rules(rules: dict, json: str, label: str, missing: str, dot: str) -> str:
    """SQL of a list of the errors of one object under a table of rules."""
    gone = "list_filter([" + ", ".join(f"CASE WHEN NOT json_exists({json}, '$.{k}') THEN {label} || '{missing} ''{k}''' END" for k in sorted(rules)) + "], lambda x: x IS NOT NULL)"
    checks = []
    for k, (kind, null) in rules.items():
        at = f"json_extract({json}, '$.{k}')"
        t = _KIND.format(at)
        ok = {"number": f"{t} IN ('int', 'float')", "int": f"{t} IN ('int', 'bool')"}.get(kind, f"{t} = '{kind}'")
        said = "'expected int or float'" if kind == "number" else f"'expected {kind}, got ' || {t}"
        checks.append(f"CASE WHEN NOT ({ok}{f' OR {t} = ' + chr(39) + 'NoneType' + chr(39) if null else ''}) THEN {dot} || '{k}: ' || {said} END")
    return f"CASE WHEN len({gone}) > 0 THEN {gone} ELSE list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL) END"


_LACKS = lambda rules, json: " OR ".join(f"NOT json_exists({json}, '$.{k}')" for k in rules)


@query(rf"""
    WITH {_RAW}, o AS (SELECT file_id, j, {_rules(quality.TOP, "j", "''", "missing top-level key", "''")} AS errors, {_LACKS(quality.TOP, "j")} AS stopped FROM files),
    s AS (SELECT file_id, i - 1 AS i, json_extract(j, '$.steps[' || CAST(i - 1 AS VARCHAR) || ']') AS v FROM o, UNNEST(range(1, coalesce(CAST(json_array_length(j, '$.steps') AS BIGINT), 0) + 1)) AS u(i) WHERE NOT stopped AND json_type(j, '$.steps') = 'ARRAY'),
    q AS (SELECT file_id, i, v, CASE WHEN json_type(v) <> 'OBJECT' THEN ['steps[' || CAST(i AS VARCHAR) || ']: expected object, got ' || {_KIND.format("v")}] ELSE {_rules(quality.STEP, "v", "'steps[' || CAST(i AS VARCHAR) || ']: '", "missing key", "'steps[' || CAST(i AS VARCHAR) || '].'")} END AS errors FROM s),
    c AS (SELECT file_id, i, k - 1 AS k, json_extract(v, '$.tool_calls[' || CAST(k - 1 AS VARCHAR) || ']') AS v FROM q, UNNEST(range(1, coalesce(CAST(json_array_length(v, '$.tool_calls') AS BIGINT), 0) + 1)) AS u(k) WHERE json_type(v) = 'OBJECT' AND NOT ({_LACKS(quality.STEP, "v")}) AND json_type(v, '$.tool_calls') = 'ARRAY'),
    d AS (SELECT file_id, CASE WHEN json_type(v) <> 'OBJECT' THEN ['steps[' || CAST(i AS VARCHAR) || '].tool_calls[' || CAST(k AS VARCHAR) || ']: expected object, got ' || {_KIND.format("v")}] ELSE {_rules(quality.CALL, "v", "'steps[' || CAST(i AS VARCHAR) || '].tool_calls[' || CAST(k AS VARCHAR) || ']: '", "missing key", "'steps[' || CAST(i AS VARCHAR) || '].tool_calls[' || CAST(k AS VARCHAR) || '].'")} END AS errors FROM c),
    more AS (SELECT file_id, 'metadata: expected dict when present' AS error FROM o WHERE NOT stopped AND json_exists(j, '$.metadata') AND json_type(j, '$.metadata') <> 'OBJECT'
             UNION ALL SELECT file_id, 'outcome: unknown' FROM o WHERE NOT stopped AND NOT coalesce(json_type(j, '$.outcome') = 'VARCHAR' AND (j ->> '$.outcome') IN ('failed', 'incomplete', 'match', 'partial'), false)
             UNION ALL SELECT file_id, CASE WHEN body IS NULL THEN 'failed to read file' WHEN j IS NULL THEN 'invalid JSON' ELSE 'expected object, got ' || {_KIND.format("j")} END FROM (SELECT raw.*, e.body FROM raw JOIN raw_episodes e USING (file_id)) WHERE j IS NULL OR json_type(j) <> 'OBJECT')
    SELECT file_id, error FROM (SELECT file_id, unnest(errors) AS error FROM o UNION ALL SELECT file_id, unnest(errors) FROM q UNION ALL SELECT file_id, unnest(errors) FROM d UNION ALL FROM more)""")
def e40_errors(spark, sf):
    """Each error of each file as an episode, a row each."""
    v = quality.validate(table(spark, sf, "raw_episodes")).select("file_id", F.explode("errors").alias("error"))
    return v.withColumn("error", F.when(F.startswith("error", F.lit("outcome: expected one of")), "outcome: unknown").otherwise(F.col("error")))


@query(rf"""
    WITH {_RAW}, o AS (SELECT file_id, j, json_extract(j, '$.steps[' || CAST(coalesce(CAST(json_array_length(j, '$.steps') AS BIGINT), 0) - 1 AS VARCHAR) || ']') AS last FROM files WHERE NOT ({_LACKS(quality.TOP, "j")}))
    SELECT file_id, coalesce((j ->> '$.outcome') = 'match' AND json_type(j, '$.outcome') = 'VARCHAR', false) AND coalesce(json_type(j, '$.final_match_percent') NOT IN ('VARCHAR', 'BOOLEAN') AND TRY_CAST(j ->> '$.final_match_percent' AS DOUBLE) = 100, false)
        AND coalesce(json_type(j, '$.best_match_percent') NOT IN ('VARCHAR', 'BOOLEAN') AND TRY_CAST(j ->> '$.best_match_percent' AS DOUBLE) = 100, false) AND json_type(j, '$.steps') = 'ARRAY' AND coalesce(json_type(last, '$.compiled') = 'BOOLEAN' AND (last ->> '$.compiled') = 'true', false)
        AND coalesce(json_type(last, '$.match_percent') NOT IN ('VARCHAR', 'BOOLEAN') AND TRY_CAST(last ->> '$.match_percent' AS DOUBLE) = 100, false) AND coalesce(json_type(j, '$.final_source') NOT IN ('NULL') AND (j ->> '$.final_source') NOT IN ('', '0', 'false', '[]', '{{}}'), false) AS exact FROM o""")
def e41_require_match(spark, sf):
    """Of the files with all keys, those that pass as exact matches."""
    rules = ("outcome: expected 'match'", "final_match_percent: expected 100.0", "best_match_percent: expected 100.0", "steps: expected at least one step", "steps[-1]", "final_source: expected non-empty")
    v = quality.validate(table(spark, sf, "raw_episodes"), require_match=True)
    whole = ~F.exists("errors", lambda e: e.startswith("missing top-level") | e.startswith("expected object") | e.isin("invalid JSON", "failed to read file"))
    failed = F.exists("errors", lambda e: F.lit(False) if not rules else _any([e.startswith(r) for r in rules]))
    return v.where(whole).select("file_id", (~failed).alias("exact"))


def _any(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


@query(rf"""
    WITH {_RAW}, bad AS (SELECT file_id FROM raw WHERE j IS NULL OR json_type(j) <> 'OBJECT' OR {_LACKS(quality.TOP, "j")})
    SELECT count(*) > 0 AS failed, CAST(count(*) > 0 AS INT) AS exit_code FROM bad""")
def e42_exit_code(spark, sf):
    """What a run over all files ends with: 1 if any file has an error."""
    return quality.summary(quality.validate(table(spark, sf, "raw_episodes"))).select("failed", "exit_code")


@query(f"""
    SELECT file_id, n IS NULL AS ok, coalesce(n, 0) AS errors FROM raw_episodes LEFT JOIN (SELECT file_id, count(*) AS n FROM ({SQL["e40_errors"]}) GROUP BY 1) USING (file_id)""")
def d08_validate(spark, sf):
    """Every file, whether it is a valid episode, and how many errors it has."""
    v = quality.validate(table(spark, sf, "raw_episodes"))
    return v.select("file_id", "ok", F.size("errors").cast("bigint").alias("errors"))

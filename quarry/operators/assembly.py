"""Assembly listings: discovery of functions, lines with their words, and defects at their boundaries.

Listings are rows (path, text); sources are rows (path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def size_of(text: str | Column) -> Column:
    """The size that the first ``nonmatching NAME, SIZE`` states, or null."""
    said = F.nullif(F.regexp_extract(T.col(text), r"nonmatching\s+\S+,\s+(0x[0-9A-Fa-f]+|\d+)", 1), F.lit(""))
    return F.when(said.startswith("0x"), T.hex_number(said)).otherwise(said.try_cast("bigint"))


def is_candidate(text: str | Column) -> Column:
    """Not handwritten, not stated to be 8 bytes or less, and no fragment: a fragment neither opens a frame in
    its first instruction nor returns anywhere. A listing without instructions is kept."""
    t = T.col(text)
    body = T.instructions(t)
    first = F.try_element_at(body, F.lit(1))
    opens = first.contains("addiu") & first.contains("$sp") & first.contains("-0x")
    returns = F.exists(body, lambda s: s.contains("jr") & s.contains("$ra"))
    return ~t.contains("Handwritten") & F.coalesce(size_of(t) > 8, F.lit(True)) & ((F.size(body) == 0) | opens | returns)


def included(sources: DataFrame) -> DataFrame:
    """(name, src_path): the names that INCLUDE_ASM lines of each source state."""
    name = lambda s: F.regexp_extract(s, r",\s*([A-Za-z_]\w*)\)", 1)
    lines = F.filter(T.split_lines("text"), lambda s: s.contains("INCLUDE_ASM("))
    return sources.select("path", F.explode(F.transform(lines, name)).alias("name")).where("name <> ''").select("name", F.col("path").alias("src_path")).distinct()


def discover(listings: DataFrame, sources: DataFrame, asm_root: str = "asm/nonmatchings/", src_root: str = "src/") -> DataFrame:
    """(name, asm_path, segment, src_path, instruction_count) of functions still to be decompiled.

    A function's candidate sources are src/<segment>.c, else the files below src/<segment>/. It is kept with
    the first candidate that includes it, kept without one if there is no candidate, and dropped
    if there are candidates but none includes it: it has been decompiled."""
    f = listings.where(is_candidate("text")).select(
        T.stem("path").alias("name"), F.col("path").alias("asm_path"), F.nullif(F.regexp_extract("path", rf"{asm_root}(.+)/[^/]+\z", 1), F.lit("")).alias("segment"),
        T.instruction_count_listing("text").alias("instruction_count"),
    )
    seg = F.coalesce(F.nullif(F.regexp_extract("path", rf"(?:^|/){src_root}([^/]+)\.c\z", 1), F.lit("")), F.regexp_extract("path", rf"(?:^|/){src_root}(.+)/[^/]+\.c\z", 1))
    cand = sources.select(seg.alias("s"), (~F.col("path").rlike(rf"(?:^|/){src_root}[^/]+\.c\z")).cast("int").alias("deep"), F.col("path").alias("src_path"))
    # a file counts for its own folder and all folders above it
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("s", "/"))), lambda i: F.array_join(F.slice(F.split("s", "/"), F.lit(1), i), "/"))
    cand = cand.where("s <> ''").select(F.explode(up).alias("segment"), "deep", "src_path", "s").where("deep = 1 or segment = s").drop("s")
    known = cand.select("segment").distinct().withColumn("has", F.lit(True))
    hits = f.join(included(sources), "name").join(cand, ["segment", "src_path"]).groupBy("name", "asm_path").agg(F.min(F.struct("deep", "src_path"))["src_path"].alias("src_path"))
    return f.join(known, "segment", "left").join(hits, ["name", "asm_path"], "left").where("has is null or src_path is not null").select("name", "asm_path", "segment", "src_path", "instruction_count")


def lines(listings: DataFrame) -> DataFrame:
    """(func, line_no, rom_off, vram, word, text) of each line that carries an offset, an address and a word."""
    pat = r"/\*\s*([0-9A-Fa-f]+)\s+([0-9A-Fa-f]{8})\s+([0-9A-Fa-f]{8})\s*\*/\s*(.*)"
    e = listings.select(T.stem("path").alias("func"), F.posexplode(T.split_lines("text")).alias("line_no", "line"))
    g = lambda k: F.regexp_extract("line", pat, k)
    return e.where(F.col("line").rlike(pat)).select("func", F.col("line_no").cast("bigint"), T.hex_number(g(1)).alias("rom_off"), T.hex_number(g(2)).alias("vram"), T.hex_number(g(3)).alias("word"), T.strip(g(4)).alias("text"))


def functions(code: DataFrame) -> DataFrame:
    """(func, start, end, first, last, insns) of each function's lines."""
    rows = F.array_sort(F.collect_list(F.struct("vram", "text")))
    g = code.groupBy("func").agg(F.min("vram").alias("start"), (F.max("vram") + 4).alias("end"), rows.alias("rows"))
    return g.select("func", "start", "end", F.transform("rows", lambda r: r["text"]).alias("insns"))


def boundaries(funcs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each function beside its neighbour above: what is wrong at the edge between them.

    ``epilogue_only``: frees a frame it did not open, right behind its neighbour. ``tail``: code behind the return
    and its delay slot. ``borrowed``: reads a temporary that only the neighbour's last instructions set."""
    by = by or [F.lit(0)]
    w = Window.partitionBy(*by).orderBy("start", "func")
    opens = lambda a: F.exists(a, lambda s: s.rlike(r"addiu\s+\$sp,\s*\$sp,\s*-0x"))
    first = F.try_element_at("insns", F.lit(1))
    ret = F.array_position(F.transform("insns", lambda s: s.rlike(r"\Ajr\s+\$ra")), F.lit(True))
    behind = F.when(ret > 0, F.slice("insns", ret.cast("int") + 2, F.greatest(F.size("insns") - ret.cast("int") - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    sets = F.filter(F.transform(F.slice("insns", F.greatest(F.size("insns") - 2, F.lit(1)), F.lit(3)), lambda s: F.regexp_extract(s, r"\A\S+\s+(\$t\d)", 1)), lambda s: s != "")
    reads = F.flatten(F.transform(F.slice("insns", 1, 3), lambda s: F.regexp_extract_all(F.regexp_replace(s, r"\A\S+\s+\$t\d,?", ""), F.lit(r"(\$t\d)"), F.lit(1))))
    d = funcs.withColumn("above", F.lag("func").over(w)).withColumn("contiguous", F.coalesce(F.lag("end").over(w) == F.col("start"), F.lit(False))).withColumn("set_above", F.lag(sets).over(w))
    return d.select(
        "func", "above", "contiguous", (F.coalesce(first.rlike(r"addiu\s+\$sp,\s*\$sp,\s*0x"), F.lit(False)) & ~opens("insns") & F.col("contiguous")).alias("epilogue_only"),
        F.exists(behind, lambda s: ~s.rlike(r"\Anop\b")).alias("tail"), F.coalesce(F.col("contiguous") & F.arrays_overlap("set_above", reads), F.lit(False)).alias("borrowed"),
    )


def escapes(code: DataFrame, funcs: DataFrame) -> DataFrame:
    """(func, vram, target, inside): branches that leave their function and land within another one.

    The function of a target comes from an as-of on function starts; no pair of functions is compared."""
    from .relational import MANY_RANGES, asof_join

    b = code.select("func", "vram", T.hex_number(F.regexp_extract("text", r"\Ab\w*\s+.*(?:\.L|0x)([0-9A-Fa-f]{8})\b", 1)).alias("target")).where("target is not null")
    at = asof_join(b.withColumn("_k", F.lit(0)).withColumnRenamed("target", "at"), funcs.select(F.lit(0).alias("_k"), F.col("start").alias("at"), F.col("func").alias("other"), "end"), ["_k"], "at", ["other", "end"], "other", ranges=MANY_RANGES)
    return at.where("asof_other is not null and asof_other <> func and at < asof_end").select("func", "vram", F.col("at").alias("target"), F.col("asof_other").alias("inside"))


def resolve_targets(code: DataFrame, funcs: DataFrame, prefix: str = "at_") -> DataFrame:
    """(func, vram, target, kind, symbol) of encoded calls: placeholder, function, or inside (an absolute symbol)."""
    calls = code.where((F.shiftrightunsigned(F.col("word"), 26) == 3)).select("func", "vram", (T.call_target("word") + F.lit(0x80000000)).alias("target"), (T.call_target("word") == 0).alias("empty"))
    j = calls.join(funcs.select(F.col("func").alias("callee"), F.col("start").alias("target")), "target", "left")
    kind = F.when(F.col("empty"), "placeholder").when(F.col("callee").isNotNull(), "function").otherwise("inside")
    return j.select("func", "vram", "target", kind.alias("kind"), F.when(kind == "function", F.col("callee")).when(kind == "inside", T.absolute_symbol("target", prefix)).alias("symbol"))


#: The register that an instruction sets: its first one, unless it stores, branches or moves to a coprocessor.
_SET = r"\A(?!s[bhwd](?:[lr]|c\d)?\b|b|j|mt|c\.)\S+\s+\$(\w+),?"


def _registers(insns: Column, family: str, first: int) -> Column:
    """The registers of a family that the first instructions read before any of them sets it."""
    head = F.slice(insns, 1, first)
    uses = lambda s: F.array_distinct(F.regexp_extract_all(F.regexp_replace(s, _SET, ""), F.lit(rf"\$({family})"), F.lit(1)))
    step = lambda acc, s: F.struct(F.array_union(acc["read"], F.array_except(uses(s), acc["set"])).alias("read"), F.array_union(acc["set"], F.array(F.regexp_extract(s, _SET, 1))).alias("set"))
    none = F.array().cast("array<string>")
    return F.aggregate(head, F.struct(none.alias("read"), none.alias("set")), step)["read"]


def boundary_defects(funcs: DataFrame, by: list[str]) -> DataFrame:
    """(by, func, returns, direction, confidence): what the edges of each function say about how it was cut.

    ``bundle``: three returns or more. ``leaf``: code that is no padding behind the first return and its delay slot, HIGH
    if it returns and calls nothing, else LOW. ``stolen head``: one or two loads from argument registers whose result the
    contiguous successor reads before it sets it. ``merge``: contiguous, opens no frame and reads a temporary that it
    has not set. ``stolen prologue``: the same with a result register. The first that holds counts; null if none does."""
    w = Window.partitionBy(*by).orderBy("start", "func")
    is_return = lambda s: s.rlike(r"\Ajr\s+\$ra\b")
    returns = F.size(F.filter("insns", is_return))
    at = F.array_position(F.transform("insns", is_return), F.lit(True)).cast("int")
    tail = F.when(at > 0, F.slice("insns", at + 2, F.greatest(F.size("insns") - at - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    alive = F.exists(tail, lambda s: ~s.rlike(r"\Anop\b"))
    leaf = F.exists(tail, is_return) & ~F.exists(tail, lambda s: s.rlike(r"\Ajal\b"))
    frame = F.exists(F.slice("insns", 1, 3), lambda s: s.rlike(r"\Aaddiu\s+\$sp,\s*\$sp,\s*-"))
    loaded = F.transform(F.filter("insns", lambda s: s.rlike(r"\Al\w+\s+\$t\d,.*\(\$a[0-3]\)")), lambda s: F.regexp_extract(s, _SET, 1))
    d = funcs.withColumn("temps", _registers(F.col("insns"), r"t\d", 6)).withColumn("results", _registers(F.col("insns"), r"v[01]", 3))
    d = d.withColumn("below", F.coalesce(F.lag("end").over(w) == F.col("start"), F.lit(False))).withColumn("next", F.when(F.lead("start").over(w) == F.col("end"), F.lead("temps").over(w)))
    head = (F.size("insns") <= 2) & (F.size(loaded) == F.size("insns")) & F.coalesce(F.arrays_overlap(loaded, "next"), F.lit(False))
    kind = F.when(returns >= 3, "bundle").when(alive, "leaf").when(head, "stolen head").when(F.col("below") & ~frame & (F.size("temps") > 0), "merge").when(F.col("below") & ~frame & (F.size("results") > 0), "stolen prologue")
    return d.select(*by, "func", returns.alias("returns"), kind.alias("direction"), F.when(kind == "leaf", F.when(leaf, "HIGH").otherwise("LOW")).alias("confidence"))


def prefix_orphans(funcs: DataFrame, calls: DataFrame, by: list[str]) -> DataFrame:
    """(by, func, name, of): functions whose whole body begins the body of the next one in address order, and which nothing calls
    by name. funcs has name beside func; calls: (callee)."""
    w = Window.partitionBy(*by).orderBy("start", "func")
    body = F.concat(F.array_join("insns", "\n"), F.lit("\n"))
    d = funcs.withColumn("_body", body).withColumn("of", F.lead("func").over(w)).withColumn("_next", F.lead("_body").over(w))
    return d.where(F.startswith("_next", F.col("_body"))).select(*by, "func", "name", "of").join(calls.select(F.col("callee").alias("name")).distinct(), "name", "left_anti").select(*by, "func", "name", "of")


def valid_labels(labels: DataFrame, code: DataFrame, opens: str, closes: str) -> DataFrame:
    """Labels (name, at) that land on an instruction that opens a function, with nothing before it in its listing or
    an instruction that closes one."""
    w = Window.partitionBy("func").orderBy("vram", "line_no")
    good = code.withColumn("_before", F.lag("text").over(w)).where(F.col("text").rlike(opens) & (F.col("_before").isNull() | F.col("_before").rlike(closes)))
    return labels.join(good.select(F.col("vram").alias("at")).distinct(), "at", "left_semi")


def depth_first(edges: DataFrame, roots: DataFrame, most: int = 8) -> DataFrame:
    """(node, depth, path) of what calls reach, in depth-first order of ``path``: the names of the way from a root, of which
    each node keeps the first. A way never meets a node twice, and ends after ``most`` calls. Ways are pruned
    to the first of each node in every round, so what is kept is a row for each node."""
    from ..session import cut

    e = edges.select(F.col("caller").alias("_from"), F.col("callee").alias("node")).where("_from is not null and node is not null").distinct()
    front = roots.select(F.col(roots.columns[0]).alias("node"), F.lit(0).alias("depth"), F.array(roots.columns[0]).alias("path")).distinct()
    out = front = cut(front, "dfs")
    for depth in range(1, most + 1):
        step = front.join(e, front["node"] == e["_from"]).where(~F.array_contains("path", e["node"])).select(e["node"], F.lit(depth).alias("depth"), F.concat("path", F.array(e["node"])).alias("path"))
        front = cut(step.groupBy("node").agg(F.min(F.struct("path", "depth")).alias("b")).select("node", "b.depth", "b.path"), "dfs")
        if front.isEmpty():
            break
        out = cut(out.unionByName(front).groupBy("node").agg(F.min(F.struct("path", "depth")).alias("b")).select("node", "b.depth", "b.path"), "dfs")
    return out

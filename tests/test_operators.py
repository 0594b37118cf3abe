"""Relational, ordered, listing and image operators on small fixtures with results worked out by hand."""

import random
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import assembly, binary, state
from quarry.operators import assembly as A
from quarry.operators import relational as R
from quarry.plans import report


def tuples(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_first_wins_is_idempotent(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None), ("a", 1, "z"), (None, 1, "n")], "k string, o int, v string")
    once = R.first_wins(df, ["k"], ["o", "v"])
    assert tuples(once, "k") == [(None, 1, "n"), ("a", 1, "y"), ("b", 3, None)]
    assert tuples(R.first_wins(once, ["k"], ["o", "v"]), "k") == tuples(once, "k")
    assert R.first_wins(df.limit(0), ["k"], ["o"]).count() == 0


def test_ranked_join(spark):
    left = spark.createDataFrame([(1, "f", "seg", None), (2, "f", None, "other/f.s"), (3, "g", "seg", None)], "id int, stem string, segment string, asm string")
    right = spark.createDataFrame([("f", "a/seg/f.s"), ("f", "a/aaa/f.s"), ("f", "other/f.s")], "stem string, path string")
    rank = F.when(F.col("path") == F.col("asm"), 0).when(F.array_contains(T.path_parts("path"), F.col("segment")), 1).otherwise(2)
    got = R.ranked_join(left, right, ["stem"], ["id"], F.when(F.col("path").isNotNull(), rank), ["path"], ["path"])
    assert tuples(got, "id") == [(1, "a/seg/f.s"), (2, "other/f.s"), (3, None)]


def test_asof(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", 7)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 10), ("a", 5, 11), ("a", 6, 12), ("c", 1, 13)], "k string, t int, v int")
    assert tuples(R.asof_join(left, right, ["k"], "t", ["v"], "v"), "id") == [(1, "a", 5, 11), (2, "a", 1, None), (3, "b", 9, None), (4, "a", 7, 12)]
    assert tuples(R.asof_join(left, right, ["k"], "t", ["v"], "v", "forward"), "id")[1][3] is not None


def test_range_lookup_both_ways(spark):
    df = spark.createDataFrame([(0,), (5,), (10,), (25,), (None,)], "v int")
    bands = spark.createDataFrame([("x", 0, 10), ("y", 10, 20)], "b string, lo int, hi int")
    want = [(None, None), (0, "x"), (5, "x"), (10, "y"), (25, None)]
    assert tuples(R.range_lookup(df, "v", bands, "lo", "hi", ["b"]), "v") == want
    before, R.BROADCAST_ROWS = R.BROADCAST_ROWS, 0
    try:
        assert tuples(R.range_lookup(df, "v", bands, "lo", "hi", ["b"]), "v") == want
    finally:
        R.BROADCAST_ROWS = before


def test_contains_join(spark):
    hay = spark.createDataFrame([(1, "one two three four five six"), (2, "nothing here"), (3, None)], "id int, text string")
    needles = spark.createDataFrame([(1, "e two three four five si"), (2, "here"), (3, ""), (4, None), (5, "two three")], "n int, needle string")
    got = R.contains_join(needles, hay, "needle", "text", 3)
    assert sorted((r["n"], r["id"]) for r in got.collect()) == [(1, 1), (2, 2), (5, 1)]


def test_shared_shingles_against_brute_force(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("text is not null").collect()]
    first: dict[str, int] = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    runs = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for t, i in first.items() for w in [R._WORDS.findall(t.lower())]}
    want = {(a, b): n for a in runs for b in runs if a < b and (n := len(runs[a] & runs[b])) >= 3}
    got = R.shared_shingles(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", 5, 3)
    assert {(r["class_a"], r["class_b"]): r["shared"] for r in got.collect()} == want


def test_shared_shingles_in_blocks(spark, monkeypatch):
    """Texts with passages in common, some of them in most texts: no pair is joined with its sets, and blocks, chunks and bits lose nothing."""
    rng = random.Random(8)
    passages = [[f"p{k}w{i}" for i in range(rng.choice((6, 9, 14, 30)))] for k in range(25)]
    odds = [1 / (1 + k) for k in range(25)]
    texts = [" ".join(w for p in rng.choices(passages, odds, k=rng.randrange(7)) for w in [*p, f"x{rng.random()}"]) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate([*texts, *texts[:40], None, ""])]
    first: dict[str, int] = {}
    for i, t in rows:
        if t is not None:
            first.setdefault(t, i)
    runs = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for t, i in first.items() for w in [R._WORDS.findall(t)]}
    want = {(a, b): n for a in runs for b in runs if a < b and (n := len(runs[a] & runs[b])) >= 12}
    assert len(want) > 300
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for hot, chunk, keys in ((128, 1 << 19, 1 << 20), (8, 64, 200), (3, 1 << 19, 100)):
        monkeypatch.setattr(R.shingles, "HOT", hot)
        monkeypatch.setattr(R.shingles, "CHUNK", chunk)
        monkeypatch.setattr(R, "BLOCK_KEYS", keys)
        got = R.shared_shingles(df, "doc_id", "text", 4, 12)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        got = got.collect()
        assert len(got) == len(want) and {(r["class_a"], r["class_b"]): r["shared"] for r in got} == want


def test_snapshots_and_streaks(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "y"), (4, "w")], "k int, v string")
    assert tuples(R.snapshot_diff(a, b, "k", ["v"]), "k") == [(1, "removed"), (3, "changed"), (4, "added")]
    s = spark.createDataFrame([("u", i, v) for i, v in enumerate("aabba")], "u string, i int, v string")
    assert tuples(R.streaks(s, ["u"], ["i"], "v").select("v", "length", "first"), "first") == [("a", 2, 0), ("b", 2, 2), ("a", 1, 4)]


def test_reachable_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), (None, "a"), ("d", None)], "caller string, callee string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert tuples(R.reachable(e, roots)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_reachable_ends_only_when_all_is_found(spark):
    chain = spark.range(67).selectExpr("id AS caller", "id + 1 AS callee").coalesce(1)
    roots = spark.range(1).withColumnRenamed("id", "node")
    assert tuples(R.reachable(chain, roots)) == [(k, k) for k in range(68)]
    assert R.reachable(chain, roots, most=3).count() == 4
    with pytest.raises(RuntimeError):
        R.reachable(chain, roots, rounds=3)


def test_running_state(spark):
    df = spark.createDataFrame([("k", 1, 50.0, 3), ("k", 2, None, None), ("k", 3, 80.0, 4), ("k", 4, 20.0, 5)], "k string, o int, s double, t int")
    got = state.running(df, ["k"], ["o"], "s", "t").orderBy("o").select("seq", "best", "final", "total_tokens").collect()
    assert [tuple(r) for r in got] == [(1, 50.0, 50.0, 3), (2, 50.0, 50.0, 3), (3, 80.0, 80.0, 7), (4, 80.0, 20.0, 12)]


def test_call_score(spark):
    calls = [("verify_rom", "MISMATCH: Function f: 72.0% (3)"), ("diff", "FULL MATCH"), ("verify_rom", "MISMATCH: size mismatch"), ("compile", "SUCCESS")]
    df = spark.createDataFrame([(calls,), ([],), (None,), (calls[:1],)], "tool_calls array<struct<name string, output string>>")
    assert [tuple(r) for r in df.select(state.call_score(), state.call_compiled()).collect()] == [(100.0, True), (None, None), (None, None), (72.0, None)]


def listing(name, first, *rest, size=None):
    body = [first, *rest]
    head = f"nonmatching {name}, {size}\n" if size else ""
    return head + f"glabel {name}\n" + "".join(f"/* {k * 4:06X} {0x80001000 + k * 4:08X} 00000000 */  {s}\n" for k, s in enumerate(body))


def test_discover(spark):
    push = "addiu $sp, $sp, -0x20"
    rows = [
        ("asm/nonmatchings/a/f1.s", listing("f1", push, "jr $ra")), ("asm/nonmatchings/a/f2.s", listing("f2", push, "jr $ra")), ("asm/nonmatchings/a/stub.s", listing("stub", "jr $ra", size="0x8")),
        ("asm/nonmatchings/a/frag.s", listing("frag", "addu $a0, $a1, $a2")), ("asm/nonmatchings/b/c/f3.s", listing("f3", "jr $ra", size="12")), ("asm/nonmatchings/z/f4.s", listing("f4", "jr $ra")),
        ("asm/nonmatchings/a/hand.s", "# Handwritten\n" + listing("hand", push)), ("asm/nonmatchings/a/empty.s", "glabel empty\n"),
    ]
    src = [("src/a.c", 'INCLUDE_ASM("asm/nonmatchings/a", f1);\n'), ("src/b/c/x.c", 'INCLUDE_ASM("x", f3);\n'), ("src/b/c/w.c", "")]
    got = assembly.discover(spark.createDataFrame(rows, "path string, text string"), spark.createDataFrame(src, "path string, text string"))
    # f2 and the label-only listing have a source that does not include them; z has no source at all
    assert [(r["name"], r["src_path"]) for r in got.orderBy("name").collect()] == [("f1", "src/a.c"), ("f3", "src/b/c/x.c"), ("f4", None)]


def test_boundaries_and_escapes(spark):
    lines = [("f", 0x1000, 0, "addiu $sp, $sp, -0x8"), ("f", 0x1004, 0, "b .L00001014"), ("f", 0x1008, 0, "addu $t3, $a0, $a1"), ("g", 0x100C, 0, "addiu $sp, $sp, 0x8"), ("g", 0x1010, 0, "addu $v0, $t3, $zero"), ("g", 0x1014, 0, "jr $ra"), ("g", 0x1018, 0, "nop"), ("g", 0x101C, 0, "addu $v0, $v0, $v0")]
    code = spark.createDataFrame(lines, "func string, vram bigint, word bigint, text string")
    funcs = assembly.functions(code)
    b = {r["func"]: r for r in assembly.boundaries(funcs).collect()}
    assert (b["g"]["contiguous"], b["g"]["epilogue_only"], b["g"]["tail"], b["g"]["borrowed"]) == (True, True, True, True)
    assert (b["f"]["contiguous"], b["f"]["epilogue_only"], b["f"]["tail"], b["f"]["borrowed"]) == (False, False, False, False)
    assert [(r["func"], r["target"], r["inside"]) for r in assembly.escapes(code, funcs).collect()] == [("f", 0x1014, "g")]


def test_call_targets_resolve(spark):
    jal = lambda a: 0x0C000000 | (a & 0x0FFFFFFF) >> 2
    code = spark.createDataFrame([("f", 0x80001000, jal(0x80001008), ""), ("f", 0x80001004, jal(0x8000100C), ""), ("g", 0x80001008, jal(0), ""), ("g", 0x8000100C, 0, "")], "func string, vram bigint, word bigint, text string")
    got = assembly.resolve_targets(code, assembly.functions(code)).orderBy("vram").collect()
    assert [(r["kind"], r["symbol"]) for r in got] == [("function", "g"), ("inside", "at_8000100C"), ("placeholder", None)]


def test_images(spark):
    img = [("a", bytes([0x27, 0xBD, 0, 0, 3, 0xE0, 0, 8, 9])), ("b", bytes([0x27, 0xBD, 0, 1, 3, 0xE0, 0, 9, 9])), ("e", b"")]
    df = spark.createDataFrame(img, "path string, content binary")
    w = binary.words(df)
    assert tuples(w) == [("a", 0, 0x27BD0000), ("a", 1, 0x03E00008), ("b", 0, 0x27BD0001), ("b", 1, 0x03E00009)]
    pick = lambda p: w.where(F.col("path") == p).withColumn("path", F.lit("x"))
    diffs = binary.word_diffs(pick("a"), pick("b"), "path")
    assert binary.patch_spec(diffs, "path").first()["spec"] == "0:27BD0001,4:03E00009"
    assert {(r["op"], r["n"]) for r in binary.opcode_histogram(df.where("path = 'a'")).collect()} == {(0x27, 1), (3, 1)}
    pairs = spark.createDataFrame([(b"abc", b"abc"), (b"abc", b"abd"), (b"abc", b"aXY"), (b"ab", b"abc"), (b"", b"")], "a binary, b binary")
    assert [tuple(r[0]) for r in pairs.select(binary.compare_images(F.col("a"), F.col("b"))).collect()] == [(True, 0), (True, 1), (False, 2), (False, None), (True, 0)]
    checks = binary.blob_checks(df, least=8, returns=1)
    assert [r["code_like"] for r in checks.orderBy("path").collect()] == [True, False, False]


def test_windows_and_shifts(spark):
    a, b = bytes(range(200)), bytes(8) + bytes(range(200))
    df = spark.createDataFrame([("a", a), ("b", b)], "path string, content binary")
    h = binary.window_hashes(df, "path", "content")
    s = binary.shifts(h.where("path = 'a'"), h.where("path = 'b'"))
    assert {r["shift"] for r in s.collect()} == {8} and binary.shift_changes(s).count() == 1
    m = spark.createDataFrame([(b"..0123MARK",), (b"MARK",)], "c binary").select(binary.marker_window("c", "MARK", 4, 4))
    assert [r[0] for r in m.collect()] == [bytearray(b"0123"), None]


def test_keyed_compare(spark):
    df = spark.createDataFrame([("f", b"a", b"a"), ("g", b"a", b"b"), ("h", b"a", None), ("f.NON_MATCHING", b"a", b"b")], "name string, base binary, built binary")
    assert tuples(binary.keyed_compare(df)) == [("f", "same"), ("g", "differs"), ("h", "missing")]


def test_progress_from_images(spark):
    base, built = bytes(16), bytes(8) + b"\1" + bytes(7)
    lst = spark.createDataFrame([(f"asm/nonmatchings/s/{n}.s", f"glabel {n}\n/* 0 80000000 00000000 */ nop\n".replace("glabel", "g")) for n in ("func_80000000", "func_80000008", "func_80000004", "func_zz", "func_90000000")], "path string, text string")
    seg = spark.createDataFrame([("s", 0, 0x80000000, "src/s.c")], "dir_name string, rom_start bigint, vram bigint, src_path string")
    src = spark.createDataFrame([("src/s.c", 'void func_80000000(void) {}\nvoid func_80000008(void) {}\nINCLUDE_ASM("asm/nonmatchings/s", func_80000004)')], "path string, text string")
    image = lambda b: spark.createDataFrame([(b,)], "content binary")
    got = report.from_images(lst, seg, src, image(base), image(built))
    assert tuples(got.select("name", "decompiled", "matched")) == [("func_80000000", True, True), ("func_80000004", False, False), ("func_80000008", True, False)]
    total = report.rollup(got, "segment", "size", F.col("matched")).where("total = 1").first()
    assert (total["matched_functions"], total["functions"], total["code_percent"]) == (1, 3, round(100 / 3, 6))
    lines = [r["line"] for r in report.text_report(report.rollup(got, "segment", "size", F.col("matched")), "segment", "x").collect()]
    assert lines[0] == "x Decompilation Progress" and lines[2].startswith("  src/s ")


def test_rollup_of_nothing(spark):
    empty = spark.createDataFrame([], "segment string, size bigint, matched boolean")
    got = report.rollup(empty, "segment", "size", F.col("matched")).collect()
    assert [(r["functions"], r["code_percent"]) for r in got] in ([], [(0, 0.0)])


def test_drift(spark):
    df = spark.createDataFrame([("d1", 10.0), ("d2", 12.0), ("d3", 40.0)], "at string, p double")
    assert [r["alert"] for r in report.drift(df, "at", "p", 10).orderBy("at").collect()] == [False, False, True]


def test_stream_equals_batch(spark, tmp_path):
    from quarry.streaming.fold import fold_stream

    rows = [("a", 1, 0, 50.0, 3), ("b", 1, 1, None, 1), ("a", 2, 2, None, 2), ("a", 3, 3, 80.0, 4), ("a", 4, 4, 20.0, None)]
    schema = "key string, at bigint, ord bigint, score double, tokens bigint"
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    q = fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("fold").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("fold").groupBy("key").agg(F.max_by(F.struct("seq", "best", "final", "tokens"), "seq").alias("s")).select("key", "s.*")
    batch = state.running(spark.createDataFrame(rows, schema), ["key"], ["at", "ord"], "score", "tokens").groupBy("key").agg(F.max_by(F.struct("seq", "best", "final", F.col("total_tokens").alias("tokens")), "seq").alias("s")).select("key", "s.*")
    assert isinstance(last.toPandas(), pd.DataFrame) and tuples(last) == tuples(batch)


# --- edges of functions, parity, search --------------------------------------------------


def test_boundary_defects(spark):
    frame, ret, nop = "addiu $sp, $sp, -0x18", "jr $ra", "nop"
    rows = [
        ("p", "a", 0, 16, [frame, "lw $t1, 0x0($a0)", ret, nop]), ("p", "b", 16, 20, ["lw $t7, 0x4($a1)"]), ("p", "c", 20, 36, [frame, "addu $v0, $t7, $t7", ret, nop]),
        ("p", "d", 36, 48, ["addu $a0, $t7, $a1", ret, nop]), ("p", "e", 48, 56, ["sw $v0, 0x0($a0)", "nop"]), ("p", "f", 100, 124, [frame, ret, nop, "sw $a0, 0x0($a1)", ret, nop]),
        ("p", "g", 200, 216, [frame, ret, nop, "jal h"]), ("p", "h", 300, 324, [ret, nop, ret, nop, ret, nop]), ("p", "i", 400, 412, [ret, nop, nop]), ("q", "j", 412, 416, []),
    ]
    df = spark.createDataFrame(rows, "project string, func string, start bigint, end bigint, insns array<string>")
    got = {r["func"]: (r["direction"], r["confidence"], r["returns"]) for r in A.boundary_defects(df, ["project"]).collect()}
    assert got["a"][0] is None and got["i"][0] is None and got["j"] == (None, None, 0)
    assert got["b"][0] == "stolen head" and got["d"][0] == "merge" and got["e"][0] == "stolen prologue" and got["h"] == ("bundle", None, 3)
    assert got["f"][:2] == ("leaf", "HIGH") and got["g"][:2] == ("leaf", "LOW")
    assert A.boundary_defects(df.limit(0), ["project"]).count() == 0


def test_prefix_orphans_and_labels(spark):
    f = spark.createDataFrame([("p", "1", "x", 0, ["a", "b"]), ("p", "2", "y", 8, ["a", "b", "c"]), ("p", "3", "z", 20, ["a"]), ("q", "4", "w", 24, ["a", "d"])], "project string, func string, name string, start bigint, insns array<string>")
    calls = lambda *n: spark.createDataFrame([(x,) for x in n], "callee string")
    assert [r["func"] for r in A.prefix_orphans(f, calls("q"), ["project"]).collect()] == ["1"]
    assert A.prefix_orphans(f, calls("x"), ["project"]).count() == 0
    code = spark.createDataFrame([("f", 0, 0, "addiu $sp"), ("f", 1, 4, "nop"), ("f", 2, 8, "lui $v0"), ("f", 3, 12, "lui $v1")], "func string, line_no bigint, vram bigint, text string")
    labels = spark.createDataFrame([("a", 0), ("b", 4), ("c", 8), ("d", 12), ("e", None)], "name string, at bigint")
    assert sorted(r["name"] for r in A.valid_labels(labels, code, r"\A(?:addiu|lui)\b", r"\Anop\b").collect()) == ["a", "c"]


def test_depth_first_with_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("x", "y"), ("b", None), ("b", "c")], "caller string, callee string")
    roots = spark.createDataFrame([("a",)], "node string")
    got = A.depth_first(e, roots).orderBy("path").collect()
    assert [(r["node"], r["depth"]) for r in got] == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]


def test_contains_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "NEEDLES", 2)
    hay = spark.createDataFrame([(i, f"x needle{i} y" * (i % 3)) for i in range(30)] + [(99, None)], "id int, text string")
    needles = spark.createDataFrame([(i, f"dle{i}") for i in range(30)] + [(77, "dle5"), (78, "")], "n int, needle string")
    got = {(r["n"], r["id"]) for r in R.contains_join(needles, hay, "needle", "text").collect()}
    texts, words = {i: f"x needle{i} y" * (i % 3) for i in range(30)}, [*((i, f"dle{i}") for i in range(30)), (77, "dle5")]
    assert got == {(n, i) for n, w in words for i, t in texts.items() if w in t}


def test_parity(spark):
    from quarry.operators import parity as P

    a, b = spark.createDataFrame([("f", 3), ("g", 4)], "k string, n int"), spark.createDataFrame([("f", 3), ("g", 5), ("h", 1)], "k string, n int")
    assert {(r["k"], r["same"]) for r in P.count_parity(a, b, ["k"], "n").collect()} == {("f", True), ("g", False)}
    assert {(r["k"], r["residual"]) for r in P.size_residual(a, b, "k", "n").collect()} == {("f", 0), ("g", -1), ("h", -1)}
    rows = spark.createDataFrame([("u", "d", "d", "INCLUDE_ASM"), ("u", "d", "d", ""), ("v", "d", "e", "INCLUDE_ASM"), ("w", "d", "d", "f() {"), ("x", None, "d", "INCLUDE_ASM")], "g string, a string, b string, t string")
    c = P.contaminated(rows, ["g"], F.col("a") == F.col("b"), F.contains("t", F.lit("INCLUDE_ASM")), F.contains("t", F.lit("{")))
    assert {r["g"] for r in c.where("contaminated").collect()} == {"u"}
    p = spark.createDataFrame([("m", "x"), ("m", "x"), ("m", None), ("n", "x"), ("n", "y")], "g string, place string")
    assert {(r["g"], r["together"]) for r in P.co_located(p, ["g"], "place").collect()} == {("m", True), ("n", False)}
    assert [r["k"] for r in P.undone(a, b.where("n > 4"), ["k"]).collect()] == ["g"]


def test_asof_of_a_hot_key_in_ranges(spark):
    left = spark.createDataFrame([("k" if i % 3 else "h", i / 2 if i % 17 else None, i) for i in range(300)], "k string, t double, i int")
    right = spark.createDataFrame([("k", float(x), x % 7 or None, f"r{x}{y}") for x in (3, 9, 9, 50, 51, 120, 149) for y in "ab"] + [("h", 100.0, 1, "h"), ("h", None, 1, "n")], "k string, t double, o int, v string")
    one = R.asof_join(left, right, ["k"], "t", ["o", "t"], "o", ranges=1)
    many = R.asof_join(left, right, ["k"], "t", ["o", "t"], "o", ranges=6)
    assert tuples(one, "i") == tuples(many, "i") and one.columns == many.columns
    assert R.asof_join(left, right.limit(0), ["k"], "t", ["v"], "o").where("asof_v is not null").count() == 0


def test_definitions_with_many_heads():
    from quarry.functions.code import find_definition

    code = "s32 f(s32);\n\n#if 1\n/* note */\nstatic\ns32 f(s32 (*g)(void))\n{\n  if (f(1)) { return 2; }\n}\nint x = f(3) + 1;\n"
    assert find_definition(code, "f") == "/* note */\nstatic\ns32 f(s32 (*g)(void))\n{\n  if (f(1)) { return 2; }\n}\n"
    assert find_definition(code, "g") is None and find_definition("f(", "f") is None and find_definition("f() {", "f") is None


def test_first_of_a_hot_key(spark):
    df = spark.createDataFrame([("a", f"v{i:03d}") for i in range(200)] * 2 + [("b", "x"), ("c", None)], "k string, v string")
    got = {r["k"]: r["firsts"] for r in R.first_of(df, ["k"], "v", 3).collect()}
    assert got == {"a": ["v000", "v001", "v002"], "b": ["x"], "c": []}


def test_range_lookup_three_ways(spark, monkeypatch):
    bands = spark.createDataFrame([(f"b{i}", i * 10, i * 10 + (10 if i % 3 else 5)) for i in range(30)], "band string, low bigint, high bigint")
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, -1, 0, 4, 5, 9, 10, 19, 20, 295, 299, 300, 10**6])], "i int, v bigint")
    want = tuples(R.range_lookup(df, "v", bands, "low", "high", ["band"]), "i")
    for few, most in ((3, 100_000), (3, 3)):
        monkeypatch.setattr(R, "FEW_BANDS", few)
        monkeypatch.setattr(R, "BROADCAST_ROWS", most)
        assert tuples(R.range_lookup(df, "v", bands, "low", "high", ["band"]), "i") == want
        assert R.range_lookup(df, "v", bands, "low", "high", ["band"], "inner").count() == sum(r[2] is not None for r in want)

"""Nested records, drifting schemas, export, validation and files, on fixtures with edge cases."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from quarry.operators import drift, shred
from quarry.plans import export, quality
from quarry.sources import files

SCHEMA = """episode_id bigint, steps array<struct<step_number bigint, timestamp string, assistant_text string, tool_calls array<struct<name string, input string, output string, duration_ms bigint>>,
    match_percent double, compiled boolean, token_usage struct<input_tokens bigint, output_tokens bigint>>>, metadata string, leaves string"""


def call(text):
    return ("n", text, "o", 1)


def step(calls):
    return (1, "t", None, calls, 1.5, True, (1, None))


sys.setrecursionlimit(shred.WALK)
DEEP = "[" * 5000 + "]" * 5000
ROWS = [
    (1, [step([call('{"a": {"b": [1, {"c": null}], "e": {}, "f": []}, "g.h": true}'), None, call('"{\\"x\\": \\"y\\"}"')]), None, step(None), step([])], '{"m": [[1, 2], [3]], "m2": 1.5}', "x"),
    (2, None, None, None), (3, [], "", None), (4, [None], "[1]", None), (5, [step([call(None), call(""), call('{"a": 1'), call('"text"'), call("null"), call('"\\"{}\\""')])], '{"a": 1, "a": "2"}', None),
    (6, [step([call(json.dumps({"a": DEEP})), call('{"a": ' + DEEP + "}"), call('{"a": ' + "[" * 150 + "1" + "]" * 150 + "}")])], '{"k": "' + "v" * 300_000 + '"}', None), (1, [], '{"q": 1}', "again"),
]


def walk(v, path=""):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from walk(x, f"{path}.{k}" if path else k)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from walk(x, f"{path}[{i}]")
    else:
        yield path, {type(None): "null", bool: "boolean", str: "string"}.get(type(v), "number")


def test_leaves_against_brute_force(spark):
    want = []
    for i, steps, meta, _ in ROWS:
        want += [(i, 0, 0, *x) for x in walk(shred.parse_object(meta) or {})]
        for s, st in enumerate(steps or [], 1):
            for c, ca in enumerate((st and st[3]) or [], 1):
                want += [(i, s, c, *x) for x in walk(shred.parse_object(ca and ca[1]) or {})]
    got = shred.episode_leaves(spark.createDataFrame(ROWS, SCHEMA))
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(want)
    assert (1, 1, 1, "a.b[1].c", "null") in want and (1, 0, 0, "m[0][1]", "number") in want and (1, 1, 3, "x", "string") in want
    # however deep: 150 levels hold a leaf, 5000 hold an empty array
    assert (6, 1, 1, "a", "string") in want and not [w for w in want if w[:3] == (6, 1, 2)] and [w[4] for w in want if w[:3] == (6, 1, 3)] == ["number"]


def test_ancestor_tables(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).where("leaves is null or leaves <> 'again'")
    steps = shred.episode_steps(df).where("episode_id = 1").orderBy("step_ord").collect()
    assert [(r["step_ord"], r["present"], r["match_percent"]) for r in steps] == [(1, True, 1.5), (2, False, None), (3, True, 1.5), (4, True, 1.5)]
    calls = shred.episode_calls(df).where("episode_id = 1").orderBy("call_ord").collect()
    assert [(r["step_ord"], r["call_ord"], r["present"], r["duration_ms"]) for r in calls] == [(1, 1, True, 1), (1, 2, False, None), (1, 3, True, 1)]
    assert shred.episode_steps(df).where("episode_id in (2, 3)").count() == 0


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert shred.episode_leaves(empty).count() == shred.episode_steps(empty).count() == shred.episode_calls(empty).count() == 0


# --- drift -----------------------------------------------------------------------

STEP = {"step_number": 1, "timestamp": "t", "assistant_text": "Some words here", "tool_calls": [{"name": "x", "input": {}}], "match_percent": None, "compiled": None, "token_usage": None}
B1 = {k: "x" for k in drift.CANONICAL} | {"function_name": "fn", "steps": [STEP], "final_match_percent": 1, "best_match_percent": float("nan"), "total_tokens": 1, "instruction_count": 1, "metadata": {}, "final_source": "void fn(void) { a(); }"}
TRY = {"c_code": "a();", "matched": True, "diff_count": 0, "diff_details": [], "compiler_flags": "", "notes": "first try"}
B2 = {k: "x" for k in drift.LEGACY} | {"function_name": "fn", "matched": True, "has_branches": True, "has_calls": False, "instruction_count": 1, "timestamp": 1.5, "nearby_decompiled": [], "called_functions": [], "referenced_data": [], "attempts": [TRY], "final_c": "void fn(void) { a(); }"}


def without(d, *keys, **more):
    return {k: v for k, v in d.items() if k not in keys} | more


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (B1, []), (B2, []), (without(B2, symbol_name="s", notes=[]), []), (without(B1, end_time=None, final_source=None), []),
        (without(B1, "final_source", code_text=B1["final_source"]), [("final_source", "renamed")]),
        (without(B1, "final_source", draft="void other(void) { a(); }"), [("final_source", "removed"), ("draft", "added")]),
        (without(B1, "final_source", Final_Source=["void fn(void) {", " a();", "}"]), [("final_source", "renamed"), ("final_source", "retyped")]),
        (without(B1, final_source=3), [("final_source", "retyped")]), (without(B1, "steps", turns=[STEP]), [("steps", "renamed")]), (without(B1, "steps"), [("steps", "removed")]),
        (without(B1, steps={"1": STEP}), [("steps", "retyped")]), (without(B1, "steps", log=json.dumps([STEP])), [("steps", "renamed"), ("steps", "retyped")]),
        (without(B1, steps=[without(STEP, "assistant_text", said="Some words here")]), [("steps.assistant_text", "renamed")]),
        (without(B1, steps=[without(STEP, "assistant_text", branch="word")]), [("steps.assistant_text", "removed"), ("steps.branch", "added")]),
        (without(B1, steps=[without(STEP, "tool_calls", calls={"calls": STEP["tool_calls"]})]), [("steps.tool_calls", "renamed"), ("steps.tool_calls", "retyped")]),
        (without(B2, attempts=[without(TRY, "notes", warnings=["first try"])]), [("attempts.notes", "removed"), ("attempts.warnings", "added")]),
        (without(B2, attempts=[without(TRY, "c_code", code="a();")]), [("attempts.c_code", "renamed")]), (without(B2, "final_c", priority=None), [("final_c", "removed"), ("priority", "added")]),
        (without(B1, steps=[], seed=1), [("seed", "added")]), (without(B1, steps=[None, 3]), []),
    ],
)
def test_deviations(body, want):
    assert sorted(drift.file_deviations(json.loads(json.dumps(body)))[0]) == sorted(want)


def test_drift_operators(spark):
    bodies = [json.dumps(B1), json.dumps(without(B2, "final_c", w=B2["final_c"])), None, "", " ", "[1]", '"x"', "{", json.dumps(B1), DEEP]
    df = spark.createDataFrame([(i, b, "clash") for i, b in enumerate(bodies)], "file_id bigint, body string, field string")
    assert [tuple(r) for r in drift.deviations(df).collect()] == [(1, "final_c", "renamed", 1)]
    assert {(r["file_id"], r["reason"]) for r in drift.rejects(df).collect()} == {(2, "null"), (3, "empty"), (4, "empty"), (5, "no object"), (6, "no object"), (7, "unreadable"), (9, "no object")}
    table = {r["file_id"]: r for r in drift.cast_files(df).collect()}
    assert sorted(table) == [0, 1, 8] and table[1]["source"] == B2["final_c"] and table[1]["changes"] == "final_c:renamed"
    union = {(r["schema"], r["field"]): r["type"] for r in drift.union_schema(df).collect()}
    assert union["canonical", "final_match_percent"] == "integer" and union["legacy", "w"] == "string"
    empty = df.limit(0)
    assert drift.deviations(empty).count() == drift.cast_files(empty).count() == drift.union_schema(empty).count() == 0


def test_cast_keeps_all_values(spark):
    bodies = [
        without(B1, "final_source", code_text=B1["final_source"], labels=["x", None], instruction_count=2.5, total_tokens=2**70), without(B1, model=None, metadata={"a": [1]}, outcome=["match"], start_time="\ud800"),
        without(B2, notes=["n"], model="m", has_calls=True), without(B2, "attempts", "final_c", Attempts=json.dumps([TRY]), metadata=3, timestamp=7),
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "file_id bigint, body string")
    out = drift.cast_files(df)
    kind = {f.name: f.dataType.simpleString() for f in out.schema}
    assert kind["has_branches"] == "boolean" and kind["timestamp"] == kind["instruction_count"] == kind["total_tokens"] == "double" and kind["reference"] == "string"
    t = [r.asDict() for r in out.orderBy("file_id").collect()]
    assert t[0]["final_source"] == t[0]["source"] == B1["final_source"] and json.loads(t[0]["added"]) == {"labels": ["x", None]} and t[0]["instruction_count"] == 2.5 and t[0]["total_tokens"] == float(2**70)
    assert t[1]["model"] is None and json.loads(t[1]["metadata"]) == {"a": [1]} and t[1]["added"] is None and [json.loads(r["outcome"]) for r in t] == ["x", ["match"], "match", "match"] and t[1]["start_time"] == "?"
    assert t[2]["notes"] == '["n"]' and json.loads(t[2]["added"]) == {"model": "m"} and t[2]["has_calls"] is True and t[2]["asm_text"] == "x" and t[2]["project"] == t[2]["game"] == "x"
    assert json.loads(json.loads(t[3]["attempts"])) == json.loads(t[3]["parts"]) == [TRY] and json.loads(t[3]["added"]) == {"metadata": 3} and t[3]["final_c"] is None and t[3]["timestamp"] == 7.0
    few = drift.cast_files(df.where("file_id = 2"))
    assert few.schema["timestamp"].dataType.simpleString() == "double" and few.schema["instruction_count"].dataType.simpleString() == "bigint"


def test_lattice():
    assert drift.promote("integer", "number") == "number" and drift.promote("null", "array") == "array" and drift.promote("string", "array") == "variant"
    for a in drift.LATTICE:
        for b in drift.LATTICE:
            assert drift.promote(a, b) == drift.promote(b, a)


# --- export and validation ---------------------------------------------------------


def raw(spark, *rows):
    return spark.createDataFrame([(i, p, path, json.dumps(b) if isinstance(b, dict) else b) for i, (p, path, b) in enumerate(rows)], "file_id bigint, project string, path string, body string")


MATCH = without(B1, outcome="match", final_match_percent=100, project="P", metadata={"segment": "seg", "model": "old"}, instruction_count=0)


def test_export(spark):
    df = raw(
        spark, ("p", "b.json", MATCH), ("p", "a.json", without(MATCH, outcome="failed")), ("p", "c.json", MATCH), ("q", "__os.json", without(MATCH, metadata={"segment": ""}, function_name="g")), ("p", "d.json", B2),
        ("p", "e.json", without(B2, final_c="")), ("p", "f.json", without(B2, final_c=" \n", function_name="ws", segment="s2")), ("p", "g.json", without(MATCH, final_match_percent="100", function_name="str")), ("p", "h.json", "[1]"), ("p", "i.json", "{"), ("p", "j.json", {"a": 1}), ("p", "k.json", None),
    )
    lst = spark.createDataFrame([("P", "asm/x/fn.s", "/* 1 */ a\n"), ("P", "asm/seg/fn.s", "/* 1 */ a\n/* 2 */ b  \n\n"), ("P", "asm/seg/other.s", "")], "project string, path string, text string")
    out = {r["task_id"]: r for r in export.export(df, lst).collect()}
    assert sorted(out) == ["P/g", "P/seg/fn", "p/s2/ws", "p/x/fn"]
    r = out["P/seg/fn"]
    meta = json.loads(r["metadata"])
    assert (r["instruction_count"], r["assembly"], meta["episode_path"], meta["model"]) == (2, "/* 1 */ a\n/* 2 */ b\n", "b.json", "x")
    assert r["prompt"] == "Decompile the following N64 function to exact-match C.\nProject: P\nFunction: fn\nSegment: seg\nInstruction count: 2\n\nAssembly:\n/* 1 */ a\n/* 2 */ b\n\nInitial m2c output:\nx\n\nReturn only the decompiled C for the target function.\n"
    assert out["p/s2/ws"]["target_c"] == "\n" and out["p/x/fn"]["source_schema"] == "legacy_v1"
    assert {(x["path"], x["reason"]) for x in export.rejects(export.parse(df)).collect()} == {("h.json", "no object"), ("i.json", "invalid JSON"), ("j.json", "unknown schema"), ("k.json", "no object")}
    for ratio, split in ((0.0, "train"), (1.0, "eval")):
        assert {x["split"] for x in export.export(df, eval_ratio=ratio).collect()} == {split}
    assert export.export(df.limit(0)).count() == 0


def test_write(spark, tmp_path):
    records = export.export(raw(spark, ("p", "b.json", MATCH), ("p", "d.json", B2)), eval_ratio=0.0)
    assert [tuple(r) for r in export.write(records, str(tmp_path / "out")).collect()] == [("train", 2)]
    lines = [json.loads(s) for p in sorted((tmp_path / "out" / "split=train").glob("*.json")) for s in p.read_text().splitlines()]
    assert [x["task_id"] for x in lines] == ["P/seg/fn", "p/x/fn"] and "assembly" in lines[0]


def test_validator():
    good = without(B1, outcome="match", final_match_percent=100.0, best_match_percent=100, steps=[without(STEP, compiled=True, match_percent=100.0, tool_calls=[{"name": "a", "input": {}, "output": "", "duration_ms": True}])])
    check = lambda b, **k: quality.errors_of(json.dumps(b) if not isinstance(b, str) else b, **k)
    assert check(good, require_match=True) == []
    assert check(without(good, "model", "steps")) == ["missing top-level key 'model'", "missing top-level key 'steps'"]
    assert check(without(good, total_tokens=1.5, final_match_percent=True)) == ["final_match_percent: expected int or float", "total_tokens: expected int, got float"]
    assert check(without(good, outcome="won")) == ["outcome: expected one of ['failed', 'incomplete', 'match', 'partial'], got 'won'"]
    assert check(without(good, steps=[3, {"a": 1}]))[0] == "steps[0]: expected object, got int"
    assert check(without(good, steps=[without(STEP, tool_calls=[{"name": 1}])])) == [f"steps[0].tool_calls[0]: missing key '{k}'" for k in ("duration_ms", "input", "output")]
    assert check(without(good, steps=[], final_source=""), require_match=True) == ["steps: expected at least one step for exact match episode", "final_source: expected non-empty source text"]
    assert check("[1]") == ["expected object, got list"] and check("{") == ["invalid JSON"] and quality.errors_of(None) == ["failed to read file"]


def test_files(spark, tmp_path):
    at = tmp_path / "projects" / "p" / "episodes"
    at.mkdir(parents=True)
    for n in ("_x.json", ".y.json", "__os.json", "z.json", "no.txt"):
        (at / n).write_text("{}")
    (tmp_path / "projects" / "empty").mkdir()
    got = files.read_episodes(spark, str(tmp_path))
    assert [(r["project"], r["path"], r["body"]) for r in got.orderBy("file_id").collect()] == [("p", f"episodes/{n}", "{}") for n in (".y.json", "__os.json", "_x.json", "z.json")]
    (tmp_path / "asm").mkdir()
    (tmp_path / "asm" / "_f.s").write_bytes(b"a\r\nb")
    (tmp_path / "asm" / "bad.s").write_bytes(b"\xff")
    assert {(r["path"].rpartition("/")[2], r["text"]) for r in files.read_listings(spark, str(tmp_path)).collect()} == {("_f.s", "a\r\nb"), ("bad.s", None)}
    assert files.read_listings(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "rom").write_bytes(bytes(0x20) + b"MY GAME             ")
    from quarry.functions import text as T

    assert files.read_image(spark, str(tmp_path / "rom")).select(T.base_name(T.rom_name("content"))).first()[0] == "my_game"
    (tmp_path / "report.json").write_text(json.dumps({"measures": {}, "units": [{"name": "u", "functions": [{"name": "f", "size": "8", "fuzzy_match_percent": 50.0}, {"name": "g", "size": "4"}]}]}))
    assert [tuple(r) for r in files.read_report(spark, str(tmp_path / "report.json")).orderBy("function").collect()] == [("u", "f", 8, 50.0), ("u", "g", 4, None)]


YAML = """
name: game
segments:
  - name: main
    start: 0x1000
    vram: 0x80000400
    subsegments:
      - [0x1000, c, boot]
      - [0x2000, asm]
      - [0x3000, data, d]
      - [0x4000, c, boot]
  - [0x9000]
"""


def test_segments_and_config(spark, tmp_path):
    assert {tuple(r) for r in files.segment_table(spark, YAML).collect()} == {("boot", 0x4000, 0x80003400, "src/boot.c"), ("2000", 0x2000, 0x80001400, "src/2000.c")}
    (tmp_path / "engine.yaml").write_text("asm_dir: asm\nturns: 30\n")
    (tmp_path / "a").mkdir()
    assert files.load_config(str(tmp_path / "a"), ("engine.toml", "engine.yaml")) == {"asm_dir": str(tmp_path / "asm"), "turns": 30}
    assert files.chosen_text("a", None) == "a" and files.chosen_text(None, None) is None
    assert files.save_episode(str(tmp_path / "e"), {"function_name": "f"}, "20240101_000000").endswith("20240101_000000_f.json")


def test_unused_columns_stay_out(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("leaf_path", F.lit("clash")).withColumn("ords", F.lit(1))
    assert shred.episode_leaves(df).columns == ["episode_id", "step_ord", "call_ord", "leaf_path", "kind", "value"]


def test_deep_json_keeps_all_leaves(spark):
    deep = '{"top": 1, "d": ' + '{"k": [' * 120 + '{"x": true}' + "]}" * 120 + "}"
    row = [(1, None, deep, ""), (2, None, '{"a": [[1, 2], [3]]}', "")]
    got = shred.episode_leaves(spark.createDataFrame(row, SCHEMA)).collect()
    assert {(r["episode_id"], r["leaf_path"]) for r in got} == {(1, "top"), (1, "d" + ".k[0]" * 120 + ".x"), (2, "a[0][0]"), (2, "a[0][1]"), (2, "a[1][0]")}


def test_exit_code(spark):
    files = raw(spark, ("p", "b.json", MATCH))
    assert quality.summary(quality.validate(files)).select("files").first()[0] == 1
    assert tuple(quality.summary(quality.validate(files.limit(0))).first()) == (0, 0, False, 0)

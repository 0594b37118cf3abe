"""Semantics of text functions, against Python's own or values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.code import bodies, find_definition, replace_function
from quarry.functions.hashing import blake2s_unit, md5_unit

TEXTS = ["", "   ", "x \t\n", "x\x1c", "x\xa0", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h\n", "a\n\nb", "a\nb\n", None, "ü  \n \n", "\n"]


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_normalize(spark):
    want = [None if t is None else t.rstrip() + "\n" if t else "" for t in TEXTS]
    assert one(spark, TEXTS, T.normalize_text("c")) == want


def test_split_lines(spark):
    assert one(spark, TEXTS, T.split_lines("c")) == [None if t is None else t.splitlines() for t in TEXTS]


def test_strip(spark):
    assert one(spark, TEXTS, T.strip("c")) == [None if t is None else t.strip() for t in TEXTS]


LISTING = "glabel f\n/* 0 80000000 27BDFFE0 */  addiu $sp, $sp, -0x20\n.L1:\n/* 4 80000004 00000000 */  nop\n/* 8 80000008 03E00008 */  .word 1\n# note\nnonmatching f, 0xC\nendlabel f\n"


def test_three_counts(spark):
    df = spark.createDataFrame([(LISTING,)], "c string")
    assert tuple(df.select(T.instruction_count_listing("c"), T.instruction_count_words("c"), T.instruction_count_code("c")).first()) == (5, 3, 2)


def test_first_percent(spark):
    assert one(spark, ["Function f: 72.0% (3)", "Match: 5% 9%", "none", None], T.first_percent("c")) == [72.0, 5.0, None, None]


def test_task_id(spark):
    df = spark.createDataFrame([("p", None), ("p", ""), ("p", "a")], "p string, s string")
    assert [r[0] for r in df.select(T.task_id("p", "s", F.lit("f"))).collect()] == ["p/f", "p/f", "p/a/f"]


def test_key_values(spark):
    df = spark.createDataFrame([(["a=1", "b=x=y", "a=2", "=3", "none"],)], "c array<string>")
    assert df.select(T.key_values("c")).first()[0] == {"a": "2", "b": "x=y"}


def test_symbols_and_words(spark):
    assert one(spark, ["func_80001234", "gl_func_80001234", "func", None], T.symbol_address("c")) == [0x80001234, None, None, None]
    assert one(spark, [0x0C000400], T.call_target("c"), "bigint") == [0x1000]
    assert one(spark, [0x3C018012], T.without_immediate("c"), "bigint") == [0x3C010000]
    assert one(spark, [0x80001000], T.absolute_symbol("c", "at_"), "bigint") == ["at_80001000"]


def test_stem_and_names(spark):
    assert one(spark, ["a/b/func_1.s", "x", ".hid", "a.b.c"], T.stem("c")) == ["func_1", "x", ".hid", "a.b"]
    assert one(spark, ["  My Game! 64 ", "***", ""], T.base_name("c")) == ["my_game__64", "game", "game"]


def test_bands_and_exact(spark):
    bounds = [(95, "a"), (80, "b")]
    assert one(spark, [None, 96.0, 95.0, 0.0], T.band("c", bounds, "z"), "double") == ["none", "a", "b", "z"]
    df = spark.createDataFrame([(None, None), (100.0, False), (99.9, True), (0.0, False)], "s double, b boolean")
    assert [r[0] for r in df.select(T.is_exact("s", "b")).collect()] == [False, True, True, False]


def test_percent_of_nothing(spark):
    df = spark.createDataFrame([(0, 0), (1, 4)], "a bigint, b bigint")
    assert [r[0] for r in df.select(T.percent_of(F.col("a"), F.col("b"))).collect()] == [0.0, 25.0]


def test_leading_directives(spark):
    assert one(spark, [".section .text\n\n.set noat\naddiu\n.end\n", "nop\n"], T.without_leading_directives("c")) == ["addiu\n.end\n", "nop\n"]


def test_template(spark):
    df = spark.createDataFrame([("27BDFFE0AFBF0014",), ("0AFBF001400000000",)], "c string")
    assert [r[0] for r in df.select(T.template_match("c", "AFBF ????")).collect()] == [True, False]


def test_hash_splits(spark):
    # blake2s of 8 bytes and md5 of the same text, by hashlib
    import hashlib

    got = spark.createDataFrame([("seed:p/f",), (None,)], "c string").select(blake2s_unit("c"), md5_unit("c")).collect()
    assert got[0][0] == int.from_bytes(hashlib.blake2s(b"seed:p/f", digest_size=8).digest(), "big") / 2**64
    assert got[0][1] == int(hashlib.md5(b"seed:p/f").hexdigest()[:8], 16) / 2**32
    assert got[1][0] is None and got[1][1] is None


SOURCE = """#include "a.h"
s32 f(s32 a);
s32 g(void) { return 1; }

/* about f */
static inline
s32 f(s32 (*a)(int)) {
    if (a) { return "}"[0] - '}'; }
}
void func_80001000(void) {
}
void func_80001004(s32 x) { x++; }
"""


def test_definition():
    # brackets in strings are counted like any other, so the literal ends the body early
    assert find_definition(SOURCE, "f").startswith("/* about f */\nstatic inline\ns32 f(s32 (*a)(int)) {")
    assert find_definition(SOURCE, "g") == "s32 g(void) { return 1; }\n"
    assert find_definition(SOURCE, "h") is None and find_definition(None, "f") is None and find_definition("f(", "f") is None


def test_bodies_and_replacement():
    assert [n for n, _ in bodies(SOURCE)] == ["func_80001004"]
    text = 'INCLUDE_ASM("asm", func_1);\nvoid func_2(void) { a(); }\n'
    assert replace_function(text, "func_1", "X") == "X\nvoid func_2(void) { a(); }\n"
    assert replace_function(text, "func_2", "Y") == 'INCLUDE_ASM("asm", func_1);\nY\n'
    assert replace_function(text, "func_3", "Z") is None


@pytest.mark.parametrize("n", [0, 3])
def test_first_rows(spark, n):
    df = spark.createDataFrame([(["a"] * n,)], "c array<string>")
    assert df.select(T.first_rows("c", 2)).first()[0] == (["a", "a", "... (3 diffs)"] if n == 3 else [])


def test_variants(spark):
    from quarry.functions import variant as V

    texts = ['{"a": 1, "a": "x"}', '{"a": NaN, "b": -Infinity}', '{"a": 1} tail', '{"a": [1]}]', '{"a": 1},{"b": 2}', "", None, "[]", '{"a": {"k": null}, "b": 0.0, "c": "false"}', "5,0"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    j = V.with_json(df, "t", "j")
    rows = {r["i"]: r for r in j.select("i", F.to_json("j").alias("j"), V.has("j", "a").alias("has"), *[V.filled(V.get("j", k)).alias(k) for k in "abc"], V.string(V.get("j", "c")).alias("s"), V.number(V.get("j", "b")).alias("n")).collect()}
    assert rows[0]["j"] == '{"a":"x"}' and rows[1]["j"] == '{"a":null,"b":null}' and rows[7]["j"] == "[]"
    assert [i for i, r in rows.items() if r["j"] is None] == [2, 3, 4, 5, 6, 9]
    assert rows[8]["a"] and not rows[8]["b"] and rows[8]["c"] and rows[8]["s"] == "false" and rows[8]["n"] == 0.0
    assert rows[1]["has"] and not rows[1]["a"] and not rows[7]["has"]


def test_times_entries_and_hits(spark):
    df = spark.createDataFrame([("2024-01-05T10:00:00.5Z", "2024-01-05T12:00:01+02:00", "x\n## One two!\n\n_Sum._\n\nbody\n## B\nno _s_\n")], "a string, b string, t string")
    r = df.select(T.stamp(T.time_of("a")).alias("s"), T.elapsed_ms(T.time_of("a"), T.time_of("b")).alias("ms"), T.entries("t").alias("e"), T.hits("t", "^##").alias("h"), T.time_of("t").alias("none")).first()
    assert r["s"] == "20240105_100000" and r["ms"] == 500 and r["none"] is None
    assert [(e["title"], e["summary"], e["anchor"]) for e in r["e"]] == [("One two!", "Sum.", "one-two"), ("B", None, "b")]
    assert [(h["line_no"], h["line"]) for h in r["h"]] == [(2, "## One two!"), (7, "## B")]

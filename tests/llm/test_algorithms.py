"""Splits, survivors, mixing, spam pages and the tokenizer, against brute force, libraries or held-out accuracy."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import components, group_splits, mixing, spam_pages, survivors, tokenizer

VOCABULARY = tokenizer.vocabulary("byte_bpe_50k")


# --- components and splits ---------------------------------------------------------


def closed(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in up}


@pytest.mark.parametrize("kind", ["random", "path", "star", "loops"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = {
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)], "path": [(i, i + 1) for i in range(120)] + [(500, 501)],
        "star": [(0, i) for i in range(1, 300)] + [(i, 0) for i in range(1, 50)], "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
    }[kind]
    df = spark.createDataFrame([*edges, (None, 3)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    want = closed([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components.components(df.limit(0)).count() == 0


EPISODES = "episode_id bigint, function_name string, project string, metadata string, keep string"
M = json.dumps
ROWS = [
    (1, "F_1", "P", M({"source_path": "src/a.c"}), ""), (2, " f_1.NON_MATCHING ", "p ", None, ""), (3, "g", "p", M({"source": {"path": "/w/x/projects/p/src//b/../a.c"}}), ""),
    (4, "h", "p", M({"former_name": "G"}), ""), (5, "h", "q", M({"source_path": "src/a.c"}), ""), (6, "i", "p", M({"symbol_name": "nobody"}), ""), (7, "j", "p", M({"previous_names": ["nobody", None, 3]}), ""),
    (8, None, "p", M({"source_path": "src/a.c"}), ""), (9, "k", None, None, ""), (10, "l", "p", '{"source_path": "src/a.c"', ""), (11, "m", "p", M({"source_path": "projects/q/src/a.c"}), ""),
    (12, "n", "p", M(M({"source_path": ".\\src\\a.c"})), ""), (13, "o", "p", M({"source_path": "../p2/a.c"}), ""), (14, "", "p", "[]", ""), (15, "h", "q", "null", ""),
]


def test_groups(spark):
    df = spark.createDataFrame(ROWS, EPISODES).withColumn("key", F.lit("clash"))
    got = {r["episode_id"]: r["group_key"] for r in group_splits.found_groups(df).collect()}
    assert got == {i: "p/f_1" for i in (1, 2, 3, 4, 12)} | {5: "q/h", 15: "q/h"}
    assert group_splits.found_groups(df.limit(0)).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(4)
    rows = [(i, f"f{rng.randrange(900) if rng.random() < 0.7 else 0}" if rng.random() < 0.98 else None, "p", None, "") for i in range(4000)]
    out = group_splits.assign(spark.createDataFrame(rows, EPISODES), [("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", 0.0)]).collect()
    assert len(out) == 4000 and {r["split_name"] for r in out} == {"train", "validation", "test"}
    per = {}
    for r in out:
        if r["group_key"]:
            per.setdefault(r["group_key"], set()).add(r["split_name"])
    assert all(len(s) == 1 for s in per.values())
    share = {n: sum(r["split_name"] == n for r in out) / 4000 for n in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["validation"] - 0.1) < 0.01
    assert group_splits.assign(spark.createDataFrame([], EPISODES), [("train", 1.0)]).count() == 0


# --- survivors -----------------------------------------------------------------------

RECORDS = "episode_id bigint, project string, function_name string, outcome string, best_match_percent double, end_time string, model string, metadata string"


def test_preferred(spark):
    rows = [
        (1, "P", "f", "partial!", 99.0, "2024-01-01T00:00:00", "m", None), (2, "p", "F ", "MATCH.", float("nan"), "1704067200", "m", None), (3, "p", "f", "match", 250.0, "1704067200001", "m", None),
        (4, "p", "f.NON_MATCHING", "failed;", 99.0, "n/a", "m", None), (5, "p", "g", None, None, None, "m", None), (6, "p", "g", "?", -1.0, "0000-00-00T00:00:00", None, None),
        (7, "p", "h", "match", 1.0, None, "m", None), (8, None, "h", "match", 1.0, None, "m", None), (9, "p", " ", "match", 1.0, None, "m", None),
        (10, "q", "t", "in-complete", 5.0, "2024-01-01T01:00:00+02:00", "m", None), (11, "q", "t", "incomplete", 5.0, "2023-12-31 23:30:00", "m", None),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    got = {(r["project"], r["function_name"]): (r["keep_id"], r["percent_id"], r["end_id"]) for r in survivors.best_records(df).collect()}
    assert got == {("p", "f"): (3, 1, 3), ("p", "g"): (5, -1, -1), ("q", "t"): (11, 10, 11)}
    assert survivors.best_records(df.limit(0)).count() == 0


def test_times(spark):
    values = {"2024-01-01T00:00:00.123456Z": 1704067200123456, " 2024-01-01 00:00:00 ": 1704067200000000, "1704067200": 1704067200000000, "1704067200123": 1704067200123000, "2024-01-01T05:30:00+05:30": 1704067200000000, "2024-01-01T00:00:00+0000": 1704067200000000, "": None, "n/a": None, "2024-13-01T00:00:00": None, "12:00": None, "now": None}
    df = spark.createDataFrame([(k,) for k in values], "t string")
    assert [r[0] for r in df.select(survivors.epoch_micros("t")).collect()] == list(values.values())


def test_two_sided_model_finds_true_values_and_bad_sources(spark):
    rng = random.Random(7)
    quality = {"good": (0.95, 0.98), "fair": (0.8, 0.95), "keen": (0.95, 0.6), "lazy": (0.5, 0.98), "fine": (0.9, 0.97)}
    rows, truth = [], {}
    for e in range(400):
        true, false = {f"t{e}_{k}" for k in range(rng.choice([1, 2]))}, {f"w{e}_{k}" for k in range(2)}
        truth |= {v: True for v in true} | {v: False for v in false}
        for s, (sens, spec) in quality.items():
            rows += [(str(e), s, "field", v) for v in true if rng.random() < sens] + [(str(e), s, "field", v) for v in false if rng.random() > spec]
    model = survivors.TwoSided(spark.createDataFrame(rows, "e string, source string, field string, value string"), ["e"])
    facts = {r["value"]: r["p_true"] for r in model.facts.collect()}
    right = np.mean([(p >= 0.5) == truth[v] for v, p in facts.items()])
    q = {r["source"]: (r["sensitivity"], r["specificity"]) for r in model.quality.collect()}
    assert right > 0.93 and q["keen"][1] < min(q[s][1] for s in ("good", "fair", "lazy", "fine")) and q["lazy"][0] == min(x[0] for x in q.values())


# --- tokenizer -------------------------------------------------------------------------

TEXTS = [None, "", " ", "\n\n  \t x", "don't I'll 12345 a1b2", "naïve café — 日本語 😀​", "<|endoftext|> plain", "a" * 3000, "\x00\x1c\x85 ", "﻿Ã©", "word " * 400_000, "don't"]


def test_ids_against_libraries(spark):
    import tiktoken
    from tokenizers import Tokenizer

    e = tokenizer.Encoder(VOCABULARY)
    reference = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks={t: i for i, t in enumerate(e.tokens)}, special_tokens={})
    got = e.encode(TEXTS)
    assert [x.tolist() for x in got] == [reference.encode_ordinary(t) if t else [] for t in TEXTS]
    assert [e.decode(x) for x in got] == [t or "" for t in TEXTS]
    other = Tokenizer.from_file(os.path.join(tokenizer.TOKENIZERS, "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    assert [x.tolist() for x in got] == [other.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids array<int>").repartition(2)
    assert {r["doc_id"]: r["ids"] for r in tokenizer.encode_column(df, "doc_id", "text", VOCABULARY).collect()} == {i: x.tolist() for i, x in enumerate(got)}
    assert tokenizer.encode_column(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0


def test_random_text_round_trip():
    rng = random.Random(1)
    e = tokenizer.encoder(VOCABULARY)
    texts = ["".join(rng.choice("ab 1\n\té世😀'sßÅ_;") for _ in range(rng.randrange(60))) for _ in range(500)]
    assert [e.decode(x) for x in e.encode(texts)] == texts


def test_other_vocabulary():
    e = tokenizer.Encoder(tokenizer.vocabulary("byte_bpe_multi_50k"))
    assert e.decode(e.encode(["größe 日本 x"])[0]) == "größe 日本 x"


# --- mixing ------------------------------------------------------------------------------


def documents(spark, n=600):
    rng = random.Random(3)
    kinds = {"prose": "the load of that slot is kept until loop ends and we".split(), "code": "s32 void ( ) { } ; if else return arg0 ->".split(), "log": "match rename split decompile audio menu 12 34".split()}
    rows = []
    for i in range(n):
        s = rng.choice(["prose"] * 6 + ["code"] * 3 + ["log"])
        rows.append((i, " ".join(rng.choice(kinds[s]) for _ in range(rng.randrange(5, 80))), {"prose": "Prose "}.get(s, s) if i % 3 else s, "x"))
    return spark.createDataFrame([*rows, (n, None, "log", ""), (n + 1, "", "log", ""), (n + 2, "text", None, ""), (n + 3, "text", "unlisted", "")], "doc_id bigint, text string, source string, tokens string")


def test_mixture(spark):
    m = mixing.Mixture(documents(spark), [("prose", 0.5, 1), ("code", 0.2, 2), (" LOG", 0.3, 3), ("absent", 0.1, 2), ("zero", 0.0, 3), (None, None, None)], VOCABULARY)
    s = {x["source"]: x for x in m.shares}
    for name, want in (("prose", 0.5), ("code", 0.2), ("log", 0.3)):
        assert abs(s[name]["share"] - want) < 0.01
    assert s["absent"]["share"] == 0 and s["prose"]["most_copies"] <= 1 and s["code"]["most_copies"] <= 2 and s["log"]["most_copies"] <= 3
    rows = m.documents.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(r["doc_id"] < 600 for r in rows)
    assert sum(r["copies"] * r["tokens"] for r in rows) == sum(x["tokens"] for x in m.shares)


def test_mixture_too_large_says_so(spark):
    m = mixing.Mixture(documents(spark, 200), [("prose", 0.5, 1), ("log", 0.5, 1)], VOCABULARY, size=1e7)
    assert all(x["tokens"] <= x["available_tokens"] for x in m.shares)
    nothing = mixing.Mixture(documents(spark, 200).limit(0), [("prose", 0.5, 1)], VOCABULARY)
    assert nothing.documents.count() == 0 and nothing.shares[0]["share"] == 0


def test_classifier_on_held_out(spark):
    d = documents(spark)
    names = ["prose", "code", "log"]
    model = mixing.fit(d, names, odd=True)
    rest = d.where(F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).select(mixing.normal_source().alias("s"), "text").where(F.col("s").isin(names) & (F.col("text") != "")).collect()
    assert np.mean([names[int(np.argmax(model.posterior(r["text"])))] == r["s"] for r in rest]) > 0.95


# --- spam pages ----------------------------------------------------------------------------

PROSE = "The first argument is passed on untouched, which is why it looks odd. We measured {} words before the change and {} after it. The load sits in the delay slot of the branch. Nobody has found a shape that emits this order. Remember to rebuild the object before you trust it."
SPAM = [
    "cheap rom hack\n" * 30, "# best pages\n\n" + ", ".join(f"buy rom hack {w}" for w in "now cheap online free best top full fast".split()) + "\n", " ".join(f"#romhack{i} #freeroms" for i in range(20)),
    "\n".join(f"https://www.site{i}.example/a/b-{i}" for i in range(12)), "\n".join(f"- [Title {i}](http://x{i}.example/p)" for i in range(10)), "Rom Hack | SKU 12345 | 12.99 | new\n" * 12,
    "It took many attempts to see this at last.\n\n" + "cheap rom hack | " * 20, "<html><body>" + "".join(f'<a href="http://x.example/{i}">t {i}</a> ' for i in range(12)),
    "ch​eap r0m hack " * 30, "rom hack (12), save editor (33), " * 8,
]
CLEAN = [
    None, "", " \n ", "Too short.", PROSE.format(1, 2) + "\n" + "\n".join(f"* https://a.example/{i}" for i in range(5)), PROSE.format(3, 4) + "\n\nTags: rom, hack, editor",
    "glabel f\n" + "/* 000010 80000010 27BDFFE0 */  addiu $sp, $sp, -0x20\n" * 30, "s32 f(s32 a) {\n    return a;\n}\n" * 9, "| function | size | percent |\n" + "| func_80001234 | 0x20 | 12.50 |\n" * 20,
    "abcd1234 Match func_80001234 (menu)\n" * 12, "\n".join(f"slot {i}: The load of slot {i} is kept in the loop until it ends." for i in range(9)), "user wrote:\nThis works for the menu code only. See http://a.example/b",
    "* pollCrest: 97.90% -> 100%\n" * 9, "変更前は 60 語、変更後は 4 語が違っていた。キャストがないと全体が一つずれる。" * 3,
]


def test_spam_pages(spark):
    texts = [PROSE.format(i, i + 1) * (1 + i % 3) for i in range(80)] + SPAM + CLEAN
    df = spark.createDataFrame([(i, t, [None, "en", " EN-us", "xx"][i % 4], "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, spam string").repartition(3)
    rows = spam_pages.judged(df).collect()
    assert {r["doc_id"] for r in rows if r["spam"]} == set(range(80, 80 + len(SPAM)))
    assert len(rows) == len(texts) - 3  # pages without text have no figures
    assert sum(r["candidate"] for r in rows if r["doc_id"] < 80) < 20


def test_spam_without_prose(spark):
    df = spark.createDataFrame(list(enumerate(SPAM)), "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    assert {r["doc_id"] for r in spam_pages.judged(df).where("spam").collect()} == set(range(len(SPAM)))
    assert spam_pages.judged(df.limit(0)).count() == 0


def test_queries_run(spark, data):
    from quarry.llm import queries

    from ..oracle import connect, rows

    duck = connect(data)
    for name, f in queries.QUERIES.items():
        got = f(spark, data).toPandas()
        assert len(got) > 0, name
        if name in queries.SQL:
            assert rows(got) == rows(duck.execute(queries.SQL[name]).df())


def test_long_words_have_counters_of_their_own():
    words = ["逆コンパイルの手順" + x for x in "一二三四五六"] + ["a_long_prefix_of_many_identifiers_" + x for x in "abcdef"]
    known = spam_pages.Words()
    assert len({spam_pages.bucket(known.of(w)[0]) for w in words}) > 10
    assert known.of("Save")[0] == known.of("save")[0] == known.of("#save")[0]


NOUNS = "load slot branch loop shape object register frame header caller struct macro table switch label offset word pointer symbol segment listing compiler listener value member field block stack line page".split()
VERBS = "keeps moves reads emits clears shares spills unrolls replaces follows precedes touches loads stores rebuilds splits merges counts".split()


def prose_page(rng):
    one = lambda: f"{rng.choice(['The', 'A', 'Each', 'This'])} {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.choice(['the', 'a', 'its'])} {rng.choice(NOUNS)} {rng.choice(['before', 'after', 'when', 'because', 'while'])} the {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.choice(['it', 'them', 'nothing'])}."
    return " ".join(one() for _ in range(rng.randrange(4, 24)))


def made_pages(rng):
    """(text, is spam) of many kinds: any domain, currency, percentage, article number and script."""
    things = ["rom hack", "iPhone case", "save editor", "レベル エディタ", "чехол телефон", "Spielstand Editor"]
    more = "cheap free best online buy full official latest top deals review fast".split()
    tlds = "com net example shop xyz museum de co.jp онлайн".split()
    out = []
    for i in range(60):
        a, b = rng.sample(things, 2)
        host = f"shop{i}.{rng.choice(tlds)}"
        phrase = lambda: f"{rng.choice(more)} {rng.choice((a, a, b))} {rng.choice(more)}"  # noqa: B023, E731
        money = rng.choice(["€", "$", "円", "₽"])
        kinds = [
            "; ".join(phrase() for _ in range(25)), "\n".join(f"{phrase()} | {rng.randrange(10**7, 10**8)} | {rng.randrange(5, 99)}.99 {money} | {rng.randrange(5, 90)}% off" for _ in range(15)),
            "\n".join(f"https://{host}/{k}/p-{rng.randrange(999)}.html" for k in range(14)), "\n".join(f"{k}. {phrase()} » {host}/item/{k}" for k in range(14)),
            " ".join(f"#{x.replace(' ', '')}" for x in (phrase() for _ in range(25))), "。".join(f"{a}{rng.choice(['無料', '格安', '最新'])}" for _ in range(30)) + "。",
            ". ".join(f"{a.capitalize()} {rng.choice(more)} with {phrase()} for {a} {rng.choice(more)} and {a}" for _ in range(12)) + ".", phrase().title() + "\n" + ",\n".join(f"{phrase()};" for _ in range(25)),
        ]
        out.append((kinds[i % len(kinds)], True))
    for i in range(12):
        name = f"read{rng.choice('ABCDEF')}lot{i}"
        out += [
            ("\n".join(f"| func_80{rng.randrange(16**6):06X} | 0x{rng.randrange(999):X} | {rng.randrange(100)}.5% |" for _ in range(20)), False), (f"s32 {name}(s32 a, s32 b) {{\n    if (a == b) {{\n        return p->slot{i};\n    }}\n}}\n" * 3, False),
            ("\n".join(f"{rng.randrange(16**8):08x} Match {name}{k} (menu)" for k in range(9)), False), (PROSE.format(i, 2 * i) + "\n\nSee also:\n" + "\n".join(f"https://a.example/{i}/{k}" for k in range(6)), False),
            ("\n".join(f"slot {k}: The load of slot {k} is kept in the loop until it ends." for k in range(9)), False), ("\n".join(f"/* {k:06X} 80{k:06X} {rng.randrange(16**8):08X} */  lw $t{k % 9}, 0x{k:X}($sp)" for k in range(30)), False),
        ]
    return out


def test_spam_of_any_domain_currency_and_script(spark):
    rng = random.Random(11)
    prose = [prose_page(rng) for _ in range(240)]
    made = made_pages(rng)
    texts = [(t, False) for t in prose] + made
    df = spark.createDataFrame([(i, t, ["en", None, "sv"][i % 3]) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(3)
    rows = spam_pages.judged(df).toPandas()
    spam = {i for i, (_, x) in enumerate(texts) if x}
    got = set(rows.doc_id[rows.spam])
    assert len(spam & got) >= 0.95 * len(spam) and len(got - spam) <= 2, (sorted(spam - got), sorted(got - spam))
    # stuffed pages have the form of prose: only their curves tell
    fluent = {i for i in spam if (i - len(prose)) % 8 == 6}
    assert fluent <= got and set(rows.doc_id[rows.stuffed]) >= fluent
    assert not set(rows.doc_id[(rows.sentences >= 2) & ~rows.stuffed]) & got


def test_curves_decide(spark, monkeypatch):
    rng = random.Random(11)
    texts = [prose_page(rng) for _ in range(100)] + [t for t, _ in made_pages(rng)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    with_curves = spam_pages.judged(df).where("spam").count()
    monkeypatch.setattr(spam_pages, "EXTREME", 1e9)
    monkeypatch.setattr(spam_pages, "FAR", 1e9)
    assert spam_pages.judged(df).where("spam").count() == 0 < with_curves


def test_wrongly_decoded_text_is_read():
    right = "変更前は 60 語、変更後は 4 語が違っていた。"
    assert spam_pages.plain(right.encode().decode("latin-1")) == spam_pages.plain(right)
    assert spam_pages.plain("café ‘x’") == "café ‘x’"

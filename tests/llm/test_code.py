"""Near duplicates and cross-split overlaps against brute force; tokens against a plain regular expression."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import near_duplicates, rarity, split_overlap
from quarry.llm.code_tokens import PIECE, jaccard, shingles, token_hashes, windows

TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\s\w]")
REMARK = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*", re.S)


def plain_tokens(text):
    return TOKEN.findall(REMARK.sub(" ", text))


def plain_alike(a, b):
    x, y = ({tuple(t[i : i + 3]) for i in range(max(1, len(t) - 2))} if (t := plain_tokens(s)) else set() for s in (a, b))
    return bool(x and y) and 2 * len(x & y) >= len(x | y)


WORDS = ["alpha", "beta", "gamma", "if", "(", ")", "{", "}", ";", "=", "+", "0x1F", "3.5f", "->", "unk12", "x", "y", "z", "return"]


def make(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(500)) if rng.random() < 0.5 else "") for _ in range(n))


def edit(rng, text, share):
    t = text.split(" ")
    for _ in range(int(len(t) * share)):
        t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
    return " ".join(t)


def corpus(seed=1):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        base = make(rng, rng.choice([8, 20, 60, 200]))
        texts += [base, base, "/* a remark */\n" + base.replace(" ", "\n"), edit(rng, base, 0.03), edit(rng, base, 0.08), edit(rng, base, 0.3)]
    family = make(rng, 120)
    texts += [edit(rng, family, 0.02) for _ in range(90)]
    return texts + [None, "", "  \n", "/* only */", "// only", "a", "a", "a b", "a b", "b", "a b c", "x" * (PIECE + 5), make(rng, PIECE // 4)]


def test_tokens():
    rng = random.Random(3)
    texts = [make(rng, 50) for _ in range(40)] + ['s = "/* no remark */ // nor this";', "a.b arg0.c 1.5e3 .5 3. x->y", "ü = größe;", "a//b\nc/*d*/e/*"]
    known = {}
    for t, (_, h) in zip(texts, token_hashes(texts)):
        want = plain_tokens(t) if '"' not in t else None
        if want is not None:
            assert len(want) == len(h)
            for a, b in zip(want, h.tolist()):
                assert known.setdefault(a, b) == b
    assert len(set(known.values())) == len(known)


def test_long_texts_are_whole():
    rng = random.Random(5)
    text = make(rng, PIECE // 3)
    (_, whole), = token_hashes([text])
    assert len(whole) == len(plain_tokens(text)) and np.array_equal(whole[-40:], next(token_hashes([" ".join(text.split(" ")[-60:])]))[1][-40:])


def test_bound_never_below_overlap():
    rng = np.random.default_rng(1)
    for n, m in ((5, 9), (60, 100), (190, 200), (300, 600), (64, 64)):
        both = rng.integers(0, 2**63, n // 2, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, k - n // 2, dtype=np.uint64)])) for k in (n, m))
        maps = near_duplicates.Bitmaps([near_duplicates.bitmap(a), near_duplicates.bitmap(b)])
        la, lb = maps.lacking(np.array([0]), np.array([1]))
        assert min(len(a) - la[0], len(b) - lb[0]) >= len(np.intersect1d(a, b))


def test_near_duplicates(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, t if i % 2 else None, "clash") for i, t in enumerate(texts)], "episode_id bigint, final_source string, initial_m2c_source string, field string").repartition(3)
    got = near_duplicates.found_pairs(near_duplicates.NearDuplicates(df, "episode_id", ["final_source", "initial_m2c_source"])).collect()
    assert len(got) == len(set(got))
    want = {(a, b) for (a, x), (b, y) in combinations(enumerate(texts), 2) if x and y and plain_alike(x, y)}
    assert {(r["id_a"], r["id_b"]) for r in got if r["field"] == "final_source"} == want
    assert {(r["id_a"], r["id_b"]) for r in got if r["field"] == "initial_m2c_source"} == {(a, b) for a, b in want if a % 2 and b % 2}
    groups = {r["id"]: r["group_id"] for r in near_duplicates.grouped(near_duplicates.NearDuplicates(df, "episode_id", ["final_source"])).collect()}
    assert sorted(groups) == [i for i, t in enumerate(texts) if t and plain_tokens(t)]
    assert all(groups[a] == groups[b] <= a for a, b in want) and len(set(groups.values())) > 20


def test_blocks_of_a_common_key_lose_nothing(spark, monkeypatch):
    texts = [t for t in corpus() if t]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    want = sorted(near_duplicates.found_pairs(near_duplicates.NearDuplicates(df, "id", ["t"])).collect())
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    monkeypatch.setattr(split_overlap, "BLOCK", 8)
    assert sorted(near_duplicates.found_pairs(near_duplicates.NearDuplicates(df, "id", ["t"])).collect()) == want


def test_near_duplicates_within_a_hot_family(spark):
    rng = random.Random(5)
    base = [f"v{k}" for k in range(450)]
    texts = [" ".join([*base, f"own{k}"]) for k in range(300)]
    for k in range(40):  # single tokens put in by turns 7 and 8 apart: similarity is above one half, two thirds of the windows are the text's own
        texts.append(" ".join(t for j, x in enumerate(base, rng.randrange(15)) for t in ([x, f"n{k}_{j}"] if j % 15 in (0, 7) else [x])))
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    got = {(r["id_a"], r["id_b"]) for r in near_duplicates.found_pairs(near_duplicates.NearDuplicates(df, "id", ["t"])).collect()}
    want = {(a, b) for b in range(300, 340) for a in range(0, 300, 30) if plain_alike(texts[a], texts[b])}
    assert len(want) > 200 and want <= got


def test_near_duplicates_reordered_in_small_pieces(spark):
    """Pairs that share two thirds of their shingles, but few windows of six tokens: none may be left to chance."""
    rng = random.Random(6)
    texts = []
    for k in range(120):
        tokens = [f"t{k}_{i}" for i in range(200)]
        pieces = [tokens[i : i + 5] for i in range(40, 200, 5)]
        rng.shuffle(pieces)
        texts += [" ".join(tokens), " ".join(tokens[:40] + [t for p in pieces for t in p])]
    assert all(plain_alike(texts[k], texts[k + 1]) for k in range(0, len(texts), 2))
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    got = {(r["id_a"], r["id_b"]) for r in near_duplicates.found_pairs(near_duplicates.NearDuplicates(df, "id", ["t"])).collect()}
    assert got == {(k, k + 1) for k in range(0, len(texts), 2)}


def test_near_duplicates_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, ""), (2, " ")]):
        df = spark.createDataFrame(rows, "id bigint, t string")
        assert near_duplicates.found_pairs(near_duplicates.NearDuplicates(df, "id", ["t"])).count() == 0


def test_keys_of_a_large_family():
    counts = np.zeros(rarity.BUCKETS, np.int64)
    items = np.arange(1, 101, dtype=np.uint64) << np.uint64(44)
    counts[rarity.bucket(items)] = 5000
    rare = rarity.Rarity(counts)
    keys, klass = rare.keys(items, 20, items, 1 / 3)
    assert len(keys) == 20 and (klass > 0).all()


def test_chunks_cover_everything():
    (_, t), = token_hashes([make(random.Random(2), 300)])
    d, covers = split_overlap.chunks(t)
    assert covers.sum() == len(t)
    e, more = split_overlap.chunks(t[40:])  # cut off in front: only chunks near the cut change
    assert more[np.isin(e, d)].sum() > 0.8 * (len(t) - 40)


SPLITS = ["train", " Train", "TRAIN\n", "eval", "test ", "dev", None, "", "  "]


def test_split_overlap(spark):
    texts = corpus(4)
    rng = random.Random(9)
    rows = [(i, rng.choice(SPLITS), t, "s", "p") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "record_id bigint, split string, final_source string, source_schema string, project string").repartition(3)
    so = split_overlap.SplitOverlap(df, "record_id", "final_source")
    got = [tuple(sorted((r["train_id"], r["eval_id"]))) for r in split_overlap.found_pairs(so).collect()]
    side = lambda s: None if not s or not s.strip() else s.strip().lower() == "train"
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if a[2] and b[2] and None not in (side(a[1]), side(b[1])) and side(a[1]) != side(b[1]) and plain_alike(a[2], b[2])}
    assert len(got) == len(set(got)) and set(got) == want
    rep = split_overlap.report(so, df, "record_id", ["split", "source_schema", "project"]).collect()
    assert sum(r["pairs"] for r in rep) == len(want) and sum(r["records"] for r in rep) == sum(side(r[1]) is False for r in rows)
    empty = split_overlap.SplitOverlap(df.limit(0), "record_id", "final_source")
    assert split_overlap.found_pairs(empty).count() == 0


def test_split_overlap_of_long_records(spark):
    rng = random.Random(3)
    rows = []
    for n, rate in ((4_000, 0.1), (20_000, 0.03), (20_000, 0.1)):
        a = [f"v{rng.randrange(5000)}" for _ in range(n)]
        b = [f"w{rng.randrange(5000)}" if rng.random() < rate else x for x in a]
        rows += [(len(rows), "train", " ".join(a)), (len(rows) + 1, "eval", " ".join(b))]
    assert all(plain_alike(rows[k][2], rows[k + 1][2]) for k in (0, 2, 4))
    df = spark.createDataFrame(rows, "record_id bigint, split string, final_source string")
    got = split_overlap.found_pairs(split_overlap.SplitOverlap(df, "record_id", "final_source")).collect()
    assert sorted((r["train_id"], r["eval_id"]) for r in got) == [(0, 1), (2, 3), (4, 5)]


def test_split_overlap_of_repeated_parts(spark):
    rng = random.Random(4)
    body = [f"v{rng.randrange(900)}" for _ in range(300)]
    row, zeros = [f"r{k}" for k in range(12)], ["0", ","] * 2
    texts = [" ".join(body + row * 2), " ".join(body + row * 600), " ".join(body + zeros), " ".join(body + zeros * 3000)]
    assert plain_alike(texts[0], texts[1]) and plain_alike(texts[2], texts[3])
    df = spark.createDataFrame([(k, ["train", "eval"][k % 2], t) for k, t in enumerate(texts)], "record_id bigint, split string, final_source string")
    got = split_overlap.found_pairs(split_overlap.SplitOverlap(df, "record_id", "final_source")).collect()
    assert sorted((r["train_id"], r["eval_id"]) for r in got) == [(a, b) for a in (0, 2) for b in (1, 3) if plain_alike(texts[a], texts[b])]


def test_windows_and_shingles_of_short_texts():
    (_, a), (_, b) = token_hashes(["a b", "a b c d"])
    assert len(shingles(a)) == 1 and len(shingles(b)) == 2 and len(windows(b, 6)) == 1 and jaccard(shingles(a), shingles(a)) == 1.0
    assert jaccard(shingles(a), a[:0]) == 0.0


@pytest.mark.parametrize("field", ["final_source", "initial_m2c_source"])
def test_on_the_tables(spark, data, field):
    rows = [(r["episode_id"], r[field]) for r in spark.read.parquet(f"{data}/episodes.parquet").select("episode_id", field).collect()]
    sets = {rows[i][0]: shingles(t) for i, t in token_hashes([t for _, t in rows]) if len(t)}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.5}
    nd = near_duplicates.NearDuplicates(spark.createDataFrame(rows, "episode_id bigint, t string"), "episode_id", ["t"])
    assert {(r["id_a"], r["id_b"]) for r in near_duplicates.found_pairs(nd).collect()} == want


def test_counters_are_added_up_in_two_steps(spark, monkeypatch):
    from quarry.llm import rarity

    rng = np.random.default_rng(5)
    per = rarity.BUCKETS // rarity.SLICES
    parts = [(int(k), rng.integers(0, 9, per).astype(np.uint32)) for k in [0, 0, 0, 0, 0, 3, 3]]
    rows = spark.createDataFrame([(k, c.tobytes()) for k, c in parts], "slice int, counts binary")
    want = np.zeros(rarity.BUCKETS, np.int64)
    for k, c in parts:
        want[k * per : (k + 1) * per] += c
    assert (rarity.total(rows) == want).all()
    monkeypatch.setattr(rarity, "FAN", 2)
    assert (rarity.total(rows) == want).all()
    assert rarity.total(rows.limit(0)).sum() == 0


def test_report_counts_what_pairs_would(spark, data):
    from quarry.llm import queries

    pairs = split_overlap.found_pairs(queries._split_overlap(spark, data))
    assert queries.p6_report(spark, data).agg(F.sum("pairs")).first()[0] == pairs.count()
    assert queries.p6_report(spark, data).agg(F.sum("overlapping")).first()[0] == pairs.select("eval_id").distinct().count()

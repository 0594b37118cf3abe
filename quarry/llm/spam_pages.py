"""Pages of repeated keywords, of links, or of product and topic tags in place of sentences.

1. A narrow pass reads each text once: its words with their counts, and what it is made of: sentences,
   links, and the words left over outside sentences.
2. Rank-frequency curves, with SQL windows: a page's words are ranked by count, and a line is fitted to log
   count over log rank. The figures of a page are its slope, the spread around the line, and the
   divergence of its words from those of same-language prose (relative entropy, in bits a word).
3. Each figure is held against that of prose of the same language and of comparable length, in units of
   the spread there. Prose is what has four sentences or more and little else, so nothing needs labels. Medians
   and quartiles are used, and pages of extreme slope teach neither the word statistics nor the
   measure, so stuffed pages among the prose don't hide each other.
4. The curves decide which pages may be spam, in two ways, and a check of what the page is made of follows.
   A *list* is extreme in any figure, has one sentence at most, and what is left outside it is words or links, but not
   names and numbers of machines (:data:`_MACHINE`). A *stuffed* page may have the form of prose, but is too steep
   and FAR too divergent at once: its sentences are strings of the same few keywords.

The page is the unit of every shuffle: its counts move once, and the curve is fitted where they arrive. Word
statistics of prose are BUCKETS counters for each of SLOTS languages, a table of fixed size. Statistics of a
language are blended with those of all languages by a fixed weight (PRIOR_WORDS, PRIOR_PAGES), and
those of a length with those of all lengths, so nothing switches with the size of the input.

Defined cases. Null, empty and blank texts are no spam. Zero-width characters, entities, compatibility forms and
markup are taken out before counting; of markup the quoted contents, titles and alternative texts stay. Repeated documents get the
same answer. A language is the first subtag in lower case, hashed to a slot; missing ones have a slot of their own.
Where there is no prose at all, every page is a candidate list and none is stuffed.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SLOTS, BUCKETS = 64, 1 << 14
#: How many words and pages the statistics of all languages (or lengths) count for beside those of one.
PRIOR_WORDS, PRIOR_PAGES = 2000, 30
#: How many spreads from prose make a figure extreme, and the divergence of a page of extreme slope decisive.
EXTREME, FAR = 2.0, 8.0
#: The least spread of each figure, for prose that is all alike.
LEAST = {"slope": 0.05, "residual": 0.03, "divergence": 0.35}
#: What must be left outside sentences of a list: words, a link counting LINK_WORDS of them.
MIN_LEFT, LINK_WORDS = 10, 3
#: The part of the distinct words left outside sentences that may be names and numbers of machines.
MOST_MACHINE = 0.3

_INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤﻿]")
_WRONG = re.compile("[\xc2-\xf4][^\x00-\x7f]+")
_TAG = re.compile(r"<[!/?A-Za-z][^<>]*>")
_SAID = re.compile(r"\b(?:content|title|alt)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)
#: A scheme, www, or a host of any domain with a path.
_LINK = re.compile(r"(?:\b[A-Za-z][A-Za-z0-9+.-]{1,15}://|\bwww\.)[^\s\"'<>)\]]+|(?<![\w@./-])(?:[\w-]{1,63}\.)+[^\W\d_]{2,24}/[^\s\"'<>)\]]*")
_MAY_LINK = re.compile(r"://|www\.|\.[^\W\d_]{2,24}/")
#: Where a stretch of text breaks off, and where a sentence ends within it.
_BREAK = re.compile(r"[\n\r|•]+")
_END = re.compile(r"(?<=[.!?])(?=[\s\"'»”)_*<`]|$)|(?<=[。！？])")
_WORD, _TAGGED = re.compile(r"\w+"), re.compile(r"#?\w+")
_NUMBERED = re.compile(r"\w*\d\w*")
#: Scripts that put no spaces between words.
_WIDE = re.compile("[฀-໿぀-ヿ㐀-鿿]")
#: Hex numbers, and names with an underscore or a capital inside; hashtags are none.
_MACHINE = re.compile(r"0[xX][0-9A-Fa-f]+|(?=\d*[A-Fa-f])(?=\D*\d)[0-9A-Fa-f]{6,}|[^\W_]+_\w*|_+\w+|\w*[a-z][A-Z]\w*")
LINK = zlib.crc32(b"://")
_OPERATORS = ("{", "}", "->", "==", "!=", "&&", "();")


def _decoded(m: re.Match) -> str:
    """A run of letters that are the bytes of UTF-8, read as such; else as it is."""
    for code in ("cp1252", "latin-1"):
        try:
            return m[0].encode(code).decode("utf-8")
        except UnicodeError:
            pass
    return m[0]


def plain(text: str) -> str:
    t = text
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", _WRONG.sub(_decoded, t)))
    return html.unescape(t) if "&" in t else t


def _said(m: re.Match) -> str:
    return " " + " ".join(a or b for a, b in _SAID.findall(m[0])) + " " if "=" in m[0] else " "


def is_sentence(s: str) -> bool:
    """Five words, or four long ones; in scripts without spaces two letters count as a word."""
    words = s.split()
    if len(words) >= 5:
        return len(s) >= 12
    if len(words) == 4 and len(s) > 24:
        return True
    return not s.isascii() and sum(len(_WIDE.findall(w)) or 2 for w in words) >= 10


class Words:
    """What is known of a word: a hash of its lower case, and whether it is a number or a machine's name. Kept, as words recur."""

    def __init__(self):
        self.known: dict[str, tuple[int, int, int]] = {}

    def of(self, word: str) -> tuple[int, int, int]:
        """(hash, 1 if it is no number, 1 if it is a machine's)."""
        k = self.known.get(word)
        if k is None:
            if len(self.known) > 300_000:
                self.known.clear()
            bare = word[1:] if word[0] == "#" else word
            named = not bare.isdigit()
            k = self.known[word] = (zlib.crc32(bare.lower().encode("utf-8", "replace")), int(named), int(named and bare is word and _MACHINE.fullmatch(word) is not None))
        return k


def read_page(text: str | None, words: Words | None = None) -> tuple[dict[int, int], int, int, int, int, float] | None:
    """(counts by hash of the word, sentences, words in them, links, words left outside, machine share) of a text with any.
    All links are one word, LINK, whatever their addresses; a sentence that recurs, with other numbers or not, is counted once.

    The machine share is the part of the distinct words, numbers and the words of a single sentence left out, that are
    machines' names, with operators of code as words of their own."""
    if text is None or not text.strip():
        return None
    words = words or Words()
    t = plain(text)
    bare = _TAG.sub(_said, t) if "<" in t else t
    links = 0
    if _MAY_LINK.search(t):
        links = len(_LINK.findall(t))
        bare = _LINK.sub(" ", bare)
    outside, n, inside, alone, kept, shapes = 0, 0, 0, "", [], set()
    for stretch in _BREAK.split(bare):
        parts = _END.split(stretch) if "." in stretch or "!" in stretch or "?" in stretch or not stretch.isascii() else [stretch]
        for part in parts[:-1]:
            if is_sentence(part.strip()):
                n += 1
                inside += len(part.split())
                alone = part
                shape = _NUMBERED.sub("0", part)
                if shape in shapes:
                    continue
                shapes.add(shape)
            else:
                outside += len(part.split())
            kept.append(part)
        outside += len(parts[-1].split())
        kept.append(parts[-1])
    find = (_TAGGED if "#" in bare else _WORD).findall
    seen = Counter(find(" ".join(kept)))
    counts = {LINK: links} if links else {}
    single = set(find(alone)) if n == 1 else ()
    named, machine = 0, sum(1 for x in _OPERATORS if x in bare)
    named += machine
    for w, c in seen.items():
        h, is_named, is_machine = words.of(w)
        counts[h] = counts.get(h, 0) + c
        if w not in single:
            named += is_named
            machine += is_machine
    return counts, n, inside, links, outside, machine / named if named else 0.0


def bucket(h: int) -> int:
    return h % BUCKETS


def slot(lang: str | None) -> int:
    code = re.split(r"[-_]", (lang or "").strip().lower())[0]
    return 1 + zlib.crc32(code.encode()) % (SLOTS - 1) if code else 0


def pages(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, band, n, sentences, inside, links, left, machine, buckets, counts): what each text is made of.
    lang is the slot of its language, band the power of two of its length; buckets and counts are those of its
    distinct words."""

    def run(batches):
        names = ["doc_id", "lang", "band", "n", "sentences", "inside", "links", "left", "machine", "buckets", "counts"]
        kinds = [pa.int64(), *[pa.int32()] * 7, pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        words = Words()
        for batch in batches:
            rows = []
            for i, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                p = read_page(text, words)
                if p is not None:
                    counts, *rest = p
                    n = sum(counts.values())
                    rows.append((i, slot(lang), (n + 1).bit_length() - 1, n, *rest, [bucket(h) for h in counts], list(counts.values())))
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    return documents.select("doc_id", "text", "lang").mapInArrow(run, "doc_id bigint, lang int, band int, n int, sentences int, inside int, links int, left int, machine double, buckets array<int>, counts array<int>")


FIGURES = ("slope", "residual", "divergence")
MADE = ["lang", "band", "n", "sentences", "inside", "links", "left", "machine"]
IS_PROSE = "sentences >= 4 and inside >= 4 * (left + links)"


def curves(read: DataFrame) -> DataFrame:
    """A row per page: what it is made of, slope and residual of its rank-frequency curve, the entropy of its own
    words, its buckets and counts, and whether it is prose."""
    words = F.explode(F.arrays_zip("buckets", "counts")).alias("w")
    flat = read.repartition("doc_id").select("doc_id", *MADE, words).select("doc_id", *MADE, F.col("w.buckets").alias("b"), F.col("w.counts").alias("c"))
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("c"), "b")))
    x, y = F.log("rank"), F.log("c")
    off = F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.nullif(F.regr_sxx(y, x), F.lit(0.0))
    return ranked.groupBy("doc_id", *MADE).agg(
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.sqrt(F.greatest(F.coalesce(off, F.lit(0.0)), F.lit(0.0)) / F.count("*")).alias("residual"),
        (F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("own"), F.collect_list("b").alias("buckets"), F.collect_list("c").alias("counts"),
    ).withColumn("prose", F.expr(IS_PROSE))


def measures(c: DataFrame, figures: list[str]) -> DataFrame:
    """(lang, band, mid_*, spread_*) of prose for every language slot and length: medians and spreads (quartile distance as that of
    a normal distribution), blended with those of all languages at the length, and these with those of all lengths. A table
    of fixed size."""
    quartiles = [F.percentile_approx(k, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(k) for k in figures]
    got = {(r["band"], r["lang"]): r for r in c.where("prose").rollup("band", "lang").agg(F.count("*").alias("pages"), *quartiles).collect()}  # a row per language and length

    def blend(key, under: list[float]) -> list[float]:
        r = got.get(key)
        if r is None or not r["pages"]:
            return under
        own = [x for k in figures for x in (r[k][1], (r[k][2] - r[k][0]) / 1.349)]
        return [(r["pages"] * a + PRIOR_PAGES * b) / (r["pages"] + PRIOR_PAGES) for a, b in zip(own, under)] if under[0] is not None else own

    every = blend((None, None), [None] * (2 * len(figures)))
    rows = []
    for band in range(33):
        mine = blend((band, None), every)
        rows += [(k, band, *blend((band, k), mine)) for k in range(SLOTS)]
    return c.sparkSession.createDataFrame(rows, "lang int, band int, " + ", ".join(f"mid_{k} double, spread_{k} double" for k in figures))


def far(c: DataFrame, figures: list[str]) -> DataFrame:
    """far_*: by how many spreads each figure is above (or below) prose; null if there is no prose."""
    out = c.join(F.broadcast(measures(c, figures)), ["lang", "band"], "left")
    names = [f"{p}_{k}" for k in figures for p in ("mid", "spread")]
    return out.withColumns({f"far_{k}": (F.col(k) - F.col(f"mid_{k}")) / F.greatest(f"spread_{k}", F.lit(LEAST[k])) for k in figures}).drop(*names)


def word_bits(c: DataFrame) -> np.ndarray:
    """-log2 of the probability of each bucket in prose, a row for each language slot that has any."""
    words = F.explode(F.arrays_zip("buckets", "counts")).alias("w")
    rows = c.where("prose").select("lang", words).groupBy("lang", F.col("w.buckets").alias("b")).agg(F.sum("w.counts").alias("c"))
    # SLOTS * BUCKETS rows at most, whatever the input
    t = rows.select("lang", "b", F.col("c").cast("double").alias("c")).toPandas()
    counts = np.zeros((SLOTS, BUCKETS))
    np.add.at(counts, (t["lang"].to_numpy(int), t["b"].to_numpy(int)), t["c"].to_numpy(float))
    every = counts.sum(axis=0) + 0.5
    prior = every / every.sum()
    own = counts.sum(axis=1, keepdims=True)
    own[0] += 1  # prose without a language stands for all where there is no other
    bits = -np.log2((counts + PRIOR_WORDS * prior) / (own + PRIOR_WORDS)).astype(np.float32)
    return bits[own[:, 0] > 0]


def divergent(c: DataFrame, bits: np.ndarray) -> DataFrame:
    """The pages with the divergence of their words from same-language prose, in bits a word. The language is the
    one whose prose is nearest, so pages without a label, or with a wrong one, are measured alike."""
    shared = c.sparkSession.sparkContext.broadcast(bits)
    keep = ["doc_id", *MADE, "slope", "residual", "own", "prose"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words, n = batch.column("buckets"), batch.column("counts")
            size = np.diff(words.offsets.to_numpy())
            w = n.flatten().to_numpy().astype(np.float64)
            first = np.cumsum(size) - size
            total = np.add.reduceat(w, first)  # a page has one word at least
            at = words.flatten().to_numpy()
            cross = np.min([np.add.reduceat(w * b[at], first) for b in shared.value], axis=0) / total
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(cross - batch.column("own").to_numpy())], names=[*keep, "divergence"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.select(*keep).schema.fields)
    return c.select(*keep, "buckets", "counts").mapInArrow(run, schema + ", divergence double")




def judged(documents: DataFrame) -> DataFrame:
    """A row per document with words: its figures, how far they are from prose, and whether it is a candidate,
    stuffed, and spam."""
    c = cut(curves(cut(pages(documents).where("n > 0"), "pages")), "curves")
    # pages of extreme slope teach nothing from here on
    c = far(c, ["slope"]).withColumn("prose", F.col("prose") & (F.abs("far_slope") <= EXTREME)).drop("far_slope")
    c = cut(divergent(c, word_bits(c)), "divergence")
    out = far(c, list(FIGURES))
    candidate = F.lit(False)
    for k in FIGURES:
        candidate = candidate | F.coalesce(F.abs(f"far_{k}") > EXTREME, F.lit(True))
    outside = F.col("left") + LINK_WORDS * F.col("links")
    words = F.col("machine") <= MOST_MACHINE
    stuffed = words & F.coalesce((F.col("far_slope") < -EXTREME) & (F.col("far_divergence") > FAR), F.lit(False))
    listed = words & candidate & (F.col("sentences") <= 1) & (outside >= MIN_LEFT)
    return out.select("doc_id", "n", "sentences", "inside", "links", "left", "machine", *FIGURES, *[f"far_{k}" for k in FIGURES], candidate.alias("candidate"), stuffed.alias("stuffed"), (listed | stuffed).alias("spam"))

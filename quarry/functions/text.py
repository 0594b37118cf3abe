"""Text functions as column expressions; all stay inside the JVM.

Python and Java disagree on white space and line ends; these follow Python's ``str`` methods, which is what
the data was written with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Line ends as Python's str.splitlines sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), rf"(?U)\A{SPACE}+", ""), rf"(?U){SPACE}+\z", "")


def normalize_text(c: str | Column) -> Column:
    """Null stays null, empty stays empty, all else loses trailing white space and ends with one newline."""
    c = col(c)
    return F.when(c == "", "").otherwise(F.concat(F.rtrim(c, F.lit(SPACES)), F.lit("\n")))


def split_lines(c: str | Column) -> Column:
    c = col(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, f"(?:{LINE_END})\\z", ""), LINE_END))


def instruction_count_listing(c: str | Column) -> Column:
    """Lines that are not blank, a directive, a remark, a label or a ``glabel``."""
    keep = lambda s: (s != "") & ~s.startswith(".") & ~s.startswith("#") & ~s.endswith(":") & ~s.startswith("glabel")
    return F.size(F.filter(F.transform(split_lines(c), strip), keep)).cast("bigint")


def has_words(line: Column) -> Column:
    """A listing line that carries offset, address and word between comment marks."""
    return line.contains("/*") & line.contains("*/")


def instruction_count_words(c: str | Column) -> Column:
    """Lines with both comment marks."""
    return F.size(F.filter(split_lines(c), has_words)).cast("bigint")


def instructions(c: str | Column) -> Column:
    """What follows the last comment mark of each instruction line, without labels and directives."""
    after = lambda s: strip(F.element_at(F.split(s, r"\*/"), -1))
    body = F.transform(F.filter(split_lines(c), lambda s: has_words(s) & ~s.contains("glabel")), after)
    return F.filter(body, lambda s: (s != "") & ~s.rlike(r"\A(?:\.|endlabel|nonmatching|enddlabel)"))


def instruction_count_code(c: str | Column) -> Column:
    return F.size(instructions(c)).cast("bigint")


def first_percent(c: str | Column) -> Column:
    """The first number followed by a percent sign."""
    return F.nullif(F.regexp_extract(col(c), r"(\d+(?:\.\d+)?)%", 1), F.lit("")).try_cast("double")


def shorten(c: str | Column, most: int = 50) -> Column:
    c = col(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def tail(c: str | Column, n: int) -> Column:
    return F.right(col(c), F.lit(n))


def head(c: str | Column, n: int) -> Column:
    return F.left(col(c), F.lit(n))


def first_rows(items: str | Column, n: int, note: str = "diffs") -> Column:
    """The first n items, and behind them how many there are if there are more."""
    a = col(items)
    return F.when(F.size(a) > n, F.concat(F.slice(a, 1, n), F.array(F.concat(F.lit("... ("), F.size(a).cast("string"), F.lit(f" {note})"))))).otherwise(a)


def task_id(project: str | Column, segment: str | Column, function: str | Column) -> Column:
    """project/segment/function; a null or empty segment is left out."""
    s = col(segment)
    return F.concat(col(project), F.lit("/"), F.when(s != "", F.concat(s, F.lit("/"))).otherwise(F.lit("")), col(function))


def base_name(c: str | Column, default: str = "game") -> Column:
    """A name of letters, digits and underscores in lower case."""
    name = F.lower(F.regexp_replace(F.regexp_replace(strip(c), r"[^\p{L}\p{N}]", "_"), r"\A_+|_+\z", ""))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def rom_name(content: str | Column) -> Column:
    """The image's title, bytes 0x20 to 0x33 of its header."""
    return F.decode(F.substring(col(content), 33, 20), "US-ASCII")


def key_values(items: str | Column) -> Column:
    """A map of ``KEY=VALUE`` items: the first ``=`` splits, the last of a key counts, an empty key is left out."""
    a = F.filter(col(items), lambda x: x.rlike(r"\A[^=]+="))
    pair = F.transform(a, lambda x: F.struct(strip(F.regexp_extract(x, r"\A([^=]+)=", 1)).alias("k"), F.regexp_extract(x, r"(?s)\A[^=]+=(.*)\z", 1).alias("v")))
    last = lambda keys, k: F.element_at(F.filter(pair, lambda p: p["k"] == k), -1)["v"]
    keys = F.array_distinct(F.filter(F.transform(pair, lambda p: p["k"]), lambda k: k != ""))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: last(keys, k)))


def path_parts(c: str | Column) -> Column:
    return F.split(col(c), "/")


def stem(c: str | Column) -> Column:
    name = F.element_at(path_parts(c), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def call_targets(asm: str | Column) -> Column:
    """The first call target of each line, distinct in order."""
    found = F.transform(split_lines(asm), lambda s: F.regexp_extract(s, r"jal\s+(func_[0-9A-Fa-f]+|[A-Za-z_]\w*)", 1))
    return F.array_distinct(F.filter(found, lambda s: s != ""))


def data_symbols(asm: str | Column) -> Column:
    """Symbols behind %hi and %lo that begin with ``D_``, distinct in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(col(asm), F.lit(r"%(?:hi|lo)\(([A-Za-z_]\w*)\)"), F.lit(1)), lambda s: s.startswith("D_")))


def without_leading_directives(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"\A(?:[ \t]*(?:\.[^\n]*)?(?:\n|\z))+", "")


def hex_number(c: str | Column) -> Column:
    """The number of a string of hex digits, with or without 0x; null for all else."""
    digits = F.nullif(F.regexp_extract(col(c), r"\A(?:0[xX])?([0-9A-Fa-f]{1,15})\z", 1), F.lit(""))
    return F.conv(digits, 16, 10).cast("bigint")


def symbol_address(name: str | Column) -> Column:
    """The address in the second part of ``func_80001234``; null if that is not hex."""
    return hex_number(F.try_element_at(F.split(col(name), "_"), F.lit(2)))


def call_target(word: str | Column) -> Column:
    return F.shiftleft(col(word).bitwiseAND(F.lit(0x03FFFFFF).cast("bigint")), 2)


def without_immediate(word: str | Column) -> Column:
    return col(word).bitwiseAND(F.lit(0xFFFF0000).cast("bigint"))


def absolute_symbol(target: str | Column, prefix: str) -> Column:
    return F.format_string(f"{prefix}%08X", col(target))


def percent_of(part: Column, whole: Column) -> Column:
    """0 where there is nothing to be part of."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)) * 100)


def is_exact(score: str | Column, byte_equal: str | Column) -> Column:
    """A score of 100 or equal bytes; a missing score is neither."""
    return F.coalesce(col(score) == 100.0, F.lit(False)) | F.coalesce(col(byte_equal), F.lit(False))


def band(score: str | Column, bounds: list[tuple[float, str]], lowest: str, missing: str = "none") -> Column:
    """The label of the first bound that score exceeds; missing scores are kept apart."""
    s = col(score)
    out = F.lit(lowest)
    for least, label in reversed(bounds):
        out = F.when(s > least, label).otherwise(out)
    return F.when(s.isNull(), missing).otherwise(out)


def prompt(lines: list[Column]) -> Column:
    """Lines that are not null, one below the other, with a newline at the end."""
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n"))


def template_match(words_hex: str | Column, template: str) -> Column:
    """Whether a run of words matches a hex template in which ``?`` stands for any digit."""
    return F.upper(col(words_hex)).rlike("^(?:.{8})*?" + template.upper().replace(" ", "").replace("?", "[0-9A-F]"))


def time_of(c: str | Column) -> Column:
    """The time of an ISO text with or without offset (UTC), or null."""
    t = F.regexp_replace(F.trim(col(c)), r"Z\z", "+00:00")
    return F.when(t.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:\d{2})?\z"), t).try_cast("timestamp")


def stamp(time: Column) -> Column:
    """A time as file names have it."""
    return F.date_format(time, "yyyyMMdd_HHmmss")


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000)


def register_priority(uses: str | Column, live: str | Column, size: str | Column) -> Column:
    """floor(log2 uses) * uses / live * 10000 * size, as a whole number; null where there is no use or no life."""
    n, length = col(uses), col(live)
    return F.when((n > 0) & (length > 0), F.floor(F.floor(F.log2(n)) * n / length * 10000 * col(size)).cast("bigint"))


def entries(c: str | Column) -> Column:
    """The entries of a page of documents: (title, summary, anchor, chars of the body) of each ``## `` heading in order. The
    summary is the first line that is not blank, if it stands between underscores."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), col(c)), "\n## "), 2, 1_000_000)

    def one(s):
        title = F.trim(F.substring_index(s, "\n", 1))
        body = F.regexp_extract(s, r"\A[^\n]*\n?((?s:.*))\z", 1)
        summary = F.nullif(F.regexp_extract(body, r"\A\n*_([^_\n]+)_[ ]*(?:\n|\z)", 1), F.lit(""))
        anchor = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9 -]", ""), " ", "-")
        return F.struct(title.alias("title"), summary.alias("summary"), anchor.alias("anchor"), F.length(body).alias("chars"))

    return F.transform(parts, one)


def hits(c: str | Column, pattern: str) -> Column:
    """(line number from 1, line) of each line that matches."""
    numbered = F.transform(split_lines(c), lambda s, i: F.struct((i + 1).alias("line_no"), s.alias("line")))
    return F.filter(numbered, lambda x: x["line"].rlike(pattern))

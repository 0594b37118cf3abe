"""Functions on C source that need nesting, as Arrow functions."""

from __future__ import annotations

import re
from itertools import takewhile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# as objects: Python workers import this module too, and have no session to parse a name
TEXT = StringType()
BODIES = ArrayType(StructType([StructField("name", TEXT), StructField("body", TEXT)]))

_TYPED = r"(?:s32|void|u32|f32)"
#: The head of a function with a typed result.
HEAD = rf"(?m)^{_TYPED}\s+func_[0-9A-Fa-f]+\s*\([^)]*\)\s*\{{"
_BRACKET = re.compile(r"[(){}]")
_GAP = re.compile(r"\s*")
_OPENS = {")": "(", "}": "{"}


def pairs(text: str) -> dict[int, int]:
    """Where each bracket that is closed is closed. Round and curly ones are paired apart; strings and comments are text like any other."""
    waiting: dict[str, list[int]] = {"(": [], "{": []}
    out = {}
    for m in _BRACKET.finditer(text):
        c = m[0]
        if c in waiting:
            waiting[c].append(m.start())
        elif waiting[_OPENS[c]]:
            out[waiting[_OPENS[c]].pop()] = m.start()
    return out


def _belongs(line: str) -> bool:
    """Whether a line above a head is part of it: not blank, no end of what comes before, no directive."""
    line = line.strip()
    return bool(line) and line[-1] not in ";}" and line[0] != "#"


def find_definition(text: str | None, name: str | None) -> str | None:
    """The whole definition of a function with the lines above it that belong to it, or None."""
    if not text or not name or name not in text:
        return None
    ends = pairs(text)
    heads = ((m.start(), ends.get(m.end() - 1)) for m in re.finditer(rf"\b{re.escape(name)}\s*\(", text))
    braces = ((at, _GAP.match(text, close + 1).end()) for at, close in heads if close is not None)
    at, end = next(((at, ends[b]) for at, b in braces if b < len(text) and text[b] == "{" and b in ends), (None, None))
    if at is None:
        return None
    line = text.rfind("\n", 0, at) + 1
    above = list(takewhile(_belongs, reversed(text[:line].split("\n")[:-1])))
    return "\n".join([*reversed(above), text[line : end + 1]]).strip() + "\n"


def bodies(text: str | None) -> list[tuple[str, str]]:
    """(name, text) of each function with a typed result that has something in its body."""
    out = []
    heads = list(re.finditer(HEAD, text or ""))
    ends = pairs(text) if heads else {}
    for m in heads:
        end = ends.get(m.end() - 1)
        if end and text[m.end() : end].strip():
            out.append((re.search(r"func_\w+", m[0])[0], text[m.start() : end + 1].strip()))
    return out


def replace_function(text: str | None, name: str | None, code: str | None) -> str | None:
    """The text with the function's INCLUDE_ASM line, or else its body, replaced by code; None if it has neither."""
    if text is None or not name or code is None:
        return None
    m = re.search(rf"INCLUDE_ASM\([^)]*\b{re.escape(name)}\s*\)\s*;?", text)
    if m:
        return text[: m.start()] + code + text[m.end() :]
    m = re.search(rf"{_TYPED}\s+{re.escape(name)}\s*\([^)]*\)\s*\{{", text)
    if m and (end := pairs(text).get(m.end() - 1)):
        return text[: m.start()] + code + text[end + 1 :]
    return None


@F.pandas_udf(TEXT)
def definition_of(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([find_definition(t, n) for t, n in zip(text, name)], dtype=object)


@F.pandas_udf(BODIES)
def function_bodies(text: pd.Series) -> pd.Series:
    return pd.Series([[{"name": n, "body": b} for n, b in bodies(t)] for t in text], dtype=object)


@F.pandas_udf(TEXT)
def with_function(text: pd.Series, name: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([replace_function(*x) for x in zip(text, name, code)], dtype=object)

"""Tokens and shingles of source code, a batch of texts at a time in numpy.

A token is an identifier, a number, or a single other character; comments and white
space are left out. Letters beyond ASCII count as letters of identifiers. A shingle is
three successive tokens. Tokens and shingles are 64-bit hashes: token hashes come from one
polynomial prefix sum over the bytes of many texts, so there is no loop over tokens.
Texts without tokens have no shingles; one or two tokens make a single shorter shingle,
so that such texts are alike only to their equals. Long texts are cut between tokens and
handled piece by piece; nothing is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 18
_COMMENT = re.compile(rb"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|/\*.*?(?:\*/|\Z)|//[^\n]*""", re.S)
_ODD_SPACE = re.compile(r"\s")
_WORD = np.zeros(256, bool)
_WORD[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_", *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[[*b"0123456789"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[*range(33), 127]] = True
R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(R, -1, 1 << 64)
_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * PIECE)
        a = np.full(size, base, np.uint64)
        a[0] = 1
        have = _powers[base] = np.cumprod(a)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on all of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def clean(text: str) -> bytes:
    """The text's bytes without comments, with plain white space."""
    if not text.isascii():
        text = _ODD_SPACE.sub(" ", text)
    raw = text.encode("utf-8", "replace")
    if b"/*" in raw or b"//" in raw:
        raw = _COMMENT.sub(lambda m: m[1] or b" ", raw)
    return raw


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each token of raw, which ends with white space."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    word = _WORD[b]
    at = np.arange(n)
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    run = np.maximum.accumulate(np.where(begin, at, 0))
    number = word & _DIGIT[b[run]]
    dot = np.zeros(n, bool)
    dot[1:] = (b[1:] == 46) & number[:-1]
    word = word | dot
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    other = ~word & ~_SPACE[b]
    starts = np.flatnonzero(begin | other)
    ends = np.empty(n, bool)
    ends[-1] = True
    ends[:-1] = word[:-1] & ~word[1:]
    ends = np.flatnonzero((ends & word) | other) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(R, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_R_INVERSE, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of raw of some PIECE bytes, cut at white space (or wherever, if there is none for long)."""
    while len(raw) > PIECE:
        k = max(raw.rfind(s, PIECE // 2, PIECE) for s in (b"\n", b" ", b"\t"))
        k = PIECE if k < 0 else k
        yield raw[:k] + b"\n"
        raw = raw[k:]
    yield raw + b"\n"


def token_hashes(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, token hashes in order) of each text that is not null."""
    batch, size = [], 0

    def flush():
        raw = b"".join(x for _, x in batch)
        h, starts = _hash_piece(raw)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) for _, x in batch)]))
        for (i, _), s, e in zip(batch, bounds, bounds[1:]):
            yield i, h[s:e]

    for i, t in enumerate(texts):
        if t is None:
            continue
        raw = clean(t)
        if len(raw) > PIECE:
            yield i, np.concatenate([_hash_piece(p)[0] for p in _pieces(raw)])
            continue
        if size + len(raw) > PIECE and batch:
            yield from flush()
            batch, size = [], 0
        batch.append((i, raw + b"\n"))
        size += len(raw) + 1
    if batch:
        yield from flush()


#: Odd multipliers, one for each place in a window.
_PLACES = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def windows(tokens: np.ndarray, k: int = 3) -> np.ndarray:
    """The sorted distinct hashes of all k successive tokens; of texts with fewer, one for all of them."""
    k = min(k, len(tokens))
    if k == 0:
        return tokens
    n = len(tokens) - k + 1
    h = tokens[:n] * np.uint64(_PLACES[0])
    for i in range(1, k):
        h = h + tokens[i : n + i] * np.uint64(_PLACES[i])
    h = mix(h + np.uint64(k))
    h.sort()
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def shingles(tokens: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of the shingles of one text's tokens."""
    return windows(tokens, 3)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted distinct arrays, by intersection."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)

"""Encoding of texts with a public byte-level BPE vocabulary, as a sentencepiece model.

The vocabulary's ranks are serialised directly as a sentencepiece BPE model, byte for byte in
protobuf's wire format; nothing is trained. Each token's bytes become a piece of as many
characters, one for each byte value, with its negative rank as score, so that sentencepiece merges
what the ranks would merge, in the same order. Normalisation is the identity. A text is split into
pre-tokens by the vocabulary's pattern; those not met before are encoded in one call, the others come
from a table of bounded size, and decoding maps the pieces back to bytes.

Defined cases. Null and empty texts have an empty list of ids. Whole texts are encoded, however
long: the pre-tokens of a long one are handled in parts. Repeated texts give equal ids.
Special tokens are never produced; their strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the pattern that goes with the rank files of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for ASCII texts, for a faster engine.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
#: The character of byte b is BASE + b: private use, so none is white space or has a normal form.
BASE = 0xE000
#: Pre-tokens handled at once, and those kept with their ids.
PART, KNOWN = 1 << 16, 150_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path} lacks some ranks")
    return [ranks[i] for i in range(len(ranks))]


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model proto of the tokens: ids are ranks plus OFFSET."""
    normal, unknown = 1, 2
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, float(score)) + _field(3, kind))
    out = [piece("<unk>", 0.0, unknown)]
    out += [piece("".join(chr(BASE + b) for b in t), -float(r), normal) for r, t in enumerate(tokens)]
    # trainer: model type BPE, no begin, end and padding pieces; normaliser: identity, nothing added, removed or escaped
    minus = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(tokens) + OFFSET) + _field(40, 0) + _field(41, minus) + _field(42, minus) + _field(43, minus)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


OFFSET = 1


class Encoder:
    """Encodes and decodes texts with one rank file."""

    def __init__(self, path: str):
        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.split, self.split_ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self.table = {b: BASE + b for b in range(256)}
        self.known: dict[str, list[int]] = {}

    def _words(self, text: str) -> Iterator[list[str]]:
        split = self.split_ascii if text.isascii() else self.split
        if len(text) <= 4 * PART:
            yield split.findall(text)
        else:
            found = (m[0] for m in split.finditer(text))
            while some := list(islice(found, PART)):
                yield some

    def _learn(self, words: Iterable[str]) -> None:
        new = list(words)
        mapped = [w.encode().decode("latin-1").translate(self.table) for w in new]
        for w, ids in zip(new, self.model.encode(mapped, num_threads=1)):
            self.known[w] = [i - OFFSET for i in ids]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, words, n = [], set(), 0

        def flush() -> None:
            new = words - self.known.keys()
            if len(self.known) + len(new) > KNOWN:
                self.known.clear()
                new = words
            self._learn(new)
            for i, some in held:
                out[i].append(np.fromiter(chain.from_iterable(map(self.known.__getitem__, some)), np.int32))

        for i, t in enumerate(texts):
            for some in self._words(t) if t else ():
                held.append((i, some))
                words.update(some)
                n += len(some)
                if n > PART:
                    flush()
                    held, words, n = [], set(), 0
        flush()
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no text become replacement characters."""
        pieces = (self.model.id_to_piece(int(i) + OFFSET) for i in ids)
        return bytes(ord(c) - BASE for p in pieces for c in p).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


def encode_column(df: DataFrame, id_col: str, text: str, path: str) -> DataFrame:
    """(id, ids) of each row; a narrow step, one encoder per Python worker."""

    def run(batches):
        e = encoder(path)
        for batch in batches:
            # the batch may hold very long texts: rows are encoded in groups of some 4 MB
            texts = batch.column(1).to_pylist()
            group, size, found = [], 0, []
            for t in texts:
                group.append(t)
                size += len(t or "")
                if size > 1 << 22:
                    found += e.encode(group)
                    group, size = [], 0
            found += e.encode(group)
            offsets = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str, text: str, path: str) -> DataFrame:
    """(id, tokens) of each row."""

    def run(batches):
        e = encoder(path)
        for batch in batches:
            n = [len(x) for x in e.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[id_col, "tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, tokens bigint")

"""Files whose schema drifts: one table for all of them, and a report of each change.

Every file's header (its keys and their JSON types, and those of the elements of its
lists of records) is read in parallel, in the tasks that hold the bodies. The headers
are folded through a lattice of types into one union schema (:func:`union_schema`), to which
every file is cast (:func:`cast_files`), and are held against the documented schema: what
differs is logged in a fixed order (:func:`deviations`).

A field that is absent counts as renamed only if an undocumented key of the same object holds
its content: code that defines the file's own function, a list of step or attempt records,
a list of calls, prose. A key that merely resembles the field's name while it holds something
else is an added one; a name that is the same but for letter case and separators is
taken on trust where the content says nothing.

Defined cases. Null and empty bodies, bodies cut off, and bodies that are no JSON object give
no deviations and no row in the cast table, and are listed by :func:`rejects`. A JSON null
has no type and never counts as retyped. Of a key that occurs twice in an object the last
counts; NaN and the infinities are numbers. Deviations inside the elements of a list
are reported once per file, under the documented name of the list, as long as it is a list.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The documented schemas, B1 (canonical) and B2 (legacy), and their element schemas.
CANONICAL = {
    "function_name": "string", "project": "string", "model": "string", "start_time": "string", "end_time": "string", "steps": "array", "outcome": "string",
    "final_match_percent": "number", "best_match_percent": "number", "total_tokens": "number", "instruction_count": "number",
    "initial_m2c_source": "string", "final_source": "string", "metadata": "object",
}
LEGACY = {
    "function_name": "string", "asm_text": "string", "m2c_output": "string", "final_c": "string", "matched": "boolean", "instruction_count": "number", "has_branches": "boolean",
    "has_calls": "boolean", "timestamp": "number", "game": "string", "compiler": "string", "compiler_flags": "string", "segment": "string", "nearby_decompiled": "array",
    "called_functions": "array", "referenced_data": "array", "attempts": "array",
}
LEGACY_EXTRAS = {"symbol_name": "string", "reference": "string", "notes": "array"}
STEP = {"step_number": "number", "timestamp": "string", "assistant_text": "string", "tool_calls": "array", "match_percent": "number", "compiled": "boolean", "token_usage": "object"}
ATTEMPT = {"c_code": "string", "matched": "boolean", "diff_count": "number", "diff_details": "array", "compiler_flags": "string", "notes": "string"}
ELEMENTS = {"steps": STEP, "attempts": ATTEMPT}
OWN_CODE = {"final_source", "final_c", "initial_m2c_source", "m2c_output"}
CODE, PROSE, CALLS = {"c_code"}, {"assistant_text", "notes"}, {"tool_calls"}
CHANGES = ("renamed", "removed", "retyped", "added")

#: The lattice: type names by rank. Two types meet in the lowest type above both;
#: ``null`` is below all, ``variant`` (JSON text) above all.
LATTICE = {"null": (), "boolean": ("null",), "integer": ("null",), "number": ("null", "integer"), "string": ("null",), "array": ("null",), "object": ("null",), "variant": ("boolean", "integer", "number", "string", "array", "object", "null")}
SQL_TYPES = {"null": "string", "boolean": "boolean", "integer": "bigint", "number": "double", "string": "string", "array": "string", "object": "string", "variant": "string"}


def promote(a: str, b: str) -> str:
    """The lowest type of the lattice that holds both."""
    if a == b or b in LATTICE[a]:
        return a
    return b if a in LATTICE[b] else "variant"


def kind_of(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def type_of(v) -> str:
    """The kind in the lattice's types: whole numbers of 64 bits are integers."""
    kind = kind_of(v)
    return "integer" if kind == "number" and isinstance(v, int) and -(2**63) <= v < 2**63 else kind


def _float(v: int | float) -> float:
    try:
        return float(v)
    except OverflowError:  # as 1e999 is read
        return math.inf if v > 0 else -math.inf


def _plain(s: str | None) -> str | None:
    """Text without lone surrogates, which JSON may hold and Arrow may not."""
    return s if s is None or s.isascii() else s.encode("utf-8", "replace").decode()


def parse_body(body: str | None) -> dict | None:
    try:
        v = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


# --- whose content is it? --------------------------------------------------------


def _text(v) -> str | None:
    """The text of a value, also where it was split into lines or wrapped in an object."""
    if isinstance(v, str):
        return v
    if isinstance(v, list) and v and all(isinstance(x, str) for x in v):
        return "\n".join(v)
    if isinstance(v, dict):
        found = [x for x in v.values() if isinstance(x, str)]
        return max(found, key=len) if found else None
    return None


def _same_name(key: str, field: str) -> bool:
    squeeze = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    return squeeze(key) == squeeze(field)


def _records(v, known: dict[str, str]) -> bool:
    """Whether v holds records of the known keys: a list of them, an object of them, one, or their JSON text."""
    if isinstance(v, str):
        try:
            v = json.loads(v)
        except (ValueError, RecursionError):
            return False
    if isinstance(v, dict):
        v = [v, *v.values()]
    return isinstance(v, list) and any(isinstance(x, dict) and len(known.keys() & x.keys()) >= 2 for x in v)


def _calls(v) -> bool:
    if isinstance(v, dict):
        return any(_calls(x) for x in v.values() if isinstance(x, list))
    return isinstance(v, list) and any(isinstance(x, dict) and "name" in x and ("input" in x or "output" in x) for x in v)


def _holds(key: str, field: str, values: list, function: str) -> int:
    """How sure it is that key, with these values, holds the field: 0 not at all."""
    named = _same_name(key, field)
    values = [v for v in values if v is not None]
    if field in ELEMENTS:
        sure = any(_records(v, ELEMENTS[field]) for v in values)
    elif field in CALLS:
        sure = any(_calls(v) for v in values)
    elif field in OWN_CODE:
        texts = [t for t in map(_text, values) if t]
        own = bool(function) and any(re.search(rf"(?<!\w){re.escape(function)}\s*\(", t) for t in texts)
        sure = own and any("{" in t for t in texts)
    elif field in CODE:
        texts = [t for t in map(_text, values) if t]
        sure = any(re.search(r";\s*(\n|$)", t) for t in texts)
    elif field in PROSE:
        # a list of remarks is a field of its own; a list under the field's own name is that field, split
        texts = [t for v in values if not isinstance(v, list) or named for t in [_text(v)] if t is not None]
        sure = bool(texts) and all(not t or re.search(r"\s", t.strip()) or len(t) > 24 for t in texts) and not any(re.search(r";\s*(\n|$)", t) for t in texts)
    else:
        sure = False
    return 2 + named if sure else int(named)


def _compare(known: dict[str, str], optional: dict[str, str], objects: list[dict], function: str) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """The deviations of objects that should all have the known keys, and the key of each field."""
    present: dict[str, list] = {}
    for o in objects:
        for k, v in o.items():
            present.setdefault(k, []).append(v)
    out, at = [], {k: k for k in [*known, *optional] if k in present}
    free = [k for k in present if k not in known and k not in optional]
    absent = [f for f in known if f not in present]
    pairs = sorted(((-s, i, j) for i, f in enumerate(absent) for j, k in enumerate(free) if (s := _holds(k, f, present[k], function))))
    taken: set[int] = set()
    for _, i, j in pairs:
        if absent[i] not in at and j not in taken:
            at[absent[i]] = free[j]
            taken.add(j)
    for f in absent:
        out.append((f, "renamed" if f in at else "removed"))
    for f, kind in (known | optional).items():
        if f in at and any(kind_of(v) not in (kind, "null") for v in present[at[f]]):
            out.append((f, "retyped"))
    out += [(k, "added") for j, k in enumerate(free) if j not in taken]
    return out, at


def file_deviations(v: dict) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """Of one parsed file: its deviations (field, change), and under which key each field is."""
    legacy = "game" in v
    name = v.get("function_name")
    function = re.sub(r"\.NON_MATCHING$", "", name.strip()) if isinstance(name, str) else ""
    out, at = _compare(LEGACY if legacy else CANONICAL, LEGACY_EXTRAS if legacy else {}, [v], function)
    part = "attempts" if legacy else "steps"
    if part in at and isinstance(items := v[at[part]], list) and (items := [x for x in items if isinstance(x, dict)]):
        inner, _ = _compare(ELEMENTS[part], {}, items, function)
        out += [(f"{part}.{f}", c) for f, c in inner]
    return out, at


# --- operators -------------------------------------------------------------------


def deviations(files: DataFrame, id_col: str = "file_id", body: str = "body") -> DataFrame:
    """(id, field, change, ord) of every file's deviations from its documented schema; ord counts within a
    file: top-level fields in documented order before those of elements, added keys last."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                v = parse_body(text)
                if v is not None:
                    rows += [(i, f, c, k) for k, (f, c) in enumerate(file_deviations(v)[0], 1)]
            cols = list(zip(*rows)) or [[], [], [], []]
            ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], names=[id_col, "field", "change", "ord"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, body).mapInArrow(run, f"`{id_col}` {kind}, field string, change string, ord int")


def file_fields(v: dict, at: dict[str, str]) -> dict:
    """A file's values under their documented names, renamed or not. A legacy file's game is its project too, and its matched its outcome."""
    got = {f: v[k] for f, k in at.items()}
    if "game" in v:
        got |= {"project": v["game"], "outcome": "match" if got.get("matched") is True else "failed"}
    return got


def headers(files: DataFrame, id_col: str = "file_id", body: str = "body", documented: bool = False) -> DataFrame:
    """(id, schema, field, type) of every top-level key of every file, in the lattice's types; with
    ``documented``, of every documented field in place of the keys, as :func:`file_fields` has them."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                v = parse_body(text)
                if v is not None:
                    schema = "legacy" if "game" in v else "canonical"
                    rows += [(i, schema, _plain(k), type_of(x)) for k, x in (file_fields(v, file_deviations(v)[1]) if documented else v).items()]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.string()) for c in cols[1:]]], names=[id_col, "schema", "field", "type"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, body).mapInArrow(run, f"`{id_col}` {kind}, schema string, field string, type string")


def union_schema(files: DataFrame, id_col: str = "file_id", body: str = "body", documented: bool = False) -> DataFrame:
    """The headers folded through the lattice: (schema, field, type, files, types). The types seen
    are bits of one number, so what moves is a row per field and task; :func:`promote` gives the
    type of each of the 128 possible numbers."""
    names = sorted(LATTICE.keys() - {"variant"})
    seen = [[t for k, t in enumerate(names) if m >> k & 1] for m in range(1 << len(names))]
    bit = F.element_at(F.create_map(*[F.lit(x) for k, t in enumerate(names) for x in (t, 1 << k)]), F.col("type"))
    folded = headers(files, id_col, body, documented).groupBy("schema", "field").agg(F.count("*").alias("files"), F.bit_or(bit).alias("m"))
    of = lambda texts: F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("m") + 1)
    return folded.select("schema", "field", of([reduce(promote, s, "null") for s in seen]).alias("type"), "files", of([",".join(s) for s in seen]).alias("types"))


#: The documented fields of either schema, each once, and where the two schemas meet.
DOCUMENTED = CANONICAL | LEGACY | LEGACY_EXTRAS
MET = {"source": "string", "initial_source": "string", "percent": "double", "n_parts": "int", "parts": "string"}
ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def _cast(x, kind: str):
    """A value as the union type ``kind``, which is above its own."""
    if x is None or kind in ("boolean", "integer"):
        return x
    return _plain(x) if kind == "string" else _float(x) if kind == "number" else json.dumps(x)


def cast_files(files: DataFrame, id_col: str = "file_id", body: str = "body") -> DataFrame:
    """Every file as one row of the union table. The files are read once for their union schema, of
    some 30 rows, and again to be cast to it. Every documented field is a column under its
    documented name, also where a file has it under another, in the type that the fold gives:
    lists, objects and fields of several types (``variant``) as JSON text, numbers as double where not all
    are whole. A field that no file has a value of takes its documented type. All undocumented keys
    that hold no renamed field are in ``added``, one JSON object (null if there are none).

    Both schemas meet in ``project`` (game), ``outcome`` (of matched), ``source`` (final_source or final_c), ``initial_source``, ``percent`` and
    ``parts`` (steps or attempts, as JSON text, also where they were wrapped or encoded): there texts split into lines or wrapped
    in an object are put together again, and other values of a wrong type are null. ``changes`` lists the file's deviations in order."""
    kinds = dict.fromkeys(DOCUMENTED, "null")
    for r in union_schema(files, id_col, body, documented=True).collect():
        kinds[r["field"]] = promote(kinds[r["field"]], r["type"])
    kinds = {f: DOCUMENTED[f] if k == "null" else k for f, k in kinds.items()}
    first = ["function_name", "project", "source", "initial_source", "outcome", "percent", "instruction_count", "n_parts", "parts"]
    names = ["schema", *first, "changes", *[f for f in kinds if f not in first], "added"]
    types = [MET.get(n) or (SQL_TYPES[kinds[n]] if n in kinds else "string") for n in names]

    def row(v: dict) -> list:
        dev, at = file_deviations(v)
        legacy = "game" in v
        fields = file_fields(v, at)
        get = fields.get
        parts = get("attempts" if legacy else "steps")
        if isinstance(parts, str):
            try:
                parts = json.loads(parts)
            except (ValueError, RecursionError):
                parts = None
        if isinstance(parts, dict):
            known = ATTEMPT if legacy else STEP
            parts = [parts] if known.keys() & parts.keys() else [x for x in parts.values() if isinstance(x, dict)]
        parts = parts if isinstance(parts, list) else None
        percent = get("final_match_percent")
        used = set(at.values())
        added = {k: x for k, x in v.items() if k not in used}
        out = {f: _cast(get(f), kind) for f, kind in kinds.items()} | {
            "schema": "legacy" if legacy else "canonical", "source": _plain(_text(get("final_c" if legacy else "final_source"))), "initial_source": _plain(_text(get("m2c_output" if legacy else "initial_m2c_source"))),
            "percent": (100.0 if get("matched") is True else None) if legacy else _float(percent) if kind_of(percent) == "number" else None,
            "n_parts": None if parts is None else len(parts), "parts": None if parts is None else json.dumps(parts),
            "changes": _plain(";".join(f"{f}:{c}" for f, c in dev)), "added": json.dumps(added) if added else None,
        }
        return [out[n] for n in names]

    def run(batches):
        for batch in batches:
            rows = [(i, *row(v)) for i, t in enumerate(batch.column(1).to_pylist()) if (v := parse_body(t)) is not None]
            cols = list(zip(*rows)) or [[]] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, ARROW[t]) for c, t in zip(cols[1:], types)]], names=[id_col, *names])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, body).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))


def rejects(files: DataFrame, id_col: str = "file_id", body: str = "body") -> DataFrame:
    """(id, reason) of the files that give no row: null, empty, unreadable or no object."""

    def why(text):
        if text is None:
            return "null"
        if not text.strip():
            return "empty"
        try:
            v = json.loads(text)
        except (ValueError, RecursionError):
            return "unreadable"
        return None if isinstance(v, dict) else "no object"

    def run(batches):
        for batch in batches:
            found = [(i, w) for i, t in enumerate(batch.column(1).to_pylist()) if (w := why(t))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([w for _, w in found], pa.string())], names=[id_col, "reason"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, body).mapInArrow(run, f"`{id_col}` {kind}, reason string")

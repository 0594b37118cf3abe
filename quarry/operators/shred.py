"""Columnar shredding of nested records, and tables put together again from it.

Every leaf path of a record becomes one column of *repetition* and *definition*
levels beside its values. The repetition level of an entry says at which repeated
ancestor the entry starts a new element (0: a new record), the definition level how
many optional or repeated ancestors of the path are present. Nothing else is needed
to find an entry's position at every level, so a table of any repeated ancestor, or
of all leaves, comes out of the level sequences alone.

Typed columns (structs and arrays) are walked as Arrow buffers, a leaf at a time and
without a loop over rows. Columns that hold open JSON text are parsed, and their paths
join the typed path in front of them. Both steps are narrow: a record is shredded
and put together in the task that read it, and no step shuffles.

Defined cases. A null array and an empty one give no rows of that ancestor; a null
element of an array counts in positions and gives a row whose fields are null. JSON
text that is null, empty, cut off or not an object has no leaves; text whose value is
a string that itself holds an object is that object. Empty objects and arrays have no
leaves; a JSON null is a leaf. Of a key that occurs twice in an object the last
counts. Text may be nested as deep as the JSON parser goes (some thousand levels); what it refuses counts as unreadable.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text nested deeper than the JSON parser goes is unreadable; what it reads is walked to the end.
WALK = 100_000
#: Positions are worked out together for paths of up to so many repeated levels, and for each deeper one alone.
SHALLOW = 16
#: Kinds of JSON leaves, by the character that stands for them beside the values.
KINDS = {"s": "string", "n": "number", "b": "boolean", "z": "null"}
ABSENT = object()

LEVELS = "leaves array<struct<path string, max_def int, open boolean, rep binary, def binary, val array<string>, kind string>>"
_LEAF = pa.struct([("path", pa.string()), ("max_def", pa.int32()), ("open", pa.bool_()), ("rep", pa.binary()), ("def", pa.binary()), ("val", pa.list_(pa.string())), ("kind", pa.string())])


# --- typed columns ---------------------------------------------------------------


def typed_levels(column: pa.Array) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """(path below the column, highest definition level, record of each entry,
    repetition, definition, leaf array, index into it or -1) of each leaf."""
    n = len(column)
    yield from _walk(column, "", 0, 0, np.arange(n), np.zeros(n, np.int16), np.zeros(n, np.int16), np.arange(n))


def _walk(a, path, depth, top, rec, rep, dfn, idx):
    valid = np.zeros(len(idx), bool)
    if len(a):
        valid = (idx >= 0) & ~a.is_null().to_numpy(zero_copy_only=False)[np.maximum(idx, 0)]
    dfn = dfn + valid.astype(np.int16)
    idx = np.where(valid, idx, -1)
    top += 1
    if pa.types.is_struct(a.type):
        for k in range(a.type.num_fields):
            field = a.type.field(k)
            yield from _walk(a.field(k), f"{path}.{field.name}" if path else field.name, depth, top, rec, rep, dfn, idx)
    elif pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        ends = a.offsets.to_numpy() if len(a) else np.zeros(1, np.int64)
        at = np.maximum(idx, 0)
        size = np.where(valid, (ends[1:][at] - ends[:-1][at]) if len(a) else 0, 0)
        many = np.maximum(size, 1)
        first = np.cumsum(many) - many
        within = np.arange(int(many.sum())) - np.repeat(first, many)
        begin = np.where(size > 0, ends[:-1][at] if len(a) else 0, -1)
        begin = np.repeat(begin, many)
        yield from _walk(
            a.values, path + "[]", depth + 1, top + 1, np.repeat(rec, many),
            np.where(within > 0, depth + 1, np.repeat(rep, many)).astype(np.int16),
            (np.repeat(dfn, many) + (begin >= 0)).astype(np.int16), np.where(begin >= 0, begin + within, -1),
        )
    else:
        yield path, top, rec, rep, dfn, a, idx


# --- open JSON text --------------------------------------------------------------


class Node:
    """A path below the root of a JSON document, as far as one record has it."""

    __slots__ = ("elem", "fields", "kind", "leaf", "path", "rep", "dfn", "val")

    def __init__(self, path: str):
        self.path, self.fields, self.elem, self.leaf = path, None, None, False


def parse_object(text: str | None) -> dict | None:
    """The object a JSON text holds, also if it is encoded twice; else None."""
    if not text:
        return None
    try:
        v = json.loads(text)
        if isinstance(v, str):
            v = json.loads(v)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _learn(node: Node, v) -> None:
    if isinstance(v, dict):
        if node.fields is None:
            node.fields = {}
        for k, x in v.items():
            child = node.fields.get(k)
            if child is None:
                child = node.fields[k] = Node(f"{node.path}.{k}" if node.path else k)
            _learn(child, x)
    elif isinstance(v, list):
        if v:
            if node.elem is None:
                node.elem = Node(node.path + "[]")
            for x in v:
                _learn(node.elem, x)
    elif not node.leaf:
        node.leaf = True
        node.rep, node.dfn, node.val, node.kind = array("h"), array("h"), [], []


def _emit(node: Node, v, rep: int, dfn: int, depth: int) -> None:
    """One entry at least for every leaf below node: its value, or up to where it is defined."""
    if node.leaf:
        node.rep.append(rep)
        if v is ABSENT or isinstance(v, (dict, list)):
            node.dfn.append(dfn)
            node.val.append(None)
            node.kind.append("-")
        else:
            node.dfn.append(dfn + 1)
            if isinstance(v, str):
                node.val.append(v)
                node.kind.append("s")
            elif v is None:
                node.val.append(None)
                node.kind.append("z")
            elif isinstance(v, bool):
                node.val.append("true" if v else "false")
                node.kind.append("b")
            else:
                node.val.append(repr(v))
                node.kind.append("n")
    if node.fields is not None:
        if isinstance(v, dict):
            for k, child in node.fields.items():
                _emit(child, v.get(k, ABSENT), rep, dfn + 1, depth)
        else:
            for child in node.fields.values():
                _emit(child, ABSENT, rep, dfn, depth)
    if node.elem is not None:
        if isinstance(v, list) and v:
            at = rep
            for x in v:
                _emit(node.elem, x, at, dfn + 1, depth + 1)
                at = depth + 1
        else:
            _emit(node.elem, ABSENT, rep, dfn, depth)


def _leaves(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        if x.leaf:
            yield x
        if x.elem is not None:
            stack.append(x.elem)
        if x.fields is not None:
            stack.extend(reversed(x.fields.values()))


def _max_def(node_path_levels: int, base: int) -> int:
    return base + node_path_levels


def open_levels(texts: list[str | None], reps: np.ndarray, defs: np.ndarray, base: int, depth: int) -> Iterator[tuple[str, int, bytes, bytes, list, str]]:
    """Leaf columns of one record's JSON texts. texts: the text at each entry of the typed
    path in front, whose levels are reps and defs; base: its highest definition level."""
    if sys.getrecursionlimit() < WALK:
        sys.setrecursionlimit(WALK)
    docs = [parse_object(t) for t in texts]
    root = Node("")
    for d in docs:
        if d is not None:
            _learn(root, d)
    if root.fields is None:
        return
    for d, r, q in zip(docs, reps, defs):
        _emit(root, ABSENT if d is None else d, int(r), int(q), depth)
    for leaf in _leaves(root):
        yield leaf.path, max((d for d, k in zip(leaf.dfn, leaf.kind) if k != "-"), default=base), leaf.rep.tobytes(), leaf.dfn.tobytes(), leaf.val, "".join(leaf.kind)


# --- operators -------------------------------------------------------------------


def shred(df: DataFrame, id_col: str, columns: Iterable[str], open_json: Iterable[str] = ()) -> DataFrame:
    """Shred ``columns`` of ``df``: (id, leaves), one row per record, each of whose
    leaves is a path with its repetition levels, definition levels and values.

    ``open_json`` names leaf paths (``steps[].tool_calls[].input``) whose JSON text is
    shredded further. Other columns of df are left out, so their names cannot clash."""
    columns, open_json = list(columns), set(open_json)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            leaves: list[list] = [[] for _ in range(n)]
            for c, name in enumerate(columns):
                for path, top, rec, rep, dfn, a, idx in typed_levels(batch.column(c + 1)):
                    full = name + (path if path.startswith("[") else f".{path}" if path else "")
                    live = idx >= 0
                    taken = a.take(pa.array(np.where(live, idx, 0), mask=~live)) if len(a) else pa.nulls(len(idx), pa.string())
                    vals = pc.cast(taken, pa.string()).to_pylist()
                    bounds = np.searchsorted(rec, np.arange(n + 1))
                    if full in open_json:
                        depth = full.count("[]")
                        for i in range(n):
                            s, e = bounds[i], bounds[i + 1]
                            for p, m, r, q, v, k in open_levels(vals[s:e], rep[s:e], dfn[s:e], top, depth):
                                leaves[i].append((f"{full}.{p}", m, True, r, q, v, k))
                    else:
                        rb, db = rep.tobytes(), dfn.tobytes()  # two bytes a level
                        kinds = "".join("v" if x else "-" for x in live)
                        for i in range(n):
                            s, e = bounds[i], bounds[i + 1]
                            leaves[i].append((full, top, False, rb[2 * s : 2 * e], db[2 * s : 2 * e], vals[s:e], kinds[s:e]))
            flat = [x for row in leaves for x in row]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in leaves])]).astype(np.int32)
            cols = list(zip(*flat)) if flat else [()] * 7
            inner = pa.StructArray.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, _LEAF)], fields=list(_LEAF))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), inner)], names=[id_col, "leaves"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, *columns).mapInArrow(run, f"`{id_col}` {kind}, {LEVELS}")


def positions(rep: np.ndarray, depth: int, starts: np.ndarray) -> np.ndarray:
    """The position from 1 of each entry at each repeated level 1..depth, out of the
    repetition levels alone. starts: where a new sequence begins (its level is 0)."""
    n = len(rep)
    out = np.empty((depth, n), np.int64)
    at = np.arange(n)
    for k in range(1, depth + 1):
        steps = np.cumsum(rep == k)
        last = np.maximum.accumulate(np.where(rep < k, at, 0))
        out[k - 1] = steps - steps[last] + 1
    return out


def _positions_of(rep: np.ndarray, deep: np.ndarray, here: np.ndarray) -> list[list[int]]:
    """The positions of the entries ``here``. deep: the repeated levels of each entry's path. A path's entries stand
    together, so any choice of whole paths is a sequence of its own."""
    shallow = deep <= SHALLOW
    if shallow.all():
        return positions(rep, int(deep.max(initial=0)), None)[:, here].T.tolist() if len(rep) else []
    out: dict[int, list[int]] = {}
    wanted = np.zeros(len(rep), bool)
    wanted[here] = True
    for some in [shallow, *[deep == d for d in np.unique(deep[~shallow])]]:
        at = np.flatnonzero(some)
        if len(at):
            keep = np.flatnonzero(wanted[at])
            out.update(zip(at[keep].tolist(), positions(rep[at], int(deep[at].max()), None)[:, keep].T.tolist()))
    return [out[i] for i in here.tolist()]


def _flat(batch: pa.RecordBatch):
    """The batch's leaf columns side by side, and the record of each."""
    lists = batch.column(1)
    flat = lists.flatten()
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), flat


def _levels_of(flat, which: np.ndarray):
    part = flat.take(pa.array(which))
    rep = np.frombuffer(b"".join(part.field("rep").to_pylist()), np.int16)
    dfn = np.frombuffer(b"".join(part.field("def").to_pylist()), np.int16)
    sizes = pc.binary_length(part.field("rep")).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    return part, rep, dfn, sizes


def leaf_table(levels: DataFrame, id_col: str, prefixes: dict[str, int], values: bool = True) -> DataFrame:
    """The table of all leaves of open objects, from their level sequences.

    ``prefixes`` maps the typed path in front of each open object to its repeated depth.
    Columns: the id, ``source`` (that path), ``ords`` (positions at its repeated
    levels), ``leaf_path`` below the object with positions as ``[0]``, and, unless
    ``values`` is false, ``kind`` and ``value``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rec, flat = _flat(batch)
            is_open = np.flatnonzero(flat.field("open").to_numpy(zero_copy_only=False)) if len(flat) else np.zeros(0, np.int64)
            part, rep, dfn, sizes = _levels_of(flat, is_open)
            tops = part.field("max_def").to_numpy(zero_copy_only=False)
            paths = part.field("path").to_pylist()
            col = np.repeat(np.arange(len(is_open)), sizes)
            kinds = np.frombuffer("".join(part.field("kind").to_pylist()).encode(), np.uint8)
            here = np.flatnonzero(kinds != ord("-"))
            deep = np.array([p.count("[]") for p in paths], np.int64)
            rows = _positions_of(rep, deep[col], here)
            source, template, skip = [], [], []
            for p in paths:
                head = next(x for x in prefixes if p.startswith(x + "."))
                source.append(head)
                template.append(p[len(head) + 1 :].split("[]"))
                skip.append(prefixes[head])
            ids = batch.column(0).take(pa.array(rec[is_open][col[here]]))
            cs = col[here].tolist()
            tail = []
            for c, row in zip(cs, rows):
                t = template[c]
                if len(t) == 1:
                    tail.append(t[0])
                else:
                    k = skip[c]
                    tail.append("".join(x for i, s in enumerate(t) for x in ((f"[{row[k + i - 1] - 1}]", s) if i else (s,))))
            out = [
                ids,
                pa.array([source[c] for c in cs], pa.string()),
                pa.array([row[: skip[c]] for c, row in zip(cs, rows)], pa.list_(pa.int32())),
                pa.array(tail, pa.string()),
            ]
            names = [id_col, "source", "ords", "leaf_path"]
            if values:
                out += [pa.array([KINDS[chr(k)] for k in kinds[here]], pa.string()), part.field("val").flatten().take(pa.array(here))]
                names += ["kind", "value"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = levels.schema[id_col].dataType.simpleString()
    more = ", kind string, value string" if values else ""
    return levels.mapInArrow(run, f"`{id_col}` {kind}, source string, ords array<int>, leaf_path string{more}")


def ancestor_table(levels: DataFrame, id_col: str, ancestor: str, fields: dict[str, str]) -> DataFrame:
    """The table of one repeated ancestor (``steps[].tool_calls[]``): a row for each of its
    elements, with ``ords`` (its position from 1 at each repeated level), ``present`` (false for a
    null element) and ``fields``, a map of leaf path below it to output type."""
    depth = ancestor.count("[]")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rec, flat = _flat(batch)
            paths = flat.field("path").to_numpy(zero_copy_only=False)
            cols, keep, ids, ords, present = [], None, None, None, None
            for f in fields:
                which = np.flatnonzero(paths == f"{ancestor}.{f}")
                part, rep, dfn, sizes = _levels_of(flat, which)
                if keep is None:
                    # below the element: its struct and the field are optional
                    top = part.field("max_def").to_numpy(zero_copy_only=False)[0] if len(which) else 0
                    nested = f.count(".")
                    slot = top - 2 - nested
                    keep = np.flatnonzero(dfn >= slot)
                    pos = positions(rep, depth, None)
                    ids = batch.column(0).take(pa.array(np.repeat(rec[which], sizes)[keep]))
                    ords = pa.array(pos.T[keep].tolist(), pa.list_(pa.int32()))
                    present = pa.array(dfn[keep] > slot)
                cols.append(part.field("val").flatten().take(pa.array(keep)))
            yield pa.RecordBatch.from_arrays([ids, ords, present, *cols], names=[id_col, "ords", "present", *[f"f{i}" for i in range(len(cols))]])

    kind = levels.schema[id_col].dataType.simpleString()
    raw = levels.mapInArrow(run, f"`{id_col}` {kind}, ords array<int>, present boolean, " + ", ".join(f"f{i} string" for i in range(len(fields))))
    return raw.select(id_col, "ords", "present", *[F.col(f"f{i}").cast(t).alias(f.replace(".", "_")) for i, (f, t) in enumerate(fields.items())])


# --- this project's records ------------------------------------------------------

OPEN = {"steps[].tool_calls[].input": 2, "metadata": 0}
STEP_FIELDS = {
    "step_number": "bigint", "timestamp": "string", "assistant_text": "string", "match_percent": "double",
    "compiled": "boolean", "token_usage.input_tokens": "bigint", "token_usage.output_tokens": "bigint",
}
CALL_FIELDS = {"name": "string", "input": "string", "output": "string", "duration_ms": "bigint"}
#: What the leaf table reads of an episode: the scan leaves all other fields out.
LEAF_SCHEMA = "episode_id bigint, steps array<struct<tool_calls array<struct<input string>>>>, metadata string"


def episode_leaves(episodes: DataFrame, values: bool = True) -> DataFrame:
    """Leaves of tool-call inputs and metadata, with step_ord and call_ord (0 for metadata)."""
    slim = episodes.select("episode_id", "steps", "metadata")
    out = leaf_table(shred(slim, "episode_id", ["steps", "metadata"], OPEN), "episode_id", OPEN, values)
    ords = [F.coalesce(F.try_element_at("ords", F.lit(k)), F.lit(0)).cast("int").alias(n) for k, n in ((1, "step_ord"), (2, "call_ord"))]
    return out.select("episode_id", *ords, "leaf_path", *(["kind", "value"] if values else []))


def episode_steps(episodes: DataFrame) -> DataFrame:
    """A row per element of ``steps``: its position and its fields."""
    t = ancestor_table(shred(episodes, "episode_id", ["steps"]), "episode_id", "steps[]", STEP_FIELDS)
    return t.select("episode_id", F.element_at("ords", 1).alias("step_ord"), "present", *[f.replace(".", "_") for f in STEP_FIELDS])


def episode_calls(episodes: DataFrame) -> DataFrame:
    """A row per element of ``steps.tool_calls``: both positions and its fields."""
    t = ancestor_table(shred(episodes, "episode_id", ["steps"]), "episode_id", "steps[].tool_calls[]", CALL_FIELDS)
    return t.select("episode_id", F.element_at("ords", 1).alias("step_ord"), F.element_at("ords", 2).alias("call_ord"), "present", *CALL_FIELDS)

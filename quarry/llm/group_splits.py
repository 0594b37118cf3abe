"""Splits that keep together all records that share an entity.

Episodes of one project belong together if they have the same function name, if one
states the other's name as a former or symbol name, or if their metadata names the same source
file below the project's directory; and so do all that are linked through others. The graph has a
node for each name and each file, not for each episode, so the episodes of a hot function are one
node, aggregated before the first shuffle of links. Components come from ``components``.

Split: groups larger than BIG of all rows (at most 1/BIG of them) are placed one by one, largest
first, where most rows are missing. All others are hashed into BINS bins of the unit interval;
the bins' row counts, a table of fixed size, are cut into ranges that fill what is left of each
split. So shares are met as nearly as whole groups allow, up to one bin's rows.

Defined cases. Project and function name are compared trimmed and in lower case, names without the
alias suffix. Episodes without one of them are in no group; each is a group of its own for the split.
Metadata that is null, cut off or no object names nothing. A stated name that no episode of the
project has links nothing. A path is read with either slash, ``.``, ``..`` and doubled slashes resolved,
below ``projects/<project>/`` if it has that part; other absolute paths, those of other projects and those
that lead out of the project are no files of the project. Node ids are 64-bit hashes.
"""

from __future__ import annotations

import json
import posixpath
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components

ALIAS = ".non_matching"
BIG, BINS = 0.002, 1 << 14
STATED = ("former_name", "symbol_name", "previous_names")


def normal_project(p: str | None) -> str:
    return (p or "").strip().lower()


def normal_name(f: str | None) -> str:
    f = (f or "").strip().lower()
    return f[: -len(ALIAS)].strip() if f.endswith(ALIAS) else f


def source_file(path, project: str) -> str | None:
    """The file's path below the project's directory, or None."""
    if not isinstance(path, str) or not path.strip():
        return None
    p = re.sub(r"/+", "/", path.strip().replace("\\", "/"))
    parts = p.split("/")
    at = [i for i in range(len(parts) - 1) if parts[i].lower() == "projects"]
    if at:
        if parts[at[-1] + 1].lower() != project:
            return None
        p = "/".join(parts[at[-1] + 2 :])
    p = posixpath.normpath(p) if p else "."
    return None if p.startswith(("/", "..")) or re.match(r"[A-Za-z]:", p) or p == "." else p


def parse_metadata(text: str | None) -> dict:
    try:
        v = json.loads(text) if text else None
        if isinstance(v, str):
            v = json.loads(v)
    except (ValueError, RecursionError):
        return {}
    return v if isinstance(v, dict) else {}


def links(episodes: DataFrame) -> DataFrame:
    """(episode_id, key, names, files): the normal project/name of each episode that has both, and
    the project/names it states and project/files it names."""

    def run(batches):
        for batch in batches:
            ids, keys, names, files = [], [], [], []
            for i, f, p, m in zip(*(c.to_pylist() for c in batch.columns)):
                project, name = normal_project(p), normal_name(f)
                if not project or not name:
                    continue
                v = parse_metadata(m)
                stated = [x for k in STATED for x in (v.get(k) if isinstance(v.get(k), list) else [v.get(k)]) if isinstance(x, str)]
                src = v.get("source")
                paths = [source_file(x, project) for x in (v.get("source_path"), src.get("path") if isinstance(src, dict) else None)]
                ids.append(i)
                keys.append(f"{project}/{name}")
                names.append(sorted({f"{project}/{n}" for x in stated if (n := normal_name(x)) and n != name}))
                files.append(sorted({f"{project}/{x}" for x in paths if x}))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(names, pa.list_(pa.string())), pa.array(files, pa.list_(pa.string()))], names=["episode_id", "key", "names", "files"])

    slim = episodes.select("episode_id", "function_name", "project", "metadata")
    return slim.mapInArrow(run, "episode_id bigint, key string, names array<string>, files array<string>")


def groups(episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(episode_id, key) of every episode that can be in a group, and (key, group_key, rows) of every name.

    What is learned from the metadata is pre-aggregated to distinct names and links."""
    rows = cut(links(episodes), "links")
    names = rows.groupBy("key").agg(F.count("*").alias("rows"))
    node = lambda c, kind: F.xxhash64(F.lit(kind), c)
    stated = rows.select("key", F.explode("names").alias("other")).distinct()
    known = stated.join(names.select(F.col("key").alias("other")), "other", "left_semi")
    files = rows.select("key", F.explode("files").alias("other")).distinct()
    # a file that one name has alone links nothing
    edges = known.select(node(F.col("key"), "name").alias("u"), node(F.col("other"), "name").alias("v")).unionByName(files.select(node(F.col("key"), "name").alias("u"), node(F.col("other"), "file").alias("v")))
    found = components(edges)
    named = names.withColumn("node", node(F.col("key"), "name")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("key").alias("group_key"), F.sum("rows").alias("rows"))
    return rows.select("episode_id", "key"), named.select("key", "component").join(least, "component").select("key", "group_key", "rows")


def found_groups(episodes: DataFrame) -> DataFrame:
    """(episode_id, group_key) of every episode in a group of two or more."""
    rows, names = groups(episodes)
    return rows.join(names.where("rows > 1"), "key").select("episode_id", "group_key")


def assign(episodes: DataFrame, shares: list[tuple[str, float]], seed: str = "split-v1") -> DataFrame:
    """(episode_id, group_key, split_name) of every episode; group_key is null for those in no group.

    Shares need not sum to one; a split with share 0 gets nothing."""
    rows, names = groups(episodes)
    all_rows = episodes.select("episode_id").join(rows.join(names, "key").select("episode_id", "group_key"), "episode_id", "left")
    lone = F.concat(F.lit("#"), F.col("episode_id").cast("string"))
    unit = lambda c: F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), c)), 1, 12), 16, 10).cast("bigint")
    of_bin = lambda c: F.pmod(unit(c), F.lit(BINS)).cast("int")
    total = episodes.count()
    splits = [(n, s) for n, s in shares if s > 0]
    whole = sum(s for _, s in splits)
    missing = {n: total * s / whole for n, s in splits}
    per_group = names.groupBy("group_key").agg(F.max("rows").alias("rows"))
    big = {}
    for r in per_group.where(F.col("rows") > BIG * total).orderBy(F.desc("rows"), "group_key").collect():  # at most 1 / BIG rows
        to = max(missing, key=lambda n: missing[n])
        big[r["group_key"]] = to
        missing[to] -= r["rows"]
    placed = F.create_map(*[F.lit(x) for kv in big.items() for x in kv]) if big else None
    key = F.coalesce("group_key", lone)
    small = all_rows if placed is None else all_rows.where(F.col("group_key").isNull() | ~F.col("group_key").isin(*big))
    held = {r["bin"]: r["n"] for r in small.groupBy(of_bin(key).alias("bin")).agg(F.count("*").alias("n")).collect()}  # BINS rows
    order = [n for n, _ in splits]
    room = {n: max(0.0, missing[n]) for n in order}
    left, want = sum(held.values()), sum(room.values())
    bounds, at, filled = [], 0, 0
    for n in order[:-1]:
        quota = filled + (left * room[n] / want if want else 0)
        done = filled
        while at < BINS and done + held.get(at, 0) / 2 <= quota:
            done += held.get(at, 0)
            at += 1
        bounds.append((n, at))
        filled = done
    b = of_bin(key)
    ranged = F.lit(order[-1])
    for n, upto in reversed(bounds):
        ranged = F.when(b < upto, n).otherwise(ranged)
    split = ranged if placed is None else F.coalesce(F.try_element_at(placed, F.col("group_key")), ranged)
    return all_rows.select("episode_id", "group_key", split.alias("split_name"))

"""Files of a project as DataFrames: episodes, listings, sources, images, and configuration.

Spark's own file sources leave out names that begin with ``_`` or ``.``, and C names such as ``__osSetFpcCsr``
do. So paths are listed first, and read by the tasks, a batch of paths each."""

from __future__ import annotations

import json
import os
import tomllib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, suffix: str, recursive: bool = False) -> DataFrame:
    """(path) of all files with the suffix, hidden ones too, in tasks of 1000 paths. The root is a folder that all
    executors see."""
    at = Path(root)
    found = sorted(str(p) for p in (at.rglob("*") if recursive else at.glob("*")) if p.name.endswith(suffix) and p.is_file()) if at.is_dir() else []
    return spark.createDataFrame([(p,) for p in found], "path string").repartition(max(1, -(-len(found) // 1000)))


def read_text(paths: DataFrame) -> DataFrame:
    """Rows with a path and the text there, null if the file is missing or no UTF-8. Other columns go along."""

    def run(batches):
        for batch in batches:
            texts = []
            for p in batch.column("path").to_pylist():
                try:
                    texts.append(Path(p).read_text("utf-8", newline=""))
                except (OSError, UnicodeDecodeError):
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return paths.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema.fields) + ", text string")


def episode_dirs(root: str) -> list[str]:
    """The ``episodes`` folders below ``projects``, in order."""
    at = Path(root) / "projects"
    return [str(p / "episodes") for p in sorted(at.iterdir()) if (p / "episodes").is_dir()] if at.is_dir() else []


def read_episodes(spark: SparkSession, root: str) -> DataFrame:
    """(file_id, project, path, body) of every episode file of every project; file_id follows scan order."""
    paths = [(k, Path(d).parent.name, str(p)) for k, (d, p) in enumerate((d, p) for d in episode_dirs(root) for p in sorted(Path(d).iterdir()) if p.name.endswith(".json"))]
    files = spark.createDataFrame(paths, "file_id bigint, project string, path string")
    texts = read_text(files.repartition(max(1, -(-len(paths) // 1000))))
    return texts.select("file_id", "project", F.regexp_replace("path", r"^.*?/projects/[^/]+/", "").alias("path"), F.col("text").alias("body"))


def read_listings(spark: SparkSession, root: str) -> DataFrame:
    return read_text(list_files(spark, root, ".s", recursive=True))


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    return read_text(list_files(spark, root, ".c", recursive=True))


def read_image(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def chosen_text(direct: str | None, path: str | None) -> str | None:
    """Text given directly wins over that of a file."""
    return direct if direct is not None else Path(path).read_text() if path else None


def load_config(start: str, names: tuple[str, ...]) -> dict:
    """The first configuration file of these names in the folder or one above it, its relative paths resolved; {} without one."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        for n in names:
            if (folder / n).is_file():
                text = (folder / n).read_text()
                conf = tomllib.loads(text) if n.endswith(".toml") else parse_yaml(text)
                return {k: str(folder / v) if k.endswith(("_dir", "_path", "_root")) and isinstance(v, str) and not os.path.isabs(v) else v for k, v in (conf or {}).items()}
    return {}


def parse_yaml(text: str):
    """YAML by the installed parser, or else the part of it that these files use: nested maps, lists and scalars."""
    try:
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        return _block([(len(s) - len(s.lstrip()), s.strip()) for s in text.splitlines() if s.strip() and not s.strip().startswith("#") and s.strip() != "---"], 0, 0)[0]


def _scalar(s: str):
    s = s.split(" #")[0].strip()
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    if s[:1] in "\"'" and s[-1:] == s[:1]:
        return s[1:-1]
    low = s.lower()
    if low in ("", "null", "~"):
        return None
    if low in ("true", "false"):
        return low == "true"
    for kind in (lambda x: int(x, 0), float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def _block(rows: list[tuple[int, str]], at: int, indent: int):
    if at >= len(rows):
        return None, at
    indent = rows[at][0]
    is_list = rows[at][1].startswith("- ") or rows[at][1] == "-"
    out: list | dict = [] if is_list else {}
    while at < len(rows) and rows[at][0] == indent and (rows[at][1].startswith("-") == is_list or not is_list):
        s = rows[at][1]
        if is_list:
            item = s[1:].strip()
            if item and (item.startswith(("[", '"', "'")) or ": " not in item and not item.endswith(":")):
                out.append(_scalar(item))
                at += 1
            else:
                inner = [(indent + 2, item)] if item else []
                at += 1
                while at < len(rows) and rows[at][0] > indent:
                    inner.append(rows[at])
                    at += 1
                out.append(_block(inner, 0, 0)[0])
        else:
            key, _, value = s.partition(":")
            at += 1
            if value.strip():
                out[_scalar(key)] = _scalar(value)
            elif at < len(rows) and (rows[at][0] > indent or rows[at][0] == indent and rows[at][1].startswith("-")):
                out[_scalar(key)], at = _block(rows, at, rows[at][0])
            else:
                out[_scalar(key)] = None
    return out, at


def segment_table(spark: SparkSession, splat_yaml: str) -> DataFrame:
    """(dir_name, rom_start, vram, src_path) of the code subsegments of a split description; of a folder name that
    occurs twice the last counts. Subsegments without a name are called by their offset."""
    found: dict[str, tuple] = {}
    doc = parse_yaml(splat_yaml) or {}
    for s in doc.get("segments") or []:
        if not isinstance(s, dict) or not isinstance(s.get("subsegments"), list):
            continue
        for sub in s["subsegments"]:
            if isinstance(sub, list) and len(sub) >= 2 and sub[1] in ("c", "asm"):
                name = str(sub[2]) if len(sub) > 2 else f"{sub[0]:X}"
                vram = (s.get("vram") or 0) + sub[0] - (s.get("start") or 0)
                found[name] = (name, int(sub[0]), int(vram), f"src/{name}.c")
    return spark.createDataFrame(list(found.values()), "dir_name string, rom_start bigint, vram bigint, src_path string")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(unit, function, size, fuzzy_match_percent) of the functions of a report in JSON."""
    doc = spark.read.option("multiLine", "true").json(path)
    f = doc.select(F.explode("units").alias("u")).select(F.col("u.name").alias("unit"), F.explode_outer("u.functions").alias("f"))
    return f.select("unit", F.col("f.name").alias("function"), F.col("f.size").cast("bigint").alias("size"), F.col("f.fuzzy_match_percent").cast("double").alias("fuzzy_match_percent"))


def save_episode(folder: str, episode: dict, stamp: str | None = None) -> str:
    """One episode as a file: with a stamp beside others of its function, without one in place of them."""
    name = f"{stamp}_{episode['function_name']}.json" if stamp else f"{episode['function_name']}.json"
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    (at / name).write_text(json.dumps(episode, indent=2))
    return str(at / name)

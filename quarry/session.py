"""Session defaults, table access, and the one way in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", app: str = "quarry", **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    """A table of the data directory. ``schema`` names the columns (and nested
    fields) wanted, so that the parquet scan reads no others."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, local mode) a folder of our own
    is made, and removed when the process ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quarry-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    atexit.register(lambda: shutil.rmtree(own, ignore_errors=True))
    return f"file://{own}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here,
    and the loss of any executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


#: Tables that this process has cut, by application.
_written: dict[str, list[str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Remove all tables cut in this session. Call it once the results that read them are written."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _remove(spark, path)
    return len(paths)


def discard(df: DataFrame) -> None:
    """Remove a table written by :func:`cut` that no later plan reads."""
    path = getattr(df, "_quarry_path", None)
    if path:
        _written.get(df.sparkSession.sparkContext.applicationId, [path]).remove(path)
        _remove(df.sparkSession, path)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per session, so that their Python
    workers import it wherever they run. Spark serves the archive from the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    at = shared_dir(spark)
    if at.startswith("file:"):
        at = at[5:].replace("//", "", 1)
    elif "://" in at:  # the driver serves the archive; nothing but its own process reads the folder
        at = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(lambda: shutil.rmtree(at, ignore_errors=True))
    os.makedirs(at, exist_ok=True)
    with zipfile.ZipFile(path := os.path.join(at, f"quarry-{uuid.uuid4().hex}.zip"), "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("quarry", os.path.relpath(full, here)))
    before = list(sys.path)
    sc.addPyFile(path)
    sys.path[:] = before
    sc._quarry_shipped = True
    return spark

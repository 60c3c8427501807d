"""Session settings that the library relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str = "local[*]", **conf) -> SparkSession:
    """A session with UTC times and adaptive execution. Shuffle partitions and memory are the caller's: they depend on the cluster."""
    builder = SparkSession.builder.master(master).appName("patternlake")
    for k, v in (SETTINGS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once for a context, unless their search path or folder has it already."""
    package = Path(__file__).resolve().parent
    parent = str(package.parent)
    sc = spark.sparkContext
    reachable = parent in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == parent
    if reachable or getattr(sc, "_patternlake_shipped", False):
        return
    name = Path(tempfile.mkdtemp()) / "patternlake.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(name))
    sc._patternlake_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which the cluster shares.

    Only a local session may do without that setting: it gets a temporary folder. ``clear_shared`` removes what was given out.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/patternlake-shared"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    given = getattr(spark.sparkContext, "_patternlake_paths", [])
    spark.sparkContext._patternlake_paths = [*given, path]
    return path


def clear_shared(spark: SparkSession) -> int:
    """Delete the tables of intermediate steps that this context wrote; results that are still to be read from them must be written before. Returns how many."""
    sc, n = spark.sparkContext, 0
    for path in getattr(sc, "_patternlake_paths", []):
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True))
    sc._patternlake_paths = []
    return n


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that no later step repeats its work."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

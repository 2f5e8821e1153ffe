"""Tables in the folder that all nodes share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where it is unset on a local master (tests), below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        base = "file://" + tempfile.mkdtemp(prefix="glossweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: iterations don't grow its lineage, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by its path on one machine, as a zip elsewhere."""
    sc = spark.sparkContext
    root = str(PACKAGE.parent)
    if sc.master.startswith("local"):
        known = sc.environment.get("PYTHONPATH", "")
        if root not in known.split(":"):
            sc.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
        return
    if getattr(sc, "_glossweave_shipped", False):
        return
    to = Path(tempfile.mkdtemp()) / "glossweave.zip"
    with zipfile.ZipFile(to, "w") as out:
        for path in PACKAGE.rglob("*.py"):
            out.write(path, path.relative_to(PACKAGE.parent))
    sc.addPyFile(str(to))
    sc._glossweave_shipped = True

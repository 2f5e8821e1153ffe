"""Shared helpers: the shared folder, written tables and the code that workers import."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package (by path on one machine, as a zip elsewhere) and hold little memory:
    smaller Arrow batches unless the session sets its own, and freed memory goes back to the system."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "2"), ("MALLOC_TRIM_THRESHOLD_", "1048576"), ("OMP_NUM_THREADS", "1")):
        sc.environment.setdefault(name, value)
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


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that all nodes share.

    Where the setting is absent on a local master (tests on one machine) a temporary folder is set for the session; on a
    cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        base = "file://" + tempfile.mkdtemp(prefix="glossweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        base = ("file://" + os.path.abspath(base)) if not base.startswith("file:") else "file://" + base[5:]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _SCOPES[-1:]:
        made.append(path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that operators make within are deleted at its end; what is computed from them must be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)
        gc.collect()
        spark._jvm.java.lang.System.gc()  # lets Spark see which shuffles nothing reads any more


def _delete(spark: SparkSession, path: str) -> None:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of `written` that nothing reads any more (a round that a later one has replaced)."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def flat_array(uri: str, dtype: str):
    """A flat file as an array: mapped where the folder is mounted, else read."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if fs.type_name == "local":
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_of(df: DataFrame):
    """All columns of a row in one struct, so that no name of an operator can clash with them."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)).alias("row")


def output_names(carry: list[str], own: list[str]) -> list[str]:
    """The names under which carried columns come back: one that is an output's (in any case) gets `_carried` at its end."""
    taken, out = {c.lower() for c in own}, []
    for c in carry:
        while c.lower() in taken:
            c += "_carried"
        taken.add(c.lower())
        out.append(c)
    return out


def with_row(df: DataFrame, carry: list[str], own: list[str]) -> DataFrame:
    """The fields of df's column `row` as columns, but for clashes under the names of carry, and its other columns `own`."""
    fields = [F.col("row")[c].alias(n) for c, n in zip(carry, output_names(carry, own))]
    return df.select(*fields, *own)


def kept_rows(docs: DataFrame, decide: Callable[[], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay. decide() gives doc_id, text_sha256 and verdict of every row: 0 goes, 1 stays but only one of
    the rows that repeat both id and text, 2 stays. Rows are told apart by id and text, so rows that share an id only
    are judged each by its own. Columns may have any names. What decide() leaves in the shared folder is deleted
    when the verdicts are written.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "verdicts")
    with scratch(spark):
        told = decide().where("verdict < 2").groupBy("doc_id", "text_sha256").agg(F.max("verdict").alias("verdict"), F.count("*").alias("rows")).where("verdict = 0 or rows > 1")
        told.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "verdict").write.parquet(path)
    told = spark.read.schema("id long, sha string, verdict int").parquet(path)
    own = docs.select(row_of(docs), F.col(id_col).cast("long").alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("sha"))
    kept = own.join(told.hint("merge"), same, "left_anti").select("row.*")  # verdicts grow with the documents: never broadcast
    again = told.where("verdict = 1")
    if again.isEmpty():
        return kept
    one = own.join(again.hint("merge"), same).groupBy("id", "sha").agg(F.any_value("row").alias("row"))  # tasks reduce repeated rows before the shuffle
    return kept.unionByName(one.select("row.*"))


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int | None = None, share: int = 1000, least: int = 10_000) -> DataFrame:
    """left joined (left outer) to right, which has each key once, with the number of left rows that have it.

    Keys with at least `least` rows and 1/share of all rows (so no more than `share` keys) are broadcast, and their rows are
    dealt by a hash of the whole row instead of the key.
    """
    if total is None:
        total = right.agg(F.sum(rows)).first()[0] or 0
    bound = max(least, -(-total // share))
    if total < bound:
        return left.join(right, key, "left")
    names = [c for c in right.columns if c != key]
    hot = right.where(F.col(rows) >= bound).select(F.col(key).alias("__hot"), F.struct(*names).alias("__told"))
    marked = left.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hot")), "left")
    kind = right.schema[key].dataType
    # a hot row's second key is null: it meets nothing, so it may go anywhere
    marked = marked.withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key)).cast(kind)).withColumn("__deal", F.when(F.col("__key").isNull(), F.xxhash64(*left.columns) % 1000).otherwise(F.lit(0)))
    rest = right.where(F.col(rows) < bound).select(F.col(key).alias("__other"), F.struct(*names).alias("__more"), F.lit(0).cast("bigint").alias("__none"))
    joined = marked.join(rest, (F.col("__key") == F.col("__other")) & (F.col("__deal") == F.col("__none")), "left")
    return joined.select(*(F.col(c) for c in left.columns), *(F.coalesce(F.col(f"__told.{c}"), F.col(f"__more.{c}")).alias(c) for c in names))

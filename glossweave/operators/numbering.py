"""Places in a total order without one task that gets all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.sources.shared import written

#: Spark's increasing ids have the partition above this bit and the row's number within it below.
_BITS = 33


def numbered(rows: DataFrame, *order: Column | str, keep: list[str] | None = None) -> DataFrame:
    """rows (their columns `keep`) with place (from 0) in their order, a written table; rows that are equal in it stand as they come. Rows are dealt by range, sorted, numbered within
    their range and written once; a range begins where the ones before it end, and there is one count a range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = rows.withColumn("__tie", F.monotonically_increasing_id())  # splits a range of equal rows
    dealt = ties.repartitionByRange(n, *order, "__tie").sortWithinPartitions(*order, "__tie").select(*(rows.columns if keep is None else keep))
    kept = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranges")  # ranges come from a sample, so they are drawn once
    part = F.shiftright("__at", _BITS)
    counts = {r["part"]: r["n"] for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a range
    begins, at = [], 0
    for k in sorted(counts):
        begins.append((k, at))
        at += counts[k]
    start = F.broadcast(rows.sparkSession.createDataFrame(begins, "__part long, __begin long"))
    within = F.col("__at") - F.shiftleft(part, _BITS)
    return kept.join(start, part == F.col("__part")).withColumn("place", within + F.col("__begin")).drop("__at", "__part", "__begin")

"""Reproducible samples. Every random choice is an md5 order of seed, purpose and key, so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .numbering import numbered

from glossweave.functions.text import draw, half_even
from glossweave.sources.shared import written

STRATUM = ["relation", "source_type"]
IDENTITY = ["source", "relation", "target", "source_type"]


def identity() -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in IDENTITY))


def quotas(edges: DataFrame, fraction: float | None = None, total: int | None = None, keys: list[str] = STRATUM) -> DataFrame:
    """Largest remainders: each stratum's floor of its share, and one more for the largest remainders (then the larger
    stratum, then the later key) until the total is met; the total is half-even rounded. (keys, n, quota)"""
    sizes = edges.groupBy(*keys).agg(F.count("*").alias("n"))
    both = sizes.crossJoin(F.broadcast(edges.agg(F.count("*").alias("all"))))
    want = F.lit(total).cast("long") if total is not None else half_even(F.col("all") * F.lit(fraction))
    exact = F.col("n") * (want / F.col("all"))
    both = both.withColumn("want", want).withColumn("floor", F.floor(exact).cast("long")).withColumn("rest", F.round(exact - F.floor(exact), 9))
    everything = Window.partitionBy()  # over strata, of which there are few
    place = F.row_number().over(Window.orderBy(F.desc("rest"), F.desc("n"), *(F.desc(k) for k in keys)))
    extra = F.when(place <= F.col("want") - F.sum("floor").over(everything), 1).otherwise(0)
    return both.select(*keys, "n", (F.col("floor") + extra).cast("long").alias("quota"))


def _cut(edges: DataFrame, quota: DataFrame, seed: int, purpose: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """edges with draw, digits and last (the digits that hold their stratum's last place, and how many edges with these are taken; strata that take
    none are left out), and of those with these digits the taken ones."""
    drawn = edges.withColumn("draw", draw(seed, purpose, identity())).withColumn("digits", F.substring("draw", 1, 4))
    counts = drawn.groupBy(*keys, "digits").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows a stratum
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(F.broadcast(quota.select(*keys, "quota")), keys)
    last = counts.where("before < quota").groupBy(*keys).agg(F.max(F.struct("digits", (F.col("quota") - F.col("before")).alias("rest"))).alias("last"))
    met = drawn.join(F.broadcast(written(last, "last-digits")), keys)  # one row a stratum
    order = Window.partitionBy(*keys).orderBy("draw", *IDENTITY)
    return met, met.where("digits = last.digits").withColumn("place", F.row_number().over(order)).where("place <= last.rest")


def stratified(edges: DataFrame, quota: DataFrame, seed: int, purpose: str, keys: list[str] = STRATUM) -> DataFrame:
    """The first edges of each stratum by their draw, as many as its quota.

    Draws are counted by their first four digits. Edges before the digits that hold a stratum's last place are taken, and only those with
    these digits are ranked, so a stratum is neither sorted nor gathered."""
    met, some = _cut(edges, quota, seed, purpose, keys)
    return met.where("digits < last.digits").select(*edges.columns).unionByName(some.select(*edges.columns))


def stratified_marks(edges: DataFrame, quota: DataFrame, seed: int, purpose: str, keys: list[str] = STRATUM) -> DataFrame:
    """edges with taken: whether `stratified` takes them. Edges are different; each is held against the last taken one of its stratum, so none is joined back."""
    at = F.struct("draw", *IDENTITY)
    cut = written(_cut(edges, quota, seed, purpose, keys)[1].groupBy(*keys).agg(F.max(at).alias("cut")), "cut")  # one row a stratum
    cut = F.broadcast(cut.select(*(F.col(k).alias(f"__{k}") for k in keys), "cut"))
    met = edges.withColumn("draw", draw(seed, purpose, identity())).join(cut, [F.col(k) == F.col(f"__{k}") for k in keys], "left")
    return met.select(*edges.columns, F.coalesce(at <= F.col("cut"), F.lit(False)).alias("taken"))


def stratified_fraction(edges: DataFrame, fraction: float, seed: int, purpose: str = "sample") -> DataFrame:
    own = written(edges, "edges")
    return stratified(own, quotas(own, fraction), seed, purpose)


def paired(edges: DataFrame, per_language: int, overlap: float, seed: int) -> DataFrame:
    """Edges of two samples of one size that share a fixed part: (identity columns, part) with part shared, first or second."""
    shared_n = int(round(per_language * overlap))  # half-even
    own = per_language - shared_n
    left, out = written(edges, "edges"), None
    for part, n in (("shared", shared_n), ("first", own), ("second", own)):
        drawn = written(stratified(left, quotas(left, total=n), seed, part), f"paired-{part}")
        out = drawn.withColumn("part", F.lit(part)) if out is None else out.unionByName(drawn.withColumn("part", F.lit(part)))
        left = left.join(drawn.select(*IDENTITY), IDENTITY, "left_anti")
    return out


def split(df: DataFrame, fraction: float, seed: int, key: str) -> DataFrame:
    """The column `part`: the first max(1, int(n * fraction)) rows by their draw are dev, the others train."""
    n = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(fraction))).alias("devs"))
    drawn = df.withColumn("draw", draw(seed, "split", F.col(key).cast("string")))
    first = drawn.select("draw", key).orderBy("draw", key)
    return _first(drawn, first, n, key)


def _first(drawn: DataFrame, ordered: DataFrame, n: DataFrame, key: str) -> DataFrame:
    bound = ordered.limit(int(n.first()[0])).agg(F.max(F.struct("draw", key)).alias("bound"))  # one row
    return drawn.crossJoin(F.broadcast(bound)).withColumn("part", F.when(F.struct("draw", key) <= F.col("bound"), "dev").otherwise("train")).drop("draw", "bound")


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows by their draw; all where there are no more."""
    return df.withColumn("draw", draw(seed, "sample", F.col(key).cast("string"))).orderBy("draw", key).limit(n).drop("draw")


def epoch(df: DataFrame, size: int, seed: int, number: int, key: str) -> DataFrame:
    """One epoch's rows: without replacement if there are enough, else with. Each epoch has its own draws."""
    n = df.count()
    if size <= n:
        return sample_n(df, size, seed * 1000 + number, key)
    ranked = numbered(df, key).withColumnRenamed("place", "k")
    picks = df.sparkSession.range(size).select(F.pmod(F.conv(F.substring(draw(seed, number, F.col("id").cast("string")), 1, 15), 16, 10).cast("long"), F.lit(n)).alias("k"))
    return ranked.join(picks, "k").drop("k")


def bilingual_epoch(a: DataFrame, b: DataFrame, size: int, seed: int, number: int, key: str) -> DataFrame:
    """Half of an epoch from one language, the rest from the other."""
    half = size // 2
    return epoch(a, half, seed, number, key).withColumn("lang", F.lit("a")).unionByName(epoch(b, size - half, seed + 1, number, key).withColumn("lang", F.lit("b")))


def probes(edges: DataFrame, usable: DataFrame, per_relation: int, min_total: int, seed: int, track: str) -> DataFrame:
    """per_relation usable triples of each relation that has enough triples and enough usable ones."""
    keys = ["source", "relation", "target"]
    enough = edges.select(*keys).distinct().groupBy("relation").agg(F.count("*").alias("total")).where(F.col("total") >= min_total)
    fit = usable.groupBy("relation").agg(F.count("*").alias("usable")).where(F.col("usable") >= per_relation)
    pool = usable.join(enough.select("relation"), "relation", "left_semi").join(fit.select("relation"), "relation", "left_semi")
    order = Window.partitionBy("relation").orderBy("draw", "source", "target")
    ranked = pool.withColumn("draw", draw(seed, track, F.concat_ws("|", *keys))).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= per_relation).select(F.lit(track).alias("track"), *keys)


def coverage_fill(edges: DataFrame, cover: DataFrame, target: int, fraction: float, seed: int) -> DataFrame:
    """The cover, filled to target edges: strata by how far the cover falls short of their quota, then by draw.

    The shortfall is that of the cover alone; filling does not reorder.
    """
    short = quotas(edges, fraction).join(cover.groupBy(*STRATUM).agg(F.count("*").alias("have")), STRATUM, "left").select(*STRATUM, (F.col("quota") - F.coalesce("have", F.lit(0))).alias("short"))
    rest = edges.join(cover.select(*IDENTITY), IDENTITY, "left_anti").join(short, STRATUM)
    need = max(0, target - cover.count())
    fill = rest.withColumn("draw", draw(seed, "fill", identity())).orderBy(F.desc("short"), "draw", *IDENTITY).limit(need)
    return cover.select(*IDENTITY).unionByName(fill.select(*IDENTITY))


def dense_fill(edges: DataFrame, cover: DataFrame, target: int, seed: int) -> DataFrame:
    """The cover, filled with the edges whose endpoints have the most incident edges."""
    from .graph import degree_incident

    d = degree_incident(edges)
    rest = edges.join(cover.select(*IDENTITY), IDENTITY, "left_anti").join(d.select(F.col("node").alias("source"), F.col("degree").alias("ds")), "source").join(d.select(F.col("node").alias("target"), F.col("degree").alias("dt")), "target")
    fill = rest.withColumn("draw", draw(seed, "dense", identity())).orderBy(F.desc(F.col("ds") + F.col("dt")), "draw", *IDENTITY).limit(max(0, target - cover.count()))
    return cover.select(*IDENTITY).unionByName(fill.select(*IDENTITY))


def grid(spark, conditions: list[tuple[str, float]], seeds: list[int]) -> DataFrame:
    """(condition, fraction, seed) of every run."""
    return spark.createDataFrame(conditions, "condition string, fraction double").crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in seeds], "seed int")))

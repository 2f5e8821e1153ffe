"""Statistics: ranks, Spearman with permutation tests, Fisher's exact test, two proportions, summaries over runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOLERANCE = 1e-12
MOST_EXACT = 40_320
DRAWS = 20_000


def average_ranks(df: DataFrame, value: str, out: str, *keys: str) -> DataFrame:
    """Ranks from 1; equal values share the mean of their places."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2)


def spearman(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, rho, n): 0 where one side does not vary."""
    ranked = average_ranks(average_ranks(df, x, "__rx", *keys), y, "__ry", *keys)
    n = F.count("*").cast("double")
    sxy = F.sum(F.col("__rx") * F.col("__ry")) - F.sum("__rx") * F.sum("__ry") / n
    sxx = F.sum(F.col("__rx") * F.col("__rx")) - F.sum("__rx") * F.sum("__rx") / n
    syy = F.sum(F.col("__ry") * F.col("__ry")) - F.sum("__ry") * F.sum("__ry") / n
    sums = ranked.groupBy(*keys).agg(F.count("*").alias("n"), sxy.alias("sxy"), sxx.alias("sxx"), syy.alias("syy"))
    rho = F.when((F.col("sxx") <= 0) | (F.col("syy") <= 0), 0.0).otherwise(F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    return sums.select(*keys, F.round(rho, 9).alias("rho"), "n")


def seed_means(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, condition, x, score): the mean over seeds of each condition."""
    return runs.groupBy(*keys, "condition", "x").agg(F.avg("score").alias("score"))


def _extreme(value: Column, observed: Column, side: str) -> Column:
    if side == "greater":
        return value >= observed - TOLERANCE
    if side == "less":
        return value <= observed + TOLERANCE
    return F.abs(value) >= F.abs(observed) - TOLERANCE


def permutation_p(means: DataFrame, x: str, y: str, key: str, side: str = "two-sided", seed: int = 0) -> DataFrame:
    """(key, n, rho, p) for groups of three or more rows.

    All permutations of the ranks are looked at where there are at most 40,320, else 20,000 drawn ones; p is the share of
    those as extreme as the observed order, the observed one among the exact ones.
    """
    ranked = average_ranks(average_ranks(means, x, "rx", key), y, "ry", key)
    groups = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rx", "ry"))).alias("r")).where(F.size("r") >= 3)
    groups = groups.select(key, F.transform("r", lambda r: r.rx).alias("rx"), F.transform("r", lambda r: r.ry).alias("ry"), F.size("r").alias("n"))
    # permutations grow by one place a step, as arrays of places
    exact = groups.where(F.factorial("n") <= MOST_EXACT).withColumn("perm", F.array().cast("array<int>"))
    most = exact.agg(F.max("n")).first()[0] or 0
    for _ in range(most):
        step = F.explode_outer(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: ~F.array_contains("perm", k)))
        exact = exact.withColumn("k", step).withColumn("perm", F.when(F.col("k").isNull(), F.col("perm")).otherwise(F.concat("perm", F.array("k")))).drop("k")
    drawn = groups.where(F.factorial("n").isNull() | (F.factorial("n") > MOST_EXACT)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(DRAWS))))
    places = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), k.cast("string"))).alias("h"), k.alias("k")))
    drawn = drawn.withColumn("perm", F.transform(F.array_sort(places), lambda p: p.k)).drop("draw")
    mean = (F.col("n") + 1) / 2
    centred = lambda c: F.transform(c, lambda v: v - mean)
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    cx, cy = centred(F.col("rx")), centred(F.col("ry"))
    scale = F.sqrt(total(cx, cx) * total(cy, cy))
    rho = lambda b: F.when(scale == 0, 0.0).otherwise(total(cx, b) / scale)
    permuted = F.transform("perm", lambda k: F.element_at(cy, k + 1))
    all_of = exact.unionByName(drawn).select(key, "n", rho(cy).alias("rho"), rho(permuted).alias("other"))
    return all_of.groupBy(key, "n").agg(F.round(F.first("rho"), 9).alias("rho"), F.round(F.avg(_extreme(F.col("other"), F.col("rho"), side).cast("double")), 9).alias("p"))


#: Beyond this many standard deviations from where a sum begins, its terms add nothing to a double.
REACH = 12
_HALF_LOG_2PI = math.log(2 * math.pi) / 2


def _stirling_rest(n: Column) -> Column:
    """log(n!) less Stirling's formula, n above 0: from the factorial itself up to 16, by the series beyond."""
    exact = F.log(F.factorial(F.least(n, F.lit(16)).cast("int"))) - (n + 0.5) * F.log(n) + n - _HALF_LOG_2PI
    r = F.try_divide(F.lit(1.0), n * n)
    series = F.try_divide(1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - (1 / 1188 - 691 / 360360 * r) * r) * r) * r) * r, n)
    return F.when(n <= 16, exact).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) + mean - x, by its series where both are near."""
    v = F.try_divide(x - mean, x + mean)
    odd = F.lit(0.0)
    for k in range(12, 0, -1):
        odd = (odd + 1 / (2 * k + 1)) * v * v
    return F.when(F.abs(x - mean) < 0.1 * (x + mean), (x - mean) * v + 2 * x * v * odd).otherwise(x * F.log(F.try_divide(x, mean)) + mean - x)


def _log_binomial(x: Column, n: Column, p: Column, q: Column) -> Column:
    """log of the probability of x of n, to full precision at any size (saddle point form)."""
    inner = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q) + 0.5 * (F.log(F.try_divide(n, x * (n - x))) - 2 * _HALF_LOG_2PI)
    none = F.when(q <= 0, F.when(n == 0, 0.0).otherwise(float("-inf"))).when(p < 0.5, n * F.log1p(-p)).otherwise(n * F.log(q))
    every = F.when(p <= 0, F.when(n == 0, 0.0).otherwise(float("-inf"))).when(q < 0.5, n * F.log1p(-q)).otherwise(n * F.log(p))
    return F.when(n == 0, 0.0).when(x == 0, none).when(x == n, every).otherwise(inner)


def fisher(tables: DataFrame, side: str = "greater") -> DataFrame:
    """tables (hits_a, n_a, hits_b, n_b, ...) with p_fisher.

    The probability of a table comes from three binomial ones in saddle point form, and a tail from it by ratios of neighbouring
    terms, outwards from the mode's side that falls; a tail that begins before the mode is one less the other one. A sum ends REACH
    standard deviations after its beginning, so its length grows with the root of the total. Everything is a column.
    """
    d = lambda c: F.col(c).cast("double")
    rows = tables.withColumn("__t", F.struct(d("n_a").alias("a"), d("n_b").alias("b"), (d("hits_a") + d("hits_b")).alias("good"), d("hits_a").alias("k")))
    a, b, good, own = (F.col(f"__t.{c}") for c in ("a", "b", "good", "k"))
    total = a + b
    low, high = F.greatest(F.lit(0.0), good - b), F.least(a, good)
    mode = F.least(high, F.greatest(low, F.floor((a + 1) * (good + 1) / (total + 2)).cast("double")))
    deviation = F.sqrt(good * F.try_divide(a, total) * F.try_divide(b, total) * (total - good) / F.greatest(total - 1, F.lit(1.0)))
    rows = rows.withColumn("__s", F.struct(low.alias("low"), high.alias("high"), mode.alias("mode"), (F.ceil(REACH * F.coalesce(deviation, F.lit(0.0))) + 100).cast("long").alias("reach")))
    low, high, mode, reach = (F.col(f"__s.{c}") for c in ("low", "high", "mode", "reach"))
    p, q = F.try_divide(good, total), F.try_divide(total - good, total)

    def log_p(k: Column) -> Column:
        return _log_binomial(k, a, p, q) + _log_binomial(good - k, b, p, q) - _log_binomial(good, total, p, q)

    def up(k: Column) -> Column:
        """The sum from k to the end, k at the mode or after it."""
        first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        at = lambda i: k + i - 1
        ratio = lambda i: (a - at(i)) * (good - at(i)) / ((at(i) + 1) * (b - good + at(i) + 1))
        last = F.least(reach, (high - k).cast("long"))
        summed = F.aggregate(F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<bigint>")), first, lambda s, i: F.struct((s.term * ratio(i)).alias("term"), (s.sum + s.term * ratio(i)).alias("sum")), lambda s: s.sum)
        return F.when(k > high, 0.0).otherwise(F.exp(log_p(k)) * summed)

    def down(k: Column) -> Column:
        """The sum from the beginning to k, k at the mode or before it."""
        first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        at = lambda i: k - i + 1
        ratio = lambda i: at(i) * (b - good + at(i)) / ((a - at(i) + 1) * (good - at(i) + 1))
        last = F.least(reach, (k - low).cast("long"))
        summed = F.aggregate(F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<bigint>")), first, lambda s, i: F.struct((s.term * ratio(i)).alias("term"), (s.sum + s.term * ratio(i)).alias("sum")), lambda s: s.sum)
        return F.when(k < low, 0.0).otherwise(F.exp(log_p(k)) * summed)

    if side == "greater":
        out = F.when(own >= mode, up(own)).otherwise(1 - down(own - 1))
    elif side == "less":
        out = F.when(own <= mode, down(own)).otherwise(1 - up(own + 1))
    else:
        rows = rows.withColumn("__o", F.struct((log_p(own) + 1e-7).alias("limit"), log_p(mode).alias("top")))
        limit = F.col("__o.limit")
        halved = F.sequence(F.lit(1), F.lit(64))

        def halve(s: Column, left: bool) -> Column:
            """One halving of lo to hi: on the left lo is no likelier than the limit, on the right hi is."""
            middle = F.floor((s.lo + s.hi) / 2).cast("double")
            upper, lower = F.struct(middle.alias("lo"), s.hi.alias("hi")), F.struct(s.lo.alias("lo"), middle.alias("hi"))
            rare = log_p(middle) <= limit
            return F.when(s.hi - s.lo <= 1, s).when(rare if left else ~rare, upper).otherwise(lower)

        # the last k before the mode, and the first after it, that are no likelier
        left = F.aggregate(halved, F.struct((low - 1).alias("lo"), mode.alias("hi")), lambda s, _: halve(s, True), lambda s: s.lo)
        right = F.aggregate(halved, F.struct(mode.alias("lo"), (high + 1).alias("hi")), lambda s, _: halve(s, False), lambda s: s.hi)
        rows = rows.withColumn("__h", F.when(own > mode, left).otherwise(right))
        other = F.col("__h")
        out = F.when(F.col("__o.top") <= limit, 1.0).when(own > mode, up(own) + down(other)).otherwise(down(own) + up(other))
    return rows.withColumn("p_fisher", F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), out)))).drop("__t", "__s", "__o", "__h")


def z_of(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column) -> Column:
    """The pooled z of two proportions; NaN where the standard error is 0."""
    pooled = (hits_a + hits_b) / (n_a + n_b)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n_a + 1 / n_b))
    return F.when(se == 0, F.lit(float("nan"))).otherwise((hits_a / n_a - hits_b / n_b) / se)


def normal_tail(z: Column) -> Column:
    """P(Z >= z) of a standard normal variable, to 1e-12 of itself: a series of positive terms near 0, a continued fraction from 3 on."""
    x = F.abs(z)
    density = F.exp(-x * x / 2 - _HALF_LOG_2PI)
    steps = F.sequence(F.lit(1), F.lit(70))
    series = F.aggregate(steps, F.struct(x.alias("term"), x.alias("sum")), lambda s, k: F.struct((s.term * x * x / (2 * k + 1)).alias("term"), (s.sum + s.term * x * x / (2 * k + 1)).alias("sum")), lambda s: s.sum)
    fraction = F.aggregate(steps, x, lambda s, k: x + (71 - k) / s)
    upper = F.when(x < 3, 0.5 - density * series).otherwise(density / fraction)
    return F.when(z < 0, 1 - upper).otherwise(upper)


def two_proportions(tables: DataFrame, side: str = "greater") -> DataFrame:
    z = z_of(*(F.col(c) for c in ("hits_a", "n_a", "hits_b", "n_b")))
    out = tables.withColumn("z", z)
    tail = normal_tail(F.col("z")) if side == "greater" else normal_tail(-F.col("z")) if side == "less" else 2 * normal_tail(F.abs("z"))
    return out.withColumn("p_z", F.when(F.isnan("z"), F.lit(float("nan"))).otherwise(tail))  # a NaN of pandas would come back as null


def significant(p: Column, level: float = 0.05) -> Column:
    return F.when(p < level, "YES").otherwise("NO")


def trend_label(rho: Column) -> Column:
    return F.when(rho > 0.5, "monotone increasing").when(rho < -0.5, "monotone decreasing").otherwise("no clear trend")


def hits_of(accuracy: Column, n: Column) -> Column:
    return F.bround(accuracy * n).cast("long")


def mean_sd(df: DataFrame, values: list[str], keys: list[str], kind: str) -> DataFrame:
    """(keys, value_mean, value_sd, value_n) of each value. kind: sample (null SD below two values), sample_zero (0 there),
    sample_nan (NaN there) or population. Nulls are left out."""
    sd = {"sample": F.stddev_samp, "population": F.stddev_pop, "sample_zero": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)), "sample_nan": lambda c: F.coalesce(F.stddev_samp(c), F.lit(float("nan")))}[kind]
    return df.groupBy(*keys).agg(*(a for v in values for a in (F.round(F.avg(v), 6).alias(f"{v}_mean"), F.round(sd(v), 6).alias(f"{v}_sd"), F.count(v).alias(f"{v}_n"))))

"""Text and statistics functions on known values."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from glossweave.functions import stats
from glossweave.functions import text as tx
from glossweave.operators import report


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "token, want",
    [("abdomen.n.01.", ["abdomen.n.01", "."]), ("conceptnet:art:1286.", ["conceptnet:art:1286", "."]), ("abdominal_wall.n.01,", ["abdominal_wall.n.01", ","]), ("ball-and-socket_joint.n.01.", ["ball-and-socket_joint.n.01", "."]), (".,x,.", [".", ",", "x", ",", "."]), (".", ["."])],
)
def test_split_edges(spark, token, want):
    assert one(spark, token, tx.split_edges) == want


@pytest.mark.parametrize("raw, want", [("Ice_Cream", "ice cream"), ("a+b", None), ("100%", None), ("x_y_z_w", None), ("caf%C3%A9", "café"), ("w1", None), ("", None), (None, None)])
def test_clean_lemma(spark, raw, want):
    assert one(spark, raw, tx.clean_lemma) == want


def test_lemma_keeps_plus_and_bad_escapes(spark):
    assert one(spark, "a+b", tx.normalize_lemma) == "a+b"
    assert one(spark, "50%_off", tx.normalize_lemma) == "50% off"


@pytest.mark.parametrize("meta, want", [('{"weight": 2.5}', 2.5), ('{"weight": "x"}', 1.0), ("{broken", 1.0), ("[1]", 1.0), (None, 1.0), ("{}", 1.0)])
def test_weight(spark, meta, want):
    assert one(spark, meta, tx.weight_of) == want


def test_mask_first_only(spark):
    assert one(spark, "a b a", lambda v: tx.mask_first(tx.words(v), F.lit("a"))) == "[MASK] b a"
    assert one(spark, "b", lambda v: tx.mask_first(tx.words(v), F.lit("a"))) is None


def test_half_even(spark):
    assert one(spark, "717.5", lambda v: tx.half_even(v.cast("double"))) == 718
    assert one(spark, "2152.5", lambda v: tx.half_even(v.cast("double"))) == 2152


def test_related_and_comma_lists(spark):
    assert spark.range(1).select(tx.comma_list(F.array(F.lit("a, b"), F.lit(",c"))).alias("r")).first().r == ["a", "b", "c"]


TABLES = [(167, 278, 106, 278, 1.6167e-07, 1.1408e-07), (1669, 1903, 1529, 2000, 2.2794e-20, 3.2807e-20), (122, 169, 4, 256, 4.452e-61, None)]


@pytest.mark.parametrize("a, na, b, nb, fisher, z", TABLES)
def test_published_significance(spark, a, na, b, nb, fisher, z):
    t = spark.createDataFrame([(a, na, b, nb)], "hits_a long, n_a long, hits_b long, n_b long")
    assert math.isclose(stats.fisher(t).first().p_fisher, fisher, rel_tol=1e-3)
    if z:
        assert math.isclose(stats.two_proportions(t).first().p_z, z, rel_tol=1e-3)


def test_fisher_sides(spark):
    t = spark.createDataFrame([(3, 4, 1, 4)], "hits_a long, n_a long, hits_b long, n_b long")
    assert math.isclose(stats.fisher(t, "greater").first().p_fisher, 17 / 70)
    assert math.isclose(stats.fisher(t, "two-sided").first().p_fisher, 34 / 70)


@pytest.mark.parametrize("side, p", [("greater", 1 / 24), ("two-sided", 2 / 24), ("less", 1.0)])
def test_permutation_floor(spark, side, p):
    t = spark.createDataFrame([("g", k, float(k)) for k in range(4)], "g string, x int, y double")
    r = stats.permutation_p(t, "x", "y", "g", side).first()
    assert r.rho == 1.0 and math.isclose(r.p, p, abs_tol=1e-8)


def test_permutation_sampled_and_skipped(spark):
    t = spark.createDataFrame([("g", k, float(k)) for k in range(10)] + [("h", k, 1.0) for k in range(2)], "g string, x int, y double")
    rows = stats.permutation_p(t, "x", "y", "g").collect()
    assert [r.g for r in rows] == ["g"] and rows[0].p < 0.001


def test_spearman_without_variation(spark):
    t = spark.createDataFrame([("g", k, 1.0) for k in range(4)], "g string, x int, y double")
    assert stats.spearman(t, "x", "y", "g").first().rho == 0.0


def test_seed_summary(spark):
    t = spark.createDataFrame([("a", v) for v in (0.3685, 0.4975, 0.507)] + [("b", 1.0), ("b", None)], "k string, v double")
    got = {r.k: r for r in stats.mean_sd(t, ["v"], ["k"], "sample").collect()}
    assert (got["a"].v_mean, got["a"].v_sd, got["a"].v_n) == (0.457667, 0.077367, 3)
    assert got["b"].v_sd is None and got["b"].v_n == 1
    assert {r.k: r.v_sd for r in stats.mean_sd(t, ["v"], ["k"], "sample_zero").collect()}["b"] == 0.0
    assert math.isnan({r.k: r.v_sd for r in stats.mean_sd(t, ["v"], ["k"], "sample_nan").collect()}["b"])


def test_log_without_four_precisions_fails(spark):
    df = spark.createDataFrame([("top-1 precision : 0.5",)], "t string").select(report.word_log(F.col("t")))
    with pytest.raises(Exception, match="expected 4 precisions"):
        df.collect()


def exact_fisher(a, na, b, nb, side):
    good = a + b
    ways = {k: math.comb(na, k) * math.comb(nb, good - k) for k in range(max(0, good - nb), min(na, good) + 1)}
    inside = {"greater": lambda k: k >= a, "less": lambda k: k <= a, "two-sided": lambda k: ways[k] <= ways[a] + ways[a] // 10**7}[side]
    return float(Fraction(sum(w for k, w in ways.items() if inside(k)), math.comb(na + nb, good)))


@pytest.mark.parametrize("side", ["greater", "less", "two-sided"])
def test_fisher_against_whole_numbers(spark, side):
    r, made = random.Random(1), [(0, 0, 0, 0), (0, 5, 0, 7), (5, 5, 7, 7), (0, 0, 3, 9), (1, 1, 0, 1)]
    for _ in range(60):
        na, nb = (r.choice([r.randint(0, 12), r.randint(1, 300), r.randint(100, 2500)]) for _ in range(2))
        p = r.random()
        made += [(r.randint(0, na), na, r.randint(0, nb), nb), (sum(r.random() < p for _ in range(na)), na, sum(r.random() < p for _ in range(nb)), nb)]
    for x in stats.fisher(spark.createDataFrame(made, "hits_a long, n_a long, hits_b long, n_b long"), side).collect():
        assert math.isclose(x.p_fisher, exact_fisher(*x[:4], side), rel_tol=1e-9, abs_tol=1e-12)


def test_fisher_of_large_totals(spark):
    """Totals of 10^9, where the normal tail with its half-step is near; no list, no bound."""
    t = spark.createDataFrame([(300_010_000, 600_000_000, 200_000_000, 400_000_000)], "hits_a long, n_a long, hits_b long, n_b long")
    a, b, good = 600_000_000, 400_000_000, 500_010_000
    deviation = math.sqrt(good * (a / 1e9) * (b / 1e9) * (1e9 - good) / (1e9 - 1))
    z = (300_010_000 - 0.5 - good * a / 1e9) / deviation
    assert math.isclose(stats.fisher(t).first().p_fisher, math.erfc(z / math.sqrt(2)) / 2, rel_tol=1e-6)


def test_normal_tail(spark):
    df = spark.createDataFrame([(k / 10,) for k in range(-80, 370)], "z double")
    for x in df.select("z", stats.normal_tail(F.col("z")).alias("p")).collect():
        assert math.isclose(x.p, math.erfc(x.z / math.sqrt(2)) / 2, rel_tol=1e-12)
    assert math.isnan(spark.createDataFrame([(float("nan"),)], "z double").select(stats.normal_tail(F.col("z")).alias("p")).first().p)

"""Steps whose work in one task or whose shuffles grew with the whole input."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossweave.operators import corpus, graph, retrieval, sampling

EDGE = "source string, relation string, target string, source_type string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strata_are_cut_by_digits(spark):
    """Quotas of none, some, all and more than all; only edges with the digits of the last place are ranked."""
    edges = [(f"s{k}", r, f"t{k % 9}", "x") for r, n in (("a", 60), ("b", 40), ("c", 5), ("d", 7)) for k in range(n)]
    quota = {"a": 23, "b": 0, "c": 5, "d": 9}
    got = sampling.stratified(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(r, "x", n) for r, n in quota.items()], "relation string, source_type string, quota long"), 3, "p")
    key = lambda e: hashlib.md5("|".join(["3", "p", *e]).encode()).hexdigest()
    want = [e for r, n in quota.items() for e in sorted((e for e in edges if e[1] == r), key=key)[:n]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "digits" in plan(got)


def test_pairs_of_a_graph_are_told_apart_once(spark):
    e = spark.createDataFrame([("a", "r", "b", "x"), ("b", "r", "a", "x"), ("a", "q", "b", "x"), ("c", "r", "c", "x"), ("c", "r", "a", "x")], EDGE)
    near = graph.neighbours(e)
    assert sorted(map(tuple, near.collect())) == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")]
    assert "Union" not in plan(near)


def test_blocks_meet_without_a_shuffle_and_ties_stay(spark):
    """Many equal similarities: the smaller ids come first, whatever blocks they stand in."""
    r = np.random.default_rng(1)
    vecs = [v.tolist() for v in r.normal(size=(6, 4))] * 5
    df = spark.createDataFrame(list(enumerate(vecs)), "id long, vec array<double>")
    assert "Exchange" not in plan(retrieval._pair_units(df, 7)).replace("BroadcastExchange", "")
    unit = np.array(vecs) / (np.linalg.norm(vecs, axis=1, keepdims=True) + 1e-9)
    every = [(a, b, round(float(unit[a] @ unit[b]), 9)) for a in range(30) for b in range(a + 1, 30)]
    for largest in (True, False):
        want = sorted(every, key=lambda x: (-x[2] if largest else x[2], x[0], x[1]))[:9]
        assert [(x.a, x.b) for x in retrieval.extreme_pairs(df, 9, largest, 7).collect()] == [x[:2] for x in want]


def test_small_lexicon_meets_tokens_without_a_shuffle(spark):
    """A lexicon whose size cannot be told from its plan."""
    lexicon = spark.range(10**7).where("id < 3").select(F.lit("a").alias("lang"), F.concat(F.lit("w"), "id").alias("key"), F.concat(F.lit("x"), "id").alias("artificial"))
    tokens = spark.range(10**7).where("id < 5").select(F.lit("s").alias("sentence"), F.col("id").alias("position"), F.concat(F.lit("w"), "id").alias("token"))
    out = corpus.translate(tokens, lexicon, False)
    assert [r.mapped for r in out.orderBy("position").collect()] == ["x0", "x1", "x2", None, None]
    assert "SortMergeJoin" not in plan(out)


def test_a_task_sends_k_rows_a_query():
    """Four blocks of a gallery meet one block of queries: the best of all travel, at a tie the smaller ids."""
    r = np.random.default_rng(2)
    queries, gallery = r.normal(size=(5, 3)), np.repeat(r.normal(size=(6, 3)), 2, axis=0)
    ids = np.array([7, 3, 0, 11, 4, 9, 1, 2, 10, 5, 8, 6])
    rows = [{"block": 0, "ids": list(range(5)), "vecs": queries.ravel(), "ids2": ids[k : k + 3], "vecs2": gallery[k : k + 3].ravel()} for k in range(0, 12, 3)]
    out = pd.concat(retrieval._best(iter([pd.DataFrame(rows[:2]), pd.DataFrame(rows[2:])]), 4))
    sims = np.round(queries @ gallery.T, 12)
    want = [(q, g) for q in range(5) for g in sorted(range(12), key=lambda g: (-sims[q, list(ids).index(g)], g))[:4]]
    assert list(zip(out["q"], out["g"])) == want


@pytest.mark.parametrize("held", [1 << 17, 7])
def test_gallery_passes_by_row_by_row(spark, held):
    """Groups of queries meet groups of the gallery in cells: no join of blocks, and no row that holds a block."""
    r = np.random.default_rng(5)
    m = np.repeat(r.normal(size=(30, 4)), 2, axis=0)
    v = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(m)], "id long, vec array<double>")
    out = retrieval.top_k(v.where("id % 3 = 0"), v.where("id % 3 > 0"), 3, held=held)
    assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out) and "ObjectHashAggregate" not in plan(out)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    want = {(q, p + 1): g for q in range(0, 60, 3) for p, g in enumerate(sorted((g for g in range(60) if g % 3), key=lambda g: (-sims[q, g], g))[:3])}
    assert {(x.q, x.place): x.g for x in out.collect()} == want


def test_cells_of_one_task_stand_apart():
    """Two cells in batches that cut them anywhere: each has its own best; a cell without queries or without gallery has none."""
    rows = [(0, 0, 1, [1.0, 0.0]), (0, 0, 2, [0.0, 1.0]), (0, 1, 5, [1.0, 0.0]), (0, 1, 4, [1.0, 0.0]), (1, 1, 6, [1.0, 0.0]), (2, 0, 1, [1.0, 0.0]), (3, 0, 3, [1.0, 1.0]), (3, 1, 7, [0.5, 0.0]), (3, 1, 8, [1.0, 0.0])]
    whole = pa.RecordBatch.from_pylist([dict(zip(("cell", "side", "id", "vec"), x)) for x in rows], pa.schema([("cell", pa.int32()), ("side", pa.int32()), ("id", pa.int64()), ("vec", pa.list_(pa.float64()))]))
    for size in (1, 2, 9):
        out = pa.Table.from_batches(retrieval._cells((whole.slice(k, size) for k in range(0, 9, size)), 1)).to_pydict()
        assert list(zip(out["q"], out["g"], out["sim"])) == [(1, 4, 1.0), (2, 4, 0.0), (3, 8, 1.0)]


def test_tokens_are_added_up_where_they_are(spark):
    """Means of a sentence's tokens: tokens meet few vectors without a shuffle, and one row a sentence and task travels; neither those left out nor unknown ones count."""
    tokens = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "the", 1), (2, "the", 1), (3, "z", 9)], "sentence long, token string, kind long")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 4.0])], "kind long, vec array<double>")
    out = retrieval.pooled_sentences(tokens, F.broadcast(vectors), 2, ["the"], "kind")
    assert {r.sentence: r.vec for r in out.collect()} == {1: [0.5, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    assert "SortMergeJoin" not in plan(out) and "ObjectHashAggregate" not in plan(out)

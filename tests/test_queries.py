"""Every registered query runs; those with SQL give its rows."""

from collections import Counter

import pytest
from compare import same
from conftest import SF

from glossweave.plans import registry


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


WHOLE = ["greedy_capped_graph", "edge_cover", "relation_first_repair", "relation_control", "paired_coverage_repair", "paired_overlap_sample", "coverage_first_fill", "dense_control_fill"]


@pytest.mark.parametrize("name", WHOLE)
def test_takes_large_relations(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert {r.relation.removeprefix("also_") for r in rows} & {"placedBy", "suppliedBy"}
    assert len({(r.source, r.relation, r.target, r.source_type) for r in rows}) == len(rows)


def test_whole_cap_and_cover(spark):
    from glossweave.sources import adapters

    nodes = {n for r in adapters.kg_edges(spark, SF).collect() for n in (r.source, r.target)}
    near = {}
    for r in registry.QUERIES["greedy_capped_graph"](spark, SF).collect():
        near.setdefault(r.source, set()).add(r.target)
        near.setdefault(r.target, set()).add(r.source)
    assert max(map(len, near.values())) == 12
    for name in ("edge_cover", "relation_first_repair"):
        assert {n for r in registry.QUERIES[name](spark, SF).collect() for n in (r.source, r.target)} == nodes


@pytest.mark.parametrize("name", ["sentence_retrieval", "sentence_retrieval_without_marks"])
def test_all_turns_are_retrieved(spark, name):
    from glossweave.sources import adapters

    odd = adapters.table(spark, SF, "conversations").where("turn % 2 = 1").count()
    assert registry.QUERIES[name](spark, SF).first().queries == odd


def test_relation_control_has_swaps(spark):
    """The wanted counts are of the sample's size: many edges leave and come, until the largest relation has none left to give or the others have theirs."""
    from glossweave.operators import sampling
    from glossweave.sources import adapters

    edges = [tuple(r) for r in adapters.kg_edges(spark, SF).collect()]
    before = {tuple(r) for r in sampling.stratified_fraction(adapters.kg_edges(spark, SF), 0.3, 1).collect()}
    after = {(r.source, r.relation, r.target, r.source_type) for r in registry.QUERIES["relation_control"](spark, SF).collect()}
    nodes = lambda part: Counter(n for x in part for n in (x[0], x[2]))
    assert len(after) == len(before) and after <= set(edges) and set(nodes(before)) <= set(nodes(after))
    assert len(after - before) > len(before) // 4
    held, kinds, stock = nodes(after), Counter(x[1] for x in after), Counter(x[1] for x in edges)
    loose = [x for x in after if x[1] == "suppliedBy" and held[x[0]] > 1 and held[x[2]] > 1]
    assert not loose or all(kinds[r] >= round(0.9 * n) - 2 for r, n in stock.items() if r != "suppliedBy")

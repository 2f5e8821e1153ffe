"""Typed graphs: counts, degrees, validation, neighbourhoods, comparisons. Edges are (source, relation, target, source_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .numbering import numbered

EDGE = ["source", "relation", "target"]


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Counts with their percent of all and their place: most frequent first, then by key."""
    out = counts(df, key)
    total = df.agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), key))  # over the groups, not the rows
    return out.crossJoin(F.broadcast(total)).select(key, "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"), place.alias("place"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other): each undirected pair both ways, once."""
    pairs = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()  # once a pair, not once a way
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("p")).select("p.*")


def degree_distinct(edges: DataFrame) -> DataFrame:
    return neighbours(edges).groupBy("node").agg(F.count("*").alias("degree"))


def degree_incident(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("source").alias("node")).unionAll(edges.select("target"))
    return both.groupBy("node").agg(F.count("*").alias("degree"))


def degree_stats(degrees: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: nodes, active nodes, least, most and mean degree over all and over active nodes, nodes below 2."""
    if nodes is not None:
        degrees = nodes.join(degrees, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    active = F.when(F.col("degree") > 0, F.col("degree"))
    return degrees.agg(F.count("*").alias("nodes"), F.count(active).alias("active"), F.min("degree").alias("least"), F.max("degree").alias("most"), F.round(F.avg("degree"), 4).alias("mean"), F.round(F.avg(active), 4).alias("active_mean"), F.count_if(F.col("degree") < 2).alias("below_two"))


def degree_histogram(degrees: DataFrame) -> DataFrame:
    return degrees.groupBy("degree").agg(F.count("*").alias("nodes"))


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that edges name and that are not listed."""
    return endpoints(edges).join(nodes.select("node"), "node", "left_anti")


def validation_report(edges: DataFrame, nodes: DataFrame, max_degree: int) -> DataFrame:
    """One row: edges, duplicates, self-loops, endpoints missing, edges a node, nodes above the cap."""
    keys = edges.groupBy(*EDGE).agg(F.count("*").alias("copies"))
    e = keys.agg(F.sum("copies").alias("edges"), F.sum(F.col("copies") - 1).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("source") == F.col("target"), F.col("copies"))), F.lit(0)).alias("self_loops"))
    n = nodes.agg(F.count("*").alias("nodes"))
    m = missing_endpoints(edges, nodes).agg(F.count("*").alias("missing"))
    c = degree_distinct(edges).agg(F.count_if(F.col("degree") > max_degree).alias("above_cap"))
    one = e.crossJoin(n).crossJoin(m).crossJoin(c)  # four one-row tables
    return one.withColumn("edges_per_node", F.round(F.try_divide(F.col("edges").cast("double"), F.col("nodes").cast("double")), 6))


def multi_relation_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs that stand in several relations."""
    pair = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "relation").distinct()
    return pair.groupBy("a", "b").agg(F.count("*").alias("relations")).where("relations > 1")


def unique_targets(edges: DataFrame, min_degree: int) -> DataFrame:
    """Edges that are the only target of their source and relation, with a target of enough incident edges."""
    one = edges.groupBy("source", "relation").agg(F.max("target").alias("last"), F.min("target").alias("target")).where("last = target")  # one row a key, not one a different target
    degree = degree_incident(edges).where(F.col("degree") >= min_degree).select(F.col("node").alias("target"))
    return one.select(*EDGE).join(degree, "target", "left_semi").select(*EDGE)


def unique_relations(edges: DataFrame, min_degree: int) -> DataFrame:
    one = edges.groupBy("source", "target").agg(F.max("relation").alias("last"), F.min("relation").alias("relation")).where("last = relation")
    degree = degree_incident(edges).where(F.col("degree") >= min_degree)
    out = one.join(degree.select(F.col("node").alias("source")), "source", "left_semi").join(degree.select(F.col("node").alias("target")), "target", "left_semi")
    return out.select(*EDGE)


def connectivity(edges: DataFrame, relations: list[str]) -> DataFrame:
    """Of each source the number of edges in the given relations."""
    return edges.where(F.col("relation").isin(relations)).groupBy("source").agg(F.count("*").alias("score"))


def relation_shares(edges: DataFrame) -> DataFrame:
    total = edges.agg(F.count("*").alias("total"))
    return counts(edges, "relation").crossJoin(F.broadcast(total)).select("relation", "n", (F.col("n") / F.col("total")).alias("share"))


def compare_relations(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the largest difference of a relation's shares, and the sum of differences of counts."""
    x = relation_shares(a).select("relation", F.col("n").alias("na"), F.col("share").alias("sa"))
    y = relation_shares(b).select("relation", F.col("n").alias("nb"), F.col("share").alias("sb"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = x.join(y, "relation", "full")
    return both.agg(F.round(F.max(F.abs(zero("sa") - zero("sb"))), 6).alias("max_share_delta"), F.sum(F.abs(zero("na") - zero("nb"))).alias("l1_distance"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: sizes, intersection, share of each side and Jaccard similarity of two sets of keys."""
    x = a.select(*keys).distinct().withColumn("in_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("in_b", F.lit(1))
    both = x.join(y, keys, "full")
    sums = both.agg(F.count("in_a").alias("size_a"), F.count("in_b").alias("size_b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("shared"), F.count("*").alias("total"))
    ratio = lambda n, d: F.round(F.try_divide(F.col(n).cast("double"), F.col(d).cast("double")), 6)
    return sums.select("size_a", "size_b", "shared", ratio("shared", "size_a").alias("share_a"), ratio("shared", "size_b").alias("share_b"), ratio("shared", "total").alias("jaccard"))


def coverage(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, covered) for the nodes of edges."""
    return endpoints(edges).join(endpoints(selected).withColumn("hit", F.lit(True)), "node", "left").select("node", F.col("hit").isNotNull().alias("covered"))


def first_edges(edges: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """Of edges that agree in the keys, the first in the order."""
    return edges.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(c) for c in edges.columns)), F.struct(*order)).alias("e")).select("e.*")


def bfs_depth(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): the least number of steps from a root along edges' direction reversed, up to max_depth."""
    from glossweave.sources.shared import written

    found = roots.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = found
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier, edges.target == frontier.node, "left_semi").select(F.col("source").alias("node")).distinct()
        frontier = written(reached.join(found, "node", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def siblings(edges: DataFrame, kind: str) -> DataFrame:
    """Pairs of edges with one source. same_relation: other target; same_target: other relation; any: another edge."""
    a = edges.select(*EDGE).distinct()
    b = a.select("source", F.col("relation").alias("relation2"), F.col("target").alias("target2"))
    on = {"same_relation": "relation = relation2 and target <> target2", "same_target": "target = target2 and relation <> relation2", "any": "not (relation = relation2 and target = target2)"}
    keys = {"same_relation": a.relation == b.relation2, "same_target": a.target == b.target2}
    same = b.withColumnRenamed("source", "source2")
    joined = a.join(same, (a.source == same.source2) & keys[kind] if kind in keys else a.source == same.source2)
    return joined.where(on[kind]).select("source", "relation", "target", "relation2", "target2")


def sibling_classes(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, edges, pairs, digest) of edges that agree in keys, at least two: how many there are, how many ordered pairs they make, and the sum of
    the first 32 bits of the md5 of their ends. Pairs are counted, not listed, so a hub costs as much as its edges."""
    own = edges.select(*EDGE).distinct()
    rest = F.concat_ws("|", *(c for c in EDGE if c not in keys))
    digest = F.conv(F.substring(F.md5(rest), 1, 8), 16, 10).cast("long")
    sizes = own.groupBy(*keys).agg(F.count("*").alias("edges"), F.sum(digest).alias("digest")).where("edges > 1")
    return sizes.select(*keys, "edges", (F.col("edges") * (F.col("edges") - 1)).alias("pairs"), "digest")


def drawn_siblings(edges: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """For each edge one of the others that agree with it in keys, uniformly by a draw: (source, relation, target, relation2, target2).

    Edges stand in one order by keys; a partner is so many places further, round its class, so two edges meet by a place and no
    class is listed in pairs or gathered."""
    from glossweave.sources.shared import written

    from .numbering import numbered

    rest = [c for c in EDGE if c not in keys]
    placed = written(numbered(edges.select(*EDGE).distinct(), *keys, *rest), "siblings")
    sizes = placed.groupBy(*keys).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    ahead = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *EDGE)), 1, 8), 16, 10).cast("long") % (F.col("n") - 1) + 1
    aims = placed.join(sizes, keys).select(*EDGE, (F.col("first") + (F.col("place") - F.col("first") + ahead) % F.col("n")).alias("aim"))
    return aims.join(placed.select(F.col("place").alias("aim"), F.col("relation").alias("relation2"), F.col("target").alias("target2")), "aim").drop("aim")


def expansions(edges: DataFrame, allowed: DataFrame, rules: DataFrame) -> DataFrame:
    """Sibling pairs whose relations may follow each other and whose second relation has rules."""
    own = edges.select(*EDGE).distinct()
    may = allowed.select("relation", "relation2").distinct().join(rules.select(F.col("relation").alias("relation2")).distinct(), "relation2", "left_semi")
    second = own.select(F.col("source").alias("source2"), F.col("relation").alias("relation3"), F.col("target").alias("target2"))
    first = own.join(may, "relation")  # only edges whose relation allows one meet second edges, and only those of that relation
    pairs = first.join(second, (F.col("source") == F.col("source2")) & (F.col("relation2") == F.col("relation3")))
    return pairs.where("not (relation = relation2 and target = target2)").select("source", "relation", "target", "relation2", "target2")


def quality_lookup(edges: DataFrame, relation: str) -> tuple[DataFrame, DataFrame]:
    """(edges for sentences, node -> sorted qualities): the edges of one relation only describe their sources."""
    lookup = edges.where(F.col("relation") == relation).groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_set("target")).alias("qualities"))
    return edges.where(F.col("relation") != relation), lookup


def lemma_index(nodes: DataFrame) -> DataFrame:
    """(lemma, node) of (node, lemmas): of several nodes the last in order."""
    return nodes.select(F.explode("lemmas").alias("lemma"), "node").groupBy("lemma").agg(F.max("node").alias("node"))


def candidate_edges(parsed: DataFrame, index: DataFrame, allowed: list[str], min_weight: float) -> DataFrame:
    """Assertions (relation, source_lemma, target_lemma, weight, ...) with the nodes their lemmas name; at least one is known."""
    own = parsed.where(F.col("relation").isin(allowed) & (F.col("weight") >= min_weight) & F.col("source_lemma").isNotNull() & F.col("target_lemma").isNotNull() & (F.col("source_lemma") != F.col("target_lemma")))
    s = index.select(F.col("lemma").alias("source_lemma"), F.col("node").alias("source_node"))
    t = index.select(F.col("lemma").alias("target_lemma"), F.col("node").alias("target_node"))
    out = own.join(s, "source_lemma", "left").join(t, "target_lemma", "left")
    return out.where("source_node is not null or target_node is not null").where("not (source_node <=> target_node)")


def external_support(candidates: DataFrame) -> DataFrame:
    """Of each lemma outside the graph, the candidates that tie it to a known node."""
    outside = F.when(F.col("source_node").isNull(), F.col("source_lemma")).otherwise(F.col("target_lemma"))
    return candidates.where(F.col("source_node").isNull() != F.col("target_node").isNull()).groupBy(outside.alias("lemma")).agg(F.count("*").alias("support"))


def ranked_candidates(candidates: DataFrame, degrees: DataFrame, support: DataFrame, priority: list[str], loose: str = "RelatedTo") -> DataFrame:
    """Candidates in the order of insertion (rank from 1): firm relations before the loose one, edges between known nodes
    first, low degrees, rare support last, priority of the relation, weight, then the names."""
    p = F.array_position(F.array(*map(F.lit, priority)), F.col("relation"))
    d = degrees.select(F.col("node").alias("n"), F.col("degree").alias("d"))
    lemma = F.when(F.col("source_node").isNull(), F.col("source_lemma")).when(F.col("target_node").isNull(), F.col("target_lemma"))
    out = candidates.withColumn("outside", lemma)
    out = out.join(d.select(F.col("n").alias("source_node"), F.col("d").alias("source_degree")), "source_node", "left").join(d.select(F.col("n").alias("target_node"), F.col("d").alias("target_degree")), "target_node", "left")
    out = out.join(support.select(F.col("lemma").alias("outside"), "support"), "outside", "left")
    low = F.least(F.coalesce("source_degree", F.lit(10**6)), F.coalesce("target_degree", F.lit(10**6)))
    keys: list[Column] = [F.col("relation") == loose, F.col("outside").isNotNull(), low, F.desc(F.coalesce("support", F.lit(0))), p, F.desc("weight"), F.col("relation"), F.col("source_lemma"), F.col("target_lemma")]
    return numbered(out, *keys).withColumn("rank", (F.col("place") + 1).cast("int")).drop("outside", "place")


def second_pass_ranked(candidates: DataFrame, edges: DataFrame, priority: list[str]) -> DataFrame:
    """Candidates between two known nodes in the order of the second pass (rank from 1): priority of the relation (others last), heavy first,
    a low sum of distinct neighbours in edges, then the names."""
    degrees = degree_distinct(edges).select(F.col("node").alias("n"), F.col("degree").alias("d"))
    own = candidates.where("source_node is not null and target_node is not null")
    for side in ("source", "target"):
        own = own.join(degrees.select(F.col("n").alias(f"{side}_node"), F.col("d").alias(f"{side}_degree")), f"{side}_node", "left")
    p = F.array_position(F.array(*map(F.lit, priority)), F.col("relation"))
    total = F.coalesce("source_degree", F.lit(0)) + F.coalesce("target_degree", F.lit(0))
    own = own.withColumn("priority", F.when(p > 0, p).otherwise(99)).withColumn("degrees", total)
    order = [F.col("priority"), F.desc("weight"), F.col("degrees"), F.col("source_node"), F.col("target_node"), F.col("relation")]
    return numbered(own, *order).withColumn("rank", (F.col("place") + 1).cast("int")).drop("source_degree", "target_degree", "priority", "place")


def noun_neighbours(edges: DataFrame, nouns: DataFrame, relations: list[str]) -> DataFrame:
    """(node, score): for each noun the targets of its edges of the relations that are nouns (node), each relation's counted by itself."""
    own = edges.where(F.col("relation").isin(relations)).select("source", "relation", "target").distinct()
    known = nouns.select("node").distinct()
    own = own.join(known.select(F.col("node").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("score"))
    return known.join(own, "node", "left").select("node", F.coalesce("score", F.lit(0)).alias("score"))

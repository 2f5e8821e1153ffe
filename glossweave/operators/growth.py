"""Growth of bounded graphs from roots, from ranked candidates and around nodes with few neighbours.

Each is an ordered rule: an item is taken if, when its turn comes, its nodes have room, its lemmas are free and no quota is filled. The
sets that the rules give are found by rounds (see `rounds`), so no task gets the whole list. Quotas are cuts: what stands up to the item that
fills a quota is settled, and what the quota bars after it is taken out before the rest is settled anew.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.sources.shared import ship, written

from . import rounds
from .numbering import numbered
from .rounds import COLUMNS, admit, end, places

#: Begins the key of a lemma that has no node yet; no node's name begins so.
_UNKNOWN = "\x01"


def _pair() -> list[Column]:
    return [F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")]


def neighbours(edges: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes with an edge."""
    return edges.where("source <> target").select(*_pair()).distinct()


def _degree(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def _with_room(pairs: DataFrame, degree: DataFrame, max_degree: int) -> DataFrame:
    """pairs (a, b, ...) with room_a and room_b: how many more neighbours each end may get."""
    for c in ("a", "b"):
        pairs = pairs.join(degree.select(F.col("node").alias(c), F.col("degree").alias("__d")), c, "left").withColumn(f"room_{c}", F.lit(max_degree) - F.coalesce("__d", F.lit(0))).drop("__d")
    return pairs


def _kth(rows: DataFrame, column: str, k: int) -> int:
    """The k-th smallest value of a column without repeats; -1 for none."""
    return numbered(rows.select(column), column).where(F.col("place") == k - 1).first()[0] if k > 0 else -1


def named(made: DataFrame, prefix: str, taken: DataFrame) -> DataFrame:
    """made (lemma, place) with node: prefix:lemma:number, spaces as underscores. The number is the place, or the next one whose name neither taken
    (node) nor a row of an earlier place has.

    A name goes to the earliest place that asks for it, even if a later one had it first; that one asks on. So rounds give what one loop would.
    """
    live = made.withColumn("__k", F.col("place"))
    there = taken.select(F.col("node").alias("__node")).distinct()
    while True:
        asked = written(live.withColumn("node", F.concat(F.lit(prefix + ":"), F.translate("lemma", " ", "_"), F.lit(":"), F.col("__k").cast("string"))), "names")
        first = asked.groupBy(F.col("node").alias("__n")).agg(F.min("place").alias("__first"))
        told = asked.join(first, F.col("node") == F.col("__n")).join(there, F.col("node") == F.col("__node"), "left")
        told = told.withColumn("__again", F.col("__node").isNotNull() | (F.col("place") > F.col("__first")))
        if told.where("__again").isEmpty():
            return asked.drop("__k")
        live = told.withColumn("__k", F.col("__k") + F.col("__again").cast("long")).select(*live.columns)


def _rivals(first: DataFrame, lemmas: DataFrame, column: str) -> DataFrame:
    """(node, rival): the least value of a column (node, column) among the other nodes that share a lemma."""
    own = lemmas.join(first.where(F.col(column).isNotNull()).select("node", column), "node")
    best = own.groupBy("lemma").agg(F.min(F.struct(column, "node")).alias("best"))
    other = own.join(best, "lemma").where(F.col("node") != F.col("best.node")).groupBy("lemma").agg(F.min(column).alias("second"))
    both = lemmas.join(best, "lemma").join(other, "lemma", "left")
    seen = F.when(F.col("best.node") != F.col("node"), F.col(f"best.{column}")).otherwise(F.col("second"))
    return both.groupBy("node").agg(F.min(seen).alias("rival"))


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rule itself, on open and taken rows in order."""
    used: Counter[str] = Counter()
    said: set[str] = set()
    there: set[str] = set()
    out = []
    for f in batches:
        for rank, a, b, room_a, room_b, new, held, lemmas in f.itertuples(index=False, name=None):
            comes = isinstance(new, str) and new not in there
            if not held and (used[a] >= room_a or used[b] >= room_b or comes and not said.isdisjoint(lemmas)):
                continue
            used.update((a, b))
            if comes:
                there.add(new)
                said.update(lemmas)
            if not held:
                out.append(rank)
    yield pd.DataFrame({"rank": pd.Series(out, dtype="int64")})


def admit_claims(items: DataFrame, lemmas: DataFrame, small: int | None = None) -> DataFrame:
    """The ranks of items that an ordered rule takes: both ends have room, and a node that the item brings in has all its lemmas free.

    items: rank (unique), a, b, room_a, room_b (the same in all rows of a node), new (the end that is not in the graph yet, or null). lemmas:
    (node, lemma) of such ends. A node's first item that is taken claims its lemmas; an item that is refused claims nothing.

    In a round an item is sure to be taken if what is open or taken before it leaves room at both ends, and its new node either came in before or
    has no rival (a node that shares a lemma) with an item before it. It is sure to be refused if taken ones before it fill an end, or if
    a rival came in before it and before every item of its own node. The first open item is always settled.
    """
    small = rounds.SMALL if small is None else small
    ship(items.sparkSession)
    live = written(items.select("rank", "a", "b", F.col("room_a").cast("long"), F.col("room_b").cast("long"), "new", F.lit(0).cast("long").alias("held")), "open")
    lemmas = written(lemmas.select("node", "lemma").distinct().join(live.select(F.col("new").alias("node")).distinct(), "node", "left_semi"), "claims")
    taken: list[DataFrame] = []
    left = live.count()
    while left > small:
        ends = live.select("rank", "held", F.explode(F.array(end(F.col("a"), F.col("room_a")), end(F.col("b"), F.col("room_b")))).alias("end")).select("rank", "held", "end.*")
        at = places(ends, "of", "rank", "held").where("held = 0")
        room = at.groupBy("rank").agg(F.max(F.col("before") >= F.col("room")).alias("late"), F.max(F.col("held_before") >= F.col("room")).alias("out"))
        first = live.where("new is not null").groupBy(F.col("new").alias("node")).agg(F.min("rank").alias("first"), F.min(F.when(F.col("held") == 1, F.col("rank"))).alias("came"))
        first = written(first, "first")
        first = first.join(_rivals(first, lemmas, "first").withColumnRenamed("rival", "rival_first"), "node", "left").join(_rivals(first, lemmas, "came").withColumnRenamed("rival", "rival_came"), "node", "left")
        open_ = live.where("held = 0").join(room, "rank").join(first.withColumnRenamed("node", "new"), "new", "left")
        sure = F.col("new").isNull() | F.coalesce(F.col("came") < F.col("rank"), F.lit(False)) | F.col("rival_first").isNull() | (F.col("rank") < F.col("rival_first"))
        barred = F.coalesce((F.col("rank") > F.col("rival_came")) & (F.col("first") > F.col("rival_came")), F.lit(False))
        state = F.when(F.col("out") | barred, "refused").when(~F.col("late") & sure, "taken").otherwise("open")
        told = written(open_.withColumn("state", state).select("rank", "state"), "told")
        taken.append(told.where("state = 'taken'").select("rank"))
        kept = live.join(told, "rank", "left").where("state is null or state <> 'refused'").withColumn("held", F.when(F.col("state") == "open", 0).otherwise(1).cast("long")).drop("state")
        kept = written(kept.select(*live.columns), "kept")
        still = kept.where("held = 0")
        near = still.select(F.explode(F.array("a", "b")).alias("n")).distinct()
        said = lemmas.join(still.select(F.col("new").alias("node")).distinct(), "node", "left_semi").select("lemma").distinct()
        related = lemmas.join(said, "lemma", "left_semi").select(F.col("node").alias("n")).distinct()
        matters = near.union(related).distinct()
        rivals = [kept.where("held = 1").join(matters, F.col(c) == F.col("n"), "left_semi") for c in ("a", "b", "new")]
        live = written(still.unionAll(reduce(DataFrame.unionAll, rivals).distinct()), "open")
        left = 0 if still.isEmpty() else live.count()
    if left:
        own = lemmas.groupBy(F.col("node").alias("new")).agg(F.collect_list("lemma").alias("lemmas"))
        rows = live.join(own, "new", "left").select(*live.columns, F.coalesce("lemmas", F.array().cast("array<string>")).alias("lemmas"))
        taken.append(written(rows.repartition(1).sortWithinPartitions("rank").mapInPandas(_finish, "rank long"), "finished"))
    return reduce(DataFrame.unionAll, taken) if taken else live.select("rank")


def backbone(edges: DataFrame, lemmas: DataFrame, roots: list[str], priority: list[str], target_nodes: int, max_degree: int, max_depth: int, small: int | None = None) -> DataFrame:
    """Breadth-first growth from roots: (source, relation, target, source_type, depth, root); depth and root are those of the edge's target.

    A level's nodes are expanded in the order in which they came in: relations by priority, targets by falling number of edges, then by
    name. A pair of nodes gets one edge. A new node needs lemmas (node, lemma) of which none is taken; a node whose edge is refused takes none.
    Growth ends with the node that makes up target_nodes. Then further edges between chosen nodes are added, source by source in the same
    order, several a pair, as long as the source has fewer than max_degree neighbours. No roots, or none with lemmas of its own: no rows.
    """
    spark = edges.sparkSession
    first = F.array_position(F.array(*map(F.lit, priority)), F.col("relation"))
    own = edges.select(*COLUMNS, first.alias("first")).where("source <> target and first > 0")
    score = own.groupBy(F.col("source").alias("target")).agg(F.count("*").alias("score"))
    own = written(own.join(score, "target", "left").select(*COLUMNS, "first", F.coalesce("score", F.lit(0)).alias("score")), "usable")
    order: list[Column | str] = ["first", F.desc("score"), "target", "relation", "source_type"]
    said = written(lemmas.select("node", "lemma").where("lemma <> ''").distinct(), "lemmas")

    asked = spark.createDataFrame(list(enumerate(dict.fromkeys(roots))), "rank long, node string")
    claims = asked.join(said, "node").groupBy("rank", "node").agg(F.collect_list(end(F.col("lemma"), F.lit(1))).alias("ends"))
    begin = claims.join(admit(claims.select("rank", "ends"), small), "rank")
    nodes = frontier = written(begin.select("node", F.col("rank").alias("place"), F.lit(0).alias("depth"), F.col("node").alias("root")), "level")
    made = spark.createDataFrame([], "source string, relation string, target string, source_type string, depth int, root string")
    have = nodes.count()
    for depth in range(1, max_depth + 1):
        if have >= target_nodes or frontier.isEmpty():
            break
        tied = neighbours(made)
        taken = said.join(nodes, "node", "left_semi").select("lemma")
        barred = said.join(taken.distinct(), "lemma", "left_semi").select("node")
        ends = nodes.select(F.col("node").alias("target"), F.lit(None).cast("string").alias("new")).unionAll(said.select("node").distinct().join(barred.distinct(), "node", "left_anti").select("node", "node"))
        out = own.join(frontier.select(F.col("node").alias("source"), F.col("place").alias("parent"), "root"), "source").join(ends, "target")
        ranked = numbered(out.select("*", *_pair()).join(tied, ["a", "b"], "left_anti"), "parent", *order).withColumnRenamed("place", "rank")
        pairs = written(ranked.groupBy("a", "b").agg(F.min(F.struct("rank", *COLUMNS, "root", "new")).alias("e")).select("a", "b", "e.*"), "pairs")
        items = _with_room(pairs, _degree(tied), max_degree)
        level = written(pairs.join(admit_claims(items, said, small), "rank"), "grown")
        come = written(level.where("new is not null").groupBy(F.col("new").alias("node")).agg(F.min(F.struct("rank", "root")).alias("at")).select("node", "at.*"), "come")
        n = come.count()
        if have + n > target_nodes:
            last = _kth(come, "rank", target_nodes - have)
            level, come, n = level.where(F.col("rank") <= last), come.where(F.col("rank") <= last), target_nodes - have
        frontier = written(numbered(come, "rank").select("node", "place", F.lit(depth).alias("depth"), "root"), "level")
        root_of = frontier.unionAll(nodes).select(F.col("node").alias("target"), "depth", "root")
        made = written(made.unionByName(level.select(*COLUMNS).join(root_of, "target").select(*made.columns)), "made")
        nodes = written(nodes.unionAll(frontier), "nodes")
        have += n
    return made.unionByName(_between(own, nodes, made, order, max_degree, small))


def _between(own: DataFrame, nodes: DataFrame, made: DataFrame, order: list, max_degree: int, small: int | None) -> DataFrame:
    """Further edges between chosen nodes: of a pair without one the first takes a neighbour of both; others only need a source that isn't full then."""
    target = nodes.select(F.col("node").alias("target"), "depth", "root")
    rest = own.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(target, "target").join(made, ["source", "relation", "target"], "left_anti")
    ranked = numbered(rest, "source", *order).withColumnRenamed("place", "rank")
    ranked = written(ranked.groupBy("source", "relation", "target").agg(F.min(F.struct("rank", "source_type", "depth", "root")).alias("e")).select("source", "relation", "target", "e.*", *_pair()), "between")
    tied = written(neighbours(made), "tied")
    degree = _degree(tied)
    pairs = _with_room(ranked.join(tied, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.min("rank").alias("rank")), degree, max_degree)
    pairs = written(pairs, "untied")
    ends = F.array(end(F.col("a"), F.col("room_a")), end(F.col("b"), F.col("room_b")))
    new = written(pairs.join(admit(pairs.select("rank", ends.alias("ends")), small), "rank"), "new")
    uses = new.select("rank", F.explode(F.array(end(F.col("a"), F.col("room_a")), end(F.col("b"), F.col("room_b")))).alias("e")).select("rank", "e.*", F.lit(0).cast("long").alias("held"))
    full = places(uses, "of", "rank", "held").where("before = room - 1").select(F.col("of").alias("source"), F.col("rank").alias("full"))
    full = full.unionAll(degree.where(F.col("degree") >= max_degree).select("node", F.lit(-1).cast("long")))
    since = tied.select("a", "b", F.lit(-1).cast("long").alias("since")).unionAll(new.select("a", "b", "rank"))
    out = ranked.join(since, ["a", "b"]).join(full, "source", "left")
    return out.where("rank = since or full is null or rank < full").select(*made.columns)


def _grown(candidates: DataFrame, base: DataFrame, max_degree: int, loose: str, quota: int, most: int, node_room: int, small: int | None) -> DataFrame:
    """Candidates (rank, source, relation, target, new) that the ordered rule adds to base, `most` at most; new: the end that becomes a node by it."""
    tied = written(neighbours(base), "tied")
    degree = written(_degree(tied), "degree")
    keyed = candidates.where("source <> target").groupBy("source", "relation", "target").agg(F.min(F.struct("rank", "new")).alias("m")).select("source", "relation", "target", "m.*")
    live = written(keyed.join(base, ["source", "relation", "target"], "left_anti").select("*", *_pair()), "candidates")
    is_loose = F.col("relation").eqNullSafe(F.lit(loose))
    cuts = {"nodes", "loose"}
    while True:
        pairs = _with_room(live.join(tied, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.min("rank").alias("rank")), degree, max_degree)
        pairs = written(pairs, "pairs")
        ends = F.array(end(F.col("a"), F.col("room_a")), end(F.col("b"), F.col("room_b")))
        open_ = tied.unionAll(pairs.join(admit(pairs.select("rank", ends.alias("ends")), small), "rank").select("a", "b"))
        added = written(live.join(open_, ["a", "b"], "left_semi"), "added")
        come = written(added.where("new is not null").groupBy("new").agg(F.min("rank").alias("rank")), "come")
        at = {}
        if "nodes" in cuts and come.count() > node_room:
            at["nodes"] = _kth(come, "rank", node_room)
        if "loose" in cuts and added.where(is_loose).count() > quota:
            at["loose"] = _kth(added.where(is_loose), "rank", quota)
        if not at:
            break
        kind = min(at, key=lambda k: at[k])
        cuts.remove(kind)
        last = F.col("rank") <= at[kind]
        if kind == "loose":
            live = written(live.where(last | ~is_loose), "candidates")
        else:
            stay = come.where(last).select("new", F.lit(True).alias("stays"))
            live = written(live.join(stay, "new", "left").where(last | F.col("new").isNull() | F.col("stays")).select(*live.columns), "candidates")
    return numbered(added, "rank").where(F.col("place") < most).select("rank", "source", "relation", "target", "new")


def expand(ranked: DataFrame, base: DataFrame, target_edges: int, node_limit: int, max_degree: int, loose: str = "RelatedTo", loose_ratio: float = 0.2, loose_most: int = 10**6, priority: list[str] | None = None, small: int | None = None) -> DataFrame:
    """Edges added to base from ranked candidates (rank, relation, source_lemma, target_lemma, source_node, target_node, weight).

    A lemma outside the graph becomes a node while node_limit allows; if its edge is refused it does not. The loose relation has a quota. A
    second pass takes candidates whose ends are both known by then, anew in order: priority of the relation (others last), heavy
    first, a low sum of neighbours, then the names. Candidates with neither end known wait for the second pass. Base is taken as it is.
    """
    base = written(base.select(*COLUMNS), "base")
    known = base.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    quota = min(loose_most, int(target_edges * loose_ratio))
    own = ranked.select(F.col("rank").cast("long").alias("rank"), "relation", "source_lemma", "target_lemma", "source_node", "target_node", F.col("weight").cast("double").alias("weight"))
    own = written(own, "ranked")
    key = lambda c: F.coalesce(f"{c}_node", F.concat(F.lit(_UNKNOWN), f"{c}_lemma"))
    new = F.when(F.col("source_node").isNull(), key("source")).when(F.col("target_node").isNull(), key("target"))
    offers = numbered(own.where("source_node is not null or target_node is not null"), "rank", "relation", "source_node", "target_node").select(F.col("place").alias("rank"), key("source").alias("source"), "relation", key("target").alias("target"), new.alias("new"))
    first = written(_grown(offers, base, max_degree, loose, quota, target_edges, node_limit - known.count(), small), "first_pass")
    come = first.where("new is not null").groupBy("new").agg(F.min("rank").alias("rank"))
    made = named(numbered(come, "rank").select("new", F.substring("new", 2, 1_000_000).alias("lemma"), "place"), "conceptnet", known)

    def resolved(df: DataFrame) -> DataFrame:
        for c in ("source", "target"):
            df = df.join(made.select(F.col("new").alias(c), F.col("node").alias("__node")), c, "left").withColumn(c, F.coalesce("__node", c)).drop("__node")
        return df

    kind = F.lit("conceptnet").alias("source_type")
    first_edges = written(resolved(first).select("source", "relation", "target", kind), "first_edges")
    used, loosely = first_edges.agg(F.count("*"), F.count_if(F.col("relation") == loose)).first()
    grown = written(base.unionByName(first_edges), "grown")
    again = resolved(own.select("relation", "weight", key("source").alias("source"), key("target").alias("target")))
    again = again.where(~F.col("source").startswith(_UNKNOWN) & ~F.col("target").startswith(_UNKNOWN))
    degree = _degree(neighbours(grown))
    again = rounds.with_degrees(again, degree)
    firm = F.array_position(F.array(*map(F.lit, priority or [""])), F.col("relation"))
    order = [F.when(firm > 0, firm).otherwise(99), F.desc("weight"), F.col("source_degree") + F.col("target_degree"), "source", "target", "relation"]
    offers = numbered(again, *order).select(F.col("place").alias("rank"), "source", "relation", "target", F.lit(None).cast("string").alias("new"))
    second = _grown(offers, grown, max_degree, loose, quota - loosely, target_edges - used, 0, small)
    return first_edges.unionByName(second.select("source", "relation", "target", kind))


def repair_degrees(ranked: DataFrame, base: DataFrame, least: int, budget: int, max_degree: int, small: int | None = None) -> DataFrame:
    """Edges that tie nodes of base with fewer than `least` neighbours to outside lemmas: nodes by name, best candidate first, a lemma once, `budget` at
    most. A node never gets more than max_degree neighbours. Base is taken as it is."""
    degree = _degree(neighbours(base))
    low = degree.where(F.col("degree") < min(least, max_degree)).select("node", (F.lit(min(least, max_degree)) - F.col("degree")).alias("room"))
    outside = ranked.where(F.col("source_node").isNull() != F.col("target_node").isNull())
    forward = F.col("target_node").isNull()
    offers = outside.select("rank", "relation", F.coalesce("source_node", "target_node").alias("node"), F.when(forward, F.col("target_lemma")).otherwise(F.col("source_lemma")).alias("lemma"), forward.alias("forward"))
    items = numbered(offers.where("lemma is not null").join(low, "node").withColumnRenamed("rank", "offer"), "node", "offer", "relation", "lemma")
    items = written(items.withColumnRenamed("place", "rank"), "offers")
    tag = lambda kind, c: F.concat(F.lit(kind), c)
    ends = F.array(end(tag("n", F.col("node")), F.col("room")), end(tag("l", F.col("lemma")), F.lit(1)), end(F.lit("budget"), F.lit(budget)))
    taken = items.join(admit(items.select("rank", ends.alias("ends")), small), "rank")
    nodes = base.select(F.explode(F.array("source", "target")).alias("node"))
    out = named(numbered(taken.withColumnRenamed("node", "low"), "rank").select("low", "lemma", "relation", "forward", "place"), "repair", nodes)
    return out.select(F.when(F.col("forward"), F.col("low")).otherwise(F.col("node")).alias("source"), "relation", F.when(F.col("forward"), F.col("node")).otherwise(F.col("low")).alias("target"), F.lit("repair").alias("source_type"))

"""Growth by rounds against the same rules as one loop, with every item settled by rounds and with all left to the last task."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glossweave.operators import growth

EDGE = "source string, relation string, target string, source_type string"
RANKED = "rank int, relation string, source_lemma string, target_lemma string, source_node string, target_node string, weight double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


class Plain:
    def __init__(self, most, edges=()):
        self.most, self.near, self.keys = most, defaultdict(set), set()
        for s, r, t, *_ in edges:
            if s != t:
                self.keys.add((s, r, t))
                self.near[s].add(t)
                self.near[t].add(s)

    def add(self, s, r, t):
        if s == t or (s, r, t) in self.keys:
            return False
        if t not in self.near[s] and max(len(self.near[s]), len(self.near[t])) >= self.most:
            return False
        self.keys.add((s, r, t))
        self.near[s].add(t)
        self.near[t].add(s)
        return True


def plain_backbone(edges, lemmas, roots, priority, target_nodes, most, depths):
    said = defaultdict(set)
    for node, lemma in lemmas:
        if lemma:
            said[node].add(lemma)
    usable = [e for e in edges if e[1] in priority and e[0] != e[2]]
    score = defaultdict(int)
    for e in usable:
        score[e[0]] += 1
    of = defaultdict(list)
    for e in sorted(usable, key=lambda e: (priority.index(e[1]), -score[e[2]], e[2], e[1], e[3])):
        of[e[0]].append(e)
    g, at, taken, made = Plain(most), {}, set(), []

    def comes(node):
        return bool(said[node]) and not said[node] & taken

    for r in roots:
        if comes(r):
            at[r] = (0, r)
            taken |= said[r]
    queue = list(at)
    for node in queue:
        depth, root = at[node]
        if depth == depths:
            continue
        for s, r, t, kind in of[node]:
            if len(at) >= target_nodes:
                break
            if t in g.near[s] or t not in at and not comes(t) or not g.add(s, r, t):
                continue
            if t not in at:
                at[t] = (depth + 1, root)
                taken |= said[t]
                queue.append(t)
            made.append((s, r, t, kind, *at[t]))
    for node in sorted(at):
        for s, r, t, kind in of[node]:
            if len(g.near[s]) >= most:
                break
            if t in at and g.add(s, r, t):
                made.append((s, r, t, kind, *at[t]))
    return sorted(made, key=repr)


def lexical_graph(seed):
    """A hub of a third of all edges, lemmas that several nodes share, and nodes without any."""
    r = random.Random(seed)
    name = lambda: "hub" if r.random() < 0.2 else f"n{r.randrange(30):02d}"
    edges = sorted({(name(), r.choice("abz"), name(), r.choice("xy")) for _ in range(170)})
    lemmas = sorted({(f"n{k:02d}", f"l{r.randrange(28)}") for k in range(30) for _ in range(r.choice([0, 1, 1, 2, 3]))} | {("hub", "l_hub"), ("n01", ""), ("n02", "l_hub" if seed % 2 else "own")})
    return edges, lemmas


@pytest.mark.parametrize("small,seed,target,most,depths", [(0, 2, 9, 5, 3), (8, 3, 14, 3, 4), (10**6, 1, 100, 4, 5)])
def test_backbone_is_that_of_the_loop(spark, small, seed, target, most, depths):
    edges, lemmas = lexical_graph(seed)
    roots = ["n03", "hub", "n07", "n02", "none"]
    got = rows(growth.backbone(spark.createDataFrame(edges, EDGE).repartition(3), spark.createDataFrame(lemmas, "node string, lemma string"), roots, ["a", "b"], target, most, depths, small))
    want = plain_backbone(edges, lemmas, roots, ["a", "b"], target, most, depths)
    assert len(want) > 8 and got == want


def test_backbone_of_nothing(spark):
    e, said = spark.createDataFrame([], EDGE), spark.createDataFrame([("r", "r")], "node string, lemma string")
    assert growth.backbone(e, said, ["r"], ["a"], 5, 3, 2, 0).count() == 0
    e = spark.createDataFrame([("r", "a", "t", "x")], EDGE)
    assert growth.backbone(e, said.where("false"), ["r"], ["a"], 5, 3, 2, 0).count() == 0


def plain_expand(ranked, base, target_edges, node_limit, most, loose, ratio, priority):
    g, nodes, made, out, used = Plain(most, base), {n for e in base for n in (e[0], e[2])}, {}, [], 0
    known, quota = len(nodes), int(target_edges * ratio)
    for _, r, sl, tl, s, t, _ in sorted(ranked, key=lambda c: c[0]):
        if s is None and t is None:
            continue
        s, t = s or made.get(sl), t or made.get(tl)
        lemma = sl if s is None else tl if t is None else None
        if len(out) >= target_edges or r == loose and used >= quota or lemma is not None and known >= node_limit:
            continue
        new = None
        if lemma is not None:
            k = len(made)
            while (new := f"conceptnet:{lemma.replace(' ', '_')}:{k}") in nodes:
                k += 1
            s, t = s or new, t or new
        if g.add(s, r, t):
            out.append((s, r, t, "conceptnet"))
            used += r == loose
            if new:
                made[lemma] = new
                nodes.add(new)
                known += 1
    place = {r: k for k, r in enumerate(priority, 1)}
    again = [(r, s or made.get(sl), t or made.get(tl), w) for _, r, sl, tl, s, t, w in ranked]
    again = [(place.get(r, 99), -w, len(g.near[s]) + len(g.near[t]), s, t, r) for r, s, t, w in again if s and t]
    for *_, s, t, r in sorted(again):
        if len(out) < target_edges and (r != loose or used < quota) and g.add(s, r, t):
            out.append((s, r, t, "conceptnet"))
            used += r == loose
    return sorted(out)


@pytest.mark.parametrize("small,seed,target,limit,most,ratio", [(0, 1, 100, 100, 5, 0.5), (8, 2, 40, 22, 6, 0.1), (0, 3, 30, 14, 4, 0.2), (10**6, 4, 25, 5, 9, 0.0)])
def test_expansion_is_that_of_the_loop(spark, small, seed, target, limit, most, ratio):
    r = random.Random(seed)
    base = sorted({(f"n{r.randrange(12)}", "p", f"n{r.randrange(12)}", "w") for _ in range(12)} | {("conceptnet:out_1:1", "p", "n0", "w"), ("conceptnet:out_2:0", "p", "n1", "w")})
    inside = {n for e in base for n in (e[0], e[2])}
    word = lambda: r.choice([f"n{r.randrange(12)}", "hub", f"out {r.randrange(9)}", f"out_{r.randrange(9)}"])
    node = lambda w: w if w in inside else None
    words = [(word(), r.choice(["loose", "firm", "other"]), word()) for _ in range(150)]
    ranked = [(k, rel, s, t, node(s), node(t), float(r.randrange(4))) for k, (s, rel, t) in enumerate(words) if s != t]
    got = rows(growth.expand(spark.createDataFrame(ranked, RANKED).repartition(3), spark.createDataFrame(base, EDGE), target, limit, most, "loose", ratio, priority=["firm", "other"], small=small))
    assert got == plain_expand(ranked, base, target, limit, most, "loose", ratio, ["firm", "other"])


@pytest.mark.parametrize("small", [0, 10**6])
def test_degree_repair_takes_a_lemma_once(spark, small):
    r = random.Random(3)
    base = sorted({(f"n{r.randrange(15):02d}", "p", f"n{r.randrange(15):02d}", "w") for _ in range(25)} | {("repair:l_1:0", "p", "n00", "w")})
    offers = []
    for k in range(120):
        node, lemma = f"n{r.randrange(15):02d}", f"l {r.randrange(20)}"
        offers.append((k, r.choice("ab"), node, lemma, node, None, 1.0) if r.random() < 0.5 else (k, r.choice("ab"), lemma, node, None, node, 1.0))
    got = rows(growth.repair_degrees(spark.createDataFrame(offers, RANKED), spark.createDataFrame(base, EDGE), 6, 14, 9, small))
    g, taken, names, want = Plain(9, [e for e in base if e[0] != e[2]]), set(), {n for e in base for n in (e[0], e[2])}, []
    for node in sorted(n for n in g.near if len(g.near[n]) < 6):
        for _, rel, sl, tl, s, t, _ in offers:
            lemma = sl if s is None else tl
            if (s or t) != node or len(g.near[node]) >= 6 or len(want) >= 14 or lemma in taken:
                continue
            k = len(taken)
            while (new := f"repair:{lemma.replace(' ', '_')}:{k}") in names:
                k += 1
            taken.add(lemma)
            names.add(new)
            edge = (node, rel, new) if s else (new, rel, node)
            g.add(*edge)
            want.append((*edge, "repair"))
    assert want and got == sorted(want)


def test_names_go_on_as_in_a_loop(spark):
    """Lemmas with one slug, names that the graph has, and bumps that reach a later lemma's own number."""
    lemmas = ["a b", "a_b", "c", "a b", "a_b", "c", "a_b", "d"]
    taken = {"x:a_b:0", "x:a_b:1", "x:c:2", "x:c:3", "x:c:4", "x:d:6"}
    names, want = set(taken), []
    for k, lemma in enumerate(lemmas):
        while (name := f"x:{lemma.replace(' ', '_')}:{k}") in names:
            k += 1
        names.add(name)
        want.append(name)
    got = growth.named(spark.createDataFrame(list(zip(lemmas, range(8))), "lemma string, place long"), "x", spark.createDataFrame([(t,) for t in taken], "node string"))
    assert [r.node for r in got.orderBy("place").collect()] == want


def test_caps_hold_on_all_edges(spark):
    from conftest import SF

    from glossweave.sources import adapters

    e = adapters.kg_edges(spark, SF).select(F.col("target").alias("source"), "relation", F.col("source").alias("target"), "source_type")
    nodes = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    got = growth.backbone(e, nodes.select("node", F.col("node").alias("lemma")), [f"r:{k}" for k in range(5)], ["inRegion", "inNation", "placedBy"], 400, 30, 4, 0).collect()
    near = defaultdict(set)
    for x in got:
        near[x.source].add(x.target)
        near[x.target].add(x.source)
    assert len(near) == 400 or max(map(len, near.values())) == 30
    assert len({x[:3] for x in map(tuple, got)}) == len(got) and {x.root for x in got} <= {f"r:{k}" for k in range(5)}

"""Invariants of samplers, folds and generators; sources, sinks and streams."""

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossweave.operators import corpus, grammar, graph, growth, lexicon, probing, retrieval, rounds, sampling, sentences, swaps
from glossweave.sources import readers, sinks
from glossweave.streaming import corpus_stream

EDGE = "source string, relation string, target string, source_type string"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(f"n{k}", "abc"[k % 3], f"n{(k * 7 + 1) % 40}", "xy"[k % 2]) for k in range(40)] + [(f"n{k}", "a", f"n{(k + 1) % 40}", "x") for k in range(40)]
    return spark.createDataFrame(sorted(set(rows)), EDGE)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quotas_meet_the_total(edges):
    q = sampling.quotas(edges, 0.4).collect()
    assert sum(r.quota for r in q) == round(edges.count() * 0.4)
    assert all(0 <= r.quota <= r.n for r in q)


def test_sample_does_not_depend_on_partitions(edges):
    assert rows(sampling.stratified_fraction(edges, 0.5, 1)) == rows(sampling.stratified_fraction(edges.repartition(7), 0.5, 1))


def test_paired_parts_are_disjoint(edges):
    p = sampling.paired(edges, 30, 0.25, 1)
    parts = {r.part: r["count"] for r in p.groupBy("part").count().collect()}
    assert parts == {"shared": 8, "first": 22, "second": 22}  # 7.5 is half-even
    assert p.drop("part").distinct().count() == 52


def test_split_and_epochs(spark):
    df = spark.range(25)
    assert sampling.split(df, 0.1, 3, "id").where("part = 'dev'").count() == 2
    assert sampling.split(spark.range(3), 0.1, 3, "id").where("part = 'dev'").count() == 1
    assert sampling.epoch(df, 10, 1, 0, "id").distinct().count() == 10
    assert sampling.epoch(df, 60, 1, 0, "id").count() == 60
    assert sampling.bilingual_epoch(df, df, 11, 1, 0, "id").groupBy("lang").count().orderBy("lang").collect()[1]["count"] == 6


def test_capped_graph(edges):
    out = rounds.capped_graph(edges, 3, ["source", "relation", "target"])
    assert graph.degree_distinct(out).agg(F.max("degree")).first()[0] <= 3
    assert out.where("source = target").count() == 0 and out.count() == out.distinct().count()


def test_edge_cover_touches_all(edges):
    assert graph.coverage(rounds.edge_cover(edges, 1), edges).where("not covered").count() == 0


def test_relation_first_keeps_size_and_covers(edges):
    sample = sampling.stratified_fraction(edges, 0.7, 2)
    out = swaps.relation_first(edges, sample, 2)
    assert out.count() == sample.count() and out.distinct().count() == sample.count()
    assert graph.coverage(out, edges).where("not covered").count() == 0


def test_relation_control_comes_closer(spark, edges):
    sample = sampling.stratified_fraction(edges, 0.5, 2)
    wanted = spark.createDataFrame([("a", 10), ("b", 12), ("c", 12)], "relation string, n int")
    out = swaps.relation_control(edges, sample, wanted, 1)

    def distance(df):
        have = {r.relation: r["count"] for r in df.groupBy("relation").count().collect()}
        return sum(abs(have.get(r.relation, 0) - r.n) for r in wanted.collect())

    assert out.count() == sample.count() and distance(out) < distance(sample)


def test_backbone_caps(spark):
    e = spark.createDataFrame([("r", "isa", f"k{i}", "w") for i in range(5)] + [("k0", "isa", f"m{i}", "w") for i in range(3)] + [("m0", "isa", "deep", "w")], EDGE)
    lemmas = spark.createDataFrame([(n, n) for n in ("r", "k0", "k1", "k2", "k3", "m0", "m1", "deep")] + [("k4", "k0"), ("m2", "m0")], "node string, lemma string")
    got = growth.backbone(e, lemmas, ["r"], ["isa"], 20, 4, 2).collect()
    ends = {r.target for r in got}
    assert "k4" not in ends and "m2" not in ends and "deep" not in ends  # lemmas are taken; too deep
    assert max(r.depth for r in got) == 2


def test_bfs(spark):
    e = spark.createDataFrame([("b", "x", "a", "t"), ("c", "x", "b", "t"), ("a", "x", "c", "t"), ("z", "x", "y", "t")], EDGE)
    assert rows(graph.bfs_depth(e, spark.createDataFrame([("a",)], "node string"), 5)) == [("a", 0), ("b", 1), ("c", 2)]


def test_empty_graph(spark):
    e = spark.createDataFrame([], EDGE)
    assert graph.degree_stats(graph.degree_distinct(e)).first().nodes == 0
    assert sampling.quotas(e, 0.5).count() == 0 and rounds.edge_cover(e, 1).count() == 0


GRAMMAR = {"likes": "NP -> A N [1.0]\nVP -> TRANS [0.4]\nVP -> COP [0.3]\nTRANS -> V [1.0]\nV -> 'likes' [1]\nCOP -> AUX ADJP PP [1]\nAUX -> 'is' [1]\nADJP -> 'fond' [1]\nPP -> 'of' [1]\nVP_EXP_has -> VP 'tgt' CONJ VP [1]\nCONJ -> ', and' [1]", "has": "NP -> N\n# none\nVP -> TRANS [1]\nTRANS -> V [1]\nV -> 'has' [1]"}


def generated(spark, **settings):
    e = spark.createDataFrame([("tom", "likes", "tea"), ("tom", "likes", "milk"), ("tom", "has", "cup"), ("tom", "fears", "x")], "source string, relation string, target string")
    rules = grammar.as_dict(grammar.rules(grammar.grammar_lines(spark, GRAMMAR)))
    q = spark.createDataFrame([("tea", ["a_hot", "a_iced", "a_weak"])], "node string, qualities array<string>")
    return e, {(r.relation, r.target): r for r in sentences.generate(e, rules, {"likes": ["has"]}, sentences.Settings(**settings), q).collect()}


def test_sentences(spark):
    e, out = generated(spark)
    said = out["likes", "tea"].sentences
    assert len(said) >= 8 and said == sorted(set(said)) and all(s.endswith(".") for s in said)
    assert any("a_hot tea" in s or "a_iced tea" in s or "a_weak tea" in s for s in said)
    assert out["has", "cup"].sentences and ("fears", "x") not in out
    assert rows(sentences.skipped_relations(e, GRAMMAR)) == [("fears",)]
    assert generated(spark)[1] == out


def test_word_orders_make_the_same_choices(spark):
    a, b = generated(spark, simple=5, samples=5)[1], generated(spark, simple=5, samples=5, subject_last=1, object_first=1)[1]
    assert sorted(" ".join(sorted(s[:-1].split())) for s in a["likes", "tea"].sentences) == sorted(" ".join(sorted(s[:-1].split())) for s in b["likes", "tea"].sentences)
    assert all(s.endswith(" tom.") for s in b["likes", "tea"].sentences)


def test_grammar_file_is_not_run(tmp_path, spark):
    p = tmp_path / "g.py"
    p.write_text("import nothing_of_this_name\ngrammar = {'r': 'V -> \\'a\\' [1.0]'}\n")
    assert grammar.read_grammar(str(p)) == {"r": "V -> 'a' [1.0]"}
    assert grammar.skipped_lines(grammar.grammar_lines(spark, GRAMMAR)).count() == 1


def test_artificial_tokens_are_unique(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    out = lexicon.artificial_tokens(keys, "cyrillic", 1, mean=2.0, sd=0.5, least=1, most=3)
    assert out.select("artificial").distinct().count() == 3000


def test_merge_fails_on_equal_keys(spark):
    a = spark.createDataFrame([("k", ["N"], "x")], "key string, pos array<string>, source string")
    with pytest.raises(ValueError, match="in both"):
        lexicon.merged(a, a)
    assert lexicon.merged_by_lemma(a, a.withColumn("pos", F.array(F.lit("V")))).first().pos == ["N", "V"]


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "id long, vec array<double>")
    top = retrieval.top_k(v.where("id = 0"), v.where("id > 0"), 3)
    assert [r.g for r in top.orderBy("place").collect()] == [2, 1, 3]  # at a tie the smaller id
    blocked = retrieval.top_k(v.where("id = 0"), v.where("id > 0"), 3, block_rows=2)
    assert [r.g for r in blocked.orderBy("place").collect()] == [2, 1, 3]
    assert retrieval.extreme_pairs(v, 1, True, block_rows=1).count() == 1


def test_empty_sentence_has_zeros(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "zz")], "sentence int, token string")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "token string, vec array<double>")
    got = {r.sentence: [round(x, 6) for x in r.vec] for r in retrieval.pooled_sentences(t, v, 2).collect()}
    assert got == {1: [round(2 / 3, 6), 1.0], 2: [0.0, 0.0]}


def test_wrapping(spark):
    df = spark.createDataFrame([("a", ["x", "."]), ("b", ["y"])], "lang string, t array<string>")
    got = df.select(probing.wrapped(probing.punctuated(F.col("t"), F.col("lang"), "none"), F.col("lang"), {"a": ("<", ">"), "b": ("[", "]")}).alias("r")).collect()
    assert [r.r for r in got] == [["<", "x", ">"], ["[", "y", "]"]]


def test_mask_states_are_averaged(spark):
    states = spark.createDataFrame([(1, 0, 0, [1.0]), (1, 0, 1, [3.0]), (1, 0, 2, [9.0])], "sentence_id int, layer int, position int, vec array<double>")
    tokens = spark.createDataFrame([(1, 0, "[MASK]"), (1, 1, "[MASK]"), (1, 2, "x")], "sentence_id int, position int, token string")
    assert probing.mask_states(states, tokens).first().vec == [2.0]


def test_anchors_of_share_zero(spark):
    f = corpus.token_frequency(spark.createDataFrame([(str(k % 60), k) for k in range(600)], "token string, position int"))
    assert corpus.select_anchors(f, "mid", 0.0, 1).count() == 0
    assert corpus.select_anchors(f, "mid", 0.1, 1).count() == 6


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"source": "a", "relation": "r", "target": "b"}, {"source": "b", "relation": "r", "target": "c", "source_type": "w"}]))
    e = readers.read_edges(spark, str(tmp_path / "e.json"))
    assert rows(e) == [("a", "r", "b", None), ("b", "r", "c", "w")]
    (tmp_path / "t.json").write_text(json.dumps({"results": [{"source": "a", "relation": "r", "target": "b"}]}))
    assert rows(readers.read_triples(spark, str(tmp_path / "t.json"))) == [("a", "r", "b")]
    assert readers.read_triples(spark, str(tmp_path / "e.json")).count() == 2
    (tmp_path / "d.json").write_text(json.dumps({"k": {"POS": ["N"], "source": "synsets", "artificial": "ab"}}))
    assert readers.read_dictionary(spark, str(tmp_path / "d.json"), "a").first().artificial == "ab"
    (tmp_path / "c.txt").write_text("one\n\n two \n", encoding="utf-8")
    assert rows(readers.read_corpus(spark, str(tmp_path / "c.txt")).select("line_no", "text")) == [(0, "one"), (2, " two ")]
    (tmp_path / "run1" / "s").mkdir(parents=True)
    (tmp_path / "run1" / "s" / "state.json").write_text(json.dumps({"global_step": 2, "log_history": [{"step": 1, "eval_loss": 2.0}, {"step": 2, "eval_loss": 1.5}, {"step": 2, "loss": 0.1}]}))
    from glossweave.operators.report import final_eval_loss

    assert rows(final_eval_loss(readers.read_states(spark, str(tmp_path / "*" / "s" / "state.json")))) == [("run1", 1.5)]
    sinks.write_corpus_file(readers.read_corpus(spark, str(tmp_path / "c.txt")), str(tmp_path / "out.txt"), ["line_no"])
    assert (tmp_path / "out.txt").read_text() == "one\n two "
    sinks.write_csv(e, str(tmp_path / "csv"), ["target", "source"])
    assert rows(readers.read_csv_text(spark, str(tmp_path / "csv"), ["target"])) == [("b", "a"), ("c", "b")]
    with pytest.raises(ValueError, match="absent"):
        readers.read_csv_text(spark, str(tmp_path / "csv"), ["nothing"])
    sinks.write_if_absent(e, str(tmp_path / "kept"))
    sinks.write_if_absent(e.limit(1), str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2


def test_assertions_as_batch_and_stream(spark, tmp_path):
    lines = ["/a/1\t/r/IsA\t/c/en/Cat/n\t/c/en/animal\t{\"weight\": 2.0}", "/a/2\tshort", "/a/3\t/r/IsA\t/c/fr/chat\t/c/en/cat\t{\"dataset\": \"/d/WordNet\"}"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(lines))
    want = [("IsA", None, "cat", 1.0, True), ("IsA", "cat", "animal", 2.0, False)]
    assert rows(readers.read_assertions(spark, str(tmp_path / "in"))) == sorted(want, key=repr)
    q = corpus_stream.stream_assertions(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == sorted(want, key=repr)


def random_edges(seed, nodes=30, n=120):
    r = random.Random(seed)
    out = {(f"n{r.randrange(nodes)}", r.choice("abc"), f"n{r.randrange(nodes)}") for _ in range(n)}
    return sorted((s, p, t, r.choice(["x", "y"])) for s, p, t in out if s != t)


def test_cover_against_a_plain_version(spark):
    for seed in range(4):
        rows_in = random_edges(seed, 25, 40)
        degree = lambda n: sum((e[0] == n) + (e[2] == n) for e in rows_in)
        drawn = lambda e: hashlib.md5("|".join(map(str, (seed, *e))).encode()).hexdigest()
        chosen = []
        touched = lambda: {n for e in chosen for n in (e[0], e[2])}
        for e in sorted(rows_in, key=lambda e: (min(degree(e[0]), degree(e[2])), degree(e[0]) + degree(e[2]), drawn(e))):
            if e[0] not in touched() and e[2] not in touched():
                chosen.append(e)
        for node in sorted({n for e in rows_in for n in (e[0], e[2])}, key=lambda n: (degree(n), n)):
            if node not in touched():
                own = [e for e in rows_in if node in (e[0], e[2])]
                chosen.append(min(own, key=lambda e: (e[0] in touched(), e[2] in touched(), degree(e[0]) + degree(e[2]), drawn(e))))
        assert rows(rounds.edge_cover(spark.createDataFrame(rows_in, EDGE), seed)) == sorted(chosen)


def test_relation_control_keeps_nodes_and_swaps_all_it_can(spark):
    for seed in range(3):
        all_edges = random_edges(seed)
        e = spark.createDataFrame(all_edges, EDGE)
        sample = spark.createDataFrame(random.Random(seed).sample(all_edges, 50), EDGE)
        wanted = spark.createDataFrame([(r, t, n) for r, n in (("a", 20), ("b", 4), ("c", 1)) for t in "xy"], "relation string, source_type string, n int")
        before, after = rows(sample), rows(swaps.relation_control(e, sample, wanted, seed))
        count = lambda part: Counter((x[1], x[3]) for x in part)
        nodes = lambda part: Counter(n for x in part for n in (x[0], x[2]))
        target = {(r.relation, r.source_type): r.n for r in wanted.collect()}
        distance = lambda part: sum(abs(count(part)[k] - n) for k, n in target.items())
        assert len(after) == len(set(after)) == len(before) and set(after) <= set(all_edges)
        assert distance(after) < distance(before) and set(nodes(before)) <= set(nodes(after))
        over = [x for x in after if count(after)[x[1], x[3]] > target[x[1], x[3]] and nodes(after)[x[0]] > 1 and nodes(after)[x[2]] > 1]
        under = [x for x in all_edges if x not in after and count(after)[x[1], x[3]] < target[x[1], x[3]]]
        assert not over or not under


def test_capped_graph_against_a_plain_version(spark):
    all_edges = random_edges(9, 15, 150)
    got = [tuple(r) for r in rounds.capped_graph(spark.createDataFrame(all_edges, EDGE), 4, ["source", "relation", "target", "source_type"], 40).collect()]
    want = []
    near = lambda n: {m for x in want for m in (x[0], x[2]) if n in (x[0], x[2]) and m != n}
    for x in sorted(all_edges, key=lambda x: x[:3]):
        if len(want) < 40 and x[:3] not in {y[:3] for y in want} and (x[2] in near(x[0]) or len(near(x[0])) < 4 and len(near(x[2])) < 4):
            want.append(x)
    assert sorted(got) == sorted(want)


def test_similarities_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(4)
    m = r.normal(size=(41, 6))
    m[7] = m[3]
    v = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(m)], "id long, vec array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = (unit @ unit.T)[~np.eye(41, dtype=bool)]
    for size in (1000, 7):
        got = retrieval.similarity_distribution(v, size, 64).first()
        want = [s.mean(), np.sort(s)[-(-len(s) // 2) - 1], s.std(ddof=1), s.min(), *np.quantile(s, [0.01, 0.05, 0.95, 0.99])]
        assert got.pairs == len(s) and np.allclose(list(got)[1:], want, atol=2e-6)
        top = rows(retrieval.extreme_pairs(v, 3, True, size))
        assert any(x[:2] == (3, 7) and x[2] > 0.999999 for x in top) and len(top) == 3
        near = retrieval.top_k(v, v, 2, size).where("place = 1").collect()
        assert {(x.q, x.g) for x in near if x.q in (3, 7)} == {(3, 3), (7, 3)}
    assert retrieval.similarity_distribution(v.limit(1)).count() == 0 and retrieval.top_k(v.limit(0), v, 2).count() == 0


def test_places_without_one_task(spark):
    from glossweave.operators.numbering import numbered

    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("k"))
    assert [r.place for r in numbered(df, F.desc("k")).orderBy(F.desc("k")).collect()] == list(range(500))
    assert numbered(df.limit(0), "k").count() == 0


def test_partners_are_drawn_evenly_from_the_whole_group(spark):
    e = spark.createDataFrame([("hub", "likes", f"t{k}") for k in range(300)] + [("hub", "has", f"c{k}") for k in range(200)], "source string, relation string, target string")
    rules = {r: sentences.Grammar(g) for r, g in grammar.as_dict(grammar.rules(grammar.grammar_lines(spark, GRAMMAR))).items()}
    drawn = sentences.partners(e, rules, {"likes": ["has"]}, 1).collect()
    shared = [r for r in drawn if r.kind == "share" and r.relation == "likes"]
    assert len(shared) == 6 * 300 and all(r.target2 != r.target for r in shared) and len({r.target2 for r in shared}) > 290
    assert {r.relation2 for r in drawn if r.kind == "follow"} == {"has"} and len({r.target2 for r in drawn if r.kind == "follow"}) > 190
    assert not [r for r in drawn if r.kind == "join"]


def test_unfolded_grammar(spark):
    g = sentences.Grammar(grammar.as_dict(grammar.rules(grammar.grammar_lines(spark, GRAMMAR)))["likes"])
    assert [p.words for p in g.predicates.items] == [("likes",), ("is", "fond", "of")] and abs(g.predicates.until[0] - 4 / 7) < 1e-12 and g.described == 1.0
    assert [p.verb for p in g.predicates.items] == [True, False] and g.predicates.until[-1] == 1.0 and g.links["has"].items == [", and"]


def test_lexical_database(spark, tmp_path):
    lines = ["  1 a licence line", "00000010 03 n 01 entity 0 002 ~ 00000020 n 0000 + 00000099 v 0101 | that which is", "00000020 03 n 02 dog 0 domestic_dog 1 003 @ 00000010 n 0000 #m 00000030 n 0000 %p 00000040 n 0000 | a pet | of some", "00000030 14 n 01 pack 0 000 | a group"]
    (tmp_path / "data.noun").write_text("\n".join(lines) + "\n")
    nodes, edges = readers.read_lexical_database(spark, str(tmp_path / "data.noun"))
    assert {(r.node, r.pos, tuple(r.words)) for r in nodes.collect()} == {("n:00000010", "n", ("entity",)), ("n:00000020", "n", ("dog", "domestic_dog")), ("n:00000030", "n", ("pack",))}
    assert rows(edges.select("source", "relation", "target")) == [("n:00000010", "hyponym", "n:00000020"), ("n:00000020", "hypernym", "n:00000010"), ("n:00000020", "member_holonym", "n:00000030"), ("n:00000020", "part_meronym", "n:00000040")]
    assert nodes.where("node = 'n:00000020'").first().gloss == "a pet | of some"


def test_blocks_and_tables(spark, tmp_path):
    from glossweave.operators import report

    p = tmp_path / "r.md"
    p.write_text("# Head\n<!-- b -->\nold\n<!-- e -->\nTail\n")
    sinks.replace_block(str(p), "<!-- b -->", "<!-- e -->", "new\n")
    assert p.read_text() == "# Head\n<!-- b -->\nnew\n<!-- e -->\nTail\n"
    sinks.replace_block(str(tmp_path / "n.md"), "B", "E", "x")
    assert (tmp_path / "n.md").read_text() == "B\nx\nE\n"
    df = spark.createDataFrame([("z", 0.5, None), ("a", None, None)], "condition string, m_mean double, m_sd double")
    table = report.mean_table(df, "condition", ["m"])
    assert "| z | 0.5000 +/- N/A |" in table and "| a | N/A |" in table
    df = spark.range(1500).select(F.col("id").alias("condition"))
    assert report.markdown(df, ["condition"]).count("\n") == 1502
    target = str(tmp_path / "t")
    sinks.write_if_absent(spark.range(1), target)
    sinks.write_if_absent(spark.range(2), target)
    assert spark.read.parquet(target).count() == 1
    sinks.write_if_absent(spark.range(2), target, force=True)
    assert spark.read.parquet(target).count() == 2
    sinks.write_csv(spark.createDataFrame([(1, 2)], "z int, a int"), str(tmp_path / "c"), "rows")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["z", "a"]


def test_a_missing_second_token_is_an_error(spark):
    from glossweave.operators import alignment

    a = spark.createDataFrame([("k", "x", "synsets"), ("l", "y", "grammar")], "key string, artificial string, source string")
    b = spark.createDataFrame([("l", "z")], "key string, artificial string")
    with pytest.raises(ValueError):
        alignment.aligned_words(a, b, b.select(F.col("artificial").alias("token")))


def test_second_pass_takes_its_own_order(spark):
    base = spark.createDataFrame([("a", "p", "b", "t"), ("c", "p", "d", "t"), ("a", "p", "c", "t")], EDGE)
    ranked = spark.createDataFrame([(1, "loose", "b", "d", "b", "d", 1.0), (2, "firm", "a", "d", "a", "d", 1.0), (3, "firm", "new", "b", None, "b", 1.0), (4, "firm", "new", "d", None, "d", 5.0)], "rank int, relation string, source_lemma string, target_lemma string, source_node string, target_node string, weight double")
    got = [tuple(r) for r in growth.expand(ranked, base, 9, 5, 9, loose="loose", loose_ratio=0.0, priority=["firm"]).collect()]
    assert sorted((r[0], r[1], r[2]) for r in got) == [("a", "firm", "d"), ("conceptnet:new:0", "firm", "b"), ("conceptnet:new:0", "firm", "d")]


def test_pca_against_singular_values(spark):
    import numpy as np

    m = np.random.default_rng(2).normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] + 2
    got = {r.id: (r.x, r.y) for r in retrieval.pca_2d(spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(m)], "id long, vec array<double>")).collect()}
    centred = m - m.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    axes *= np.array([[1.0 if abs(a.max()) >= abs(a.min()) else -1.0] for a in axes])
    assert np.allclose([got[k] for k in range(60)], centred @ axes.T, atol=1e-8)


def test_probe_finds_separable_labels(spark):
    import numpy as np

    r = np.random.default_rng(5)
    at = {0: [3, 0], 1: [-3, 0], 2: [0, 4]}
    df = spark.createDataFrame([(k, k % 3, [float(x) for x in r.normal(size=2) * 0.3 + at[k % 3]]) for k in range(120)], "id long, label int, vec array<double>")
    assert all(x.label == x.predicted for x in probing.linear_probe(df.where("id < 60"), df.where("id >= 60"), 3).collect())


def test_low_degree_repair_against_a_plain_version(spark):
    base = [("a", "p", "b", "t"), ("b", "p", "c", "t"), ("c", "p", "d", "t"), ("b", "p", "d", "t")]
    offers = [(k, "r", f"l{k % 5}", "x", "abcd"[k % 4], None) if k % 2 else (k, "r", "x", f"l{k % 5}", None, "abcd"[k % 4]) for k in range(12)]
    ranked = spark.createDataFrame([(k, rel, (s if n else lem) if n is None else n, lem if n else t, n, o) for k, rel, s, t, n, o in [(k, r, a, b, c, d) for k, r, a, b, c, d in offers] for lem in [f"l{k % 5}"]], "rank int, relation string, source_lemma string, target_lemma string, source_node string, target_node string")
    got = [tuple(r) for r in growth.repair_degrees(ranked, spark.createDataFrame(base, EDGE), 3, 4, 9).collect()]
    near, taken, want = {n: {m for e in base for m in (e[0], e[2]) if n in (e[0], e[2]) and m != n} for n in "abcd"}, set(), []
    for node in "abcd":
        for k, relation, _, _, s, t in offers:
            lemma = f"l{k % 5}"
            if (s or t) != node or len(near[node]) >= 3 or len(want) >= 4 or lemma in taken or len({m for e in base for m in (e[0], e[2]) if node in (e[0], e[2]) and m != node}) >= 3:
                continue
            new = f"repair:{lemma}:{len(taken)}"
            taken.add(lemma)
            near[node].add(new)
            want.append((node, relation, new, "repair") if s else (new, relation, node, "repair"))
    assert got and sorted(got) == sorted(want)


def test_paired_repair_touches_more_nodes(spark, edges):
    fixed, variable = edges.orderBy("source", "target", "relation").limit(15), edges.orderBy("target", "source", "relation").exceptAll(edges.orderBy("source", "target", "relation").limit(15)).orderBy("target", "source", "relation").limit(20)
    out = swaps.paired_repair(edges, fixed, variable, 1)
    nodes = lambda *parts: {n for p in parts for r in p.collect() for n in (r.source, r.target)}
    assert out.count() == variable.count() and not set(rows(out)) & set(rows(fixed)) and set(rows(out)) <= set(rows(edges))
    assert nodes(fixed, variable) <= nodes(fixed, out) and len(nodes(fixed, out)) >= len(nodes(fixed, variable))


def test_mean_vectors_against_a_plain_version(spark):
    r = random.Random(4)
    data = [("ab"[k % 2] if k % 3 else "hub", None if k % 7 == 0 else [r.random() for _ in range(3)]) for k in range(60)] + [("bare", None)]
    df = spark.createDataFrame(data, "key string, vec array<double>").repartition(5)
    want = {k: [v for g, v in data if g == k and v] for k in ("a", "b", "hub")}
    got = {x.key: x.vec for x in retrieval.mean_vectors(df, "key").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx([sum(c) / len(c) for c in zip(*v)], abs=1e-12) for k, v in want.items())
    assert retrieval.mean_vectors(df.where("false"), "key").count() == 0

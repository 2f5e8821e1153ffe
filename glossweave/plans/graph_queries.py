"""Queries on graphs and samples, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import graph as g
from glossweave.operators import growth, rounds, sampling, swaps
from glossweave.sources import adapters as ad
from glossweave.sources import readers
from glossweave.sources.shared import written

Q, SQL = {}, {}
KG = ad.KG
MD = "md5({} || '|' || {} || '|' || source || '|' || relation || '|' || target || '|' || source_type)"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {KG} SELECT relation, count(*) AS n FROM kg GROUP BY relation")
def edge_relation_counts(spark, d):
    return g.counts(ad.kg_edges(spark, d), "relation")


@query(f"WITH {KG} SELECT source_type, n, round(100.0 * n / sum(n) OVER (), 6) AS percent, CAST(row_number() OVER (ORDER BY n DESC, source_type) AS INTEGER) AS place FROM (SELECT source_type, count(*) AS n FROM kg GROUP BY source_type)")
def source_type_distribution(spark, d):
    return g.distribution(ad.kg_edges(spark, d), "source_type")


_DEG = f"""WITH {KG}, ends AS (SELECT source AS node, target AS other FROM kg UNION ALL SELECT target, source FROM kg),
dd AS (SELECT node, count(DISTINCT other) AS degree FROM ends WHERE node <> other GROUP BY node), di AS (SELECT node, count(*) AS degree FROM ends GROUP BY node)"""
_STATS = "SELECT count(*) AS nodes, count(*) FILTER (WHERE degree > 0) AS active, min(degree) AS least, max(degree) AS most, round(avg(degree), 4) AS mean, round(avg(degree) FILTER (WHERE degree > 0), 4) AS active_mean, count(*) FILTER (WHERE degree < 2) AS below_two FROM "


@query(f"{_DEG} {_STATS} (SELECT node, coalesce(degree, 0) AS degree FROM (SELECT DISTINCT node FROM ends UNION SELECT 'lonely') LEFT JOIN dd USING (node))")
def degree_distinct_stats(spark, d):
    e = ad.kg_edges(spark, d)
    return g.degree_stats(g.degree_distinct(e), g.endpoints(e).union(spark.range(1).select(F.lit("lonely"))))


@query(f"{_DEG} {_STATS} di")
def degree_incident_stats(spark, d):
    return g.degree_stats(g.degree_incident(ad.kg_edges(spark, d)))


@query(f"{_DEG} SELECT degree, count(*) AS nodes FROM dd GROUP BY degree")
def degree_histogram(spark, d):
    return g.degree_histogram(g.degree_distinct(ad.kg_edges(spark, d)))


@query(f"""{_DEG}, nodes AS (SELECT DISTINCT node FROM ends WHERE node NOT LIKE 'b:%'), keys AS (SELECT source, relation, target, count(*) AS copies FROM (SELECT * FROM kg UNION ALL SELECT * FROM kg WHERE relation = 'inRegion') GROUP BY ALL)
SELECT CAST(sum(copies) AS BIGINT) AS edges, CAST(sum(copies - 1) AS BIGINT) AS duplicates, CAST(coalesce(sum(copies) FILTER (WHERE source = target), 0) AS BIGINT) AS self_loops,
(SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT node) FROM ends WHERE node NOT IN (SELECT node FROM nodes)) AS missing, (SELECT count(*) FROM dd WHERE degree > 12) AS above_cap,
round(sum(copies) / (SELECT count(*) FROM nodes), 6) AS edges_per_node FROM keys""")
def graph_validation_report(spark, d):
    e = ad.kg_edges(spark, d)
    return g.validation_report(e.unionAll(e.where("relation = 'inRegion'")), g.endpoints(e).where("node not like 'b:%'"), 12)


@query(f"WITH {KG}, more AS (SELECT * FROM kg UNION ALL SELECT target, 'near', source, 'x' FROM kg WHERE relation = 'inNation') SELECT least(source, target) AS a, greatest(source, target) AS b, count(DISTINCT relation) AS relations FROM more GROUP BY 1, 2 HAVING count(DISTINCT relation) > 1")
def multi_relation_pairs(spark, d):
    e = ad.kg_edges(spark, d)
    back = e.where("relation = 'inNation'").select(F.col("target").alias("source"), F.lit("near").alias("relation"), F.col("source").alias("target"), F.lit("x").alias("source_type"))
    return g.multi_relation_pairs(e.unionByName(back))


_UT = f"{_DEG}, ut AS (SELECT source, relation, min(target) AS target FROM kg GROUP BY source, relation HAVING count(DISTINCT target) = 1), usable AS (SELECT ut.* FROM ut JOIN di ON di.node = ut.target WHERE di.degree >= 3)"


@query(f"{_UT} SELECT * FROM usable")
def unique_target_edges(spark, d):
    return g.unique_targets(ad.kg_edges(spark, d), 3)


@query(f"{_DEG}, ur AS (SELECT source, min(relation) AS relation, target FROM kg GROUP BY source, target HAVING count(DISTINCT relation) = 1) SELECT ur.source, relation, ur.target FROM ur JOIN di a ON a.node = ur.source JOIN di b ON b.node = ur.target WHERE a.degree >= 3 AND b.degree >= 3")
def unique_relation_edges(spark, d):
    return g.unique_relations(ad.kg_edges(spark, d), 3)


@query(f"WITH {KG} SELECT source, count(*) AS score FROM kg WHERE relation IN ('suppliedBy', 'hasBrand') GROUP BY source")
def connectivity_score(spark, d):
    return g.connectivity(ad.kg_edges(spark, d), ["suppliedBy", "hasBrand"])


@query(f"""WITH {KG}, a AS (SELECT relation, count(*) AS n, count(*) * 1.0 / (SELECT count(*) FROM kg) AS s FROM kg GROUP BY relation),
b AS (SELECT relation, count(*) AS n, count(*) * 1.0 / (SELECT count(*) FROM kg WHERE source_type <> 'lineitem') AS s FROM kg WHERE source_type <> 'lineitem' GROUP BY relation)
SELECT round(max(abs(coalesce(a.s, 0) - coalesce(b.s, 0))), 6) AS max_share_delta, CAST(sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0))) AS BIGINT) AS l1_distance FROM a FULL JOIN b USING (relation)""")
def relation_comparison(spark, d):
    e = ad.kg_edges(spark, d)
    return g.compare_relations(e, e.where("source_type <> 'lineitem'"))


@query(f"""WITH {KG}, a AS (SELECT DISTINCT source FROM kg WHERE relation = 'suppliedBy'), b AS (SELECT DISTINCT source FROM kg WHERE relation IN ('hasBrand', 'inRegion'))
SELECT (SELECT count(*) FROM a) AS size_a, (SELECT count(*) FROM b) AS size_b, count(*) FILTER (WHERE a.source IS NOT NULL AND b.source IS NOT NULL) AS shared,
round(count(*) FILTER (WHERE a.source IS NOT NULL AND b.source IS NOT NULL) / (SELECT count(*) FROM a), 6) AS share_a, round(count(*) FILTER (WHERE a.source IS NOT NULL AND b.source IS NOT NULL) / (SELECT count(*) FROM b), 6) AS share_b,
round(count(*) FILTER (WHERE a.source IS NOT NULL AND b.source IS NOT NULL) / count(*), 6) AS jaccard FROM a FULL JOIN b ON a.source = b.source""")
def overlap_stats(spark, d):
    e = ad.kg_edges(spark, d)
    return g.overlap(e.where("relation = 'suppliedBy'"), e.where("relation in ('hasBrand', 'inRegion')"), ["source"])


@query(f"WITH {KG}, ends AS (SELECT source AS node, relation FROM kg UNION ALL SELECT target, relation FROM kg) SELECT node, bool_or(relation = 'placedBy') AS covered FROM ends GROUP BY node")
def node_coverage(spark, d):
    e = ad.kg_edges(spark, d)
    return g.coverage(e.where("relation = 'placedBy'"), e)


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1")
def distinct_keep_first(spark, d):
    li = ad.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    return g.first_edges(li, ["l_linenumber", "l_partkey"], ["l_orderkey", "l_returnflag"])


@query(f"""WITH RECURSIVE {KG}, walk AS (SELECT target AS node, 0 AS depth FROM kg WHERE relation = 'inRegion' GROUP BY target UNION SELECT kg.source, walk.depth + 1 FROM kg JOIN walk ON kg.target = walk.node WHERE walk.depth < 4)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node""")
def bfs_depth(spark, d):
    e = ad.kg_edges(spark, d)
    return g.bfs_depth(e, e.where("relation = 'inRegion'").select(F.col("target").alias("node")), 4)


_E = f"WITH {KG}, e AS (SELECT DISTINCT source, relation, target FROM kg)"


@query(f"""{_E} SELECT source, relation, count(*) AS edges, count(*) * (count(*) - 1) AS pairs, CAST(sum(CAST('0x' || left(md5(target), 8) AS BIGINT)) AS BIGINT) AS digest
FROM e GROUP BY source, relation HAVING count(*) > 1""")
def sibling_same_relation(spark, d):
    return g.sibling_classes(ad.kg_edges(spark, d), ["source", "relation"])


@query(f"""{_E} SELECT target, relation, count(*) AS edges, count(*) * (count(*) - 1) AS pairs, CAST(sum(CAST('0x' || left(md5(source), 8) AS BIGINT)) AS BIGINT) AS digest
FROM e GROUP BY target, relation HAVING count(*) > 1""")
def sibling_same_end(spark, d):
    return g.sibling_classes(ad.kg_edges(spark, d), ["target", "relation"])


_DRAWN = f"""{_E}, c AS (SELECT *, row_number() OVER (PARTITION BY source{{keys}} ORDER BY relation, target) - 1 AS pos, count(*) OVER (PARTITION BY source{{keys}}) AS n FROM e)
SELECT a.source, a.relation, a.target, b.relation AS relation2, b.target AS target2 FROM c a JOIN c b ON a.source = b.source{{on}}
AND b.pos = (a.pos + CAST('0x' || left(md5('5|' || a.source || '|' || a.relation || '|' || a.target), 8) AS BIGINT) % (a.n - 1) + 1) % a.n WHERE a.n > 1"""


@query(_DRAWN.format(keys=", relation", on=" AND a.relation = b.relation"))
def sibling_drawn_same_relation(spark, d):
    return g.drawn_siblings(ad.kg_edges(spark, d), ["source", "relation"], 5)


@query(_DRAWN.format(keys="", on=""))
def sibling_drawn_any(spark, d):
    return g.drawn_siblings(ad.kg_edges(spark, d), ["source"], 5)


_E2 = f"WITH {KG}, e AS (SELECT DISTINCT source, relation, target FROM kg WHERE relation = 'inNation' UNION ALL SELECT DISTINCT source, 'livesIn', target FROM kg WHERE relation = 'inNation' AND source LIKE 'c:%')"


@query(f"{_E2} SELECT a.source, a.relation, a.target, b.relation AS relation2, b.target AS target2 FROM e a JOIN e b ON a.source = b.source AND a.target = b.target AND a.relation <> b.relation")
def sibling_same_target(spark, d):
    e = ad.kg_edges(spark, d).where("relation = 'inNation'")
    return g.siblings(e.unionByName(e.where("source like 'c:%'").withColumn("relation", F.lit("livesIn"))), "same_target")


@query(f"{_E} SELECT a.source, a.relation, a.target, b.relation AS relation2, b.target AS target2 FROM e a JOIN e b ON a.source = b.source WHERE a.relation = 'suppliedBy' AND b.relation = 'hasBrand'")
def sibling_expansion(spark, d):
    allowed = spark.createDataFrame([("suppliedBy", "hasBrand"), ("inNation", "inRegion")], "relation string, relation2 string")
    rules = spark.createDataFrame([("hasBrand",), ("inRegion",)], "relation string")
    return g.expansions(ad.kg_edges(spark, d), allowed, rules)


@query(f"WITH {KG} SELECT source AS node, list_sort(list(DISTINCT target)) AS qualities FROM kg WHERE relation = 'hasBrand' GROUP BY source")
def quality_lookup(spark, d):
    return g.quality_lookup(ad.kg_edges(spark, d), "hasBrand")[1]


def _nodes(spark, d):
    r = readers.parse_assertions(ad.assertions(spark, d))
    return r.where("relation = 'IsA' and source_lemma is not null").select(F.concat(F.lit("n:"), "source_lemma").alias("node"), F.array("source_lemma").alias("lemmas")).distinct().where("node < 'n:wcz'")


PARSED = ad.ASSERTIONS + r""", f AS (SELECT string_split(value, chr(9)) AS f FROM assertions), parsed AS (
  SELECT string_split(f[2], '/')[-1] AS relation,
    CASE WHEN string_split(f[3], '/')[3] = 'en' THEN trim(lower(replace(string_split(f[3], '/')[4], '_', ' '))) END AS source_lemma,
    CASE WHEN string_split(f[4], '/')[3] = 'en' THEN trim(lower(replace(string_split(f[4], '/')[4], '_', ' '))) END AS target_lemma,
    coalesce(CASE WHEN json_valid(f[5]) THEN TRY_CAST(json_extract_string(f[5], '$.weight') AS DOUBLE) END, 1.0) AS weight,
    contains(lower(f[5]), 'wordnet') AS from_wordnet
  FROM f WHERE len(f) >= 4)"""
CANDIDATES = PARSED + """, idx AS (SELECT DISTINCT source_lemma AS lemma, 'n:' || source_lemma AS node FROM parsed WHERE relation = 'IsA' AND source_lemma IS NOT NULL AND 'n:' || source_lemma < 'n:wcz'),
cand AS (SELECT p.*, s.node AS source_node, t.node AS target_node FROM parsed p LEFT JOIN idx s ON s.lemma = p.source_lemma LEFT JOIN idx t ON t.lemma = p.target_lemma
  WHERE relation IN ('IsA', 'RelatedTo', 'PartOf') AND weight >= 1.0 AND source_lemma IS NOT NULL AND target_lemma IS NOT NULL AND source_lemma <> target_lemma AND (s.node IS NOT NULL OR t.node IS NOT NULL) AND s.node IS DISTINCT FROM t.node)"""


def _candidates(spark, d):
    return g.candidate_edges(readers.parse_assertions(ad.assertions(spark, d)), g.lemma_index(_nodes(spark, d)), ["IsA", "RelatedTo", "PartOf"], 1.0)


@query(f"WITH {PARSED} SELECT * FROM parsed")
def assertion_parse(spark, d):
    return readers.parse_assertions(ad.assertions(spark, d))


@query(f"WITH {CANDIDATES} SELECT relation, source_lemma, target_lemma, source_node, target_node, weight FROM cand")
def expansion_candidates(spark, d):
    return _candidates(spark, d).select("relation", "source_lemma", "target_lemma", "source_node", "target_node", "weight")


@query(f"WITH {CANDIDATES} SELECT CASE WHEN source_node IS NULL THEN source_lemma ELSE target_lemma END AS lemma, count(*) AS support FROM cand WHERE (source_node IS NULL) <> (target_node IS NULL) GROUP BY 1")
def external_support(spark, d):
    return g.external_support(_candidates(spark, d))


def _ranked(spark, d):
    c = _candidates(spark, d).dropDuplicates(["relation", "source_lemma", "target_lemma", "weight"])
    known = c.where("source_node is not null and target_node is not null").select(F.col("source_node").alias("source"), F.col("target_node").alias("target"))
    return g.ranked_candidates(c, g.degree_distinct(known), g.external_support(c), ["IsA", "PartOf", "RelatedTo"])


@query(f"""WITH {CANDIDATES}, c AS (SELECT DISTINCT relation, source_lemma, target_lemma, weight, source_node, target_node FROM cand),
kn AS (SELECT source_node AS a, target_node AS b FROM c WHERE source_node IS NOT NULL AND target_node IS NOT NULL), dg AS (SELECT a AS node, count(DISTINCT b) AS d FROM (SELECT a, b FROM kn UNION ALL SELECT b, a FROM kn) WHERE a <> b GROUP BY a),
o AS (SELECT *, CASE WHEN source_node IS NULL THEN source_lemma WHEN target_node IS NULL THEN target_lemma END AS outside FROM c), sup AS (SELECT outside, count(*) AS support FROM o WHERE outside IS NOT NULL GROUP BY outside)
SELECT o.relation, source_lemma, target_lemma, o.weight, CAST(row_number() OVER (ORDER BY o.relation = 'RelatedTo', o.outside IS NOT NULL, least(coalesce(ds.d, 1000000), coalesce(dt.d, 1000000)), coalesce(support, 0) DESC, list_position(['IsA', 'PartOf', 'RelatedTo'], o.relation), weight DESC, o.relation, source_lemma, target_lemma) AS INTEGER) AS rank
FROM o LEFT JOIN dg ds ON ds.node = source_node LEFT JOIN dg dt ON dt.node = target_node LEFT JOIN sup ON sup.outside = o.outside""")
def candidate_ranking(spark, d):
    return _ranked(spark, d).select("relation", "source_lemma", "target_lemma", "weight", "rank")


_QUOTA = """sizes AS (SELECT relation, source_type, count(*) AS n FROM {kg} GROUP BY ALL), tot AS (SELECT sum(n) AS alln, {want} AS want FROM sizes),
ex AS (SELECT sizes.*, want, n * (want / alln) AS exact FROM sizes, tot), fl AS (SELECT *, floor(exact) AS fl, round(exact - floor(exact), 9) AS rest FROM ex),
quota AS (SELECT relation, source_type, n, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, relation DESC, source_type DESC) <= want - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM fl)"""
_HALF = "round_even(sum(n) * 0.37, 0)"


@query(f"WITH {KG}, {_QUOTA.format(kg='kg', want=_HALF)} SELECT * FROM quota")
def largest_remainder_quota(spark, d):
    return sampling.quotas(ad.kg_edges(spark, d), 0.37)


_STRAT = f"{_QUOTA.format(kg='kg', want=_HALF)}, strat AS (SELECT source, relation, target, source_type FROM (SELECT kg.*, quota, row_number() OVER (PARTITION BY relation, source_type ORDER BY {MD.format(chr(39)+'7'+chr(39), chr(39)+'sample'+chr(39))}, source, relation, target, source_type) AS k FROM kg JOIN quota USING (relation, source_type)) WHERE k <= quota)"


@query(f"WITH {KG}, {_STRAT} SELECT * FROM strat")
def stratified_sample(spark, d):
    return sampling.stratified_fraction(ad.kg_edges(spark, d), 0.37, 7)


def _paired_sql(left: str = "small") -> str:
    out = []
    for part, n in (("shared", 30), ("first", 70), ("second", 70)):
        q = _QUOTA.format(kg=left, want=str(n)).replace("sizes", f"z_{part}").replace("tot ", f"t_{part} ").replace(", tot", f", t_{part}").replace("ex AS", f"x_{part} AS").replace("FROM ex)", f"FROM x_{part})").replace("fl AS (SELECT", f"f_{part} AS (SELECT").replace("FROM fl)", f"FROM f_{part})").replace("quota AS (SELECT relation", f"q_{part} AS (SELECT relation")
        md = MD.format("'3'", f"'{part}'")
        out.append(f"{q}, s_{part} AS (SELECT source, relation, target, source_type FROM (SELECT {left}.*, quota, row_number() OVER (PARTITION BY relation, source_type ORDER BY {md}, source, relation, target, source_type) AS k FROM {left} JOIN q_{part} USING (relation, source_type)) WHERE k <= quota), l_{part} AS (SELECT * FROM {left} EXCEPT SELECT * FROM s_{part})")
        left = f"l_{part}"
    return ", ".join(out)


@query(f"WITH {KG}, {_paired_sql('kg')} SELECT *, 'shared' AS part FROM s_shared UNION ALL SELECT *, 'first' FROM s_first UNION ALL SELECT *, 'second' FROM s_second")
def paired_overlap_sample(spark, d):
    return sampling.paired(ad.kg_edges(spark, d), 100, 0.3, 3)


_PROBE = f"""{_UT}, fit AS (SELECT relation FROM (SELECT DISTINCT source, relation, target FROM kg) GROUP BY relation HAVING count(*) >= 20 INTERSECT SELECT relation FROM usable GROUP BY relation HAVING count(*) >= 5),
probe AS (SELECT 'entity' AS track, source, relation, target FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY md5('11|entity|' || source || '|' || relation || '|' || target), source, target) AS k FROM usable WHERE relation IN (SELECT relation FROM fit)) WHERE k <= 5)"""


def _probes(spark, d):
    e = ad.kg_edges(spark, d)
    return sampling.probes(e, g.unique_targets(e, 3), 5, 20, 11, "entity")


@query(f"{_PROBE} SELECT * FROM probe")
def probe_selection(spark, d):
    return _probes(spark, d)


@query(f"{_PROBE} SELECT source, relation, target, source_type FROM kg SEMI JOIN probe USING (source, relation, target)")
def omitted_edges(spark, d):
    return ad.kg_edges(spark, d).join(F.broadcast(_probes(spark, d)), ["source", "relation", "target"], "left_semi").select("source", "relation", "target", "source_type")


@query(f"{_PROBE} SELECT source, relation, target, source_type FROM kg ANTI JOIN probe USING (source, relation, target)")
def deprived_edges(spark, d):
    return ad.kg_edges(spark, d).join(F.broadcast(_probes(spark, d)), ["source", "relation", "target"], "left_anti").select("source", "relation", "target", "source_type")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('5|split|' || doc_id), doc_id) <= greatest(1, floor((SELECT count(*) FROM documents) * 0.1)) THEN 'dev' ELSE 'train' END AS part FROM documents")
def train_dev_split(spark, d):
    return sampling.split(ad.table(spark, d, "documents").select("doc_id"), 0.1, 5, "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('42001|sample|' || doc_id), doc_id LIMIT 50")
def epoch_sample(spark, d):
    return sampling.epoch(ad.table(spark, d, "documents").select("doc_id"), 50, 42, 1, "doc_id")


@query("SELECT conv_id, turn FROM (SELECT *, conv_id || '-' || turn AS key FROM conversations) ORDER BY md5('9|sample|' || key), key LIMIT 100")
def sample_records(spark, d):
    c = ad.table(spark, d, "conversations").select("conv_id", "turn").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    return sampling.sample_n(c, 100, 9, "key").select("conv_id", "turn")


@query("SELECT c AS condition, CAST(f AS DOUBLE) AS fraction, CAST(s AS INTEGER) AS seed FROM (VALUES ('low_40', 0.4), ('mid_60', 0.6), ('high_80', 0.8), ('full', 1.0)) a(c, f), (VALUES (42), (43), (44)) b(s)")
def condition_grid(spark, d):
    return sampling.grid(spark, [("low_40", 0.4), ("mid_60", 0.6), ("high_80", 0.8), ("full", 1.0)], [42, 43, 44])


@query(f"""WITH {KG}, cov AS (SELECT * FROM kg WHERE relation = 'inRegion'), {_QUOTA.format(kg='kg', want='round_even(sum(n) * 0.5, 0)')},
short AS (SELECT relation, source_type, quota - coalesce(h, 0) AS short FROM quota LEFT JOIN (SELECT relation, source_type, count(*) AS h FROM cov GROUP BY ALL) USING (relation, source_type)),
fill AS (SELECT kg.* FROM kg JOIN short USING (relation, source_type) WHERE relation <> 'inRegion' ORDER BY short DESC, {MD.format("'4'", "'fill'")}, source, relation, target, source_type LIMIT 75)
SELECT * FROM cov UNION ALL SELECT source, relation, target, source_type FROM fill""")
def coverage_first_fill(spark, d):
    return _coverage_first_fill(ad.kg_edges(spark, d))


def _coverage_first_fill(e):
    return sampling.coverage_fill(e, e.where("relation = 'inRegion'"), 100, 0.5, 4)


@query(f"""WITH {KG}, ends AS (SELECT source AS node FROM kg UNION ALL SELECT target FROM kg), di AS (SELECT node, count(*) AS degree FROM ends GROUP BY node),
fill AS (SELECT kg.* FROM kg JOIN di a ON a.node = source JOIN di b ON b.node = target WHERE relation <> 'inRegion' ORDER BY a.degree + b.degree DESC, {MD.format("'4'", "'dense'")}, source, relation, target, source_type LIMIT 75)
SELECT * FROM kg WHERE relation = 'inRegion' UNION ALL SELECT source, relation, target, source_type FROM fill""")
def dense_control_fill(spark, d):
    return _dense_control_fill(ad.kg_edges(spark, d))


def _dense_control_fill(e):
    return sampling.dense_fill(e, e.where("relation = 'inRegion'"), 100, 4)


@query()
def greedy_capped_graph(spark, d):
    return rounds.capped_graph(ad.kg_edges(spark, d), 12, ["source", "relation", "target"])


@query()
def backbone_bfs(spark, d):
    e = ad.kg_edges(spark, d).select(F.col("target").alias("source"), "relation", F.col("source").alias("target"), "source_type")
    lemmas = g.endpoints(e).select("node", F.col("node").alias("lemma"))
    return growth.backbone(e, lemmas, ["r:0", "r:1", "r:2", "r:3", "r:4"], ["inRegion", "inNation"], 200, 30, 3)


@query()
def expansion_fold(spark, d):
    r = written(_ranked(spark, d), "ranked")
    base = r.where("source_node is not null and target_node is not null and relation = 'PartOf'").select(F.col("source_node").alias("source"), "relation", F.col("target_node").alias("target"), F.lit("wordnet").alias("source_type"))
    return growth.expand(r, base, 200, 60, 12, priority=["IsA", "PartOf", "RelatedTo"])


@query()
def low_degree_repair(spark, d):
    r = written(_ranked(spark, d), "ranked")
    base = r.where("source_node is not null and target_node is not null").select(F.col("source_node").alias("source"), "relation", F.col("target_node").alias("target"))
    return growth.repair_degrees(r, base, 12, 50, 16)


@query()
def edge_cover(spark, d):
    return rounds.edge_cover(ad.kg_edges(spark, d), 1)


@query()
def relation_first_repair(spark, d):
    e = written(ad.kg_edges(spark, d), "kg").select("source", F.explode(F.array("relation", F.concat(F.lit("also_"), "relation"))).alias("relation"), "target", "source_type")
    return swaps.relation_first_fraction(e, 0.75, 1, 1)


@query()
def relation_control(spark, d):
    e = written(ad.kg_edges(spark, d), "kg")
    # the largest relation makes room for most edges of the others
    wanted = sampling.quotas(e.where("relation <> 'suppliedBy'"), 0.9).select("relation", "source_type", F.col("quota").alias("n"))
    return swaps.relation_control(e, sampling.stratified_fraction(e, 0.3, 1), wanted, 1)


@query()
def paired_coverage_repair(spark, d):
    e = ad.kg_edges(spark, d)
    p = written(sampling.paired(e, 150, 0.4, 3), "pair")
    return swaps.paired_repair(e, p.where("part = 'shared'").drop("part"), p.where("part = 'first'").drop("part"), 3)

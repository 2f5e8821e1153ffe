"""Queries on word pairs, probe examples and evaluation tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import alignment, graph, lexicon, probing, report, retrieval
from glossweave.sources import adapters as ad

from .text_queries import WORDS

Q, SQL = {}, {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _dictionaries(spark, d):
    lexicon = ad.lexicon(spark, d).withColumn("lemma", F.upper("key")).withColumn("source", F.when(F.length("key") % 2 == 0, "synsets").otherwise("grammar"))
    return lexicon.where("lang = 'a'"), lexicon.where("lang = 'b'")


def _vocabulary(token):
    return F.substring(F.md5(token), 1, 1) < "c"


@query(f"""WITH {ad.LEXICON} SELECT a.key, a.artificial AS a_token, b.artificial AS b_token FROM lexicon a JOIN lexicon b ON a.key = b.key AND a.lang = 'a' AND b.lang = 'b'
WHERE length(a.key) % 2 = 0 AND substr(md5(a.artificial), 1, 1) < 'c' AND substr(md5(b.artificial), 1, 1) < 'c'""")
def word_pair_alignment(spark, d):
    a, b = _dictionaries(spark, d)
    tokens = a.unionByName(b).select(F.col("artificial").alias("token")).where(_vocabulary(F.col("token")))
    return alignment.aligned_words(a, b, tokens)


@query(f"""WITH {ad.LEXICON}, pairs AS (SELECT a.key, upper(a.key) AS lemma, a.artificial AS a_token, b.artificial AS b_token FROM lexicon a JOIN lexicon b ON a.key = b.key AND a.lang = 'a' AND b.lang = 'b' WHERE length(b.key) % 7 <> 0),
vocab AS (SELECT c, artificial AS token FROM lexicon, (VALUES ('overlap_0'), ('overlap_50'), ('overlap_100')) x(c) WHERE substr(md5(c || artificial), 1, 1) <> '0'),
everywhere AS (SELECT token FROM vocab GROUP BY token HAVING count(DISTINCT c) = 3)
SELECT key, lemma, a_token, b_token FROM pairs WHERE key < 'm' AND a_token IN (SELECT token FROM everywhere) AND b_token IN (SELECT token FROM everywhere)""")
def pairs_in_all_conditions(spark, d):
    a, b = _dictionaries(spark, d)
    pairs = alignment.artificial_pairs(a, b.withColumn("artificial", F.when(F.length("key") % 7 != 0, F.col("artificial")).otherwise("")))
    edges = a.where("key < 'm'").select(F.col("key").alias("source"), F.lit("of").alias("relation"), F.lit("none").alias("target"))
    condition = F.explode(F.array(*map(F.lit, ("overlap_0", "overlap_50", "overlap_100")))).alias("condition")
    vocabularies = a.unionByName(b).select(F.col("artificial").alias("token"), condition).where(F.substring(F.md5(F.concat("condition", "token")), 1, 1) != "0")
    return alignment.in_all_conditions(alignment.endpoint_pairs(pairs, edges), vocabularies).select("key", "lemma", "a_token", "b_token")


@query(f"""WITH {ad.VECTORS}, c AS (SELECT k, 'c' || k AS condition, id, vec[1 + 16 * k : 32 + 16 * k] AS vec FROM vectors, range(0, 3) t(k) WHERE NOT (k = 2 AND id % 5 = 1)),
p AS (SELECT id AS pair, id AS a, id + 1 AS b FROM vectors WHERE id % 2 = 0), g AS (SELECT p.*, 'c' || k AS condition FROM p, range(0, 3) t(k))
SELECT pair, g.condition, round(round(1 - list_cosine_similarity(x.vec, y.vec), 9), 6) AS distance FROM g LEFT JOIN c x ON x.condition = g.condition AND x.id = a LEFT JOIN c y ON y.condition = g.condition AND y.id = b""")
def distance_trajectory(spark, d):
    v = ad.vectors(spark, d)
    vectors = None
    for k in range(3):
        part = v.where("id % 5 <> 1" if k == 2 else "true").select(F.lit(f"c{k}").alias("condition"), "id", F.slice("vec", 1 + 16 * k, 32).alias("vec"))
        vectors = part if vectors is None else vectors.unionByName(part)
    pairs = v.where("id % 2 = 0").select(F.col("id").alias("pair"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return alignment.distance_trajectory(pairs, vectors).select("pair", "condition", F.round("distance", 6).alias("distance"))


_SAID = f"""said AS (SELECT conv_id, turn // 2 AS n, turn % 2 AS side, {WORDS.format('text')} AS ws FROM conversations),
tok AS (SELECT * FROM (VALUES ('k0', 'the', 'the'), ('k1', 'to', 'of'), ('k2', 'and', 'de'), ('k3', 'zzzz', 'the')) t(target, a_token, b_token)),
m AS (SELECT conv_id, n, side, 'k' || (conv_id % 5) AS target, ws FROM said),
x AS (SELECT m.*, CASE WHEN side = 0 THEN a_token ELSE b_token END AS token FROM m JOIN tok USING (target)),
y AS (SELECT *, list_position(ws, token) AS loc FROM x WHERE list_contains(ws, token)),
z AS (SELECT conv_id, n, side, target, array_to_string(list_concat(list_concat(ws[1:loc - 1], ['[MASK]']), ws[loc + 1:]), ' ') AS s FROM y)"""


def _said(spark, d, side):
    c = ad.table(spark, d, "conversations").where(F.col("turn") % 2 == side)
    return c.groupBy(F.col("conv_id").cast("string").alias("source"), F.concat(F.lit("r"), F.floor(F.col("turn") / 2).cast("string")).alias("relation"), F.concat(F.lit("k"), (F.col("conv_id") % 5).cast("string")).alias("target")).agg(F.array_sort(F.collect_list(F.coalesce("text", F.lit("")))).alias("sentences"))


@query(f"""WITH {_SAID}, g AS (SELECT conv_id, n, target, count(DISTINCT s) FILTER (WHERE side = 0) AS n_a, count(DISTINCT s) FILTER (WHERE side = 1) AS n_b, min(s) FILTER (WHERE side = 0) AS a, min(s) FILTER (WHERE side = 1) AS b FROM z GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) AS source, 'r' || n AS relation, target, CAST(n_a AS INTEGER) AS n_a, CAST(n_b AS INTEGER) AS n_b, md5(a) AS first_a, md5(b) AS first_b FROM g WHERE n_a > 0 AND n_b > 0""")
def probe_examples(spark, d):
    a, b = _said(spark, d, 0), _said(spark, d, 1)
    parallel = a.select(*alignment.TRIPLE, F.col("sentences").alias("lang_a")).join(b.select(*alignment.TRIPLE, F.col("sentences").alias("lang_b")), alignment.TRIPLE)
    first = spark.createDataFrame([("k0", "the"), ("k1", "to"), ("k2", "and"), ("k3", "zzzz")], "key string, artificial string")
    second = spark.createDataFrame([("k0", "the"), ("k1", "of"), ("k2", "de"), ("k3", "the")], "key string, artificial string")
    out = alignment.probe_examples(a, parallel, first, second)
    return out.select(*alignment.TRIPLE, F.size("a_sentences").alias("n_a"), F.size("b_sentences").alias("n_b"), F.md5(F.array_min("a_sentences")).alias("first_a"), F.md5(F.array_min("b_sentences")).alias("first_b"))


@query(f"""WITH {ad.HITS}, h AS (SELECT 'cfg' || (id % 4) AS config, source, relation, target, bool_or(hit = 0) AS leak FROM hits GROUP BY ALL), s AS (SELECT * FROM h WHERE NOT leak),
k AS (SELECT * FROM s WHERE (config, relation) IN (SELECT (config, relation) FROM s GROUP BY config, relation HAVING count(*) >= 3))
SELECT config, source, relation, target, source || '.' AS a, config || source AS b FROM k""")
def config_assembly(spark, d):
    h = ad.hits(spark, d).withColumn("config", F.concat(F.lit("cfg"), (F.col("id") % 4).cast("string"))).withColumn("hit", 1 - F.col("hit"))
    left = alignment.survivors_by_config(h, h, 3)
    a = h.select(*alignment.TRIPLE).distinct().withColumn("sentences", F.array(F.concat("source", F.lit("."))))
    b = h.select("config", *alignment.TRIPLE).distinct().withColumn("sentences", F.array(F.concat("config", "source")))
    out = alignment.assemble_configs(left, a, b)
    return out.select("config", *alignment.TRIPLE, F.array_join("lang_a", " ").alias("a"), F.array_join("lang_b", " ").alias("b"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey AS k, o_comment_a AS s FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'a' || o_custkey END AS o_comment_a FROM orders)),
b AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'b' || c_custkey END AS s FROM customer)
SELECT place, k, a.s AS a, b.s AS b FROM a JOIN b USING (place) WHERE a.s IS NOT NULL AND b.s IS NOT NULL""")
def positional_join(spark, d):
    some = lambda n, c: F.when(n, F.array().cast("array<string>")).otherwise(F.array(c))
    a = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), some(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("a"), F.col("o_custkey").cast("string"))).alias("sentences"))
    b = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), some(F.col("c_custkey") % 7 == 0, F.concat(F.lit("b"), F.col("c_custkey").cast("string"))).alias("sentences"))
    return alignment.positional_join(a, b, ["k"]).select("place", "k", F.col("lang_a")[0].alias("a"), F.col("lang_b")[0].alias("b"))


_EVAL = ad.RUNS + ", m AS (SELECT grp || ':' || condition AS condition, CASE WHEN max(seed) = 2 THEN grp END AS frequency_strategy, CASE WHEN max(x) > 0 THEN max(x)::DOUBLE END AS overlap, min(score) AS dev FROM runs GROUP BY 1, grp), w AS (SELECT grp || ':' || condition AS condition, max(score) AS word_top1 FROM runs WHERE condition <> 'h3' GROUP BY 1)"


@query(f"WITH {_EVAL} SELECT m.condition, coalesce(frequency_strategy, 'unknown') AS frequency_strategy, coalesce(overlap, 0.0) AS lexical_overlap_percentage, 0.0 AS train_perplexity, dev AS dev_perplexity, word_top1 FROM m LEFT JOIN w USING (condition)".replace("0.0 AS train", "0.0::DOUBLE AS train"))
def evaluation_rows(spark, d):
    r = ad.runs(spark, d).withColumn("condition", F.concat_ws(":", "grp", "condition"))
    meta = r.groupBy("condition", "grp").agg(F.when(F.max("seed") == 2, F.col("grp")).alias("frequency_strategy"), F.when(F.max("x") > 0, F.max("x").cast("double")).alias("lexical_overlap_percentage"), F.min("score").alias("dev_perplexity"), F.lit(None).cast("double").alias("train_perplexity"))
    metrics = r.where("not condition like '%:h3'").groupBy("condition").agg(F.max("score").alias("word_top1"))
    return alignment.evaluation_rows(meta, metrics)


@query(f"WITH {ad.RUNS}, s AS (SELECT condition, avg(score) AS mean, min(score) AS least, max(score) AS most, stddev_samp(score) AS sd FROM runs GROUP BY condition), d AS (SELECT max(CASE WHEN condition = 'h0' THEN mean END) - max(CASE WHEN condition = 'h4' THEN mean END) AS mean, max(CASE WHEN condition = 'h0' THEN least END) - max(CASE WHEN condition = 'h4' THEN least END) AS least, max(CASE WHEN condition = 'h0' THEN most END) - max(CASE WHEN condition = 'h4' THEN most END) AS most, max(CASE WHEN condition = 'h0' THEN sd END) - max(CASE WHEN condition = 'h4' THEN sd END) AS sd FROM s) SELECT 'mean' AS metric, round(mean, 6) AS gap FROM d UNION ALL SELECT 'least', round(least, 6) FROM d UNION ALL SELECT 'most', round(most, 6) FROM d UNION ALL SELECT 'sd', round(sd, 6) FROM d")
def condition_gap(spark, d):
    s = ad.runs(spark, d).groupBy("condition").agg(F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.stddev_samp("score").alias("sd"))
    return alignment.condition_gap(s, "h0", "h4", ["mean", "least", "most", "sd"]).withColumn("gap", F.round("gap", 6))


@query(f"""WITH {ad.KG}, n AS (SELECT node, count(DISTINCT other) AS degree FROM (SELECT source AS node, target AS other FROM kg UNION SELECT target, source FROM kg) WHERE node <> other GROUP BY node),
c AS (SELECT source AS source_node, target AS target_node, relation, CAST(length(source) % 3 AS DOUBLE) AS weight FROM (SELECT DISTINCT source, relation, target FROM kg WHERE relation <> 'suppliedBy'))
SELECT source_node, target_node, relation, a.degree + b.degree AS degrees, CAST(row_number() OVER (ORDER BY CASE relation WHEN 'inRegion' THEN 1 WHEN 'inNation' THEN 2 ELSE 99 END, weight DESC, a.degree + b.degree, source_node, target_node, relation) AS INTEGER) AS rank
FROM c JOIN n a ON a.node = source_node JOIN n b ON b.node = target_node""")
def second_pass_ranking(spark, d):
    edges = ad.kg_edges(spark, d)
    own = edges.where("relation <> 'suppliedBy'").select(F.col("source").alias("source_node"), F.col("target").alias("target_node"), "relation").distinct().withColumn("weight", (F.length("source_node") % 3).cast("double"))
    out = graph.second_pass_ranked(own, edges, ["inRegion", "inNation"])
    return out.select("source_node", "target_node", "relation", F.col("degrees").cast("long").alias("degrees"), "rank")


@query(f"""WITH {ad.KG}, nouns AS (SELECT DISTINCT source AS node FROM kg WHERE relation IN ('inNation', 'suppliedBy')), e AS (SELECT DISTINCT source, relation, target FROM kg WHERE relation IN ('inNation', 'suppliedBy', 'hasBrand'))
SELECT node, count(target) AS score FROM nouns LEFT JOIN (SELECT * FROM e WHERE target IN (SELECT node FROM nouns)) e ON e.source = node GROUP BY node""")
def noun_connectivity(spark, d):
    edges = ad.kg_edges(spark, d)
    nouns = edges.where("relation in ('inNation', 'suppliedBy')").select(F.col("source").alias("node"))
    return graph.noun_neighbours(edges, nouns, ["inNation", "suppliedBy", "hasBrand"])


_CONTEXTS = ad.VECTORS + ", m AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM vectors) GROUP BY label, i), t AS (SELECT label, list(v ORDER BY i) AS vec FROM m GROUP BY label), u AS (SELECT label, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM t)"


@query(f"WITH {_CONTEXTS} SELECT label AS token, round(vec[1], 6) AS first, round(vec[64], 6) AS last, round(list_dot_product(vec, vec), 6) AS length FROM u")
def contextual_token_vectors(spark, d):
    own = retrieval.token_vectors(ad.vectors(spark, d).select(F.col("label").alias("token"), "vec"))
    return own.select("token", F.round(F.col("vec")[0], 6).alias("first"), F.round(F.col("vec")[63], 6).alias("last"), F.round(retrieval.dot(F.col("vec"), F.col("vec")), 6).alias("length"))


@query(f"WITH {ad.VECTORS}, n AS (SELECT id, list_transform(vec, lambda x: x / (sqrt(list_dot_product(vec, vec)) + 1e-9)) AS vec FROM vectors WHERE id IN (3, 7, 19, 42)) SELECT x.id AS a, y.id AS b, round(list_dot_product(x.vec, y.vec), 6) AS sim FROM n x JOIN n y ON x.id < y.id")
def chosen_token_pairs(spark, d):
    return retrieval.chosen_pairs(ad.vectors(spark, d), [3, 42, 7, 19, 7, 10**9]).withColumn("sim", F.round("sim", 6))


_NAMED = "CASE condition WHEN 'h0' THEN 'low_40_relation' WHEN 'h1' THEN 'mid_60_coverage' WHEN 'h2' THEN 'high_80_relation' WHEN 'h3' THEN 'full_graph' ELSE condition END"


@query(f"""WITH {ad.RUNS}, r AS (SELECT {_NAMED} AS condition, seed, score FROM runs)
SELECT condition, CASE WHEN condition LIKE 'low_40%' THEN 40 WHEN condition LIKE 'mid_60%' THEN 60 WHEN condition LIKE 'high_80%' THEN 80 ELSE 100 END AS density,
CASE WHEN condition LIKE '%@_relation' ESCAPE '@' THEN 'relation-first' WHEN condition LIKE '%@_coverage' ESCAPE '@' THEN 'coverage-first' ELSE 'full' END AS strategy,
CAST(count(DISTINCT seed) AS INTEGER) AS n_seeds, array_to_string(list_sort(list(DISTINCT seed)), ',') AS seeds, round(avg(score), 6) AS score_mean, round(stddev_samp(score), 6) AS score_sd FROM r GROUP BY condition""")
def run_summary(spark, d):
    r = ad.runs(spark, d).withColumn("condition", F.expr(_NAMED))
    return report.run_summary(r, ["score"], ["low_40_relation", "mid_60_coverage", "high_80_relation", "full_graph"])


@query(f"""WITH {ad.HITS} SELECT id, target FROM hits WHERE lang = 'en' AND hit = 1""")
def entity_probes(spark, d):
    h = ad.hits(spark, d).select("id", "target", F.when(F.col("hit") == 1, "entity").otherwise("relation").alias("track"), F.when(F.col("lang") == "en", "N").otherwise("v").alias("pos"))
    return lexicon.nouns(probing.entity_track(h)).select("id", "target")

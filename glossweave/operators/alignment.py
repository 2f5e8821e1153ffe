"""Word pairs of two artificial languages, probe examples, and the tables that evaluations are assembled from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import masked_sentences

from .numbering import numbered
from .retrieval import pair_distance

TRIPLE = ["source", "relation", "target"]


def artificial_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(key, lemma, a_token, b_token): keys of both dictionaries (key, artificial; lemma may be absent in a row), sorted; keys with an
    empty or missing token are left out."""
    a = first.select("key", F.coalesce("lemma", "key").alias("lemma"), F.col("artificial").alias("a_token"))
    out = a.join(second.select("key", F.col("artificial").alias("b_token")), "key")
    return out.where("a_token <> '' and b_token <> ''").orderBy("key")


def endpoint_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs whose key is an endpoint of an edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("key")).distinct()
    return pairs.join(ends, "key", "left_semi")


def in_all_conditions(pairs: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """The pairs whose tokens are both in the vocabulary (condition, token) of every condition."""
    seen = vocabularies.select("condition", "token").distinct()
    conditions = seen.agg(F.count_distinct("condition").alias("conditions"))  # one row
    counts = seen.groupBy("token").agg(F.count("*").alias("n"))
    everywhere = counts.crossJoin(F.broadcast(conditions)).where("n = conditions").select("token")
    for side in ("a_token", "b_token"):
        pairs = pairs.join(everywhere.withColumnRenamed("token", side), side, "left_semi")
    return pairs


def distance_trajectory(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (pair, a, b) under every condition of vectors (condition, id, vec): condition and distance, null where a vector is missing.
    A pair meets the conditions, a list that does not grow with the data, never another pair."""
    conditions = vectors.select("condition").distinct()
    grid = pairs.crossJoin(F.broadcast(conditions))
    name = lambda c: F.concat_ws("|", "condition", F.col(c).cast("string"))
    own = grid.select(*pairs.columns, "condition", F.struct(F.col("a").alias("a0"), F.col("b").alias("b0")).alias("ids")).withColumn("a", name("ids.a0")).withColumn("b", name("ids.b0"))
    out = pair_distance(own, vectors.select(name("id").alias("id"), "vec"))
    return out.withColumn("a", F.col("ids.a0")).withColumn("b", F.col("ids.b0")).select(*pairs.columns, "condition", "distance")


def aligned_words(first: DataFrame, second: DataFrame, vocabulary: DataFrame, source: str = "synsets") -> DataFrame:
    """(key, a_token, b_token) of the first dictionary's entries (key, artificial, source) from `source`, both tokens in the vocabulary
    (token). A key that the second dictionary lacks is an error."""
    own = first.where(F.col("source") == source).select("key", F.col("artificial").alias("a_token"))
    missing = own.join(second, "key", "left_anti").select("key").orderBy("key").limit(3).collect()
    if missing:
        raise ValueError(f"keys without a second token: {[r.key for r in missing]}")
    out = own.join(second.select("key", F.col("artificial").alias("b_token")), "key")
    for side in ("a_token", "b_token"):
        out = out.join(vocabulary.select(F.col("token").alias(side)).distinct(), side, "left_semi")
    return out.select("key", "a_token", "b_token")


def probe_examples(probes: DataFrame, parallel: DataFrame, first: DataFrame, second: DataFrame, mask: str = "[MASK]") -> DataFrame:
    """(source, relation, target, a_sentences, b_sentences): probes with the parallel sentences (lang_a, lang_b) in which the target's
    token, by the dictionary of each language (key, artificial), is masked. A probe without an entry, a token or a sentence with the token
    in one of the languages is left out."""
    a, b = (d.select(F.col("key").alias("target"), F.col("artificial").alias(n)) for d, n in ((first, "a_token"), (second, "b_token")))
    out = probes.select(*TRIPLE).join(parallel.select(*TRIPLE, "lang_a", "lang_b"), TRIPLE).join(a, "target").join(b, "target")
    out = out.select(*TRIPLE, masked_sentences(F.col("lang_a"), F.col("a_token"), mask).alias("a_sentences"), masked_sentences(F.col("lang_b"), F.col("b_token"), mask).alias("b_sentences"))
    return out.where("size(a_sentences) > 0 and size(b_sentences) > 0")


def survivors_by_config(triples: DataFrame, hits: DataFrame, floor: int) -> DataFrame:
    """(config, triple) of the triples that no sentence of the configuration gave away (hits: config, triple, hit), in relations with
    at least `floor` of them; a triple without sentences in a configuration is skipped there."""
    seen = hits.groupBy("config", *TRIPLE).agg(F.max((F.col("hit") > 0).cast("int")).alias("hit"))
    left = triples.select(*TRIPLE).distinct().join(seen.where("hit = 0"), TRIPLE).select("config", *TRIPLE)
    enough = left.groupBy("config", "relation").count().where(F.col("count") >= floor).select("config", "relation")
    return left.join(enough, ["config", "relation"], "left_semi")


def assemble_configs(survivors: DataFrame, a_sentences: DataFrame, b_sentences: DataFrame) -> DataFrame:
    """(config, triple, lang_a, lang_b): the same sentences of the first language (triple, sentences) for all configurations, beside those
    of the second (config, triple, sentences); a triple without sentences in one of them is left out."""
    a = a_sentences.where("size(sentences) > 0").select(*TRIPLE, F.col("sentences").alias("lang_a"))
    b = b_sentences.where("size(sentences) > 0").select("config", *TRIPLE, F.col("sentences").alias("lang_b"))
    return survivors.join(a, TRIPLE).join(b, ["config", *TRIPLE]).select("config", *TRIPLE, "lang_a", "lang_b")


def positional_join(first: DataFrame, second: DataFrame, order: list[str]) -> DataFrame:
    """Records of two runs over the same ordered list, paired by place: (place, order columns of the first, lang_a, lang_b); pairs in which
    one has no sentences are dropped, and so are records beyond the shorter run. Places are counted within ranges of the order."""
    a = numbered(first, *order).select("place", *order, F.col("sentences").alias("lang_a"))
    b = numbered(second, *order).select("place", F.col("sentences").alias("lang_b"))
    return a.join(b, "place").where("size(lang_a) > 0 and size(lang_b) > 0")


def evaluation_rows(metadata: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row a condition: its metadata, defaults for what is missing, and its parsed metrics (null if there are none), by overlap."""
    own = metadata.select("condition", F.coalesce("frequency_strategy", F.lit("unknown")).alias("frequency_strategy"), F.coalesce("lexical_overlap_percentage", F.lit(0.0)).alias("lexical_overlap_percentage"), F.coalesce("train_perplexity", F.lit(0.0)).alias("train_perplexity"), F.coalesce("dev_perplexity", F.lit(0.0)).alias("dev_perplexity"))
    return own.join(metrics, "condition", "left").orderBy("lexical_overlap_percentage", "condition")


def condition_gap(summary: DataFrame, first: str, second: str, metrics: list[str]) -> DataFrame:
    """(metric, gap): the first condition's value less the second's."""
    value = lambda c, m: F.max(F.when(F.col("condition") == c, F.col(m)))
    one = summary.agg(*((value(first, m) - value(second, m)).alias(m) for m in metrics))
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("gap")) for m in metrics))).alias("x")).select("x.*")

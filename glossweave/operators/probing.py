"""Probes and masked-fill evaluation. Hidden states and logits are input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRIPLE = ["source", "relation", "target"]


def any_hit(hits: DataFrame, *extra: str) -> DataFrame:
    """(triple, extra, hit): a triple counts once, as hit if one of its sentences is."""
    return hits.groupBy(*TRIPLE, *extra).agg(F.max((F.col("hit") > 0).cast("int")).alias("hit"))


def accuracy(triples: DataFrame, *keys: str) -> DataFrame:
    """(keys, accuracy, n), rounded to four places."""
    out = [F.round(F.avg("hit"), 4).alias("accuracy"), F.count("*").alias("n")]
    return triples.groupBy(*keys).agg(*out) if keys else triples.agg(*out)


def leak_floor(triples: DataFrame, hits: DataFrame, floor: int, *keys: str) -> DataFrame:
    """Triples of which no sentence was hit, of relations that keep at least `floor` of them."""
    leaked = hits.where("hit > 0").select(*TRIPLE, *keys).distinct()
    left = triples.join(leaked, [*TRIPLE, *keys], "left_anti")
    w = Window.partitionBy("relation", *keys)
    return left.withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= floor).drop("__n")


def gold_ranks(logits: DataFrame) -> DataFrame:
    """(sentence_id, rank): one more than the number of tokens above the gold one (sentence_id, token_id, logit, gold)."""
    gold = logits.where("token_id = gold").select("sentence_id", F.col("logit").alias("gold_logit"))
    return logits.join(gold, "sentence_id").groupBy("sentence_id").agg((1 + F.count_if(F.col("logit") > F.col("gold_logit"))).alias("rank"))


def mrr(ranks: DataFrame, ks: list[int]) -> DataFrame:
    return ranks.agg(F.count("*").alias("n"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), *(F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"top{k}") for k in ks))


def lenient_strict(logits: DataFrame, examples: DataFrame, b_tokens: DataFrame, k: int) -> DataFrame:
    """(metric, top1, topk, n): over concepts, any of whose sentences may hit.

    examples: sentence_id, concept, a_token, b_token. lenient ranks B tokens only and wants b_token; strict_token
    ranks all and wants b_token; strict_concept ranks all and takes a_token too. A sentence whose b_token is no known
    B token is passed over, but its concept stays in the denominator.
    """
    order = Window.partitionBy("sentence_id").orderBy(F.desc("logit"), "token_id")
    ranked = lambda df: df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("sentence_id", "token_id", "place")
    of_b = logits.join(b_tokens, "token_id", "left_semi")
    full, part = ranked(logits), ranked(of_b)
    seen = examples.join(b_tokens.select(F.col("token_id").alias("b_token")), "b_token", "left_semi")
    total = examples.select("concept").distinct()

    def hits(places: DataFrame, wants: Column, metric: str) -> DataFrame:
        hit = seen.join(places, "sentence_id").groupBy("concept").agg(F.max((wants & (F.col("place") == 1)).cast("int")).alias("h1"), F.max(wants.cast("int")).alias("hk"))
        return total.join(hit, "concept", "left").agg(F.lit(metric).alias("metric"), F.round(F.avg(F.coalesce("h1", F.lit(0))), 4).alias("top1"), F.round(F.avg(F.coalesce("hk", F.lit(0))), 4).alias("topk"), F.count("*").alias("n"))

    want_b = F.col("token_id") == F.col("b_token")
    want_ab = want_b | (F.col("token_id") == F.col("a_token"))
    return hits(part, want_b, "lenient").unionByName(hits(full, want_ab, "strict_concept")).unionByName(hits(full, want_b, "strict_token"))


def source_rates(logits: DataFrame, examples: DataFrame, b_tokens: DataFrame) -> DataFrame:
    """One row: of the seen sentences, the share whose best token is the source token, and whose best token is of the
    right concept in the wrong language; 0 where none was seen."""
    best = logits.groupBy("sentence_id").agg(F.max_by("token_id", F.struct("logit", -F.col("token_id"))).alias("best"))
    seen = examples.join(b_tokens.select(F.col("token_id").alias("b_token")), "b_token", "left_semi").join(best, "sentence_id")
    rate = lambda c: F.round(F.coalesce(F.avg(c.cast("int")), F.lit(0.0)), 4)
    return seen.agg(F.count("*").alias("seen"), rate(F.col("best") == F.col("a_token")).alias("source_token_rate"), rate((F.col("best") == F.col("a_token")) & (F.col("a_token") != F.col("b_token"))).alias("right_concept_wrong_lang"))


def mask_states(states: DataFrame, tokens: DataFrame, mask: str = "[MASK]") -> DataFrame:
    """(sentence_id, layer, vec): the mean state at a sentence's masks. states: sentence_id, layer, position, vec."""
    from .retrieval import mean_vectors

    at = tokens.where(F.col("token") == mask).select("sentence_id", "position")
    return mean_vectors(states.join(at, ["sentence_id", "position"]), "sentence_id", "layer")


def linear_probe(train: DataFrame, test: DataFrame, classes: int, c: float = 1.0, steps: int = 100) -> DataFrame:
    """(id, label, predicted) of test rows (id, label, vec) by multinomial regression with penalty 1 / (c n)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n = max(1, train.count())
    lr = LogisticRegression(family="multinomial", regParam=1 / (c * n), standardization=False, maxIter=steps)
    ready = lambda df: df.select("id", F.col("label").cast("double").alias("label"), array_to_vector("vec").alias("features"))
    out = lr.fit(ready(train)).transform(ready(test))
    return out.select("id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def wrapped(tokens: Column, lang: Column, policy: dict[str, tuple[str, str]]) -> Column:
    """Tokens between the boundary tokens of their language."""
    first = last = F.lit(None).cast("string")
    for name, (cls, sep) in policy.items():
        first, last = F.when(lang == name, F.lit(cls)).otherwise(first), F.when(lang == name, F.lit(sep)).otherwise(last)
    return F.filter(F.concat(F.array(first), tokens, F.array(last)), lambda t: t.isNotNull())


def punctuated(tokens: Column, lang: Column, setting: str, marks: str = ".,;") -> Column:
    """Marks shared by both languages, taken out, or told apart by a suffix."""
    is_mark = lambda t: F.instr(F.lit(marks), t) > 0
    if setting == "none":
        return F.filter(tokens, lambda t: ~is_mark(t))
    if setting == "disjoint":
        return F.transform(tokens, lambda t: F.when(is_mark(t), F.concat(t, F.lit("_"), lang)).otherwise(t))
    return tokens


def entity_track(probes: DataFrame, track: str = "entity") -> DataFrame:
    """The probes of one track (a column of that name)."""
    return probes.where(F.col("track") == track)

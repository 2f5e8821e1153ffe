"""The driver's tables as the engine's logical inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, relation, target, source_type)."""
    t = lambda name: table(spark, sf_dir, name)

    def edges(df: DataFrame, source: str, key: str, relation: str, target: str, to: str, kind: str) -> DataFrame:
        name = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
        return df.select(name(source, key).alias("source"), F.lit(relation).alias("relation"), name(target, to).alias("target"), F.lit(kind).alias("source_type"))

    out = edges(t("nation"), "n", "n_nationkey", "inRegion", "r", "n_regionkey", "nation")
    out = out.unionAll(edges(t("customer"), "c", "c_custkey", "inNation", "n", "c_nationkey", "customer"))
    out = out.unionAll(edges(t("supplier"), "s", "s_suppkey", "inNation", "n", "s_nationkey", "supplier"))
    out = out.unionAll(edges(t("orders"), "o", "o_orderkey", "placedBy", "c", "o_custkey", "orders"))
    out = out.unionAll(edges(t("lineitem").select("l_partkey", "l_suppkey").distinct(), "p", "l_partkey", "suppliedBy", "s", "l_suppkey", "lineitem"))
    return out.unionAll(edges(t("part"), "p", "p_partkey", "hasBrand", "b", "p_brand", "part"))


KG = """kg AS (
  SELECT 'n:' || n_nationkey AS source, 'inRegion' AS relation, 'r:' || n_regionkey AS target, 'nation' AS source_type FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'inNation', 'n:' || c_nationkey, 'customer' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'inNation', 'n:' || s_nationkey, 'supplier' FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey, 'placedBy', 'c:' || o_custkey, 'orders' FROM orders
  UNION ALL SELECT DISTINCT 'p:' || l_partkey, 'suppliedBy', 's:' || l_suppkey, 'lineitem' FROM lineitem
  UNION ALL SELECT 'p:' || p_partkey, 'hasBrand', 'b:' || p_brand, 'part' FROM part)"""


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text, lang): lines of documents that are not blank; numbers from 0 count all lines."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"), "lang").where(F.trim("text") != "")


LINES = """lines AS (
  SELECT doc_id, CAST(line_no - 1 AS INTEGER) AS line_no, line AS text, lang FROM (
    SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
  WHERE trim(line, ' ') <> '')"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, vec): vectors of doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))


VECTORS = "vectors AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, condition, x, seed, score): the mean value of events by type, four-hour bucket and user modulo 3."""
    e = table(spark, sf_dir, "events")
    bucket = (F.hour("ts") / 4).cast("int")
    return e.groupBy(F.col("event_type").alias("grp"), F.concat(F.lit("h"), bucket.cast("string")).alias("condition"), (bucket * 10).alias("x"), (F.col("user_id") % 3).alias("seed")).agg(F.round(F.avg("value"), 6).alias("score"))


RUNS = """runs AS (
  SELECT event_type AS grp, 'h' || (hour(ts) // 4) AS condition, CAST((hour(ts) // 4) * 10 AS INTEGER) AS x, user_id % 3 AS seed, round(avg(value), 6) AS score
  FROM events GROUP BY ALL)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, relation, target, lang, hit): a labelled document as a sentence of a triple."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("relation"), F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")).alias("target"), "lang", F.col("quality").alias("hit"))


HITS = "hits AS (SELECT doc_id AS id, source, lang AS relation, 't' || (doc_id % 7) AS target, lang, quality AS hit FROM documents JOIN labels USING (doc_id))"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sentence_id, concept, token_id, logit, gold): each vector's components as the logits of 64 tokens."""
    v = vectors(spark, sf_dir)
    return v.select(F.col("id").alias("sentence_id"), F.concat(F.lit("k"), (F.col("id") % 50).cast("string")).alias("concept"), F.posexplode("vec").alias("token_id", "logit"), (F.col("label") * 2).alias("gold"))


LOGITS = """logits AS (
  SELECT vec_id AS sentence_id, 'k' || (vec_id % 50) AS concept, CAST(i - 1 AS INTEGER) AS token_id, CAST(v AS DOUBLE) AS logit, CAST(label * 2 AS INTEGER) AS gold
  FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): tab-separated assertion lines made of events, some of them short, foreign or without a weight."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    node = lambda n, m: F.concat(F.when(n % 11 == 0, "/c/fr/").otherwise("/c/en/"), F.lit("w"), F.translate((n % m).cast("string"), "0123456789", "abcdefghij"), F.when(n % 5 == 0, "_Tail").otherwise(""), F.when(n % 13 == 0, "/n").otherwise(""))
    relation = F.concat(F.lit("/r/"), F.element_at(F.array(*map(F.lit, ("IsA", "RelatedTo", "PartOf", "ExternalURL"))), (k % 4 + 1).cast("int")))
    meta = F.when(k % 6 == 0, "{broken").when(k % 6 == 1, F.concat(F.lit('{"weight": '), (k % 5 / 2).cast("string"), F.lit("}"))).when(k % 6 == 2, '{"weight": "x"}').when(k % 6 == 3, '{"dataset": "/d/WordNet", "weight": 2.0}').otherwise("{}")
    line = F.concat_ws("\t", F.concat(F.lit("/a/"), k.cast("string")), relation, node(k, 40), node(k + F.col("user_id"), 60), meta)
    return e.select(F.when(k % 17 == 0, F.concat(F.lit("/a/"), k.cast("string"), F.lit("\tshort"))).otherwise(line).alias("value"))


ASSERTIONS = """assertions AS (
  SELECT CASE WHEN event_id % 17 = 0 THEN '/a/' || event_id || chr(9) || 'short' ELSE
    '/a/' || event_id || chr(9) || '/r/' || ['IsA', 'RelatedTo', 'PartOf', 'ExternalURL'][CAST(event_id % 4 + 1 AS INTEGER)] || chr(9) ||
    CASE WHEN event_id % 11 = 0 THEN '/c/fr/' ELSE '/c/en/' END || 'w' || translate(CAST(event_id % 40 AS VARCHAR), '0123456789', 'abcdefghij') || CASE WHEN event_id % 5 = 0 THEN '_Tail' ELSE '' END || CASE WHEN event_id % 13 = 0 THEN '/n' ELSE '' END || chr(9) ||
    CASE WHEN (event_id + user_id) % 11 = 0 THEN '/c/fr/' ELSE '/c/en/' END || 'w' || translate(CAST((event_id + user_id) % 60 AS VARCHAR), '0123456789', 'abcdefghij') || CASE WHEN (event_id + user_id) % 5 = 0 THEN '_Tail' ELSE '' END || CASE WHEN (event_id + user_id) % 13 = 0 THEN '/n' ELSE '' END || chr(9) ||
    CASE event_id % 6 WHEN 0 THEN '{broken' WHEN 1 THEN '{"weight": ' || CAST(event_id % 5 / 2 AS DOUBLE) || '}' WHEN 2 THEN '{"weight": "x"}' WHEN 3 THEN '{"dataset": "/d/WordNet", "weight": 2.0}' ELSE '{}' END
  END AS value FROM events)"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, key, artificial): words of English documents that begin with a to r have artificial tokens in two languages."""
    w = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(F.array_distinct(F.split("text", " "))).alias("key")).where("key rlike '^[a-r]+$'").distinct()
    return w.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("lang"), "key").withColumn("artificial", F.concat("lang", F.substring(F.md5(F.concat_ws("|", "lang", "key")), 1, 10)))


LEXICON = """lexicon AS (
  SELECT lang, key, lang || substr(md5(lang || '|' || key), 1, 10) AS artificial
  FROM (SELECT DISTINCT key FROM (SELECT unnest(string_split(text, ' ')) AS key FROM documents WHERE lang = 'en') WHERE regexp_full_match(key, '[a-r]+')) CROSS JOIN (VALUES ('a'), ('b')) l(lang))"""

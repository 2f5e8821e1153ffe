"""Sources, with explicit schemas; malformed input fails or is dropped where that is stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import text as tx

EDGE = "source string, relation string, target string, source_type string"
NODE = "id string, node_type string, synset_id string, pos string, primary_lemma string, lemmas array<string>, definition string, examples array<string>, root_sources array<string>, min_wordnet_depth int, repair_for string"
TRIPLE = "source string, relation string, target string"
GENERATED = "source string, relation string, target string, sentences array<string>, expansions array<struct<source:string,relation:string,target:string,source_type:string>>"
SWITCHED = f"switches struct<s1:int,s2:int,s3:int>, results array<struct<{GENERATED.replace('source string, relation string, target string, sentences array<string>, expansions array<', 'source:string,relation:string,target:string,sentences:array<string>,expansions:array<')}>>"
PARALLEL = "source string, relation string, target string, lang_a array<string>, lang_b array<string>"
DICTIONARY = "map<string, struct<POS:array<string>,source:string,id:string,synset_id:string,primary_lemma:string,lemmas:array<string>,artificial:string>>"
MANIFEST = "seed int, n_per_relation int, min_total int, min_degree int, direction string, probes array<struct<track:string,source:string,relation:string,target:string,mask:string,gold:string,probe_in:string>>"
STATE = "global_step int, log_history array<struct<step:int,epoch:double,loss:double,eval_loss:double>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects, or one object, over several lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, EDGE)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, NODE)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of a list, or of the results of a generation."""
    both = spark.read.schema(f"{TRIPLE}, results array<struct<source:string,relation:string,target:string>>").option("multiLine", True).json(path)
    listed = both.where("source is not null").select("source", "relation", "target")
    return listed.unionByName(both.select(F.explode("results").alias("r")).select("r.*"))


def parse_assertions(lines: DataFrame) -> DataFrame:
    """(relation, source_lemma, target_lemma, weight, from_wordnet) of tab-separated lines (value); shorter lines go.

    Works on batches and on streams.
    """
    f = F.split("value", "\t", -1)
    meta = F.get(f, F.lit(4))
    own = lines.where(F.size(f) >= 4)
    return own.select(F.element_at(F.split(F.get(f, F.lit(1)), "/"), -1).alias("relation"), tx.node_lemma(F.get(f, F.lit(2))).alias("source_lemma"), tx.node_lemma(F.get(f, F.lit(3))).alias("target_lemma"), tx.weight_of(meta).alias("weight"), tx.mentions(meta, "wordnet").alias("from_wordnet"))


def read_assertions(spark: SparkSession, path: str) -> DataFrame:
    return parse_assertions(spark.read.text(path))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text): lines that are not blank, numbered in their file from 0; line numbers count all lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "text"))
    return whole.where(F.trim("text") != "")


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): the same lines without numbers; large files are split."""
    return spark.read.text(path).select(F.col("value").alias("text")).where(F.trim("text") != "")


def read_csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, every column as text; a column that is absent is an error."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns absent from {path}: {', '.join(lacking)}")
    return df


def read_metric(spark: SparkSession, path: str, metric: str) -> DataFrame:
    return read_csv_text(spark, path, ["metric"]).where(F.col("metric") == metric)


def read_dictionary(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(lang, key, POS, source, id, synset_id, primary_lemma, lemmas, artificial) of an object of objects."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", DICTIONARY, {"mode": "FAILFAST"})).alias("key", "v")).select(F.lit(lang).alias("lang"), "key", "v.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, MANIFEST)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec): an embedding matrix stored as rows."""
    return spark.read.parquet(path).select("id", F.col("vec").cast("array<double>").alias("vec"))


def read_states(spark: SparkSession, path: str, run: str = r"([^/]+)/[^/]+/[^/]+$") -> DataFrame:
    """(run, global_step, log_history) of training states found by a glob; the run is part of the path."""
    df = read_json(spark, path, STATE)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), run, 1).alias("run"), "global_step", "log_history")


def read_logs(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, groups, text) of whole log files; groups are those of the pattern in the file's name, files it doesn't fit go."""
    df = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))
    import re

    n = re.compile(name).groups
    return df.where(F.col("file").rlike(name)).select("file", F.array(*(F.regexp_extract("file", name, k + 1) for k in range(n))).alias("groups"), "text")


#: Pointer symbols of the lexical database's files and the relations they stand for.
POINTERS = {"@": "hypernym", "~": "hyponym", "@i": "instance_hypernym", "~i": "instance_hyponym", "%p": "part_meronym", "%m": "member_meronym", "%s": "substance_meronym", "#p": "part_holonym", "#m": "member_holonym", "#s": "substance_holonym"}


def read_lexical_database(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of data files of a lexical database: nodes (node, pos, words, gloss), edges (source, relation, target, target_pos) of the
    ten relations. A line is `offset file type words(hex) (word id)* pointers (symbol offset pos places)* | gloss`; lines that begin with a
    space are no entries. A node is its part of speech and offset."""
    lines = spark.read.text(path).where("not startswith(value, ' ') and value <> ''")
    f = F.split(F.substring_index("value", "|", 1), " +")
    own = lines.select(f.alias("f"), F.trim(F.expr("substring(value, instr(value, '|') + 1)")).alias("gloss")).withColumn("n", F.conv(F.col("f")[3], 16, 10).cast("int"))
    name = lambda pos, offset: F.concat_ws(":", F.replace(pos, F.lit("s"), F.lit("a")), offset)
    at = lambda k: F.get("f", k.cast("int"))
    places = lambda count, first, width: F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: first + k * width)).otherwise(F.array().cast("array<int>"))
    own = own.withColumn("node", name(F.col("f")[2], F.col("f")[0])).withColumn("p", at(F.col("n") * 2 + 4).cast("int"))
    nodes = own.select("node", F.substring("node", 1, 1).alias("pos"), F.transform(places(F.col("n"), F.lit(4), 2), lambda k: F.get("f", k)).alias("words"), "gloss")
    pointers = own.select(F.col("node").alias("source"), "f", F.explode(places(F.col("p"), F.col("n") * 2 + 5, 4)).alias("k"))
    kinds = F.create_map(*(F.lit(x) for pair in POINTERS.items() for x in pair))
    edges = pointers.select("source", F.try_element_at(kinds, at(F.col("k"))).alias("relation"), name(at(F.col("k") + 2), at(F.col("k") + 1)).alias("target"), at(F.col("k") + 2).alias("target_pos"))
    return nodes, edges.where("relation is not null").distinct()

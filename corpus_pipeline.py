"""The corpus pipeline: toxic documents go, then exact copies, near copies and benchmark leaks; the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents, whatever columns docs has besides doc_id and text.
Stages judge rows, not ids: rows that share an id, or have none, stay or go each by its own text. Of rows that
repeat both id and text one stays, as of all equal texts. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm import common, decontaminate, exact_dedup, near_dup, toxicity
from glossweave.llm.queries import bpe_digests, held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The model is fitted on labelled rows of docs."""
    model = toxicity.fit_on(docs, common.table(spark, sf_dir, "labels"), where=lambda key: ~held_out(key))
    return toxicity.scored_rows(docs, model).where("score < 0.5").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; one without an id only if none has one."""
    verdict = F.when(F.col("group_size") == 1, 2).when(F.col("kept"), 1).otherwise(0)
    return common.kept_rows(docs, lambda: exact_dedup.exact_dedup(docs, keep="largest").withColumn("verdict", verdict))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.75) the document with the smallest id stays; one
    without an id only if none has one. Texts without words are no copies of anything and stay."""
    verdict = F.when(F.col("n_shingles") == 0, 2).when(F.col("first"), 1).otherwise(0)
    return common.kept_rows(docs, lambda: near_dup.jaccard_classes(docs).withColumn("verdict", verdict))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    found = decontaminate.leaks_of_rows(docs, common.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that is left."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can't express the model, the similarity join, the alignment and the merges; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if name != STAGES[0][0]:
            common.forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages over documents, each written as Parquet and read again before the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps of docs. All but the
last return the columns of documents; the last adds shard_id.

Every stage takes a table of any columns with doc_id and text (mixing and sharding use source too, the classifier the
table labels, decontamination the table benchmark), keeps the other columns as they are, whatever their names and types,
and gives an empty table for an empty one. A doc_id that is no whole number counts as null. Texts of any length are read
whole. run() deletes what a stage wrote once the next one is written; the last stage's table stays for the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnsieve.llm import common, decontaminate, minhash, mixing, quality_cnn, sharding


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: what the classifier rejects goes.

    Null and empty texts go; a null doc_id has no label but is judged; a probability equal to the threshold stays; repeated
    rows stay or go together. Without labels of both kinds everything stays.
    """
    return quality_cnn.filter_documents(docs, quality_cnn.train(docs, common.load(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group stays.

    Documents without a word (null and empty texts) have no near duplicates and stay; of a group the least doc_id stays,
    null last, of equal ids the least key of the text, and of repeated rows one, the least by its other columns.
    """
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go.

    Null and empty texts hold nothing and stay; null and empty items are held by nothing; repeated rows stay or go together.
    """
    return decontaminate.decontaminate(docs, common.load(spark, sf_dir, "benchmark"), thin=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: a balanced sample at the target weights.

    A null source is a source of its own; null and empty texts have no tokens and pass at their source's probability; repeated
    rows stay or go together.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the shards.

    Null sources and ids come first; a null or empty text counts with a record's constant size; rows equal in source, doc_id
    and text lie in one shard.
    """
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("sharding", shards),
]

#: The classifier and the sampling can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.load(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        at = common.fresh_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            common.remove(spark, before)
        before = at
    return docs

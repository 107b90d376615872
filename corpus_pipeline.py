"""A training corpus from raw documents: toxic ones go, poor ones go, one of each near-duplicate group stays, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it as the
next stage's documents. All but the last return the columns of documents, whatever further ones there are. Models learn
from the labels beside the documents; stages score every row they get. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.llm import common, jaccard_join, packing, quality_classifier, toxicity
from cladeflow.runtime import fewer_files, give_back, materialize, table


def own_columns(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def free_name(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def larger_files(docs: DataFrame, out: DataFrame) -> DataFrame:
    """What is left of a read table, in fewer files than the table's partitions: filtering makes them small."""
    return fewer_files(out, docs.rdd.getNumPartitions())


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and empty texts stay here. Rows that repeat stay or go alike."""
    model, verdict = toxicity.train(docs, table(spark, sf_dir, "labels")), free_name(docs, "_toxic")
    give_back(spark)
    return larger_files(docs, toxicity.score_toxicity(docs, model, keep=verdict).where(F.col(verdict) == 0).select(*own_columns(docs)))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts have the score of a text without words. Rows
    that repeat stay or go alike."""
    model, verdict = quality_classifier.train(docs, table(spark, sf_dir, "labels")), free_name(docs, "_good")
    give_back(spark)
    return larger_files(docs, quality_classifier.score_quality(docs, model, keep=verdict).where(F.col(verdict) == 1).select(*own_columns(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of five-word shingles one stays: the smallest id, of several
    texts with that id the one with the smallest hash.

    Texts without words are no copies of each other, and rows with a null id of none: both stay. Of rows with one id and
    one text, one stays."""
    give_back(spark)
    found = materialize(jaccard_join.jaccard_components(docs, k=5, num=80, den=100, groups=True, sparing=True).where("doc_id is not null").select("doc_id", "text_hash", "group"), "groups", shuffled=True)
    give_back(spark)
    row = F.struct("doc_id", "text_hash")
    first = found.where("group is not null").groupBy("group").agg(F.min(row).alias("first"), F.max(row).alias("last")).where("first <> last").select("group", "first")
    gone = materialize(found.join(first, "group").where(row != F.col("first")).select("doc_id", "text_hash").distinct(), "near-copies", shuffled=True)
    again = found.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    repeated = again.count()
    small = lambda df: F.broadcast(df) if df.count() <= jaccard_join.BROADCAST_ROWS else df
    i, h = free_name(docs, "_id"), free_name(docs, "_hash")
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64("text")})
    named = lambda df: df.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h))
    kept = rows.join(small(named(gone)), [i, h], "left_anti")
    if not repeated:
        return larger_files(docs, kept.select(*own_columns(docs)))
    again = small(named(materialize(again, "repeated-rows", shuffled=True)))
    once = kept.join(again, [i, h], "left_semi").dropDuplicates([i, h])
    return kept.join(again, [i, h], "left_anti").select(*own_columns(docs)).unionAll(once.select(*own_columns(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, packed into sequences of 1024 tokens. A null or empty text is its end id alone; rows that
    repeat are packed each."""
    give_back(spark)
    out = packing.pack_documents(docs, common.tokenizer_path("byte_bpe_50k.json"))
    give_back(spark)
    return out


STAGES = [("toxicity", drop_toxic), ("quality_classifier", drop_poor), ("ngram_jaccard_join", drop_near_copies), ("best_fit_packing", pack)]

#: Trained models and the packing can't be stated in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

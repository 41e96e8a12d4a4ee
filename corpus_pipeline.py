"""From documents to training sequences in five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all of ``docs``, of any size, with the columns of ``documents`` (and
others, which it keeps). Null and empty texts stay until they are packed, as documents of one token. Rows that repeat a
document leave the second stage once. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightloom.llm import decontaminate, neardup, packing, secrets, toxicity
from lightloom.llm.common import cut, documents, fold, labels, new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from labelled ones whose crc32 modulo 4 is not 2."""
    model = toxicity.learn(docs.filter(fold("doc_id", 4) != 2), labels(spark, sf_dir, "toxic"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarities of 0.8 or more on shingles of five words, one row stays: that with the smallest
    doc_id (null ones last), and of those the smallest hash of its text. Rows are told apart by doc_id and text."""
    found = neardup.near_duplicates(docs, words=5, percent=80).select(F.col("doc_id").alias("own"), "copy", "first")
    found = cut(found.groupBy("own", "copy").agg(F.min("first").alias("first"), F.count("*").alias("n")).filter("n > 1 or not first"))
    of = lambda marks: docs["doc_id"].eqNullSafe(marks["own"]) & (F.xxhash64(docs["text"]) == marks["copy"])
    kept = docs.join(found, of(found), "left_anti")
    again = found.filter("first")  # a document whose rows repeat
    return kept.unionByName(docs.join(again, of(again), "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of the benchmark go; rows are told apart by doc_id (null is one too) and text."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = cut(found.filter("contaminated").select(F.col("doc_id").alias("hit"), "copy"))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit"]) & (F.xxhash64(docs["text"]) == hit["copy"]), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text gives way to a mark; all documents stay."""
    return secrets.redacted(docs, secrets.train_from_corpus(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The models of the first and fourth stage are beyond SQL; tests hold what each stage keeps against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs

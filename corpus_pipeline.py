"""From raw documents to packed training sequences, one operator after the other.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns they were given. Stage by stage:

1. ``quality``: documents that the compression classifier rejects go; it learns from ``labels``.
2. ``near_duplicates``: of each component of near-equal fingerprints the document with the smallest doc_id stays. Of rows that
   share a doc_id one stays; rows without doc_id cannot be named as copies and stay.
3. ``substrings``: words of repeated windows are cut from ``text`` and ``n_chars`` follows; documents of which nothing is left go.
4. ``decontamination``: documents that hold a benchmark item go.
5. ``packing``: every piece of every document with its sequence and offset.

Null and empty texts and empty tables pass through all stages by the rules of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rewardloom.llm import decontaminate, packing, simhash, substrings
from rewardloom.llm import quality as compression
from rewardloom.llm.tables import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compression.accepted(docs, compression.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(docs)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(first, "doc_id", "left_semi")
    rows = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = named.withColumn("_row", F.row_number().over(rows)).where("_row = 1").drop("_row")
    return one.union(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substrings.substring_dedup(docs, carried=tuple(docs.columns)).where("n_removed = 0 or n_removed < n_words")
    n_chars = F.when(F.col("kept_text").isNull(), F.col("carried.n_chars")).otherwise(F.length("kept_text").cast("long"))
    changed = {"text": F.coalesce("kept_text", "carried.text"), "n_chars": n_chars}
    return found.select(*[changed.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.word_bpe())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substring_dedup),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: SQL cannot express the classifier, the edit distances or the tokens: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

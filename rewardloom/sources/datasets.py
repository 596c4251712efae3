"""Question/answer sets, held-out sets, cached prompts and code-fenced payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.functions.extract import fenced_payload, hash_answer
from rewardloom.functions.prompts import (
    EXPECTED_FIELDS, INPUT_FIELDS, MAX_TOKENS, chat_prompt, render_messages, truncated_tokens,
)
from rewardloom.sources.questions import read_csv

MAX_SAMPLES = 100


def read_split(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """One split of a table partitioned by ``split``; the other partitions are not read."""
    return spark.read.parquet(path).where(F.col("split") == split)


def with_prompts(qa: DataFrame) -> DataFrame:
    return qa.withColumn("prompt", chat_prompt(F.col("question")))


def hash_answer_set(qa: DataFrame) -> DataFrame:
    """Questions with prompts and the answer behind the '####' mark."""
    return with_prompts(qa).withColumn("answer", hash_answer(F.col("answer")))


def read_csv_qa(spark: SparkSession, path: str) -> DataFrame:
    return with_prompts(read_csv(spark, path).select("question", "answer"))


# Keys a held-out document may keep its samples under, in order of preference.
SAMPLE_KEYS = ("samples", "data", "examples", "validation")


def held_out(docs: DataFrame, value: str = "value", max_samples: int = MAX_SAMPLES) -> DataFrame:
    """The first ``max_samples`` samples of each held-out document: ``(…, pos, input, expected)``.

    A document is a list, or an object with a list under one of ``SAMPLE_KEYS``; anything else fails the job.
    """
    v = F.try_parse_json(F.col(value))
    paths = ["$", *[f"$.{k}" for k in SAMPLE_KEYS]]
    samples = F.coalesce(
        *[F.try_variant_get(v, path, "array<variant>") for path in paths],
        F.raise_error(F.lit("Invalid dataset format")).cast("array<variant>"),
    )
    others = [c for c in docs.columns if c != value]
    rows = docs.select(*others, F.posexplode(F.slice(samples, 1, max_samples)).alias("pos", "s"))

    def field(names):
        return F.coalesce(*[F.try_variant_get("s", f"$.{n}", "string") for n in names], F.lit(""))

    return rows.select(
        *others,
        F.col("pos").cast("bigint").alias("pos"),
        field(INPUT_FIELDS).alias("input"),
        field(EXPECTED_FIELDS).alias("expected"),
    )


def read_held_out(spark: SparkSession, path: str, max_samples: int = MAX_SAMPLES) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return held_out(docs, max_samples=max_samples)


def cached_prompts(
    spark: SparkSession, qa: DataFrame, path: str, force_rebuild: bool = False, max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """Prompts and cut token lists, built once and read back from ``path`` afterwards."""
    # A folder without the mark of a finished job is not a cache; any other trouble with it is an error.
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not force_rebuild and mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        return spark.read.parquet(path)
    rendered = with_prompts(qa).withColumn("text", render_messages(F.col("prompt")))
    built = rendered.withColumn("tokens", truncated_tokens(F.col("text"), max_tokens)).drop("text")
    built.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fenced_json(df: DataFrame, response: str, schema: T.StructType | str) -> DataFrame:
    """Parse code-fenced JSON replies: ``payload`` where it can be read, ``reject`` with the text where it cannot."""
    body = fenced_payload(F.col(response))
    readable = F.try_parse_json(body).isNotNull()
    return df.withColumns({
        "payload": F.when(readable, F.from_json(body, schema)),
        "reject": F.when(~F.coalesce(readable, F.lit(False)), F.col(response)),
    })

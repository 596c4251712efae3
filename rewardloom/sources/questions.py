"""Question files: JSON, CSV and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.functions.text import strip


def _variant_get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def questions_from_json(docs: DataFrame, value: str = "value") -> DataFrame:
    """Questions of JSON documents, one document per row: ``(…, pos, question)``.

    Accepted are a list of texts, a list of objects that all have ``question``, and an object with ``questions``;
    any other document has no rows. The object is tested first, as an object also casts to a text.
    """
    v = F.try_parse_json(F.col(value))
    listed = _variant_get(v, "$", "array<variant>")
    all_objects = F.forall(listed, lambda e: _variant_get(e, "$.question", "variant").isNotNull())
    all_texts = F.forall(listed, lambda e: F.schema_of_variant(e) == "STRING")
    questions = (
        F.when(_variant_get(v, "$.questions", "array<variant>").isNotNull(),
               _variant_get(v, "$.questions", "array<string>"))
        .when(all_objects, F.transform(listed, lambda e: _variant_get(e, "$.question", "string")))
        .when(all_texts, F.transform(listed, lambda e: _variant_get(e, "$", "string")))
    )
    others = [c for c in docs.columns if c != value]
    return docs.select(*others, F.posexplode(questions).alias("pos", "question")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def read_json_questions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file; files are read in parallel."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return questions_from_json(docs)


# Quotes are doubled inside quotes, quoted texts may hold line breaks, blanks at either end belong to the text.
CSV_FORM = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
CSV_READ = {**CSV_FORM, "multiLine": True, "nullValue": "\u0000"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every column is a text."""
    return spark.read.csv(path, **CSV_READ)


def read_csv_questions(spark: SparkSession, path: str) -> DataFrame:
    """The column ``question``, or the first column without one of that name."""
    table = read_csv(spark, path)
    column = "question" if "question" in table.columns else table.columns[0]
    return table.select(F.coalesce(F.col(column), F.lit("")).alias("question"))


def read_text_questions(spark: SparkSession, path: str) -> DataFrame:
    """One question per line; blank lines are dropped. A text file is split over many tasks."""
    return spark.read.text(path).select(strip(F.col("value")).alias("question")).where(F.col("question") != "")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a file or folder, by the ending of its name."""
    if path.endswith(".json"):
        return read_json_questions(spark, path).select("question")
    if path.endswith(".csv"):
        return read_csv_questions(spark, path)
    return read_text_questions(spark, path)

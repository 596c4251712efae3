"""Data set work: profiles, selections, unions, deduplication and synthetic problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.answers import result_check
from rewardloom.functions.extract import substitute, tag_content, variables
from rewardloom.functions.prompts import chat_prompt


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n_rows"))


def schema_rows(df: DataFrame) -> DataFrame:
    """Columns and types of a table as rows."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, column_type string")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of each column, all columns in one pass, most frequent first."""
    fields = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]
    counts = df.select(F.inline(F.array(*fields))).groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.orderBy("field", F.desc("n"), "value")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in a total order."""
    return df.orderBy(*order).limit(n)


def spot_check(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One row that looks random and is the same for the same seed."""
    hashed = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return df.orderBy(hashed, key).limit(1)


def latest_run(df: DataFrame, model: str = "model", run: str = "run", started: str = "started_at") -> DataFrame:
    """The newest run of each model; equal start times are decided by the run's name."""
    return df.groupBy(model).agg(F.max(F.struct(started, run)).alias("m")).select(
        model, F.col(f"m.{run}").alias("latest_run"), F.col(f"m.{started}").alias(started)
    )


def union_splits(**splits: DataFrame) -> DataFrame:
    marked = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    return reduce(lambda a, b: a.unionByName(b), marked)


def union_logs(*logs: DataFrame) -> DataFrame:
    """Logs of several runs under each other; columns a log does not have stay empty."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def undeclared(logged: DataFrame, declared: DataFrame, name: str = "reward_name") -> DataFrame:
    """Names that were logged but never declared."""
    return logged.select(name).distinct().join(declared, name, "left_anti")


def step_plan(df: DataFrame, batch: int, accumulation: int, epochs: int) -> DataFrame:
    return df.agg((F.floor(F.count("*") / (batch * accumulation)) * epochs).cast("bigint").alias("steps"))


def success_rates(df: DataFrame, source: str = "source", valid: str = "is_valid") -> DataFrame:
    """Valid and attempted verifications per source and in total (``source`` NULL)."""
    return df.rollup(source).agg(
        F.count_if(F.col(valid)).alias("valid"),
        F.count("*").alias("attempted"),
        F.avg(F.col(valid).cast("int")).alias("success_rate"),
    )


def synthetic_attempts(responses: DataFrame) -> DataFrame:
    """Parse generated variants: ``response`` with tagged problem, values and answer, ``execution_steps`` to adapt.

    ``calculated`` is the result the adapted steps gave where they were run; no generated code is executed here.
    """
    parsed = responses.withColumns({
        "question": tag_content(F.col("response"), "synthetic_problem"),
        "answer": tag_content(F.col("response"), "expected_answer"),
        "variable_mapping": variables(
            F.coalesce(tag_content(F.col("response"), "new_variable_values"), F.lit(""))
        ),
    })
    return parsed.withColumns({
        "adapted_steps": substitute(F.col("execution_steps"), F.col("variable_mapping")),
        "check": result_check(F.col("calculated"), F.col("answer")),
    })


def synthetic_problems(attempts: DataFrame, question_id: Column, equation: Column) -> DataFrame:
    """Rows of the synthetic data set: the attempts that passed their check."""
    return attempts.where(F.col("check.is_valid")).select(
        "question",
        "answer",
        chat_prompt(F.col("question")).alias("prompt"),
        question_id.alias("original_question_id"),
        equation.alias("original_equation"),
        "variable_mapping",
        F.lit(1.0).alias("verification_score"),
    )

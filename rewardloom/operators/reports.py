"""Evaluation rows, validation reports and run comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.functions.answers import matches_expected, near
from rewardloom.functions.extract import last_number, validation_answer
from rewardloom.functions.formats import malformed
from rewardloom.functions.text import has_all, n_words, py_float
from rewardloom.operators.keys import join_on
from rewardloom.profiles import V2, Profile

MAX_ERRORS = 10
EXAMPLES = 5


def evaluated(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Numeric evaluation of each generation: the last number of the output against the truth."""
    rows = df.withColumns({
        "true_answer": py_float(F.col("answer")),
        "predicted_answer": last_number(F.col("model_output")),
    })
    return rows.withColumn("is_correct", near(F.col("predicted_answer"), F.col("true_answer"), tolerance))


def accuracy(df: DataFrame, keys: list[str] = (), correct: str = "is_correct") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(F.col(correct)).alias("correct"),
        F.count("*").alias("total"),
        F.coalesce(F.avg(F.col(correct).cast("int")), F.lit(0.0)).alias("accuracy"),
    )


def validated(df: DataFrame, p: Profile = V2) -> DataFrame:
    """Validation rows: ``input, expected, output`` in, the extracted answer and its correctness out.

    Rows without input are skipped. A NULL output is a generation that failed: it is an error but not a result.
    """
    rows = df.where(F.length("input") > 0).withColumn("model_answer", validation_answer(F.col("output"), p))
    return rows.withColumn(
        "is_correct",
        F.when(F.col("output").isNotNull(), matches_expected(F.col("model_answer"), F.col("expected"))),
    )


def format_issues(df: DataFrame, keys: list[str] = (), p: Profile = V2) -> DataFrame:
    """Format problems among the wrong rows of :func:`validated`."""
    return df.where(~F.coalesce("is_correct", F.lit(False))).groupBy(*keys).agg(*_issues(p))


def _issues(p: Profile, wrong: Column | None = None) -> list[Column]:
    out = F.coalesce(F.col("output"), F.lit(""))
    wrong = F.lit(True) if wrong is None else wrong
    return [
        F.count_if(wrong & ~has_all(out, p.thought_open, p.thought_close)).alias("missing_reasoning_tag"),
        F.count_if(wrong & ~has_all(out, p.answer_open, p.answer_close)).alias("missing_answer_tag"),
        F.count_if(wrong & malformed(out)).alias("malformed_tags"),
    ]


def validation_report(
    df: DataFrame, order: str, max_errors: int = MAX_ERRORS, p: Profile = V2, keys: list[str] = ()
) -> DataFrame:
    """Per group (or in one row): accuracy, counts, the first errors, mean time and length, format problems.

    Every task keeps the first errors of a group only, so a group of any size sends few of them.
    """
    rows, keys = validated(df, p), list(keys)
    wrong = ~F.coalesce("is_correct", F.lit(False))
    seconds = F.avg("generation_time") if "generation_time" in df.columns else F.lit(None).cast("double")
    report = rows.groupBy(*keys).agg(
        F.count_if(F.col("is_correct")).alias("correct"),
        F.count("is_correct").alias("total"),
        F.coalesce(F.avg(F.col("is_correct").cast("int")), F.lit(0.0)).alias("accuracy"),
        F.coalesce(seconds, F.lit(0.0)).alias("avg_generation_time"),
        F.coalesce(F.avg(F.when(F.col("output").isNotNull(), n_words(F.col("output")))), F.lit(0.0)).alias(
            "avg_output_length"
        ),
        *_issues(p, wrong),
    )
    error = F.struct(order, "input", "expected", "output", F.col("model_answer").alias("answer"))
    if not keys:
        first = rows.where(wrong).orderBy(order).limit(max_errors)
        return report.withColumn("errors", first.agg(F.sort_array(F.collect_list(error)).alias("errors")).scalar())
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    first = rows.where(wrong).withColumn("__at", place).where(F.col("__at") <= max_errors)
    errors = first.groupBy(*keys).agg(F.sort_array(F.collect_list(error)).alias("errors"))
    joined = join_on(report, errors, keys, "left")
    return joined.withColumn("errors", F.coalesce("errors", F.array().cast(errors.schema["errors"].dataType)))


def sample_flags(df: DataFrame, order: str, p: Profile = V2) -> DataFrame:
    """What each validation sample adds to a report: ``is_correct``, its time, words and format problems, and, if it is wrong, the
    ``error`` with its texts. Other columns stay but ``input``, ``expected`` and ``output``."""
    rows = validated(df, p)
    wrong, out = ~F.coalesce("is_correct", F.lit(False)), F.coalesce(F.col("output"), F.lit(""))
    seconds = F.col("generation_time").cast("double") if "generation_time" in df.columns else F.lit(None).cast("double")
    error = F.struct(order, "input", "expected", "output", F.col("model_answer").alias("answer"))
    return rows.select(
        *[c for c in df.columns if c not in ("input", "expected", "output", "generation_time")], "is_correct",
        seconds.alias("seconds"), F.when(F.col("output").isNotNull(), n_words(F.col("output"))).alias("words"),
        (wrong & ~has_all(out, p.thought_open, p.thought_close)).alias("missing_reasoning_tag"),
        (wrong & ~has_all(out, p.answer_open, p.answer_close)).alias("missing_answer_tag"),
        (wrong & malformed(out)).alias("malformed_tags"), F.when(wrong, F.to_json(error, {"ignoreNullFields": "false"})).alias("error"),
    )


def run_comparison(df: DataFrame, base: str, tuned: str, run: str = "run") -> DataFrame:
    """Accuracy of two runs over evaluated rows, the improvement and the number of examples."""

    def share(name: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col(run) == name, F.col("is_correct").cast("int"))), F.lit(0.0))

    both = df.where(F.col(run).isin(base, tuned)).agg(
        share(base).alias("base_model_accuracy"),
        share(tuned).alias("tuned_model_accuracy"),
        F.count_if(F.col(run) == base).alias("number_of_examples"),
    )
    return both.withColumn("accuracy_improvement", F.col("tuned_model_accuracy") - F.col("base_model_accuracy"))


def side_by_side(df: DataFrame, base: str, tuned: str, key: str = "sample_id", run: str = "run") -> DataFrame:
    """Each question with the result of both runs; questions of one run only are kept."""
    fields = ("question", "true_answer", "model_output", "predicted_answer", "is_correct")

    def of(name: str, prefix: str) -> DataFrame:
        return df.where(F.col(run) == name).select(key, *[F.col(f).alias(f"{prefix}_{f}") for f in fields])

    joined = of(base, "base").join(of(tuned, "tuned"), key, "full")
    return joined.select(
        key,
        F.coalesce("base_question", "tuned_question").alias("question"),
        F.coalesce("base_true_answer", "tuned_true_answer").alias("true_answer"),
        *[
            F.col(f"{prefix}_{field}").alias(f"{prefix}_model_{name}")
            for prefix in ("base", "tuned")
            for field, name in (("model_output", "output"), ("predicted_answer", "answer"), ("is_correct", "correct"))
        ],
    )


def comparison_report(
    df: DataFrame, base: str, tuned: str, timestamp: Column, key: str = "sample_id", examples: int = EXAMPLES
) -> DataFrame:
    """One row with the comparison and the first examples side by side."""
    # The first keys are found alone, so that no model output is shuffled to be compared and thrown away.
    keys = df.where(F.col("run").isin(base, tuned)).select(key).distinct().orderBy(key).limit(examples)
    first = side_by_side(df.join(F.broadcast(keys), key, "left_semi"), base, tuned, key)
    listed = first.agg(F.sort_array(F.collect_list(F.struct(*first.columns))))
    return run_comparison(df, base, tuned).select(
        timestamp.alias("timestamp"),
        "base_model_accuracy",
        "tuned_model_accuracy",
        "accuracy_improvement",
        "number_of_examples",
        listed.scalar().alias("example_comparisons"),
    )


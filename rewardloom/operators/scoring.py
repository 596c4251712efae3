"""The scoring job: all rewards of a generation table in one pass, wide or long."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import answers, extract, formats, relevance, repetition
from rewardloom.profiles import V2, Profile
from rewardloom.schemas import REWARDS

Reward = Callable[[DataFrame, Profile], Column]


def _text() -> Column:
    return F.coalesce(F.col("model_output"), F.lit(""))


BUILT_IN: dict[str, Reward] = {
    "correctness": lambda df, p: answers.correctness(_text(), F.col("answer"), p),
    "integer": lambda df, p: answers.integer_answer(_text(), p),
    "strict_format": lambda df, p: formats.strict_format(_text(), p),
    "soft_format": lambda df, p: formats.soft_format(_text(), p),
    "tag_count": lambda df, p: formats.tag_count(_text(), p),
    "anti_repetition": lambda df, p: repetition.anti_repetition(_text(), p),
    "topic_relevance": lambda df, p: relevance.topic_relevance(
        F.coalesce(F.col("question"), F.lit("")), _text(), p
    ),
    "exact_format": lambda df, p: formats.exact_format(_text(), p),
    "approximate_format": lambda df, p: formats.approximate_format(_text(), p),
    "graded_answer": lambda df, p: answers.graded_answer(_text(), F.col("answer"), p),
    "numeric_answer": lambda df, p: answers.numeric_equality(_text(), F.col("answer"), p),
}


class Rewards:
    """Named rewards in the order they are reported. Add your own as a column expression or a pandas UDF."""

    def __init__(self, names: tuple[str, ...] = REWARDS):
        self.functions: dict[str, Reward] = {n: BUILT_IN[n] for n in names}
        self.tables: list[tuple[tuple[str, ...], Callable[..., object], tuple[str, ...]]] = []

    def register(self, name: str, reward: Reward) -> "Rewards":
        """``reward(df, profile)`` returns a DOUBLE column; other columns of the table are its extra inputs."""
        self.functions[name] = reward
        return self

    def register_table(self, names: tuple[str, ...], function: Callable[..., object], inputs: tuple[str, ...]) -> "Rewards":
        """``function`` is a table function that gives one row with the rewards ``names`` for the columns ``inputs`` of each row: for
        rewards that share work no expression can do, in one pass of Python over Arrow batches."""
        self.tables.append((names, function, inputs))
        return self

    def columns(self, df: DataFrame, profile: Profile) -> dict[str, Column]:
        return {name: f(df, profile).cast("double") for name, f in self.functions.items()}


def total_reward(names) -> Column:
    total = F.lit(0.0)
    for name in names:
        total = total + F.coalesce(F.col(name), F.lit(0.0))
    return total


def score(df: DataFrame, rewards: Rewards | None = None, profile: Profile = V2) -> DataFrame:
    """Add one column per reward and ``total_reward``. A narrow job: no shuffle, one pass over the text."""
    rewards = rewards or Rewards()
    columns = rewards.columns(df, profile)
    scored, names = df.withColumns(columns), list(columns)
    for given, function, inputs in rewards.tables:
        scored = scored.lateralJoin(function(*[F.col(c).outer() for c in inputs]))
        scored = scored.withColumns({name: F.col(name).cast("double") for name in given})
        names += given
    return scored.withColumn("total_reward", total_reward(names))


def to_long(df: DataFrame, names=REWARDS, keys=("run", "step", "sample_id")) -> DataFrame:
    """One row per reward value."""
    return df.unpivot([F.col(k) for k in keys], [F.col(n) for n in names], "reward_name", "value")


def to_wide(df: DataFrame, names=REWARDS, keys=("run", "step", "sample_id")) -> DataFrame:
    """Reward columns again; the names are given, so no extra pass looks for them."""
    return df.groupBy(*keys).pivot("reward_name", list(names)).agg(F.first("value", ignorenulls=True))


def flags(df: DataFrame, profile: Profile = V2) -> DataFrame:
    """Per-sample flags beside the rewards of :func:`score`."""
    text = _text()
    extracted = extract.model_answer(text, profile)
    return df.withColumns({
        "is_correct": F.col("correctness") > 0,
        "is_integer": answers.is_digits(extracted),
        "format_correct": F.col("strict_format") > 0,
        "soft_format_correct": F.col("soft_format") > 0,
        "output_chars": F.length(text).cast("bigint"),
        "is_balanced": formats.tags_balanced(text, profile),
        "has_penalty": F.col("anti_repetition") < 0,
        "is_relevant": F.col("topic_relevance") > 0.5,
    })


def generation_log(df: DataFrame, day: Column, source: str = "training", profile: Profile = V2) -> DataFrame:
    """Rows of the wide generation log, scored; ``day`` is a parameter so that re-runs give equal ids."""
    text = _text()
    thought, model_answer = extract.thought_and_answer(text, profile)
    truth = F.coalesce(F.col("answer"), F.lit(""))
    scored = score(df, profile=profile)
    return scored.select(
        "run",
        F.to_timestamp(day).alias("timestamp"),
        F.col("step").alias("global_step"),
        extract.question_id(F.col("question"), truth, source, day).alias("question_id"),
        "question",
        truth.alias("ground_truth_answer"),
        text.alias("model_output"),
        thought.alias("reasoning"),
        model_answer.alias("model_answer"),
        "total_reward",
        *REWARDS,
    )


"""Pairings of generations with truths, rewards, questions and other runs, all keyed by sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.functions.relevance import term_vector, vector_similarity
from rewardloom.functions.text import let, sentences
from rewardloom.operators.scoring import to_wide
from rewardloom.profiles import V2, Profile
from rewardloom.schemas import REWARDS


def with_truth(generations: DataFrame, truths: DataFrame, key: str = "sample_id") -> DataFrame:
    """Completions paired with truths; samples missing on either side end with the pairing."""
    return generations.join(truths, key, "inner")


def with_rewards(
    generations: DataFrame, long_rewards: DataFrame, names=REWARDS, keys=("run", "step", "sample_id")
) -> DataFrame:
    """Generations with their rewards side by side; a generation without rewards keeps empty reward columns.

    The wide rewards already lie by the keys of the join, so only the generations are shuffled for it.
    """
    return generations.join(to_wide(long_rewards, names, keys), list(keys), "left")


def by_question(questions: DataFrame, truths: DataFrame, outputs: DataFrame, key: str = "sample_id") -> DataFrame:
    """Questions that have an output, with the truth or '' if there is none."""
    joined = questions.join(outputs, key, "inner").join(truths, key, "left")
    return joined.withColumn("true_answer", F.coalesce("true_answer", F.lit("")))


def question_sentence_pairs(
    df: DataFrame, question: str, text: str, key: str, p: Profile = V2
) -> DataFrame:
    """One row per sentence with its position, its own question and the sentence before it."""
    listed = df.select(key, question, sentences(F.col(text), p.sentence_pattern).alias("s"))
    exploded = listed.select(key, question, "s", F.posexplode("s").alias("pos", "sentence"))
    # The previous sentence lies in the same row, so no window and no shuffle is needed to find it.
    return exploded.select(
        key,
        F.col("pos").cast("bigint").alias("pos"),
        F.col(question).alias("question"),
        "sentence",
        F.when(F.col("pos") > 0, F.get("s", F.col("pos") - 1)).alias("previous"),
    )


def pair_similarities(pairs: DataFrame, p: Profile = V2) -> DataFrame:
    """Similarity of every sentence with its question and with the sentence before (NULL for the first)."""

    def both(v: Column) -> Column:
        def against(other: Column) -> Column:
            return let(term_vector(other, p), lambda u: vector_similarity(u, v, p))

        return F.struct(
            against(F.col("question")).alias("to_question"),
            F.when(F.col("previous").isNotNull(), against(F.col("previous"))).alias("to_previous"),
        )

    return pairs.withColumn("sim", let(term_vector(F.col("sentence"), p), both)).select(
        *pairs.columns, "sim.to_question", "sim.to_previous"
    )


def with_single_prompt(df: DataFrame, prompts: DataFrame, prompt: str = "question") -> DataFrame:
    """Pair every row with the only prompt there is, as a scalar; a second prompt is an error."""
    return df.withColumn(prompt, prompts.select(prompt).scalar())


def with_prompts(
    df: DataFrame, prompts: DataFrame, at: str = "pos", prompt: str = "question"
) -> DataFrame:
    """Pair every row with the prompt at its position ``at``, or with the first prompt if there is none there."""
    first = prompts.agg(F.min_by(prompt, at).alias(prompt)).scalar()
    own = prompts.select(at, F.col(prompt).alias("__own"))
    return df.join(own, at, "left").withColumn(prompt, F.coalesce("__own", first)).drop("__own")


def with_equations(problems: DataFrame, equations: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Problems with the cached equation of their source; of several the first by ``order`` is taken."""
    fields = [c for c in equations.columns if c != key]
    # min_by keeps one row per key in every task before the shuffle; no key is gathered.
    first = equations.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("e"))
    return problems.join(first.select(key, "e.*"), key, "left")


def latest_valid(attempts: DataFrame, key: str, attempt: str = "attempt", max_attempts: int = 3) -> DataFrame:
    """The last valid one of at most ``max_attempts`` attempts per problem."""
    fields = [c for c in attempts.columns if c != key]
    usable = attempts.where((F.col(attempt) <= max_attempts) & F.col("is_valid"))
    return usable.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(attempt)).alias("a")).select(key, "a.*")


def retry_set(problems: DataFrame, attempts: DataFrame, key: str, max_attempts: int = 3) -> DataFrame:
    """Problems without a valid attempt."""
    valid = attempts.where((F.col("attempt") <= max_attempts) & F.col("is_valid"))
    return problems.join(valid, key, "left_anti")


def duplicates(df: DataFrame, keys: list[str] = ("question_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def previous_sentence(df: DataFrame, key: str, order: str, sentence: str = "sentence") -> DataFrame:
    """The sentence before, for sentences that are already rows of a table."""
    return df.withColumn("previous", F.lag(sentence).over(Window.partitionBy(key).orderBy(order)))

"""Hook for batch generation: prompts in, full responses out. The model itself is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.functions.prompts import strip_prompt
from rewardloom.profiles import V2

# (prompts, questions) of one Arrow batch -> replies without the prompt.
Generator = Callable[[pd.Series, pd.Series], pd.Series]


def fixed_reply(prompts: pd.Series, questions: pd.Series) -> pd.Series:
    """The reply tests use in place of a model."""
    return V2.thought_open + "Thinking about " + questions + V2.thought_close + "\n<answer>42</answer>"


def generate(df: DataFrame, model: Generator, prompt: str = "prompt", question: str = "question") -> DataFrame:
    """Add ``full_response`` and ``model_output``; ``model`` is given one Arrow batch at a time."""
    schema = T.StructType([*df.schema.fields, T.StructField("full_response", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(full_response=rows[prompt] + model(rows[prompt], rows[question]))

    answered = df.mapInPandas(run, schema)
    return answered.withColumn("model_output", strip_prompt(F.col("full_response"), F.col(prompt)))

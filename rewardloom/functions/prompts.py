"""Prompt columns: chat messages, their rendering, templates, truncation and log names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.text import words
from rewardloom.profiles import SYSTEM_PROMPT, V2

THOUGHT_CUE = V2.thought_open
# A neutral rendering; the real one belongs to a tokenizer and is passed in.
MESSAGE_TEMPLATE = "<start_of_turn>{role}\n{content}<end_of_turn>\n"
END_MARKER = "<eos>"
MAX_TOKENS = 1024


def _message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def chat_prompt(question: Column, system: str = SYSTEM_PROMPT) -> Column:
    return F.array(_message(F.lit("system"), F.lit(system)), _message(F.lit("user"), question))


def fill(template: str, **fields: Column) -> Column:
    """Put columns into the ``{name}`` places of a template."""
    pieces, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(before), F.coalesce(fields[name], F.lit(""))]
    return F.concat(*pieces, F.lit(rest))


def render_message(role: Column, content: Column, template: str = MESSAGE_TEMPLATE) -> Column:
    return fill(template, role=role, content=content)


def render_messages(messages: Column, template: str = MESSAGE_TEMPLATE, end: str = END_MARKER) -> Column:
    turns = F.transform(messages, lambda m: render_message(m["role"], m["content"], template))
    return F.concat(F.array_join(turns, ""), F.lit(end))


def with_thought_cue(prompt: Column) -> Column:
    return F.concat(prompt, F.lit(THOUGHT_CUE))


def strip_prompt(full: Column, prompt: Column) -> Column:
    return F.substr(full, F.length(prompt) + 1)


def truncated_tokens(text: Column, limit: int = MAX_TOKENS, tokenizer=words) -> Column:
    """At most ``limit`` tokens; ``tokenizer`` maps a text column to an array column."""
    return F.slice(tokenizer(text), 1, limit)


def question_of(prompt: Column) -> Column:
    """The content of the last message."""
    return F.element_at(prompt, -1)["content"]


def normalised_completion(df: DataFrame, column: str = "completion") -> Column:
    """A plain text, or a list of messages whose first one holds the text."""
    if df.schema[column].dataType.typeName() == "array":
        return F.get(F.col(column), F.lit(0))["content"]
    return F.col(column)


# Names and order of fall-back of validation samples.
INPUT_FIELDS = ("question", "input", "prompt")
EXPECTED_FIELDS = ("answer", "output", "target")


def first_present(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first field that is there (an empty text counts as there); '' without any."""
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(""))


# Names in the generation log.
LOG_NAMES = {"true_answer": "ground_truth_answer", "answer": "model_answer", "step": "global_step"}


def to_log_schema(df: DataFrame) -> DataFrame:
    renamed = df.withColumnsRenamed(LOG_NAMES)
    texts = [n for n in ("ground_truth_answer", "reasoning", "model_answer") if n in renamed.columns]
    return renamed.withColumns({n: F.coalesce(n, F.lit("")) for n in texts})

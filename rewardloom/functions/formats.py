"""Format rewards: do the tags occur, how often, and what trails behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions.extract import custom_format
from rewardloom.functions.text import BLANK_CLASS, count_is_one, has_all, literal_pattern
from rewardloom.profiles import THOUGHT_TAG, V2, Profile


def _scored(condition: Column, weight: float) -> Column:
    return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))


# The anchored layouts, with the profile's tags in the places of the braces.
STRICT_LAYOUT = "(?d)^{}\\n.*?\\n{}\\n{}\\n.*?\\n{}\\n$"
SOFT_LAYOUT = "(?d)^{}.*?{}[" + BLANK_CLASS + "]*{}.*?{}"


def strict_format(text: Column, p: Profile = V2) -> Column:
    if p.anchored_formats:
        return _scored(text.rlike(STRICT_LAYOUT.format(*map(literal_pattern, p.tags))), p.strict_format)
    return _scored(has_all(text, *p.tags), p.strict_format)


def soft_format(text: Column, p: Profile = V2) -> Column:
    if p.anchored_formats:
        return _scored(text.rlike(SOFT_LAYOUT.format(*map(literal_pattern, p.tags))), p.soft_format)
    return _scored(has_all(text, p.thought_open, p.thought_close), p.soft_format)


def tag_count(text: Column, p: Profile = V2) -> Column:
    """A share per well-placed tag, less a little for every character behind the end."""

    def trailing(end: str) -> Column:
        # Splits go from left to right, which matters where two ends share a line break.
        return F.length(F.element_at(F.split(text, literal_pattern(end)), -1))

    opened = count_is_one(text, f"\n{p.answer_open}\n")
    closed = count_is_one(text, f"\n{p.answer_close}")
    return (
        _scored(count_is_one(text, f"{p.thought_open}\n"), p.tag_weight)
        + _scored(count_is_one(text, f"\n{p.thought_close}\n"), p.tag_weight)
        + F.when(opened, p.tag_weight - trailing(f"\n{p.answer_close}\n") * p.trailing_char).otherwise(0.0)
        + F.when(closed, p.tag_weight - (trailing(f"\n{p.answer_close}") - 1) * p.trailing_char).otherwise(0.0)
    )


def tags_balanced(text: Column, p: Profile = V2) -> Column:
    result = F.lit(True)
    for tag in p.tags:
        result = result & count_is_one(text, tag)
    return result


def exact_format(text: Column, p: Profile) -> Column:
    return _scored(text.rlike(custom_format(p)), p.exact_format)


def approximate_format(text: Column, p: Profile) -> Column:
    total = F.lit(0.0)
    for tag in p.tags:
        total = total + F.when(count_is_one(text, tag), p.marker).otherwise(-p.marker)
    return total


# Fixed value: the layout that counts as followed.
ADHERENCE = rf"<{THOUGHT_TAG}>.*?</{THOUGHT_TAG}>.*?<answer>.*?</answer>"


def adheres(text: Column, pattern: str = ADHERENCE) -> Column:
    """The layout is found somewhere in the text; a dot in ``pattern`` also stands for a line break."""
    return text.rlike("(?s)" + pattern)


# A tag that is opened and never closed, or closed and never opened.
UNCLOSED = rf"<({THOUGHT_TAG}|answer)[^>]*>[^<]*\z"
UNOPENED = rf"^[^<]*</({THOUGHT_TAG}|answer)>"


def malformed(text: Column) -> Column:
    return text.rlike(UNCLOSED) | text.rlike(UNOPENED)

"""Extraction columns: tagged answers, sections, numbers, variables, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions.text import (
    BLANK_CLASS, extract, has, has_all, let, literal_pattern, part_after, strip,
)
from rewardloom.profiles import V2, Profile


def tagged_answer(text: Column, p: Profile = V2) -> Column:
    """After the last opening tag, before the next closing tag; without tags the whole text."""
    tail = F.substring_index(text, p.answer_open, -1)
    return strip(F.substring_index(tail, p.answer_close, 1))


# The untagged answer forms, tried in this order.
FINAL_ANSWER = r"(?d)Final Answer:.*?(\p{Nd}+)"
BOXED = r"\$\\boxed\{(\p{Nd}+)\}\$"
LABELLED = r"(?diu)(?:\*\*)?(?:answer|solution)(?:\*\*)?:.*?(\p{Nd}+(?:\.\p{Nd}+)?)"


def answer_with_fallbacks(text: Column, p: Profile = V2) -> Column:
    def first(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    plain = tagged_answer(text, p)
    return (
        F.when(has_all(text, p.answer_open, p.answer_close), plain)
        .otherwise(F.coalesce(first(FINAL_ANSWER), first(BOXED), first(LABELLED), plain))
    )


def model_answer(text: Column, p: Profile = V2) -> Column:
    return answer_with_fallbacks(text, p) if p.answer_fallbacks else tagged_answer(text, p)


def first_between(text: Column, opening: str, closing: str) -> Column:
    """Trimmed text of the first pair of tags, NULL without one."""
    pattern = f"(?s){literal_pattern(opening)}(.*?){literal_pattern(closing)}"
    return strip(extract(text, pattern))


def tag_content(text: Column, tag: str) -> Column:
    return first_between(text, f"<{tag}>", f"</{tag}>")


def thought_and_answer(text: Column, p: Profile = V2) -> tuple[Column, Column]:
    thought = first_between(text, p.thought_open, p.thought_close)
    answer = first_between(text, p.answer_open, p.answer_close)
    return F.coalesce(thought, F.lit("")), F.coalesce(answer, F.lit(""))


def sections(text: Column, p: Profile = V2) -> tuple[Column, Column, Column]:
    """Thought, answer and what follows the answer, each '' when its tags are missing."""

    def section(opening: str, closing: str) -> Column:
        inside = F.substring_index(part_after(text, opening, 1), closing, 1)
        return F.when(has_all(text, opening, closing), strip(inside)).otherwise("")

    post = F.when(has(text, p.answer_close), strip(part_after(text, p.answer_close, 1))).otherwise("")
    return section(p.thought_open, p.thought_close), section(p.answer_open, p.answer_close), post


def hash_answer(answer: Column) -> Column:
    """Between the first and second '####'; NULL without one."""
    return F.when(has(answer, "####"), strip(part_after(answer, "####", 1)))


NUMBER = r"\p{Nd}+\.?\p{Nd}*"


def last_number(text: Column) -> Column:
    """The last unsigned number, NULL without one. Signs and thousands commas are not part of a number."""
    return let(
        F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)),
        lambda found: F.try_element_at(found, F.lit(-1)).try_cast("double"),
    )


def validation_answer(output: Column, p: Profile = V2) -> Column:
    return F.coalesce(first_between(output, p.answer_open, p.answer_close), strip(output))


def custom_format(p: Profile) -> str:
    """The whole layout with the profile's tags, from a line start to a line end."""
    ro, rc, ao, ac = map(literal_pattern, p.tags)
    blank = f"[{BLANK_CLASS}]*"
    return f"(?msd)^{blank}{ro}.+?{rc}.*?{ao}(.+?){ac}{blank}$"


def custom_answer(text: Column, p: Profile) -> Column:
    return extract(text, custom_format(p))


def first_number_after(text: Column, tag: str) -> Column:
    return extract(text, f"(?s){literal_pattern(tag)}.*?([\\p{{Nd}}.]+)")


def variables(text: Column) -> Column:
    """``name: value`` or ``name = value`` lines as a map; the last line of a name wins, in first-seen order."""
    lines = F.filter(F.split(strip(text), "\n"), lambda line: line.contains(":") | line.contains("="))

    def entry(line: Column) -> Column:
        at = F.when(line.contains(":"), F.locate(":", line)).otherwise(F.locate("=", line))
        return F.struct(
            strip(F.substr(line, F.lit(1), at - 1)).alias("key"),
            strip(F.substr(line, at + 1)).alias("value"),
        )

    return let(
        F.transform(lines, entry),
        lambda pairs: F.map_from_entries(
            F.transform(
                F.array_distinct(F.transform(pairs, lambda e: e["key"])),
                lambda key: F.struct(
                    key.alias("key"),
                    F.element_at(F.filter(pairs, lambda e: e["key"] == key), -1)["value"].alias("value"),
                ),
            )
        ),
    )


def substitute(text: Column, values: Column) -> Column:
    """Put each variable's new value into its first assignment in ``text``."""

    def one(acc: Column, entry: Column) -> Column:
        name = F.regexp_replace(entry["key"], r"([\\.\[\]{}()*+?^$|])", r"\\$1")
        assignment = F.concat(
            F.lit("(?s)^(.*?)"), name, F.lit(f"[{BLANK_CLASS}]*=[{BLANK_CLASS}]*(?:[0-9.]+|[\\p{{L}}\\p{{N}}_]+)")
        )
        value = F.regexp_replace(entry["value"], r"([\\$])", r"\\$1")
        return F.regexp_replace(acc, assignment, F.concat(F.lit("$1"), entry["key"], F.lit(" = "), value))

    return F.aggregate(F.map_entries(values), text, one)


def question_id(question: Column, answer: Column, source: str, day: Column) -> Column:
    digest = F.md5(F.concat(question, F.coalesce(answer, F.lit(""))))
    return F.concat_ws("_", F.lit(source), F.date_format(day, "yyyyMMdd"), F.substring(digest, 1, 12))


def trial_id(stamp: Column, index: Column) -> Column:
    """Id of a row of a test run."""
    return F.concat(F.lit("test_run_"), stamp.cast("string"), F.lit("_sample_"), index.cast("string"))


def response_parts(parts: Column) -> tuple[Column, Column]:
    """Split ``array<struct<thought, text>>`` into thoughts and answer text."""

    def joined(flag: bool) -> Column:
        keep = F.filter(parts, lambda part: F.coalesce(part["thought"], F.lit(False)) == F.lit(flag))
        return F.array_join(F.transform(keep, lambda part: part["text"]), "")

    return joined(True), joined(False)


def fenced_payload(response: Column) -> Column:
    """Text inside a leading code fence, up to the last fence; unfenced text as it is."""
    inside = F.regexp_extract(response, r"(?s)^```[^\n]*\n(.*)```", 1)
    return F.when(response.startswith("```"), strip(inside)).otherwise(response)

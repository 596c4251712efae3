"""Queries of prompt building and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import extract as x
from rewardloom.functions import prompts as p
from rewardloom.functions.answers import is_digits
from rewardloom.functions.formats import tags_balanced
from rewardloom.operators.scoring import flags, score
from rewardloom.plans import sql as q
from rewardloom.plans.fixtures import Tables
from rewardloom.plans.registry import query
from rewardloom.plans.sources_queries import RENDERED
from rewardloom.profiles import SOLUTION_TAGS, SYSTEM_PROMPT, THOUGHT_TAG


def output() -> Column:
    return F.col("model_output")


KEY = ("run", "sample_id")


@query("p1_chat_prompt", f"""
select sample_id, 'system' as role_1, {q.lit(SYSTEM_PROMPT)} as content_1, 'user' as role_2, question as content_2
from turns""")
def p1(t: Tables) -> DataFrame:
    prompt = p.chat_prompt(F.col("question"))
    return t.turns.select("sample_id", prompt.alias("m")).select(
        "sample_id", F.col("m")[0]["role"].alias("role_1"), F.col("m")[0]["content"].alias("content_1"),
        F.col("m")[1]["role"].alias("role_2"), F.col("m")[1]["content"].alias("content_2"),
    )


@query("p2_render_messages", """
select conv_id, concat(string_agg(concat('<start_of_turn>', role, chr(10), text, '<end_of_turn>', chr(10)), '' order by turn),
  '<eos>') as text from conversations group by conv_id""")
def p2(t: Tables) -> DataFrame:
    """Conversations as texts: one text each, however long, as the text is the result."""
    pieces = t.conversations.select(
        "conv_id", "turn",
        p.render_message(F.col("role"), F.col("text")).alias("piece"),
    )
    bodies = pieces.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "piece"))), lambda m: m["piece"]), "")
        .alias("body")
    )
    return bodies.select("conv_id", F.concat("body", F.lit(p.END_MARKER)).alias("text"))


@query("p3_thought_cue", f"select sample_id, concat(question, '{q.OPEN}') as prompt from turns")
def p3(t: Tables) -> DataFrame:
    return t.turns.select("sample_id", p.with_thought_cue(F.col("question")).alias("prompt"))


@query("p4_strip_prompt", "select run, sample_id, model_output as response from generations")
def p4(t: Tables) -> DataFrame:
    prompt = p.render_messages(p.chat_prompt(F.col("question")))
    full = t.generations.withColumn("prompt", prompt).withColumn("full", F.concat("prompt", "model_output"))
    return full.select(*KEY, p.strip_prompt(F.col("full"), F.col("prompt")).alias("response"))


@query("p5_token_truncation", f"""
select doc_id, cast(len(t) as integer) as n_tokens, array_to_string(t, ' ') as tokens
from (select doc_id, list_slice({q.words('text')}, 1, 1024) as t from documents)""")
def p5(t: Tables) -> DataFrame:
    cut = t.documents.select("doc_id", p.truncated_tokens(F.col("text")).alias("t"))
    return cut.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("p6_drop_columns", f"select sample_id, {RENDERED} as text from turns")
def p6(t: Tables) -> DataFrame:
    rows = t.turns.select("sample_id", F.lit(1).alias("prompt_id"), p.chat_prompt(F.col("question")).alias("messages"))
    return rows.withColumn("text", p.render_messages(F.col("messages"))).drop("messages", "prompt_id")


@query("p7_skip_empty_input", "select sample_id, model_answer as input from typed_answers where model_answer <> ''")
def p7(t: Tables) -> DataFrame:
    return t.typed_answers.select("sample_id", F.col("model_answer").alias("input")).where(F.length("input") > 0)


@query("p8_field_fallback", """
select sample_id, case when sample_id % 3 = 0 then '' when sample_id % 3 = 1 then target else category end as input,
  case when sample_id % 2 = 0 then target else '' end as expected from typed_answers""")
def p8(t: Tables) -> DataFrame:
    third, half = F.pmod("sample_id", F.lit(3)), F.pmod("sample_id", F.lit(2))
    rows = t.typed_answers.select(
        "sample_id",
        F.when(third == 0, "").alias("question"),
        F.when(third <= 1, F.col("target")).alias("input"),
        F.col("category").alias("prompt"),
        F.when(half == 0, F.col("target")).alias("output"),
    )
    return rows.select(
        "sample_id", p.first_present(rows, p.INPUT_FIELDS).alias("input"),
        p.first_present(rows, p.EXPECTED_FIELDS).alias("expected"),
    )


@query("p9_normalise_completion", "select run, sample_id, model_output from generations")
def p9(t: Tables) -> DataFrame:
    nested = t.generations.where("run = 'base'").withColumn(
        "completion", F.array(F.struct(F.lit("assistant").alias("role"), F.col("model_output").alias("content")))
    )
    plain = t.generations.where("run = 'tuned'").withColumn("completion", output())
    return nested.select(*KEY, p.normalised_completion(nested).alias("model_output")).unionByName(
        plain.select(*KEY, p.normalised_completion(plain).alias("model_output"))
    )


@query("p10_prompt_template", """
select conv_id, turn, concat('Context: ', coalesce(lag(text) over (partition by conv_id order by turn), ''),
  chr(10), 'Message: ', text, chr(10), 'Protocol: be kind') as prompt from conversations""")
def p10(t: Tables) -> DataFrame:
    # The turn before is found by an equi-join on (conversation, turn), which spreads even a very long conversation.
    c = t.conversations.select("conv_id", "turn", "text")
    previous = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    template = "Context: {context}\nMessage: {message}\nProtocol: {protocol}"
    prompt = p.fill(template, context=F.col("context"), message=F.col("text"), protocol=F.lit("be kind"))
    return c.join(previous, ["conv_id", "turn"], "left").select("conv_id", "turn", prompt.alias("prompt"))


@query("p11_log_schema", """
select sample_id as global_step, target as ground_truth_answer, model_answer, '' as reasoning from typed_answers""")
def p11(t: Tables) -> DataFrame:
    rows = t.typed_answers.select(
        F.col("sample_id").alias("step"), F.col("target").alias("true_answer"),
        F.when(F.col("model_answer") != "", F.col("model_answer")).alias("answer"),
        F.lit(None).cast("string").alias("reasoning"),
    )
    return p.to_log_schema(rows)


@query("x1_tagged_answer", f"select run, sample_id, {q.tagged_answer('model_output')} as answer from generations")
def x1(t: Tables) -> DataFrame:
    return t.generations.select(*KEY, x.tagged_answer(output()).alias("answer"))


@query("x2_answer_with_fallbacks", f"select run, sample_id, {q.answer('model_output')} as answer from generations")
def x2(t: Tables) -> DataFrame:
    return t.generations.select(*KEY, x.answer_with_fallbacks(output()).alias("answer"))


@query("x3_thought_and_answer", f"""
select run, sample_id, {q.first_between('model_output', q.OPEN, q.CLOSE)} as reasoning,
  {q.first_between('model_output', '<answer>', '</answer>')} as answer from generations""")
def x3(t: Tables) -> DataFrame:
    thought, answer = x.thought_and_answer(output())
    return t.generations.select(*KEY, thought.alias("reasoning"), answer.alias("answer"))


@query("x4_sections", f"""
select run, sample_id, {q.section('model_output', q.OPEN, q.CLOSE)} as reasoning,
  {q.section('model_output', '<answer>', '</answer>')} as answer, {q.post_answer('model_output')} as post
from generations""")
def x4(t: Tables) -> DataFrame:
    thought, answer, post = x.sections(output())
    return t.generations.select(*KEY, thought.alias("reasoning"), answer.alias("answer"), post.alias("post"))


HASHED = "case when sample_id % 4 = 0 then target else concat(category, ' #### ', target, case when sample_id % 4 = 2 then ' #### x' else '' end) end"


@query("x5_hash_answer", f"""
select sample_id, case when contains(a, '####') then {q.strip("string_split(a, '####')[2]")} end as answer
from (select sample_id, {HASHED} as a from typed_answers)""")
def x5(t: Tables) -> DataFrame:
    rows = t.typed_answers.select("sample_id", F.expr(HASHED).alias("a"))
    return rows.select("sample_id", x.hash_answer(F.col("a")).alias("answer"))


@query("x6_last_number", """
select sample_id, try_cast(regexp_extract_all(concat(target, ' ', model_answer), '\\d+\\.?\\d*')[-1] as double) as number
from typed_answers""")
def x6(t: Tables) -> DataFrame:
    text = F.concat_ws(" ", "target", "model_answer")
    return t.typed_answers.select("sample_id", x.last_number(text).alias("number"))


@query("x7_validation_answer", f"""
select run, sample_id, case when regexp_matches(model_output, '(?s)<answer>(.*?)</answer>')
  then {q.first_between('model_output', '<answer>', '</answer>')} else {q.strip('model_output')} end as answer
from generations""")
def x7(t: Tables) -> DataFrame:
    return t.generations.select(*KEY, x.validation_answer(output()).alias("answer"))


@query("x8_tag_content", f"""
select run, sample_id, case when regexp_matches(model_output, '(?s){q.OPEN}(.*?){q.CLOSE}')
  then {q.first_between('model_output', q.OPEN, q.CLOSE)} end as content from generations""")
def x8(t: Tables) -> DataFrame:
    return t.generations.select(*KEY, x.tag_content(output(), THOUGHT_TAG).alias("content"))


VARIABLES = (
    "concat('a: ', target, chr(10), 'b = ', category, chr(10), 'no value', chr(10), 'a: ', answer_type, chr(10),"
    " 'url: x=1')"
)


@query("x9_variables", """
select sample_id, answer_type as a, category as b, 'x=1' as url, 3 as n from typed_answers""")
def x9(t: Tables) -> DataFrame:
    rows = t.typed_answers.select("sample_id", x.variables(F.expr(VARIABLES.replace("chr(10)", "'\\n'"))).alias("v"))
    return rows.select(
        "sample_id", *[F.element_at("v", F.lit(name)).alias(name) for name in ("a", "b", "url")], F.size("v").alias("n")
    )


@query("x10_substitute", """
select sample_id, concat('a = ', sample_id, chr(10), 'b = 7', chr(10), 'c = a + b', chr(10), 'a = 9') as steps
from typed_answers""")
def x10(t: Tables) -> DataFrame:
    values = F.create_map(F.lit("a"), F.col("sample_id").cast("string"), F.lit("b"), F.lit("7"))
    steps = F.lit("a=1.5\nb  =  old\nc = a + b\na = 9")
    return t.typed_answers.select("sample_id", x.substitute(steps, values).alias("steps"))


def solution_tagged(t: Tables) -> DataFrame:
    """Generations with the tag names of the ``solution_tags`` profile."""
    renamed = output()
    for old, new in zip(q.TAGS, SOLUTION_TAGS.tags):
        renamed = F.replace(renamed, F.lit(old), F.lit(new))
    return t.generations.withColumn("model_output", renamed)


SOLUTIONS = "select run, sample_id, answer, " + (
    f"replace(replace(replace(replace(model_output, '{q.OPEN}', '<start_working_out>'), "
    f"'{q.CLOSE}', '<end_working_out>'), '<answer>', '<SOLUTION>'), '</answer>', '</SOLUTION>')"
) + " as o from generations"
CUSTOM = "(?ms)^\\s*<start_working_out>.+?<end_working_out>.*?<SOLUTION>(.+?)</SOLUTION>\\s*$"


@query("x11_custom_format", f"""
select run, sample_id, case when regexp_matches(o, '{CUSTOM}') then regexp_extract(o, '{CUSTOM}', 1) end as answer
from solutions""", [("solutions", SOLUTIONS)])
def x11(t: Tables) -> DataFrame:
    return solution_tagged(t).select(*KEY, x.custom_answer(output(), SOLUTION_TAGS).alias("answer"))


@query("x12_first_number_after_tag", """
select run, sample_id, nullif(regexp_extract(o, '(?s)<SOLUTION>.*?([\\d.]+)', 1), '') as number from solutions""",
       [("solutions", SOLUTIONS)])
def x12(t: Tables) -> DataFrame:
    return solution_tagged(t).select(*KEY, x.first_number_after(output(), "<SOLUTION>").alias("number"))


@query("x13_question_id", """
select run, sample_id, concat('training_20240101_', substr(md5(concat(question, answer)), 1, 12)) as question_id
from generations""")
def x13(t: Tables) -> DataFrame:
    day = F.lit("2024-01-01").cast("date")
    return t.generations.select(
        *KEY, x.question_id(F.col("question"), F.col("answer"), "training", day).alias("question_id")
    )


BALANCED = " and ".join(f"{q.occurrences('model_output', q.lit(tag))} = 1" for tag in q.TAGS)


@query("x13_trial_id", """
select sample_id, concat('test_run_20240101_000000_sample_', sample_id) as question_id from typed_answers""")
def x13_trial(t: Tables) -> DataFrame:
    return t.typed_answers.select(
        "sample_id", x.trial_id(F.lit("20240101_000000"), F.col("sample_id")).alias("question_id")
    )


@query("x14_reward_flags", f"""
select run, sample_id, {q.answer('model_output')} = answer as is_correct,
  {q.is_digits(f"({q.answer('model_output')})")} as is_integer, {q.has('model_output', *q.TAGS)} as format_correct,
  cast(length(model_output) as bigint) as output_chars, {BALANCED} as is_balanced, false as is_relevant
from generations""")
def x14(t: Tables) -> DataFrame:
    return flags(score(t.generations)).select(
        *KEY, "is_correct", "is_integer", "format_correct", "output_chars", "is_balanced", "is_relevant"
    )


@query("x15_response_parts", """
select conv_id, turn, case when turn % 2 = 1 then text else '' end as reasoning,
  case when turn % 2 = 1 then concat('A', 'B') else concat('A', text, 'B') end as answer from conversations""")
def x15(t: Tables) -> DataFrame:
    def part(thought, text):
        return F.struct(thought.alias("thought"), text.alias("text"))

    parts = F.array(
        part(F.lit(False), F.lit("A")), part(F.pmod("turn", F.lit(2)) == 1, F.col("text")),
        part(F.lit(None).cast("boolean"), F.lit("B")),
    )
    thought, answer = x.response_parts(F.col("parts"))
    return t.conversations.withColumn("parts", parts).select(
        "conv_id", "turn", thought.alias("reasoning"), answer.alias("answer")
    )


@query("x14_tags_balanced", f"""
select run, sample_id, {BALANCED} as is_balanced, {q.is_digits(f"({q.answer('model_output')})")} as is_integer
from generations""")
def x14_balance(t: Tables) -> DataFrame:
    return t.generations.select(
        *KEY, tags_balanced(output()).alias("is_balanced"), is_digits(x.answer_with_fallbacks(output())).alias("is_integer")
    )

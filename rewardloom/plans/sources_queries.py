"""Queries over sources and sinks: files are written below the shared work folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.extract import question_id, thought_and_answer
from rewardloom.functions.prompts import render_message
from rewardloom.operators.datasets import first_rows, schema_rows, split_counts, value_counts
from rewardloom.operators.reports import comparison_report, evaluated
from rewardloom.operators.scoring import BUILT_IN, generation_log
from rewardloom.plans import sql as q
from rewardloom.plans.fixtures import Tables
from rewardloom.plans.registry import query
from rewardloom.profiles import SYSTEM_PROMPT, V2
from rewardloom.sources import datasets, logs, questions

DAY = "2024-01-01"


def user_documents(t: Tables) -> DataFrame:
    """JSON question documents in the three accepted shapes, one per conversation, as such a document is one value."""
    turns = t.conversations.where("role = 'user'")
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("m"))
    texts = F.transform("m", lambda m: m["text"])
    objects = F.transform("m", lambda m: F.struct(m["text"].alias("question")))
    shape = F.pmod("conv_id", F.lit(3))
    value = (
        F.when(shape == 0, F.to_json(texts))
        .when(shape == 1, F.to_json(objects))
        .otherwise(F.to_json(F.struct(texts.alias("questions"))))
    )
    return listed.select("conv_id", value.alias("value"))


@query("s1_json_questions", """
select conv_id, row_number() over (partition by conv_id order by turn) - 1 as pos, text as question
from conversations where role = 'user'""")
def s1(t: Tables) -> DataFrame:
    return questions.questions_from_json(user_documents(t))


@query("s2_csv_questions", "select text as question from benchmark")
def s2(t: Tables) -> DataFrame:
    path = t.work("questions") + ".csv"
    logs.write_csv(t.read("benchmark").select("item_id", F.col("text").alias("question")), path)
    return questions.read_questions(t.spark, path)


@query("s3_text_questions", f"""
select question from (select {q.strip('line')} as question from
 (select unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) as line from conversations where role = 'user'))
where question <> ''""")
def s3(t: Tables) -> DataFrame:
    path = t.work("questions") + ".txt"
    t.conversations.where("role = 'user'").select("text").write.text(path)
    return questions.read_questions(t.spark, path)


SPLIT = "case when sample_id % 10 = 9 then 'test' else 'train' end"


@query("s4_split_set", f"""
select sample_id, answer_type, target from typed_answers where {SPLIT} = 'train'""")
def s4(t: Tables) -> DataFrame:
    path = t.work("qa")
    t.typed_answers.withColumn("split", F.expr(SPLIT)).write.partitionBy("split").parquet(path)
    return datasets.read_split(t.spark, path, "train").select("sample_id", "answer_type", "target")


@query("s5_csv_prompts", f"""
select question, answer, {q.lit(SYSTEM_PROMPT)} as system_content, question as user_content, 2 as n_messages
from generations""")
def s5(t: Tables) -> DataFrame:
    path = t.work("qa")
    logs.write_csv(t.generations.select("question", "answer"), path)
    qa = datasets.read_csv_qa(t.spark, path)
    return qa.select(
        "question", "answer",
        F.col("prompt")[0]["content"].alias("system_content"),
        F.col("prompt")[1]["content"].alias("user_content"),
        F.size("prompt").alias("n_messages"),
    )


@query("s6_held_out", """
select conv_id, pos, question as input, truth as expected from (
 select conv_id, question, truth, row_number() over (partition by conv_id order by turn) - 1 as pos from turns)
where pos < 100""")
def s6(t: Tables) -> DataFrame:
    listed = t.turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "question", "truth"))).alias("m")
    )

    def samples(given: str, wanted: str):
        return F.transform("m", lambda m: F.struct(m["question"].alias(given), m["truth"].alias(wanted)))

    forms = [
        F.to_json(samples("question", "answer")),
        F.to_json(F.struct(samples("input", "output").alias("samples"), F.lit(1).alias("data"))),
        F.to_json(F.struct(F.lit("x").alias("samples"), samples("prompt", "target").alias("data"))),
        F.to_json(F.struct(samples("question", "output").alias("examples"))),
        F.to_json(F.struct(samples("prompt", "answer").alias("validation"))),
    ]
    value = F.lit(None).cast("string")
    for shape, form in enumerate(forms):
        value = F.when(F.pmod("conv_id", F.lit(len(forms))) == shape, form).otherwise(value)
    return datasets.held_out(listed.select("conv_id", value.alias("value")))


RENDERED = (
    "concat('<start_of_turn>system', chr(10), " + q.lit(SYSTEM_PROMPT) + ", '<end_of_turn>', chr(10), "
    "'<start_of_turn>user', chr(10), question, '<end_of_turn>', chr(10), '<eos>')"
)


@query("s7_prompt_cache", f"""
select sample_id, cast(len(tokens) as integer) as n_tokens, array_to_string(tokens, ' ') as token_text
from (select sample_id, list_slice({q.words(RENDERED)}, 1, 1024) as tokens from turns)""")
def s7(t: Tables) -> DataFrame:
    path = t.work("prompts")
    qa = t.turns.select("sample_id", "question")
    datasets.cached_prompts(t.spark, qa, path)
    cached = datasets.cached_prompts(t.spark, qa, path)
    return cached.select("sample_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("token_text"))


def log_table(t: Tables) -> DataFrame:
    """The generations in the schema of the log, with the correctness reward only."""
    thought, answer = thought_and_answer(F.col("model_output"))
    day = F.lit(DAY).cast("timestamp")
    return t.generations.select(
        "run",
        day.alias("timestamp"),
        F.col("step").alias("global_step"),
        question_id(F.col("question"), F.col("answer"), "training", day).alias("question_id"),
        "question",
        F.col("answer").alias("ground_truth_answer"),
        "model_output",
        thought.alias("reasoning"),
        answer.alias("model_answer"),
        BUILT_IN["correctness"](t.generations, V2).alias("correctness"),
    )


LOG_SQL = f"""
select run, step as global_step, concat('training_20240101_', substr(md5(concat(question, answer)), 1, 12)) as question_id,
  question, answer as ground_truth_answer, model_output,
  {q.first_between('model_output', q.OPEN, q.CLOSE)} as reasoning,
  {q.first_between('model_output', '<answer>', '</answer>')} as model_answer,
  cast(case when {q.answer('model_output')} = answer then 4.0 else 0.0 end as double) as correctness
from generations"""
LOG_FIELDS = (
    "run", "global_step", "question_id", "question", "ground_truth_answer", "model_output", "reasoning",
    "model_answer", "correctness",
)


@query("s8_log_scan", LOG_SQL)
def s8(t: Tables) -> DataFrame:
    path = t.work("logs")
    logs.write_csv(logs.log_rows(log_table(t)), path, logs.LOG_COLUMNS, partition_by=("run",))
    return logs.read_csv_logs(t.spark, path).select(*LOG_FIELDS)


@query("s9_fenced_payload", """
select event_id, case when event_id % 3 < 2 then cast(json_extract(props, '$.k') as bigint) end as k,
  event_id % 3 = 2 as rejected from events""")
def s9(t: Tables) -> DataFrame:
    kind = F.pmod("event_id", F.lit(3))
    response = (
        F.when(kind == 0, F.format_string("```json\n%s\n```", "props"))
        .when(kind == 1, F.col("props"))
        .otherwise("no reply")
    )
    parsed = datasets.fenced_json(t.events.select("event_id", response.alias("response")), "response", "k bigint")
    return parsed.select("event_id", "payload.k", F.col("reject").isNotNull().alias("rejected"))


@query("s10_dataset_profile", f"""
select split, count(*) as n_rows from (select {SPLIT} as split from typed_answers) group by split""")
def s10(t: Tables) -> DataFrame:
    return split_counts(t.typed_answers.withColumn("split", F.expr(SPLIT)))


@query("s10_columns", """
select column_name, case column_type when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'INTEGER' then 'int'
  when 'DOUBLE' then 'double' else lower(column_type) end as column_type
from (describe select doc_id, text, lang, source from documents)""")
def s10_columns(t: Tables) -> DataFrame:
    """Columns and types of a data set."""
    return schema_rows(t.documents.select("doc_id", "text", "lang", "source"))


@query("s10_first_examples", """
select sample_id, answer_type, category, target from typed_answers order by sample_id limit 3""")
def s10_first(t: Tables) -> DataFrame:
    return first_rows(t.typed_answers, 3, "sample_id").select("sample_id", "answer_type", "category", "target")


@query("k1_generation_log", LOG_SQL)
def k1(t: Tables) -> DataFrame:
    """The scored log: texts, ids, extractions, all rewards and their total. An attempt that is made again leaves one copy."""
    path = t.work("log")
    log = generation_log(t.generations, F.lit(DAY).cast("date"))
    logs.write_log(log.where("run = 'tuned'"), path)
    logs.write_log(log, path)
    return logs.read_log(t.spark, path).select(*LOG_FIELDS)


@query("k2_short_log", """
select strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp, event_type as question, '' as answer, '' as llm_reasoning,
  '' as llm_answer from events""")
def k2(t: Tables) -> DataFrame:
    path = t.work("short")
    rows = t.events.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("question"), "value"
    )
    logs.write_csv(rows, path, logs.SHORT_LOG)
    table = questions.read_csv(t.spark, path)
    return table.select(*[F.coalesce(c, F.lit("")).alias(c) for c in logs.SHORT_LOG])


@query("k3_json_lines", f"""
select sample_id as id, question, concat({RENDERED}, model_output) as full_response, model_output
from generations""")
def k3(t: Tables) -> DataFrame:
    path = t.work("results")
    prompt = F.concat(
        render_message(F.lit("system"), F.lit(SYSTEM_PROMPT)), render_message(F.lit("user"), F.col("question")),
        F.lit("<eos>"),
    )
    rows = t.generations.withColumn("full_response", F.concat(prompt, "model_output"))
    logs.write_json_lines(logs.batch_results(rows), path)
    return t.spark.read.schema(
        "id bigint, question string, full_response string, model_output string"
    ).json(path)


@query("k4_json_records", """
select event_id, cast(to_json({'timestamp': strftime(ts, '%Y-%m-%d %H:%M:%S'), 'level': 'INFO', 'name': event_type,
  'message': props}) as varchar) as record from events""")
def k4(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id", F.col("ts").alias("timestamp"), F.lit("INFO").alias("level"), F.col("event_type").alias("name"),
        F.lit("a.py").alias("file"), F.col("props").alias("message"),
    )
    return logs.json_records(rows, ("timestamp", "level", "name", "message")).select("event_id", "record")


EVALUATED = f"""
select run, sample_id, question, model_output, try_cast(answer as double) as true_answer,
  try_cast(regexp_extract_all(model_output, '\\d+\\.?\\d*')[-1] as double) as predicted_answer,
  coalesce(abs(try_cast(regexp_extract_all(model_output, '\\d+\\.?\\d*')[-1] as double)
    - try_cast(answer as double)) < 0.01, false) as is_correct
from generations"""


@query("k6_comparison_report", """
select '20240101_000000' as timestamp,
  round(avg(case when run = 'base' then is_correct::int end), 6) as base_model_accuracy,
  round(avg(case when run = 'tuned' then is_correct::int end), 6) as tuned_model_accuracy,
  round(avg(case when run = 'tuned' then is_correct::int end) - avg(case when run = 'base' then is_correct::int end), 6)
    as accuracy_improvement,
  count(*) filter (run = 'base') as number_of_examples,
  (select string_agg(sample_id, ',' order by sample_id) from
    (select distinct sample_id from evaluated order by sample_id limit 5)) as example_ids
from evaluated""", [("evaluated", EVALUATED)])
def k6(t: Tables) -> DataFrame:
    path = t.work("report")
    report = comparison_report(evaluated(t.generations), "base", "tuned", F.lit("20240101_000000"))
    logs.write_report(report, path)
    saved = t.spark.read.schema(report.schema).json(path)
    ids = F.transform("example_comparisons", lambda e: e["sample_id"].cast("string"))
    return saved.select(
        "timestamp",
        *[F.round(c, 6).alias(c) for c in ("base_model_accuracy", "tuned_model_accuracy", "accuracy_improvement")],
        "number_of_examples",
        F.array_join(ids, ",").alias("example_ids"),
    )


@query("k7_dataset_export", """
select form, answer_type, category, target, model_answer, count(*) as n
from typed_answers, (values ('table'), ('csv'), ('json')) f(form) group by all""")
def k7(t: Tables) -> DataFrame:
    path = t.work("export")
    table = t.typed_answers.select("answer_type", "category", F.array("target", "model_answer").alias("answers"))
    datasets_read = {}
    logs.export_dataset(table, path)
    datasets_read["table"] = t.spark.read.parquet(f"{path}/table")
    csv = questions.read_csv(t.spark, f"{path}/csv")
    datasets_read["csv"] = csv.withColumn("answers", F.from_json("answers", "array<string>"))
    datasets_read["json"] = t.spark.read.schema(table.schema).json(f"{path}/json")
    result = None
    for form, df in datasets_read.items():
        fields = (F.get("answers", F.lit(0)).alias("target"), F.get("answers", F.lit(1)).alias("model_answer"))
        rows = df.select(F.lit(form).alias("form"), "answer_type", "category", *fields)
        counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
        result = counts if result is None else result.unionByName(counts)
    return result


@query("k7_export_statistics", """
select 'target' as field, null as value, count(target) as n, round(avg(length(target)), 6) as mean_chars, max(length(target)) as max_chars from typed_answers
union all select 'model_answer', null, count(model_answer), round(avg(length(model_answer)), 6), max(length(model_answer)) from typed_answers
union all select 'category', coalesce(category, ''), count(*), null, null from typed_answers group by category""")
def k7_statistics(t: Tables) -> DataFrame:
    path = t.work("export")
    logs.export_dataset(t.typed_answers.select("target", "model_answer", "category"), path, ("target", "model_answer"), ("category",))
    return t.spark.read.parquet(f"{path}/statistics").withColumn("mean_chars", F.round("mean_chars", 6))


@query("a1_value_counts", """
select field, value, count(*) as n from (
  select 'answer_type' as field, answer_type as value from typed_answers
  union all select 'category', category from typed_answers) group by field, value""")
def a1(t: Tables) -> DataFrame:
    return value_counts(t.typed_answers, ["answer_type", "category"])

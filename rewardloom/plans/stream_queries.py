"""Queries that run a stream over the given tables to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.functions.answers import correctness
from rewardloom.functions.prompts import chat_prompt, render_messages
from rewardloom.operators.scoring import Rewards, score, to_long
from rewardloom.plans.fixtures import Tables
from rewardloom.plans.registry import query
from rewardloom.plans.reward_queries import LONG, PLAIN, R1, R2, R3, R4, R5
from rewardloom.plans.sources_queries import LOG_SQL, log_table
from rewardloom.plans.sql import words
from rewardloom.plans.table_queries import CORRECT, ISSUES, TREND, TREND_FIELDS, VALIDATION, rounded, validation_input
from rewardloom.plans.text_queries import output
from rewardloom.profiles import V2
from rewardloom.schemas import REWARDS
from rewardloom.sources import generate
from rewardloom.streaming import jobs


#: Generations of one file: about as many as a core scores in half a minute.
FILE_ROWS = 10_000


def generation_stream(t: Tables) -> DataFrame:
    """The generations as a stream of files, at least two micro-batches of them.

    A file is a task, so a trigger takes as many as there are cores; larger tables come as more files of the same size.
    """
    path, cores = t.work("incoming"), max(2, t.spark.sparkContext.defaultParallelism)
    rows = t.generations.repartition(2 * cores, "run", "step", "sample_id")
    rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return jobs.read_stream(t.spark, path, rows.schema, max_files=cores)


def metric_stream(t: Tables) -> DataFrame:
    events = jobs.read_stream(t.spark, t.sf_dir, t.events.schema, pattern="events.parquet")
    return events.select(
        F.col("event_type").alias("metric"), F.col("event_id").alias("step"), "value",
        F.col("ts").cast("timestamp").alias("ts"),
    )


@query("t1_scoring_stream", f"""
select run, sample_id, cast({R1} as double) as correctness, cast({R2} as double) as integer,
  cast({R3} as double) as strict_format, cast({R4} as double) as soft_format, round({R5}, 6) as tag_count, true as as_batch
from generations""")
def t1(t: Tables) -> DataFrame:
    """The rewards SQL can express, and whether all rewards and their total are those of the batch job."""
    out = t.work("scored")
    jobs.scoring_stream(generation_stream(t), out, t.work("checkpoint")).awaitTermination()
    names = [*REWARDS, "total_reward"]
    batch = score(t.generations).select("run", "sample_id", F.struct(*names).alias("batch"))
    both = t.spark.read.parquet(out).join(batch, ["run", "sample_id"], "left")
    same = F.struct(*names).eqNullSafe(F.col("batch")).alias("as_batch")
    return both.select("run", "sample_id", *REWARDS[:4], F.round("tag_count", 6).alias("tag_count"), same)


@query("t2_windowed_metrics", """
select date_trunc('day', ts) as window_start, metric, count(value) as n, round(avg(value), 6) as mean,
  quantile_disc(value, 0.5) as median, round(min(value), 6) as min, round(max(value), 6) as max,
  round(stddev_pop(value), 6) as std
from metric_log group by 1, 2""")
def t2(t: Tables) -> DataFrame:
    out, keys = t.work("windows"), ("window_start", "metric")
    jobs.updates_stream(jobs.windowed_metrics(metric_stream(t)), out, t.work("checkpoint"), keys).awaitTermination()
    state = jobs.latest_updates(t.spark, out, keys)
    return rounded(state, "mean", "min", "max", "std").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    )


@query("t2_running_rewards", """
select run, step, reward_name, count(value) as n, round(avg(value), 6) as mean, round(quantile_disc(value, 0.5), 6) as median,
  round(min(value), 6) as min, round(max(value), 6) as max, round(stddev_pop(value), 6) as std
from long group by all""", [("long", LONG)])
def t2_rewards(t: Tables) -> DataFrame:
    """Statistics of every reward by run and step while the generations arrive."""
    out, keys = t.work("rewards"), ("run", "step", "reward_name")
    stream = to_long(score(generation_stream(t), Rewards(PLAIN)), PLAIN)
    jobs.updates_stream(jobs.running_statistics(stream, keys), out, t.work("checkpoint"), keys).awaitTermination()
    return rounded(jobs.latest_updates(t.spark, out, keys), "mean", "median", "min", "max", "std")


@query("t3_running_trends", TREND)
def t3(t: Tables) -> DataFrame:
    out = t.work("trends")
    stream = jobs.running_trends(metric_stream(t), silent="3650 days")
    jobs.updates_stream(stream, out, t.work("checkpoint"), ("metric",)).awaitTermination()
    return rounded(jobs.latest_updates(t.spark, out, ("metric",)), *TREND_FIELDS)


#: Steps between two validations of the fixture's runs.
EVERY = 5


@query("t4_periodic_validation", f"""
select run, boundary, count(*) filter (is_correct) as correct, count(*) as total, round(avg(is_correct::int), 6) as accuracy,
  round(avg(len({words('output')})), 6) as avg_output_length, {ISSUES},
  (select string_agg(concat(sample_id, ':', model_answer), '|' order by sample_id) from wrong w
    where w.run = b.run and w.boundary = b.boundary and w.place <= 10) as errors
from bounded b where boundary + {EVERY} <= (select max(step) from v where v.run = b.run) group by run, boundary""",
       [("v", VALIDATION), ("bounded", f"select *, step // {EVERY} * {EVERY} as boundary from v"), ("wrong", """
select run, boundary, sample_id, model_answer, row_number() over (partition by run, boundary order by sample_id) as place
from bounded where not is_correct""")])
def t4(t: Tables) -> DataFrame:
    """A report of every boundary a run has passed; a report's callback names the boundaries it was called with."""
    out, seen = t.work("reports"), []
    stream = jobs.read_stream(t.spark, *validation_files(t), max_files=2)
    jobs.validation_stream(
        stream, out, t.work("checkpoint"), EVERY, on_report=lambda r: seen.extend(tuple(x) for x in r.select("run", "boundary").collect())
    ).awaitTermination()
    reports = jobs.latest_updates(t.spark, out, ("run", "boundary"))
    listed = F.transform("errors", lambda e: F.concat(e["sample_id"].cast("string"), F.lit(":"), e["answer"]))
    called = t.spark.createDataFrame(sorted(set(seen)), "run string, boundary bigint")
    return rounded(reports.join(called, ["run", "boundary"], "left_semi"), "accuracy", "avg_output_length").select(
        "run", "boundary", "correct", "total", "accuracy", "avg_output_length", "missing_reasoning_tag", "missing_answer_tag",
        "malformed_tags", F.nullif(F.array_join(listed, "|"), F.lit("")).alias("errors"),
    )


def validation_files(t: Tables) -> tuple[str, T.StructType]:
    """The samples to be validated as files."""
    path, samples = t.work("samples"), validation_input(t)
    samples.repartition(4, "step").write.parquet(path)
    return path, samples.schema


@query("t5_running_counts", """
select run, step, count(*) filter (correctness > 0) as correct, count(*) as total from c group by run, step""",
       [("c", CORRECT)])
def t5(t: Tables) -> DataFrame:
    out, keys = t.work("counts"), ("run", "step")
    stream = generation_stream(t).withColumn("correctness", correctness(output(), F.col("answer")))
    jobs.updates_stream(jobs.running_counts(stream), out, t.work("checkpoint"), keys).awaitTermination()
    return jobs.latest_updates(t.spark, out, keys)


DELIVERY_KEYS = ("question_id", "run", "global_step")


def delivered_twice(t: Tables) -> tuple[str, str]:
    """Every row is delivered twice, in different files; what became of them lies in the first folder."""
    path, out = t.work("twice"), t.work("once")
    rows = log_table(t).select("run", "timestamp", "global_step", "question_id")
    rows.write.parquet(path)
    rows.write.mode("append").parquet(path)
    stream = jobs.read_stream(t.spark, path, rows.schema, max_files=2)
    jobs.delivery_stream(stream, out, t.work("checkpoint"), DELIVERY_KEYS).awaitTermination()
    return out, path


@query("t6_without_redelivery", f"""
select run, global_step, question_id, count(*) as n from (
  select distinct run, global_step, question_id from ({LOG_SQL})) group by all""")
def t6(t: Tables) -> DataFrame:
    """Each row is kept once."""
    out, _ = delivered_twice(t)
    return jobs.delivered(t.spark, out, jobs.ON_TIME).groupBy("run", "global_step", "question_id").agg(F.count("*").alias("n"))


@query("t6_delivery_counts", f"""
select d as on_time, 0::bigint as late, 2 * n - d as repeated, 0::bigint as failed, 2 * n as rows_in from (
  select count(*) as n, count(distinct (run, global_step, question_id)) as d from ({LOG_SQL}))""")
def t6_counts(t: Tables) -> DataFrame:
    """On time, late, repeated and failed rows are all there were."""
    out, path = delivered_twice(t)
    rows = t.spark.read.parquet(path).agg(F.count("*").alias("rows_in"))
    return jobs.delivery_counts(t.spark, out).withColumn("rows_in", rows.scalar())


@query("e6_batch_generation", f"""
select sample_id, concat('{V2.thought_open}Thinking about ', question, '{V2.thought_close}', chr(10), '<answer>42</answer>')
  as model_output from turns""")
def e6(t: Tables) -> DataFrame:
    """The generation hook with a fixed reply in place of a model."""
    prompts = t.turns.select("sample_id", "question", render_messages(chat_prompt(F.col("question"))).alias("prompt"))
    return generate.generate(prompts, generate.fixed_reply, "prompt", "question").select("sample_id", "model_output")

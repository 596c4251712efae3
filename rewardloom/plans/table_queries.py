"""Queries of joins, roll-ups, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.functions.extract import question_id, sections
from rewardloom.functions.repetition import word_runs
from rewardloom.operators import datasets, metrics, pairing, reports, trends
from rewardloom.operators.scoring import BUILT_IN, Rewards, score, to_long
from rewardloom.plans import sql as q
from rewardloom.plans.fixtures import Tables
from rewardloom.plans.registry import query
from rewardloom.plans.reward_queries import ALL_STEPS, LONG, PLAIN, R1, R2, R3, R4, R5, long_rewards
from rewardloom.plans.sources_queries import EVALUATED
from rewardloom.plans.text_queries import KEY, output
from rewardloom.profiles import THOUGHT_TAG, V2
from rewardloom.schemas import REWARDS
from rewardloom.sources.logs import stored


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def with_correctness(t: Tables) -> DataFrame:
    return t.generations.withColumn("correctness", BUILT_IN["correctness"](t.generations, V2))


CORRECT = f"select run, step, sample_id, group_id, model_output, cast({R1} as double) as correctness from generations"
WIDE = f"""
select run, step, sample_id, group_id, model_output, cast({R1} as double) as correctness, cast({R2} as double) as integer,
  cast({R3} as double) as strict_format, cast({R4} as double) as soft_format, {R5} as tag_count from generations"""


# --- joins -----------------------------------------------------------------------------------------------------

@query("j1_completion_with_truth", """
select run, sample_id, model_output, truth from generations join turns using (sample_id)
where length(body) > length(turns.question)""")
def j1(t: Tables) -> DataFrame:
    truths = t.turns.where("length(body) > length(question)").select("sample_id", "truth")
    return pairing.with_truth(t.generations.select(*KEY, "model_output"), truths).select(*KEY, "model_output", "truth")


@query("j2_generation_with_rewards", f"""
select run, step, sample_id, question, case when tagged then correctness end as correctness,
  case when tagged then integer end as integer, case when tagged then round(tag_count, 6) end as tag_count
from wide join (select run, sample_id, question, contains(model_output, '<answer>') as tagged from generations)
using (run, sample_id)""", [("wide", WIDE)])
def j2(t: Tables) -> DataFrame:
    """Outputs without an answer tag were never scored; they stay, with empty rewards."""
    tagged = t.generations.where(output().contains("<answer>"))
    logged = to_long(score(tagged, Rewards(PLAIN)), PLAIN)
    joined = pairing.with_rewards(t.generations, logged, PLAIN)
    return joined.select(
        "run", "step", "sample_id", "question", "correctness", "integer", F.round("tag_count", 6).alias("tag_count")
    )


@query("j3_lists_by_index", """
select sample_id, question, case when length(body) > length(question) then truth else '' end as true_answer,
  body as model_output from turns where contains(body, chr(10))""")
def j3(t: Tables) -> DataFrame:
    """Some questions have no truth, some have no output (here: no reply of several lines)."""
    questions = t.turns.select("sample_id", "question")
    truths = t.turns.where("length(body) > length(question)").select("sample_id", F.col("truth").alias("true_answer"))
    outputs = t.turns.where(F.col("body").contains("\n")).select("sample_id", F.col("body").alias("model_output"))
    return pairing.by_question(questions, truths, outputs).select(
        "sample_id", "question", "true_answer", "model_output"
    )


@query("j4_run_side_by_side", """
select sample_id, b.question as question, b.true_answer as true_answer, b.predicted_answer as base_model_answer,
  b.is_correct as base_model_correct, u.predicted_answer as tuned_model_answer, u.is_correct as tuned_model_correct
from (select * from evaluated where run = 'base') b full join (select * from evaluated where run = 'tuned') u
using (sample_id)""", [("evaluated", EVALUATED)])
def j4(t: Tables) -> DataFrame:
    pairs = reports.side_by_side(reports.evaluated(t.generations), "base", "tuned")
    return pairs.drop("base_model_output", "tuned_model_output")


ATTEMPTS = """
select cast(o_orderkey // 4 as bigint) as problem_id, cast(o_orderkey % 4 + 1 as bigint) as attempt,
  o_orderstatus = 'F' as is_valid, concat('eq', o_orderkey) as equation, o_orderpriority as source from orders"""


def attempts(t: Tables) -> DataFrame:
    return t.read("orders").select(
        F.floor(F.col("o_orderkey") / 4).alias("problem_id"),
        (F.pmod("o_orderkey", F.lit(4)) + 1).alias("attempt"),
        (F.col("o_orderstatus") == "F").alias("is_valid"),
        F.concat(F.lit("eq"), F.col("o_orderkey").cast("string")).alias("equation"),
        F.col("o_orderpriority").alias("source"),
    )


@query("j5_prompt_or_first", """
select t.sample_id, coalesce(b.text, (select text from benchmark order by item_id limit 1)) as question
from turns t left join benchmark b on b.item_id = t.conv_id""")
def j5_prompts(t: Tables) -> DataFrame:
    """Samples beyond the last prompt get the first one."""
    prompts = t.read("benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("question"))
    rows = t.turns.select("sample_id", F.col("conv_id").alias("pos"))
    return pairing.with_prompts(rows, prompts).select("sample_id", "question")


@query("j6_equation_cache", """
select c_custkey as problem_id, e.equation from customer left join (
  select problem_id, min_by(equation, attempt) as equation from attempts where is_valid group by problem_id) e
on e.problem_id = c_custkey""", [("attempts", ATTEMPTS)])
def j6(t: Tables) -> DataFrame:
    problems = t.read("customer").select(F.col("c_custkey").alias("problem_id"))
    cache = attempts(t).where("is_valid").select("problem_id", "equation", "attempt")
    return pairing.with_equations(problems, cache, "problem_id", ["attempt"]).select("problem_id", "equation")


@query("j7_latest_valid_attempt", """
select problem_id, max(attempt) as attempt, max_by(equation, attempt) as equation from attempts
where is_valid and attempt <= 3 group by problem_id""", [("attempts", ATTEMPTS)])
def j7(t: Tables) -> DataFrame:
    return pairing.latest_valid(attempts(t), "problem_id").select("problem_id", "attempt", "equation")


@query("j7_retry_set", """
select distinct problem_id from attempts where problem_id not in (
  select problem_id from attempts where is_valid and attempt <= 3)""", [("attempts", ATTEMPTS)])
def j7_retry(t: Tables) -> DataFrame:
    problems = attempts(t).select("problem_id").distinct()
    return pairing.retry_set(problems, attempts(t), "problem_id")


# --- aggregations ----------------------------------------------------------------------------------------------

@query("a2_reward_statistics", f"""
select run, step, reward_name, {q.statistics('value')} from long group by run, step, reward_name""", [("long", LONG)])
def a2(t: Tables) -> DataFrame:
    """The flagship: extraction, five rewards in one pass, statistics per run, step and reward."""
    stats = metrics.statistics(stored(long_rewards(t), t.work("rewards")), ["run", "step", "reward_name"])
    return rounded(stats, "mean", "median", "min", "max", "std")


@query("a2_metric_statistics", f"select metric, {q.statistics('value')} from metric_log group by metric")
def a2_metrics(t: Tables) -> DataFrame:
    stats = metrics.statistics(t.metric_log, ["metric"])
    return rounded(stats, "mean", "median", "min", "max", "std")


N_WORDS = f"len({q.words('text')})"


@query("a3_length_statistics", f"""
select source, round(avg({N_WORDS}), 6) as avg_length, min({N_WORDS}) as min_length, max({N_WORDS}) as max_length,
  count(*) as num_samples from documents group by source""")
def a3(t: Tables) -> DataFrame:
    return rounded(metrics.length_statistics(t.documents, "text", ["source"]), "avg_length")


TOKENS = f"select source, unnest({q.words('text')}) as token from documents"


@query("a4_token_entropy", """
select source, cast(sum(n) as bigint) as n_tokens, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as token_entropy
from (select source, token, count(*) as n from tokens group by source, token) group by source""", [("tokens", TOKENS)])
def a4(t: Tables) -> DataFrame:
    return rounded(metrics.token_entropy(t.documents, "text", ["source"]), "token_entropy")


@query("a4_custom_tokenizer", """
select lang, cast(sum(n) as bigint) as n_tokens, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as token_entropy
from (select lang, token, count(*) as n from (
  select lang, unnest(string_split(text, '.')) as token from documents) group by lang, token) group by lang""")
def a4_custom(t: Tables) -> DataFrame:
    """A tokenizer of the user's own (E3), here an expression; an Arrow UDF returning an array works the same way."""
    entropy = metrics.token_entropy(t.documents, "text", ["lang"], lambda c: F.split(c, r"\."))
    return rounded(entropy, "token_entropy")


@query("a5_format_adherence", f"""
select run, round(avg(regexp_matches(model_output, '(?s){q.OPEN}.*?{q.CLOSE}.*?<answer>.*?</answer>')::int), 6)
  as format_adherence_rate from generations group by run""")
def a5(t: Tables) -> DataFrame:
    return rounded(metrics.adherence_rate(t.generations, "model_output", ["run"]), "format_adherence_rate")


def _words_between(tag: str) -> str:
    inside = q.first_between("model_output", f"<{tag}>", f"</{tag}>")
    return (f"avg(case when regexp_matches(model_output, '(?s)<{tag}>(.*?)</{tag}>') "
            f"then len({q.words(inside)}) end)")


@query("a6_thought_answer_ratio", """
select run, round(case when r is not null and a > 0 then r / a else 0 end, 6) as reasoning_to_answer_ratio,
  round(case when r is not null and a is not null then r else 0 end, 6) as avg_reasoning_length,
  round(case when r is not null and a is not null then a else 0 end, 6) as avg_answer_length from means""",
       [("means", f"select run, {_words_between(THOUGHT_TAG)} as r, {_words_between('answer')} as a "
                  "from generations group by run")])
def a6(t: Tables) -> DataFrame:
    ratio = metrics.thought_answer_ratio(t.generations, "model_output", ["run"])
    return rounded(ratio, "reasoning_to_answer_ratio", "avg_reasoning_length", "avg_answer_length")


SPANS = "select metric, min(value) as lo, max(value) as hi from metric_log group by metric"
BINNED = f"""
select m.metric, sample_group, lo, hi, {q.bin_index('value', 'lo', 'hi', 20)} as bin
from metric_log m join spans s on s.metric = m.metric"""


@query("a7_kl_divergence", """
select metric, round(sum(p * ln(p / r)), 6) as kl_divergence from (
  select metric, greatest(n1 / (sum(n1) over (partition by metric) + 1e-10), 1e-10) as p,
    greatest(n2 / (sum(n2) over (partition by metric) + 1e-10), 1e-10) as r
  from (select metric, bin, count(*) filter (sample_group % 2 = 0) as n1, count(*) filter (sample_group % 2 = 1) as n2
        from binned group by metric, bin)) group by metric""", [("spans", SPANS), ("binned", BINNED)])
def a7(t: Tables) -> DataFrame:
    first = F.pmod("sample_group", F.lit(2)) == 0
    return rounded(metrics.kl_divergence(t.metric_log, first, ["metric"]), "kl_divergence")


@query("a7_kl_divergence_overall", f"""
select round(sum(p * ln(p / r)), 6) as kl_divergence from (
  select greatest(n1 / (sum(n1) over () + 1e-10), 1e-10) as p, greatest(n2 / (sum(n2) over () + 1e-10), 1e-10) as r
  from (select bin, count(*) filter (sample_group % 2 = 0) as n1, count(*) filter (sample_group % 2 = 1) as n2
        from (select sample_group, {q.bin_index('value', 'lo', 'hi', 20)} as bin from metric_log,
              (select min(value) as lo, max(value) as hi from metric_log)) group by bin))""")
def a7_overall(t: Tables) -> DataFrame:
    first = F.pmod("sample_group", F.lit(2)) == 0
    return rounded(metrics.kl_divergence(t.metric_log, first), "kl_divergence")


@query("a8_accuracy", """
select run, count(*) filter (is_correct) as correct, count(*) as total, round(avg(is_correct::int), 6) as accuracy
from evaluated group by run""", [("evaluated", EVALUATED)])
def a8(t: Tables) -> DataFrame:
    return rounded(reports.accuracy(reports.evaluated(t.generations), ["run"]), "accuracy")


@query("a8_label_accuracy", """
select source, count(*) filter (quality = 1) as correct, count(*) as total, round(avg(quality), 6) as accuracy
from labels join documents using (doc_id) group by source""")
def a8_labels(t: Tables) -> DataFrame:
    rows = t.read("labels").join(t.documents.select("doc_id", "source"), "doc_id")
    judged = rows.withColumn("is_correct", F.col("quality") == 1)
    return rounded(reports.accuracy(judged, ["source"]), "accuracy")


VALIDATION = f"""
select *, coalesce(lower({q.strip('model_answer')}) = lower({q.strip('expected')}), false) as is_correct from (
  select run, sample_id, step, question as input, answer as expected, model_output as output,
    case when regexp_matches(model_output, '(?s)<answer>(.*?)</answer>')
      then {q.first_between('model_output', '<answer>', '</answer>')} else {q.strip('model_output')} end as model_answer
  from generations)"""
ISSUES = f"""
  count(*) filter (not is_correct and not (contains(output, '{q.OPEN}') and contains(output, '{q.CLOSE}')))
    as missing_reasoning_tag,
  count(*) filter (not is_correct and not (contains(output, '<answer>') and contains(output, '</answer>')))
    as missing_answer_tag,
  count(*) filter (not is_correct and (regexp_matches(output, '<({THOUGHT_TAG}|answer)[^>]*>[^<]*$')
    or regexp_matches(output, '^[^<]*</({THOUGHT_TAG}|answer)>'))) as malformed_tags"""


def validation_input(t: Tables) -> DataFrame:
    return t.generations.select(
        "run", "sample_id", "step", F.col("question").alias("input"), F.col("answer").alias("expected"),
        F.col("model_output").alias("output"),
    )


@query("a10_validation_report", f"""
select run, step, count(*) filter (is_correct) as correct, count(*) as total, round(avg(is_correct::int), 6) as accuracy,
  0.5::double as avg_generation_time, round(avg(len({q.words('output')})), 6) as avg_output_length, {ISSUES},
  coalesce((select string_agg(concat(sample_id, ':', model_answer), '|' order by sample_id) from wrong w
    where w.run = v.run and w.step = v.step and w.place <= 10), '') as errors
from v group by run, step""", [("v", VALIDATION), ("wrong", """
select run, step, sample_id, model_answer, row_number() over (partition by run, step order by sample_id) as place
from v where not is_correct""")])
def a10(t: Tables) -> DataFrame:
    """A report per run and step."""
    samples = validation_input(t).withColumn("generation_time", F.lit(0.5))
    report = reports.validation_report(samples, "sample_id", keys=["run", "step"])
    listed = F.transform("errors", lambda e: F.concat(e["sample_id"].cast("string"), F.lit(":"), e["answer"]))
    return rounded(report, "accuracy", "avg_output_length").withColumn("errors", F.array_join(listed, "|"))


@query("a10_whole_report", f"""
select count(*) filter (is_correct) as correct, count(*) as total, round(avg(is_correct::int), 6) as accuracy,
  (select string_agg(sample_id, ',' order by sample_id) from (select sample_id from v where not is_correct and run = 'tuned'
    order by sample_id limit 10)) as errors from v where run = 'tuned'""", [("v", VALIDATION)])
def a10_whole(t: Tables) -> DataFrame:
    """The report of one validation, in one row."""
    report = reports.validation_report(validation_input(t).where("run = 'tuned'"), "sample_id")
    ids = F.array_join(F.transform("errors", lambda e: e["sample_id"].cast("string")), ",")
    return rounded(report, "accuracy").select("correct", "total", "accuracy", ids.alias("errors"))


@query("a11_format_issues", f"""
select run, {ISSUES} from v group by run having count(*) filter (not is_correct) > 0""", [("v", VALIDATION)])
def a11(t: Tables) -> DataFrame:
    return reports.format_issues(reports.validated(validation_input(t)), ["run"])


@query("a12_run_comparison", """
select round(avg(case when run = 'base' then is_correct::int end), 6) as base_model_accuracy,
  round(avg(case when run = 'tuned' then is_correct::int end), 6) as tuned_model_accuracy,
  count(*) filter (run = 'base') as number_of_examples,
  round(avg(case when run = 'tuned' then is_correct::int end) - avg(case when run = 'base' then is_correct::int end), 6)
    as accuracy_improvement from evaluated""", [("evaluated", EVALUATED)])
def a12(t: Tables) -> DataFrame:
    compared = reports.run_comparison(reports.evaluated(t.generations), "base", "tuned")
    return rounded(compared, "base_model_accuracy", "tuned_model_accuracy", "accuracy_improvement")


@query("a13_metric_tags", f"""
select step, concat('model/output/', left(question, 50)) as tag, 'text' as kind, cast(null as double) as number,
  model_output as text, '' as numbers from generations
union all select step, concat('rewards/', reward_name), 'scalar', round(value, 6), null, '' from long
union all select event_id, 'metrics/value', 'scalar', value, null, '' from events
union all select event_id, 'distributions/pair', 'histogram', null, null,
  concat(cast(value as varchar), ';', cast(value as varchar)) from events
union all select event_id, 'text/output', 'text', null, event_type, '' from events""", [("long", LONG)])
def a13(t: Tables) -> DataFrame:
    logged = t.events.select(
        F.col("event_id").alias("step"), "value", F.array("value", "value").alias("pair"),
        F.col("event_type").alias("output"), "props",
    )
    parts = [
        metrics.metric_tags(t.generations.select("step", "question", "model_output")),
        metrics.metric_tags(long_rewards(t).select("step", "reward_name", "value")),
        metrics.metric_tags(logged, left_out=("props",)),
    ]
    tags = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return tags.withColumns({
        "number": F.round("number", 6),
        "numbers": F.coalesce(F.array_join(F.col("numbers").cast("array<string>"), ";"), F.lit("")),
    })


@query("a13_own_steps", """
select row_number() over (order by event_id) - 1 as step, 'metrics/value' as tag, 'scalar' as kind, round(value, 6) as number, null as text
from events union all select row_number() over (order by event_id) - 1, 'text/output', 'text', null, event_type from events""")
def a13_own_steps(t: Tables) -> DataFrame:
    """Rows without steps: every tag counts its own."""
    logged = t.events.select("event_id", "value", F.col("event_type").alias("output"))
    tags = metrics.metric_tags(logged, step=None, order=["event_id"])
    return rounded(tags, "number").select("step", "tag", "kind", "number", "text")


@query("k5_reward_tags", """
select step, concat('rewards/', reward_name) as tag, 'scalar' as kind, round(value, 6) as number from long""",
       [("long", LONG)])
def k5(t: Tables) -> DataFrame:
    tags = metrics.metric_tags(long_rewards(t).select("step", "reward_name", "value"))
    return tags.select("step", "tag", "kind", F.round("number", 6).alias("number"))


@query("a14_histogram", """
select metric, bin, round(lo + bin * ((hi - lo) / 20), 6) as edge, count(*) as n from binned group by metric, bin, lo, hi""",
       [("spans", SPANS), ("binned", BINNED)])
def a14(t: Tables) -> DataFrame:
    return rounded(metrics.histogram(t.metric_log, ["metric"]), "edge")


AUTOMATIC = f"""
select m.metric, value, lo, hi, bins, {q.bin_index('value', 'lo', 'hi', 'bins')} as bin from metric_log m join (
  select metric, case when lo = hi then lo - 0.5 else lo end as lo, case when lo = hi then hi + 0.5 else hi end as hi,
    case when lo = hi then 1 else ceil((hi - lo) / least(greatest(2 * iqr * pow(n, -1.0 / 3.0), (hi - lo) / sqrt(n) / 2), (hi - lo) / (log2(n) + 1)))
    end::bigint as bins
  from (select metric, min(value) as lo, max(value) as hi, count(value) as n, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr
    from metric_log group by metric)) s on s.metric = m.metric"""


@query("a14_automatic_histogram", """
select metric, bins, bin, round(lo + bin * ((hi - lo) / bins), 6) as edge, count(*) as n from automatic group by metric, bins, bin, lo, hi""",
       [("automatic", AUTOMATIC)])
def a14_automatic(t: Tables) -> DataFrame:
    return rounded(metrics.automatic_histogram(t.metric_log, ["metric"]), "edge")


@query("a15_reward_correlation", "\nunion all ".join(
    f"select run, '{a}' as reward_a, '{b}' as reward_b, case when stddev_pop({a}) * stddev_pop({b}) > 0 then round(corr({a}, {b}), 6) end as correlation from wide group by run"
    for i, a in enumerate(PLAIN) for b in PLAIN[i + 1:]), [("wide", WIDE)])
def a15(t: Tables) -> DataFrame:
    scored = score(t.generations, Rewards(PLAIN))
    return rounded(metrics.correlations(scored, list(PLAIN), ["run"]), "correlation")


@query("a15_label_correlation", """
select 'quality' as reward_a, 'toxic' as reward_b, round(corr(quality, toxic), 6) as correlation from labels""")
def a15_labels(t: Tables) -> DataFrame:
    return rounded(metrics.correlations(t.read("labels"), ["quality", "toxic"]), "correlation")


@query("a16_batch_accuracy", """
select run, step, count(*) filter (correctness > 0) as correct, count(*) as total,
  case when avg(correctness) > 0 then cast(round_even(avg(correctness) / 4.0, 0) as bigint) else 0 end as rounded_correct
from c group by run, step""", [("c", CORRECT)])
def a16(t: Tables) -> DataFrame:
    return metrics.batch_accuracy(with_correctness(t), ["run", "step"])


@query("a17_group_rewards", f"""
select run, group_id, round(avg(correctness), 6) as reward_mean, round(stddev_pop(correctness), 6) as reward_std,
  round(avg(len({q.words('model_output')})), 6) as completion_length, count(*) as n_generations
from c group by run, group_id""", [("c", CORRECT)])
def a17(t: Tables) -> DataFrame:
    groups = metrics.group_rewards(with_correctness(t), ["run", "group_id"], "correctness")
    return rounded(groups, "reward_mean", "reward_std", "completion_length")


@query("a17_group_advantage", """
select run, sample_id, round((correctness - avg(correctness) over w) / (stddev_pop(correctness) over w + 0.0001), 6)
  as advantage from c window w as (partition by run, group_id)""", [("c", CORRECT)])
def a17_advantage(t: Tables) -> DataFrame:
    judged = metrics.group_advantage(with_correctness(t), ["run", "group_id"], "correctness")
    return judged.select(*KEY, F.round("advantage", 6).alias("advantage"))


@query("a18_verification_success", """
select source, count(*) filter (is_valid) as valid, count(*) as attempted, round(avg(is_valid::int), 6) as success_rate
from attempts group by rollup (source)""", [("attempts", ATTEMPTS)])
def a18(t: Tables) -> DataFrame:
    return rounded(datasets.success_rates(attempts(t)), "success_rate")


@query("a19_sampled_metrics", """
select run, step, cast(sum(n) as bigint) as n_tokens, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as token_entropy
from (select run, step, token, count(*) as n from sampled group by all) group by run, step""", [("sampled", f"""
select run, step, unnest({q.words('model_output')}) as token from generations
where cast(concat('0x', substr(md5(cast(step as varchar)), 1, 8)) as bigint) % 10 = 0""")])
def a19(t: Tables) -> DataFrame:
    sampled = metrics.sampled_steps(t.generations)
    return rounded(metrics.token_entropy(sampled, "model_output", ["run", "step"]), "token_entropy")


@query("a20_duplicate_questions", """
select concat('training_20240101_', substr(md5(concat(question, answer)), 1, 12)) as question_id, count(*) as n
from generations group by 1 having count(*) > 1""")
def a20(t: Tables) -> DataFrame:
    qid = question_id(F.col("question"), F.col("answer"), "training", F.lit("2024-01-01").cast("date"))
    return pairing.duplicates(t.generations.select(qid.alias("question_id")))


@query("a21_step_plan", "select cast(floor(count(*) / 8) * 3 as bigint) as steps from typed_answers")
def a21(t: Tables) -> DataFrame:
    return datasets.step_plan(t.typed_answers, 4, 2, 3)


# --- windows ---------------------------------------------------------------------------------------------------

NEWEST = "row_number() over (partition by metric order by step desc)"


@query("w1_last_values", f"select metric, step, value from metric_log qualify {NEWEST} <= 100")
def w1(t: Tables) -> DataFrame:
    return trends.last_values(t.metric_log).select("metric", "step", "value")


TREND = f"""
select metric, round(avg(value), 6) as mean, round(median(value), 6) as median, round(min(value), 6) as min,
  round(max(value), 6) as max, round(stddev_pop(value), 6) as std, count(*) as count,
  round(coalesce(regr_slope(value, -place), 0), 6) as trend
from (select metric, value, {NEWEST} as place from metric_log qualify place <= 100) group by metric"""
TREND_FIELDS = ("mean", "median", "min", "max", "std", "trend")


@query("w2_trends", TREND)
def w2(t: Tables) -> DataFrame:
    return rounded(trends.trends(t.metric_log), *TREND_FIELDS)


@query("w3_trends_of_rewards", """
select name, round(avg(value), 6) as mean, round(median(value), 6) as median, round(min(value), 6) as min,
  round(max(value), 6) as max, round(stddev_pop(value), 6) as std, count(*) as count,
  round(coalesce(regr_slope(value, -place), 0), 6) as trend
from (select concat(run, '/', reward_name) as name, value,
        row_number() over (partition by run, reward_name order by step desc) as place
      from (select run, reward_name, step, avg(value) as value from long group by all) qualify place <= 10)
group by name""", [("long", LONG)])
def w3(t: Tables) -> DataFrame:
    means = long_rewards(t).groupBy("run", "reward_name", "step").agg(F.avg("value").alias("value"))
    named = means.withColumn("name", F.concat_ws("/", "run", "reward_name"))
    return rounded(trends.trends(named, 10, ["name"]), *TREND_FIELDS)


@query("w4_history_trim", f"select metric, step, value from metric_log qualify {NEWEST} <= 1000")
def w4(t: Tables) -> DataFrame:
    return trends.trim_history(t.metric_log).select("metric", "step", "value")


@query("w5_moving_average", """
select metric, original as step, round(avg(value) over w, 9) as moving_average,
  case when count(*) over w < 2 then 0 else round(regr_slope(value, step) over w, 6) end as moving_slope
from (select metric, value, step as original, row_number() over (partition by metric order by step) as step from metric_log)
window w as (partition by metric order by step rows between 99 preceding and current row)""")
def w5(t: Tables) -> DataFrame:
    moved = trends.moving_average(t.metric_log, width=2000)
    # Averages of up to 100 values with two decimals: nine digits, so that none ends in a tie.
    return moved.select(
        "metric", "step", F.round("moving_average", 9).alias("moving_average"),
        F.round("moving_slope", 6).alias("moving_slope"),
    )


RUNNING = """
select run, step, cast(sum(c) over w as bigint) as correct_answers, cast(sum(t) over w as bigint) as total_answers,
  round(sum(c) over w / sum(t) over w * 100, 6) as accuracy, round(step / 20 * 100, 6) as progress_percent
from (select run, step, count(*) filter (correctness > 0) as c, count(*) as t from cc group by run, step)
window w as (partition by run order by step)"""


@query("w6_running_accuracy", RUNNING, [("cc", CORRECT)])
def w6(t: Tables) -> DataFrame:
    running = trends.running_accuracy(with_correctness(t), 20, width=7)
    return rounded(running, "accuracy", "progress_percent")


@query("w7_auto_step", """
select event_type as tag, event_id, row_number() over (partition by event_type order by ts, event_id) - 1 as auto_step
from events""")
def w7(t: Tables) -> DataFrame:
    tagged = t.events.select(F.col("event_type").alias("tag"), "ts", "event_id")
    return trends.auto_step(tagged, ["tag"], ["ts", "event_id"]).select("tag", "event_id", "auto_step")


@query("w8_adjacent_sentences", f"""
select run, sample_id, pos - 1 as pos, sentence, lag(sentence) over (partition by run, sample_id order by pos) as previous
from (select run, sample_id, unnest(l) as sentence, generate_subscripts(l, 1) as pos from (
  select run, sample_id, {q.sentences(q.section('model_output', q.OPEN, q.CLOSE))} as l from generations))""")
def w8(t: Tables) -> DataFrame:
    thought, _, _ = sections(output())
    rows = t.generations.select(F.struct(*KEY).alias("sample"), "question", thought.alias("thought"))
    paired = pairing.question_sentence_pairs(rows, "question", "thought", "sample")
    return paired.select("sample.*", "pos", "sentence", "previous")


@query("w9_run_detection", """
select doc_id, word, count(*) as n from (
  select doc_id, word, i - row_number() over (partition by doc_id, word order by i) as island from (
    select doc_id, word, row_number() over (partition by doc_id order by i) as i from words where length(word) >= 2))
group by doc_id, word, island having count(*) >= 3""", [("words", f"""
select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from (
  select doc_id, {q.words('text')} as w from documents)""")])
def w9(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.inline(word_runs(F.col("text"))))


@query("w10_every_n_steps", "select run, step, sample_id from generations where step % 5 = 0")
def w10(t: Tables) -> DataFrame:
    return trends.every_n(t.generations, 5).select("run", "step", "sample_id")


# --- sorts, limits and set operations --------------------------------------------------------------------------

@query("o1_first_errors", """
select run, sample_id, model_answer from v where not is_correct order by run, sample_id limit 10""", [("v", VALIDATION)])
def o1(t: Tables) -> DataFrame:
    wrong = reports.validated(validation_input(t)).where("not is_correct")
    return datasets.first_rows(wrong, 10, "run", "sample_id").select(*KEY, "model_answer")


@query("o2_descending_counts", """
select source as value, count(*) as n, row_number() over (order by count(*) desc, source) as place
from documents group by source""")
def o2(t: Tables) -> DataFrame:
    counts = datasets.value_counts(t.documents, ["source"])
    # The window runs over the counts, one row per source.
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counts.select("value", "n", place.cast("bigint").alias("place"))


@query("o3_sample_cut", "select sample_id, target from typed_answers order by sample_id limit 500")
def o3(t: Tables) -> DataFrame:
    return datasets.first_rows(t.typed_answers.select("sample_id", "target"), 500, "sample_id")


@query("o4_latest_run", """
select event_type as model, max(started_at) as started_at,
  max_by(run, struct_pack(a := started_at, b := run)) as latest_run
from (select event_type, concat('run', user_id % 5) as run, ts as started_at from events) group by event_type""")
def o4(t: Tables) -> DataFrame:
    run = F.concat(F.lit("run"), F.pmod("user_id", F.lit(5)).cast("string"))
    starts = t.events.select(F.col("event_type").alias("model"), run.alias("run"), F.col("ts").alias("started_at"))
    return datasets.latest_run(starts)


@query("o5_spot_check", "select doc_id, text from documents order by md5(concat(doc_id, '|7')), doc_id limit 1")
def o5(t: Tables) -> DataFrame:
    return datasets.spot_check(t.documents.select("doc_id", "text"), "doc_id", seed=7)


@query("u1_split_union", """
select split, count(*) as n from (
  select 'train' as split from typed_answers where category <> 'cat_a'
  union all select 'test' from typed_answers where category = 'cat_a') group by split""")
def u1(t: Tables) -> DataFrame:
    train, test = t.typed_answers.where("category <> 'cat_a'"), t.typed_answers.where("category = 'cat_a'")
    return datasets.split_counts(datasets.union_splits(train=train, test=test)).withColumnRenamed("n_rows", "n")


@query("u2_combined_logs", f"""
select run, sample_id, model_output, case when run = 'tuned' then cast({R1} as double) end as correctness
from generations""")
def u2(t: Tables) -> DataFrame:
    old = t.generations.where("run = 'base'").select(*KEY, "model_output")
    new = with_correctness(t).where("run = 'tuned'").select(*KEY, "model_output", "correctness")
    return datasets.union_logs(old, new)


@query("u3_undeclared_rewards", """
select distinct event_type as reward_name from events where event_type not in ('click', 'view')""")
def u3(t: Tables) -> DataFrame:
    logged = t.events.select(F.col("event_type").alias("reward_name"))
    declared = logged.where(F.col("reward_name").isin("click", "view")).distinct()
    return datasets.undeclared(logged, declared)


@query("d1_synthetic_problems", """
select sample_id as original_question_id, concat('How many? ', target) as question, target as answer,
  concat('a = ', target, chr(10), 'b = 2') as adapted_steps, 1.0::double as verification_score
from typed_answers where trim(model_answer) = trim(target) or abs(try_cast(trim(model_answer) as double)
  - try_cast(target as double)) < 1e-6""")
def d1(t: Tables) -> DataFrame:
    """Generated variants: parse the reply, adapt the steps, check the result, keep what passed."""
    reply = F.concat(
        F.lit("<synthetic_problem>How many? "), "target", F.lit("</synthetic_problem>\n<new_variable_values>\na: "),
        "target", F.lit("\n</new_variable_values>\n<expected_answer>"), "target", F.lit("</expected_answer>"),
    )
    rows = t.typed_answers.select(
        "sample_id", reply.alias("response"), F.lit("a = 1\nb = 2").alias("execution_steps"),
        F.col("model_answer").alias("calculated"),
    )
    checked = datasets.synthetic_attempts(rows)
    problems = datasets.synthetic_problems(checked, F.col("sample_id"), F.col("adapted_steps"))
    return problems.select(
        "original_question_id", "question", "answer", F.col("original_equation").alias("adapted_steps"),
        "verification_score",
    )


@query("a17_step_table", """
select run, step, round(avg(correctness), 6) as reward, round(stddev_pop(correctness), 6) as reward_std from c
group by run, step""", [("c", CORRECT)])
def a17_steps(t: Tables) -> DataFrame:
    table = metrics.group_rewards(with_correctness(t), ["run", "step"], "correctness")
    return table.select("run", "step", F.round("reward_mean", 6).alias("reward"),
                        F.round("reward_std", 6).alias("reward_std"))


@query("a2_full_scoring", f"select run, step, reward_name, {q.statistics('value')} from every group by run, step, reward_name", [
    *ALL_STEPS, ("every", " union all ".join(f"select run, step, '{n}' as reward_name, {n} as value from totals" for n in (*REWARDS, "total_reward")))])
def a2_full(t: Tables) -> DataFrame:
    """All seven rewards and the total, stored as the long reward table and rolled up per run, step and reward."""
    names = (*REWARDS, "total_reward")
    long = score(t.generations).unpivot(["run", "step"], list(names), "reward_name", "value")
    stats = metrics.statistics(stored(long, t.work("rewards")), ["run", "step", "reward_name"])
    return rounded(stats, "mean", "median", "min", "max", "std")

import math
import statistics as py

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from rewardloom.operators import datasets, metrics, pairing, reports, trends


def table(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, value double")


GROUPS = {
    "one": [3.5], "two": [1, 2], "same": [7] * 9, "odd": [5, -1, 3], "even": [0.1, 0.2, 1e6, -1e6],
    "many": [((i * 7919) % 1009) / 7 - 50 for i in range(500)], "tiny": [1e-9 * i for i in range(40)],
    "hot": [1.0] * 300 + [2.0] * 299,
}


def test_statistics_are_exact(spark):
    rows = {r.g: r for r in metrics.statistics(table(spark, GROUPS), ["g"]).collect()}
    assert rows.keys() == GROUPS.keys()
    for g, values in GROUPS.items():
        r = rows[g]
        assert r.n == len(values)
        assert r.median == py.median(values)
        assert (r.min, r.max) == (min(values), max(values))
        assert r.mean == pytest.approx(math.fsum(values) / len(values), rel=1e-9, abs=1e-15)
        assert r["std"] == pytest.approx(np.std(values), rel=1e-7, abs=1e-15)


def test_statistics_keep_null_keys_and_skip_null_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "g string, value double")
    assert [tuple(r)[:4] for r in metrics.statistics(df, ["g"]).collect()] == [(None, 2, 2.0, 2.0)]


def test_kl_divergence_agrees_with_histograms(spark):
    def expected(a, b, bins=20):
        if not (a and b):
            return 0.0
        span = (min(a + b), max(a + b))
        p, r = (np.maximum(np.histogram(s, bins, span)[0] / (len(s) + 1e-10), 1e-10) for s in (a, b))
        return float(np.sum(p * np.log(p / r)))

    sides = {
        "flat": ([2.0] * 3, [2.0]), "empty": ([1.0, 2.0], []), "one": ([1.0], [4.0]),
        "edges": ([i / 10 for i in range(21)], [i / 20 for i in range(41)]),
        "odd": ([math.sin(i) for i in range(99)], [math.cos(i * 3) for i in range(77)]),
    }
    rows = [(k, side, v) for k, pair in sides.items() for side, values in enumerate(pair) for v in values]
    df = spark.createDataFrame(rows, "k string, side bigint, value double")
    got = {r.k: r.kl_divergence for r in metrics.kl_divergence(df, F.col("side") == 0, ["k"]).collect()}
    for k, (a, b) in sides.items():
        assert got[k] == pytest.approx(expected(a, b), abs=1e-9), k


def test_histogram_agrees_with_numpy(spark):
    values = [i / 10 for i in range(31)] + [0.05, 2.9999]
    got = {r.bin: r.n for r in metrics.histogram(table(spark, {"x": values}), ["g"], bins=10).collect()}
    want = np.histogram(values, 10)[0]
    assert got == {i: n for i, n in enumerate(want) if n}


def test_entropy_and_lengths_of_empty_and_full_groups(spark):
    texts = {"a": "x y x\nz", "b": "", "c": "w w w"}
    df = spark.createDataFrame(list(texts.items()), "g string, t string")
    got = {r.g: (r.n_tokens, r.token_entropy) for r in metrics.token_entropy(df, "t", ["g"]).collect()}
    for g, t in texts.items():
        assert got[g] == (len(t.split()), pytest.approx(brute.entropy(t.split())))
    empty = df.where("false")
    assert tuple(metrics.length_statistics(empty, "t").first()) == (0.0, 0, 0, 0)
    assert metrics.adherence_rate(empty, "t").first()[0] == 0.0
    assert tuple(metrics.thought_answer_ratio(df, "t").first()) == (0.0, 0.0, 0.0)
    assert metrics.token_entropy(empty, "t").first().token_entropy == 0.0


def test_entropy_with_a_tokenizer_in_python(spark):
    @F.pandas_udf("array<string>")
    def letters(texts):
        return texts.map(list)

    df = spark.createDataFrame([("aab",), ("b",)], "t string")
    assert tuple(metrics.token_entropy(df, "t", tokenizer=letters).first()) == (4, 1.0)


def test_thought_answer_ratio(spark):
    df = spark.createDataFrame(
        [("<reasoning>a b c</reasoning><answer>1</answer>",), ("<reasoning>a</reasoning>",), ("none",), (None,)], "t string"
    )
    assert tuple(metrics.thought_answer_ratio(df, "t").first()) == (2.0, 2.0, 1.0)
    blank = spark.createDataFrame([("<reasoning>a</reasoning><answer> </answer>",)], "t string")
    assert tuple(metrics.thought_answer_ratio(blank, "t").first()) == (0.0, 1.0, 0.0)


def test_constant_rewards_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert metrics.correlations(df, ["a", "b"]).first().correlation is None


def series(spark, lengths):
    rows = [(m, s * 3, math.sin(s * 1.7) * 10 + s) for m, n in lengths.items() for s in range(n)]
    return spark.createDataFrame(rows, "metric string, step bigint, value double").repartition(5, "step")


def slope(values):
    return float(np.polyfit(range(len(values)), values, 1)[0]) if len(values) > 1 else 0.0


def test_trends_of_last_values(spark):
    df = series(spark, {"a": 250, "b": 1, "c": 2})
    got = {r.metric: r for r in trends.trends(df, 100).collect()}
    for m, n in {"a": 250, "b": 1, "c": 2}.items():
        values = [math.sin(s * 1.7) * 10 + s for s in range(n)][-100:]
        r = got[m]
        assert r["count"] == len(values)
        assert (r["mean"], r["median"], r["std"], r["trend"]) == pytest.approx(
            (np.mean(values), np.median(values), np.std(values), slope(values)), abs=1e-9)


@pytest.mark.parametrize("width", [7, 40, 100_000])
def test_moving_average_over_cut_series(spark, width):
    df = series(spark, {"a": 130, "b": 3})
    got = {(r.metric, r.step): r for r in trends.moving_average(df, 10, width=width).collect()}
    assert len(got) == 133
    for m, n in {"a": 130, "b": 3}.items():
        values = [math.sin(s * 1.7) * 10 + s for s in range(n)]
        for s in range(n):
            recent = values[max(0, s - 9): s + 1]
            r = got[m, s * 3]
            assert r.moving_average == pytest.approx(np.mean(recent), abs=1e-9)
            assert r.moving_slope == pytest.approx(slope(recent), abs=1e-8)


def test_ranks_are_whole_over_ranges(spark):
    df = series(spark, {"a": 57, "b": 5})
    got = {(r.metric, r.step): r["rank"] for r in trends.ranked(df, ["metric"], ["step"], width=11).collect()}
    assert got == {**{("a", s * 3): s for s in range(57)}, **{("b", s * 3): s for s in range(5)}}


def test_only_the_newest_rows_are_shuffled(spark):
    plan = trends.last_values(series(spark, {"a": 5}), 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    plan = trends.trim_history(series(spark, {"a": 5}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_running_accuracy(spark):
    rows = [("r", s, 4.0 if (s + k) % 3 else 0.0) for s in range(12) for k in range(2)]
    df = spark.createDataFrame(rows, "run string, step bigint, correctness double")
    got = {r.step: r for r in trends.running_accuracy(df, 12, width=5).collect()}
    right = total = 0
    for s in range(12):
        right += sum(1 for _, step, c in rows if step == s and c > 0)
        total += 2
        assert (got[s].correct_answers, got[s].total_answers) == (right, total)
        assert (got[s].accuracy, got[s].progress_percent) == pytest.approx((right / total * 100, s / 12 * 100))


def test_validation_report(spark):
    rows = [(i, "q", "5", "<answer> 5</answer>" if i % 2 else "<reasoning>x") for i in range(30)]
    rows += [(90, "", "5", "5"), (91, None, "5", "5"), (92, "q", "5", None), (93, "q", "a B", " A b\n")]
    df = spark.createDataFrame(rows, "id bigint, input string, expected string, output string")
    r = reports.validation_report(df, "id").first()
    assert (r.correct, r.total, r.accuracy) == (16, 31, 16 / 31)
    assert (r.missing_reasoning_tag, r.missing_answer_tag, r.malformed_tags) == (16, 16, 15)
    assert [e.id for e in r.errors] == [2 * i for i in range(10)]
    empty = reports.validation_report(df.where("false"), "id").first()
    assert (empty.correct, empty.total, empty.accuracy, empty.errors) == (0, 0, 0.0, [])


def test_run_comparison_keeps_questions_of_one_run(spark):
    rows = [("base", 1, "q", "5", "it is 5."), ("tuned", 1, "q", "5", "4 or -5"), ("tuned", 2, "p", "7", "none")]
    df = reports.evaluated(spark.createDataFrame(rows, "run string, sample_id bigint, question string, answer string, model_output string"))
    pairs = {r.sample_id: r for r in reports.side_by_side(df, "base", "tuned").collect()}
    assert (pairs[1].base_model_answer, pairs[1].tuned_model_correct) == (5.0, True)
    assert (pairs[2].question, pairs[2].base_model_output, pairs[2].tuned_model_correct) == ("p", None, False)
    report = reports.comparison_report(df, "base", "tuned", F.lit("now")).first()
    assert (report.base_model_accuracy, report.tuned_model_accuracy, report.number_of_examples) == (1.0, 0.5, 1)
    assert [e.sample_id for e in report.example_comparisons] == [1, 2]


def test_attempts(spark):
    rows = [(1, 1, True, "a"), (1, 2, True, "b"), (2, 1, False, "c"), (3, 4, True, "d")]
    df = spark.createDataFrame(rows, "id bigint, attempt bigint, is_valid boolean, equation string")
    assert [tuple(r) for r in pairing.latest_valid(df, "id").select("id", "attempt", "equation").collect()] == [(1, 2, "b")]
    problems = df.select("id").distinct()
    assert {r.id for r in pairing.retry_set(problems, df, "id").collect()} == {2, 3}


def test_single_prompt_serves_all(spark):
    df = spark.createDataFrame([("x",), ("y",)], "t string")
    prompts = spark.createDataFrame([("p",)], "question string")
    assert {tuple(r) for r in pairing.with_single_prompt(df, prompts).collect()} == {("x", "p"), ("y", "p")}


def test_counts_and_sets(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "k string, v string")
    assert [tuple(r) for r in datasets.value_counts(df, ["k", "v"]).collect()] == [
        ("k", "a", 2), ("k", "b", 1), ("v", "x", 2), ("v", "y", 1)]
    spot = [datasets.spot_check(df, "k", seed=3).first() for _ in range(2)]
    assert spot[0] == spot[1]
    logs = datasets.union_logs(df, spark.createDataFrame([("c", 1.0)], "k string, r double"))
    assert {tuple(r) for r in logs.where("k = 'c'").collect()} == {("c", None, 1.0)}
    assert [tuple(r) for r in datasets.schema_rows(df).collect()] == [("k", "string"), ("v", "string")]


def test_metric_tags_by_type(spark):
    df = spark.createDataFrame([(3, 1.5, [1.0, 2.0], "text", "other")],
                               "step bigint, loss double, values array<double>, output string, note string")
    with pytest.raises(ValueError, match="note"):
        metrics.metric_tags(df)
    got = {(r.tag, r.kind): (r.step, r.number, r.text, r.numbers) for r in metrics.metric_tags(df, left_out=("note",)).collect()}
    assert got == {
        ("metrics/loss", "scalar"): (3, 1.5, None, None), ("text/output", "text"): (3, None, "text", None),
        ("distributions/values", "histogram"): (3, None, None, [1.0, 2.0]),
    }


def test_a_hot_group_is_split_over_tasks(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        i = F.col("id")
        df = spark.range(300_000, numPartitions=8).select(
            F.when(i % 3 == 0, 0).otherwise(i % 5000).alias("g"), F.sha1(i.cast("string")).alias("model_output"),
            (i % 7).cast("double").alias("total_reward"),
        )
        judged = metrics.group_advantage(df, ["g"]).agg(F.sum("advantage"), F.max("model_output"), F.count("*"))
        assert judged.collect()[0][2] == 300_000
        assert "skew=true" in judged._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_hovering_metric_is_not_sorted_in_one_task(spark):
    """A million distinct values that differ little are cut into cells before any are put in order."""
    values = spark.range(200_000).select(F.lit("m").alias("metric"), (1000 + F.col("id") / 400_000).alias("value"))
    found = metrics.statistics(values, ["metric"])
    assert found.first().median == pytest.approx(1000 + 99_999.5 / 400_000, abs=1e-9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan


def test_positions_inside_one_crowded_step(spark):
    """All rows of a step share its range; they are put in order in cells of the second column."""
    rows = spark.range(300_000).select(F.lit("m").alias("metric"), F.lit(7).alias("step"), (F.col("id") * 7 % 300_007).alias("i"))
    found = trends.ranked(rows, ["metric"], ["step", "i"], width=1000)
    wanted = rows.selectExpr("i", "row_number() over (order by i) - 1 as want")
    assert found.join(wanted, "i").where("rank <> want").isEmpty() and found.count() == 300_000
    cells = trends._dense_cells(rows.withColumn("__range", F.lit(0)), ["metric"], ["step", "i"], 1000)
    sizes = [r["count"] for r in cells.groupBy("__cell").count().collect()]
    assert len(sizes) == trends.CELLS and max(sizes) < 100


def test_automatic_bins_are_those_of_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(size=3000), "skewed": rng.exponential(size=700) ** 3, "ties": rng.integers(0, 4, 500).astype(float),
        "flat": np.full(20, 2.5), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "spike": np.append(np.zeros(400), [1.0, 9.0]), "wide": rng.normal(size=50) * 1e9,
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("normal", None)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(3)
    got = {}
    for r in metrics.automatic_histogram(df, ["k"]).collect():
        got.setdefault(r.k, {})[r.bin] = (r.bins, r.edge, r.n)
    for k, values in groups.items():
        n, edges = np.histogram(values, bins="auto")
        assert {b: x[2] for b, x in got[k].items()} == {i: c for i, c in enumerate(n.tolist()) if c}, k
        assert all(x[0] == len(n) and x[1] == pytest.approx(edges[b]) for b, x in got[k].items())
    whole = metrics.automatic_histogram(df.where("k = 'normal'")).collect()
    assert sum(r.n for r in whole) == 3000 and whole[0].bins == len(np.histogram(groups["normal"], bins="auto")[0])


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=999), "b": rng.integers(0, 3, 100).astype(float), "c": np.array([4.0]), "d": np.array([-1.0, 5.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x], "k string, value double")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    for r in metrics.ranked_values(df, ["k"], shares).collect():
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(groups[r.k], shares).tolist())

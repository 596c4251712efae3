import math

import pytest
from pyspark.sql import functions as F

from rewardloom.operators import trends
from rewardloom.session import work_dir
from rewardloom.streaming import jobs
from rewardloom.streaming.tables import StateTable


def incoming(spark, df, files):
    path = work_dir(spark, "incoming")
    df.coalesce(1).write.option("maxRecordsPerFile", -(-df.count() // files)).parquet(path)
    return jobs.read_stream(spark, path, df.schema, max_files=1)


def test_running_trend_over_batches_equals_the_batch_trend(spark):
    rows = [(m, s, math.sin(s) * s) for s in range(300) for m in ("a", "b") if m == "a" or s < 2]
    df = spark.createDataFrame(rows, "metric string, step bigint, value double").withColumn("ts", F.timestamp_seconds(F.col("step") + 1_700_000_000))
    out = work_dir(spark, "trends")
    stream = jobs.running_trends(incoming(spark, df, 4), window=50, history=120)
    jobs.updates_stream(stream, out, work_dir(spark, "checkpoint"), ("metric",)).awaitTermination()
    got = {r.metric: r for r in jobs.latest_updates(spark, out, ("metric",)).collect()}
    for want in trends.trends(df, 50).collect():
        for field in ("mean", "median", "min", "max", "std", "count", "trend"):
            assert got[want.metric][field] == pytest.approx(want[field], abs=1e-9), field
    assert spark.read.parquet(out).select("batch_id").distinct().count() > 1


def deliver(spark, path, rows, kinds):
    spark.createDataFrame(rows, kinds).withColumn("ts", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(path)


KINDS = "metric string, step bigint, value double, t string"


def test_a_silent_metric_expires_and_a_restart_goes_on(spark):
    path, out, checkpoint = (work_dir(spark, n) for n in ("incoming", "trends", "checkpoint"))

    def run(rows):
        deliver(spark, path, rows, KINDS)
        stream = jobs.read_stream(spark, path, spark.read.parquet(path).schema)
        # Every run is a new query that goes on from the checkpoint.
        trend = jobs.running_trends(stream, window=3, history=4, late="1 hour", silent="2 days")
        jobs.updates_stream(trend, out, checkpoint, ("metric",)).awaitTermination()
        return {r.metric: (r["count"], r["mean"], r["max"]) for r in jobs.latest_updates(spark, out, ("metric",)).collect()}

    first = run([(m, s, float(s), f"2024-01-01 0{s}:00:00") for m in "ab" for s in range(3)])
    assert first == {"a": (3, 1.0, 2.0), "b": (3, 1.0, 2.0)}
    # A value between the steps that are held takes its place; the oldest of the window goes.
    assert run([("a", 5, 50.0, "2024-01-02 00:00:00"), ("a", 1, 7.0, "2024-01-02 00:00:00")])["a"] == (3, (2 + 7 + 50) / 3, 50.0)
    run([("a", 6, 6.0, "2024-01-09 00:00:00")])
    last = run([("a", 7, 7.0, "2024-01-09 01:00:00")])
    assert last == {"a": (3, (50 + 6 + 7) / 3, 50.0), "b": (0, None, None)}


def test_what_is_read_does_not_grow_with_the_batches(spark):
    table = StateTable(spark, work_dir(spark, "state"), ("k",), buckets=4)
    schema = "k bigint, n bigint"
    for n in range(12):
        table.write(spark.createDataFrame([(k, n) for k in range(n, n + 20)], schema), n)
    want = {k: min(k, 11) for k in range(31)}
    assert {r.k: r.n for r in table.read().collect()} == want
    assert len(table.read().inputFiles()) <= 4
    assert len(spark.read.parquet(table.path).inputFiles()) <= 12
    # A batch that is run again replaces itself.
    table.write(spark.createDataFrame([(k, 11) for k in range(11, 31)], schema), 11)
    assert {r.k: r.n for r in table.read().collect()} == want
    table.write(spark.createDataFrame([(None, 1), (1, 7)], schema), 12)
    table.write(spark.createDataFrame([(None, 2)], schema), 13)
    assert {r.k: r.n for r in table.read().collect()} == {**want, 1: 7, None: 2}


def test_running_medians_keep_their_bound(spark):
    df = spark.range(60_000).select(F.lit("r").alias("run"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("value"))
    out = work_dir(spark, "running")
    jobs.updates_stream(jobs.running_statistics(incoming(spark, df, 3), ("run",)), out, work_dir(spark, "checkpoint"), ("run",)).awaitTermination()
    got = jobs.latest_updates(spark, out, ("run",)).first()
    rank = df.where(F.col("value") <= got["median"]).count()
    assert abs(rank - 30_000) <= 60_000 / jobs.RANKS + 1
    exact = df.agg(F.avg("value"), F.min("value"), F.max("value"), F.stddev_pop("value"), F.count("*")).first()
    assert (got["min"], got["max"], got["n"]) == (exact[1], exact[2], exact[4])
    assert got["mean"] == pytest.approx(exact[0]) and got["std"] == pytest.approx(exact[3])


def test_late_rows_are_dropped_and_windows_updated(spark):
    rows = [("m", f"2024-01-0{d} 0{h}:00:00", float(h)) for d in (1, 2, 3) for h in range(3)]
    path, out, checkpoint = (work_dir(spark, n) for n in ("incoming", "windows", "checkpoint"))

    def deliver(batch):
        df = spark.createDataFrame(batch, "metric string, t string, value double").withColumn("ts", F.to_timestamp("t"))
        df.write.mode("append").parquet(path)
        stream = jobs.read_stream(spark, path, df.schema).select("metric", "ts", "value")
        jobs.updates_stream(jobs.windowed_metrics(stream, late="6 hours"), out, checkpoint, ("window_start", "metric")).awaitTermination()

    deliver(rows)
    deliver([("m", "2024-01-01 05:00:00", 9.0), ("m", "2024-01-03 05:00:00", 9.0)])
    got = {str(r.window_start)[:10]: (r.n, r.max) for r in
           jobs.latest_updates(spark, out, ("window_start", "metric")).collect()}
    assert got == {"2024-01-01": (3, 2.0), "2024-01-02": (3, 2.0), "2024-01-03": (4, 9.0)}


def test_redelivered_rows_are_dropped_within_the_watermark(spark):
    rows = spark.createDataFrame(
        [("r", 1, f"q{i % 5}", "2024-01-01 00:00:00") for i in range(20)],
        "run string, global_step bigint, question_id string, t string",
    ).withColumn("timestamp", F.to_timestamp("t"))
    once = jobs.without_redelivery(incoming(spark, rows, 3))
    out, keys = work_dir(spark, "once"), ("question_id",)
    jobs.updates_stream(once, out, work_dir(spark, "checkpoint"), keys).awaitTermination()
    assert sorted(r.question_id for r in jobs.latest_updates(spark, out, keys).collect()) == [f"q{i}" for i in range(5)]


def test_no_delivered_row_is_lost(spark):
    path, out, checkpoint = (work_dir(spark, n) for n in ("incoming", "judged", "checkpoint"))
    kinds = "id bigint, k string, output string, t string"

    def run(rows):
        deliver(spark, path, rows, kinds)
        stream = jobs.read_stream(spark, path, spark.read.parquet(path).schema)
        jobs.delivery_stream(stream, out, checkpoint, ("k",), "ts", "1 day", F.col("output").isNull()).awaitTermination()

    run([(1, "a", "x", "2024-01-05 00:00:00"), (2, "a", "x", "2024-01-05 01:00:00"), (3, None, "x", None), (4, "b", None, "2024-01-05 00:00:00")])
    run([(5, "a", "x", "2024-01-05 02:00:00"), (6, "b", "x", "2024-01-05 02:00:00"), (7, "c", "x", "2024-01-03 00:00:00"), (8, None, "x", None)])
    run([(9, "d", "x", "2024-01-20 00:00:00")])
    run([(10, "a", "x", "2024-01-20 00:00:00"), (11, "d", "x", "2024-01-20 00:00:00"), (12, "a", "x", "2024-01-06 00:00:00")])
    got = {r.id: r.outcome for r in jobs.delivered(spark, out).collect()}
    late, twice, kept = "late", "repeated", "on_time"
    # The state has forgotten key a by the last batch, as the watermark has passed it.
    assert got == {1: kept, 2: twice, 3: kept, 4: "failed", 5: twice, 6: kept, 7: late, 8: twice, 9: kept, 10: kept, 11: twice, 12: late}
    assert tuple(jobs.delivery_counts(spark, out).first()) == (5, 2, 4, 1)


def test_reports_of_boundaries_are_corrected_and_given_again(spark):
    path, out, checkpoint = (work_dir(spark, n) for n in ("incoming", "reports", "checkpoint"))
    kinds, seen = "run string, step bigint, sample_id bigint, input string, expected string, output string, t string", []

    def run(steps, run="a", good=True):
        rows = [(run, s, 1000 - s, "q", "5", "<answer>5</answer>" if good else None if s % 2 else "no", "2024-01-01 00:00:00") for s in steps]
        deliver(spark, path, rows, kinds)
        stream = jobs.read_stream(spark, path, spark.read.parquet(path).schema)
        seen.clear()
        query = jobs.validation_stream(stream, out, checkpoint, 10, on_report=lambda r: seen.extend((x.run, x.boundary, x.correct, x.total) for x in r.collect()))
        query.awaitTermination()
        state = jobs.latest_updates(spark, out, ("run", "boundary"))
        return {(r.run, r.boundary): (r.correct, r.total, r.fresh) for r in state.collect()} if state else {}

    assert run(range(7)) == {} and seen == []
    assert run(range(7, 12)) == {("a", 0): (10, 10, True)} and seen == [("a", 0, 10, 10)]
    # Nothing is closed: the report before is given again.
    assert run([13]) == {("a", 0): (10, 10, False)} and seen == []
    assert run([3, 4], good=False)[("a", 0)] == (10, 11, True) and seen == [("a", 0, 10, 11)]
    assert run([25], run="b") == {("a", 0): (10, 11, True)}
    run([30])
    assert sorted(seen) == [("a", 10, 3, 3)]
    first = [r for r in jobs.latest_updates(spark, out, ("run", "boundary")).collect() if r.boundary == 0][0]
    assert [e.sample_id for e in first.errors] == [996, 997] and first.missing_answer_tag == 2


def test_every_batch_is_validated_and_reported(spark):
    rows = [(i, "q", "5", "<answer>5</answer>" if i % 4 else "no") for i in range(12)]
    df = spark.createDataFrame(rows, "sample_id bigint, input string, expected string, output string")
    seen = []
    out = work_dir(spark, "reports")
    jobs.periodic_validation(
        incoming(spark, df, 3), out, work_dir(spark, "checkpoint"), on_report=lambda r: seen.append(r.first().total)
    ).awaitTermination()
    assert seen == [4, 4, 4]
    assert spark.read.parquet(out).agg(F.sum("correct")).first()[0] == 9


def test_generations_arrive_in_a_file_for_every_core_and_batch(spark):
    """Four files and two a trigger left all cores but two idle, however large the table."""
    from pathlib import Path

    from rewardloom.plans.fixtures import Tables
    from rewardloom.plans.stream_queries import FILE_ROWS, generation_stream

    t = Tables(spark, "/root/testdata/sf0.01")
    folders = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("rewardloom/incoming-*"))
    generation_stream(t)
    (new,) = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("rewardloom/incoming-*")) - folders
    written = spark.read.parquet(str(new))
    assert len(list(new.glob("*.parquet"))) == 2 * max(2, spark.sparkContext.defaultParallelism)
    assert written.count() == t.generations.count() and FILE_ROWS >= written.groupBy(F.input_file_name()).count().agg(F.max("count")).head()[0]

"""Structured Streaming jobs over a growing table of generations or metric values."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rewardloom.operators.keys import join_on
from rewardloom.operators.reports import MAX_ERRORS, sample_flags, validation_report
from rewardloom.operators.scoring import score
from rewardloom.operators.trends import HISTORY, WINDOW
from rewardloom.profiles import V2, Profile
from rewardloom.streaming.state import SUMS, Reports, Trends, merged, use_rocksdb
from rewardloom.streaming.tables import StateTable, newest_batch


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, max_files: int = 1000
) -> DataFrame:
    """New Parquet files below ``path``; ``max_files`` per trigger bounds a micro-batch, nothing is dropped."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def _each_batch(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def _batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to a folder of its own: a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def scoring_stream(
    generations: DataFrame, path: str, checkpoint: str, profile: Profile = V2
) -> StreamingQuery:
    """Score new generations and append them to ``path``. Stateless; rewards are those of the batch job."""
    return _each_batch(score(generations, profile=profile), _batch_folder(path), checkpoint)


#: What becomes of a delivered row; all but the first are set aside.
ON_TIME, LATE, REPEATED, FAILED = "on_time", "late", "repeated", "failed"


def delivery_stream(
    rows: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...], ts: str = "timestamp", late: str = "1 day",
    failed: Column | None = None,
) -> StreamingQuery:
    """Judge every delivered row and keep it below ``path/judged`` with its ``outcome``: none is lost.

    A row behind the watermark (the newest ``ts`` of earlier batches less ``late``) is late, one with the keys of a row that
    was on time is repeated, and one for which ``failed`` holds is failed; the first row of a key by ``ts`` is the one kept. Rows
    without ``ts`` are never late. Keys are remembered in a state table until the watermark has passed them. The counts of every
    batch are observed while it is written and kept below ``path/counts``.
    """
    names = (ON_TIME, LATE, REPEATED, FAILED)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen_table = StateTable(spark, f"{path}/seen", keys)
        counts = newest_batch(spark, f"{path}/counts", batch_id)
        before = spark.read.parquet(counts).first()["newest"] if counts else None
        watermark = F.lit(before).cast("timestamp") - F.expr(f"interval {late}")
        behind = F.coalesce(F.col(ts).cast("timestamp") < watermark, F.lit(False))
        bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
        marked = batch.withColumn("outcome", F.when(bad, FAILED).when(behind, LATE))
        order = Window.partitionBy(*keys, "outcome").orderBy(ts, F.xxhash64(*batch.columns))
        marked = marked.withColumn("_at", F.row_number().over(order))
        seen = seen_table.read(before=batch_id)
        if seen is None:
            known = F.lit(False)
        else:
            # Keys that the watermark has passed may still lie in buckets no batch has written since.
            seen = seen.where(F.coalesce(F.col("_ts") >= watermark, F.lit(True)))
            marked = join_on(marked, seen.select(*keys, F.lit(True).alias("_seen")), list(keys), "left")
            known = F.coalesce("_seen", F.lit(False))
        outcome = F.coalesce("outcome", F.when((F.col("_at") > 1) | known, REPEATED).otherwise(ON_TIME))
        judged = marked.withColumn("outcome", outcome).select(*batch.columns, "outcome")
        observed = Observation(f"delivery-{batch_id}")
        metrics = [F.count_if(F.col("outcome") == name).alias(name) for name in names]
        judged = judged.observe(observed, *metrics, F.max(F.col(ts).cast("timestamp")).alias("newest"))
        folder = f"{path}/judged/batch_id={batch_id}"
        judged.write.mode("overwrite").partitionBy("outcome").parquet(folder)
        found = observed.get
        newest = max((x for x in (before, found["newest"]) if x is not None), default=None)
        row = spark.createDataFrame([(*[found[name] for name in names], newest)], f"{', '.join(f'{n} long' for n in names)}, newest timestamp")
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch_id={batch_id}")
        kept = spark.read.schema(judged.schema).parquet(folder).where(F.col("outcome") == ON_TIME)
        seen_table.write(kept.select(*keys, F.col(ts).cast("timestamp").alias("_ts")), batch_id, F.col("_ts") >= watermark)

    return _each_batch(rows, write, checkpoint)


def delivered(spark: SparkSession, path: str, *outcomes: str) -> DataFrame:
    """The rows of a :func:`delivery_stream` with these outcomes, or all of them."""
    rows = spark.read.option("basePath", f"{path}/judged").parquet(f"{path}/judged").drop("batch_id")
    return rows.where(F.col("outcome").isin(*outcomes)) if outcomes else rows


def delivery_counts(spark: SparkSession, path: str) -> DataFrame:
    """How many rows had each outcome, over all batches."""
    return spark.read.parquet(f"{path}/counts").agg(*[F.sum(n).alias(n) for n in (ON_TIME, LATE, REPEATED, FAILED)])


#: The rank of a running median is within one part in so many of the rows from the exact one; up to so many rows it is exact.
RANKS = 10_000


def _running(value: str) -> list[Column]:
    """Statistics whose states merge. The median is that of a quantile summary of bounded size, the lower of two middle ones."""
    return [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.percentile_approx(value, 0.5, RANKS).alias("median"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_pop(value).alias("std"),
    ]


RUNNING = ("n", "mean", "median", "min", "max", "std")


def windowed_metrics(metrics: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Statistics per time window and metric; rows later than the watermark are dropped (see :func:`delivery_stream`)."""
    return (
        metrics.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "metric")
        .agg(*_running("value"))
        .select(F.col("window.start").alias("window_start"), "metric", *RUNNING)
    )


def running_statistics(values: DataFrame, keys: tuple[str, ...] = ("run", "step", "reward_name"), value: str = "value") -> DataFrame:
    """Statistics so far per key, with the median of a mergeable summary; the state is one summary per key."""
    return values.groupBy(*keys).agg(*_running(value))


def running_counts(scored: DataFrame, keys: tuple[str, ...] = ("run", "step")) -> DataFrame:
    """Correct and total answers so far per key; the state is two numbers per key."""
    return scored.groupBy(*keys).agg(
        F.count_if(F.col("correctness") > 0).alias("correct"), F.count("*").alias("total")
    )


def updates_stream(aggregated: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...]) -> StreamingQuery:
    """Keep the newest row of every key; the changed ones of a micro-batch replace those before them."""
    return _each_batch(aggregated, lambda batch, n: StateTable(batch.sparkSession, path, keys).write(batch, n), checkpoint, "update")


def latest_updates(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame | None:
    """The state an :func:`updates_stream` has reached, if there is any. What is read does not grow with the number of batches."""
    return StateTable(spark, path, keys).read()


def running_trends(
    metrics: DataFrame, window: int = WINDOW, history: int = HISTORY, late: str = "1 day", silent: str = "30 days"
) -> DataFrame:
    """Trend of each metric over its newest values, updated by every micro-batch.

    The state of a metric is its newest ``history`` values, of which a batch writes the new ones only. They are found before the
    shuffle, so a metric with a large part of all rows sends no more than ``history`` rows per task to the one that holds
    its state. A metric without a row for as long as ``silent`` of event time has no values any more: its count is 0.
    """
    use_rocksdb(metrics.sparkSession)
    wanted = metrics.select("metric", F.col("step").cast("bigint"), F.col("value").cast("double"), F.col("ts").cast("timestamp"))

    def newest_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for rows in batches:
            both = rows if kept is None else pd.concat([kept, rows])
            kept = both.sort_values("step").groupby("metric", sort=False).tail(history)
        if kept is not None:
            yield kept

    fields = "mean double, median double, min double, max double, std double, count bigint, trend double"
    processor = Trends(window, history, int(pd.Timedelta(silent).total_seconds() * 1000))
    return (
        wanted.mapInPandas(newest_only, "metric string, step bigint, value double, ts timestamp")
        .withWatermark("ts", late)
        .groupBy("metric")
        .transformWithStateInPandas(processor, f"metric string, {fields}", "Update", "EventTime")
    )


EVERY = 250
REPORT = ("correct", "total", "accuracy", "avg_generation_time", "avg_output_length", "missing_reasoning_tag", "missing_answer_tag", "malformed_tags")


def validation_by_step(
    samples: DataFrame, every: int = EVERY, order: str = "sample_id", run: str = "run", max_errors: int = MAX_ERRORS
) -> DataFrame:
    """A validation report of every ``every`` steps of a run, as soon as the run has a step behind them.

    ``boundary`` is the first step. A batch that closes no boundary gives the previous report again, as not ``fresh``; samples that
    come behind their report give it anew. Tasks sum their samples and keep the first errors before the shuffle.
    """
    use_rocksdb(samples.sparkSession)
    boundary = F.expr(f"step div {every} * {every}").alias("boundary")
    flags = sample_flags(samples.select(run, "step", order, "input", "expected", "output", *[c for c in ("generation_time",) if c in samples.columns]), order)
    wanted = flags.select(F.col(run).alias("key"), boundary, F.col("step").cast("long").alias("step"), "is_correct", "seconds", "words", *SUMS[-3:], "error")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for rows in batches:
            for key, part in rows.groupby(["key", "boundary"], dropna=False):
                known = part["is_correct"].dropna().astype(bool)
                timed, words = part["seconds"].dropna(), part["words"].dropna()
                sums = [known.sum(), len(known), timed.sum(), len(timed), words.sum(), len(words), *[part[c].sum() for c in SUMS[-3:]]]
                errors = [json.loads(e) for e in part["error"].dropna()]
                now = merged([([float(x) for x in sums], errors)], order, max_errors)
                newest, before = held.get(key, (-1, None))
                held[key] = max(newest, int(part["step"].max())), merged([before, now], order, max_errors) if before else now
        if held:
            parts = [(k, b, n, json.dumps(s), json.dumps(e)) for (k, b), (n, (s, e)) in held.items()]
            yield pd.DataFrame(parts, columns=["key", "boundary", "newest", "sums", "errors"])

    kind = samples.schema[run].dataType.simpleString()
    given = (
        wanted.mapInPandas(summed, f"key {kind}, boundary long, newest long, sums string, errors string")
        .groupBy("key")
        .transformWithStateInPandas(Reports(every, order, max_errors), f"key {kind}, boundary long, fresh boolean, sums string, errors string", "Update", "None")
    )
    s = F.from_json("sums", "array<double>")
    total = {name: F.get(s, i) for i, name in enumerate(SUMS)}

    def mean(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(total[a], total[b]), F.lit(0.0))

    counts = {c: total[c].cast("long") for c in ("correct", "total", *SUMS[-3:])}
    means = {"accuracy": mean("correct", "total"), "avg_generation_time": mean("seconds", "timed"), "avg_output_length": mean("words", "outputs")}
    error = f"array<struct<{order}: {samples.schema[order].dataType.simpleString()}, input: string, expected: string, output: string, answer: string>>"
    columns = {**counts, **means}
    return given.select(F.col("key").alias(run), "boundary", "fresh", *[columns[c].alias(c) for c in REPORT], F.from_json("errors", error).alias("errors"))


def periodic_validation(
    samples: DataFrame, path: str, checkpoint: str, order: str = "sample_id",
    on_report: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """A validation report for each batch of new samples. A query runs one batch at a time, so reports never overlap.

    ``on_report`` is called with each stored report.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{path}/batch_id={batch_id}"
        report = validation_report(batch, order)
        report.write.mode("overwrite").parquet(folder)
        if on_report:
            on_report(batch.sparkSession.read.schema(report.schema).parquet(folder))

    return _each_batch(samples, write, checkpoint)


def validation_stream(
    samples: DataFrame, path: str, checkpoint: str, every: int = EVERY, order: str = "sample_id", run: str = "run",
    on_report: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Keep the newest report of every boundary (:func:`validation_by_step`). ``on_report`` is called with the fresh reports of
    each batch that has any; it may be called again with the same ones where a batch is run again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        StateTable(batch.sparkSession, path, (run, "boundary")).write(batch, batch_id)
        fresh = batch.where("fresh")
        if on_report and not fresh.isEmpty():
            on_report(fresh)
        batch.unpersist()

    return _each_batch(validation_by_step(samples, every, order, run), write, checkpoint, "update")


def without_redelivery(
    generations: DataFrame, ts: str = "timestamp", late: str = "1 day", keys=("question_id", "run", "global_step")
) -> DataFrame:
    """Drop rows that arrive again within the watermark."""
    return generations.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))

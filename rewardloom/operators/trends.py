"""Time series of metrics by step: last values, trends, moving averages, running totals.

A metric may hold a large part of all rows, so no window runs over a whole metric. Last-N windows are cut down by
Spark before the shuffle; all others run inside step ranges (``width`` steps each, those with many rows cut again) and
are stitched together from the totals of the ranges, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 100
HISTORY = 1000
WIDTH = 100_000
# A range with more rows than its width is cut into as many cells.
CELLS = 4096


def _position(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first)))


def last_values(
    df: DataFrame, n: int = WINDOW, keys: list[str] = ("metric",), order: list[str] = ("step",)
) -> DataFrame:
    """The ``n`` newest rows of every metric. Each task keeps at most ``n`` rows per metric before the shuffle.

    ``order`` should name every row of a metric once (step, then sequence); rows that tie may come in either order.
    """
    newest = [F.col(c).desc() for c in order]
    return _position(df, list(keys), newest).where(F.col("__at") <= n).drop("__at")


def trim_history(
    df: DataFrame, n: int = HISTORY, keys: list[str] = ("metric",), order: list[str] = ("step",)
) -> DataFrame:
    return last_values(df, n, keys, order)


def trends(
    df: DataFrame, n: int = WINDOW, keys: list[str] = ("metric",), order: list[str] = ("step",), value: str = "value"
) -> DataFrame:
    """Statistics and least-squares slope of the last ``n`` values against their position, not the step."""
    newest = [F.col(c).desc() for c in order]
    recent = _position(df, list(keys), newest).where(F.col("__at") <= n)
    # Positions count down from the newest; only the sign of the slope depends on that.
    slope = -F.regr_slope(F.col(value), F.col("__at").cast("double"))
    return recent.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.median(value).alias("median"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_pop(value).alias("std"),
        F.count("*").alias("count"),
        F.coalesce(slope, F.lit(0.0)).alias("trend"),
    )


def _with_range_totals(df: DataFrame, keys: list[str], step: str, width: int, **sums: Column) -> DataFrame:
    """Add the step range ``__range`` and, for each of ``sums``, its total over all earlier ranges of the group."""
    ranged = df.withColumn("__range", F.floor(F.col(step) / width))
    totals = ranged.groupBy(*keys, "__range").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__range", *[F.sum(name).over(earlier).alias(name) for name in sums])
    # The windows that follow run inside (group, range): where the offsets are too many to broadcast, the join's
    # partitioning serves them too.
    joined = ranged.join(offsets, [*keys, "__range"], "left")
    return joined.withColumns({name: F.coalesce(name, F.lit(0)) for name in sums})


def _number(df: DataFrame, name: str) -> Column:
    """A number that orders rows as the column does, or a constant where its type is no number and no time."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.col(name).cast("double")
    return F.lit(0.0)


def _dense_cells(df: DataFrame, keys: list[str], order: list[str], width: int) -> DataFrame:
    """Add ``__cell``: ranges with more than ``width`` rows are cut in order, by the first column of ``order``, or by the
    second where the first has one value there; other ranges are one cell."""
    first, second = _number(df, order[0]), _number(df, order[min(1, len(order) - 1)])
    ends = [f(c).alias(n) for n, f, c in (
        ("__lo1", F.min, first), ("__hi1", F.max, first), ("__lo2", F.min, second), ("__hi2", F.max, second))]
    spans = df.groupBy(*keys, "__range").agg(F.count("*").alias("__n"), *ends)
    joined = df.join(spans, [*keys, "__range"], "left")

    def cell(value: Column, lo: str, hi: str) -> Column:
        share = (value - F.col(lo)) / (F.col(hi) - F.col(lo))
        return F.least(F.floor(share * CELLS), F.lit(CELLS - 1).cast("bigint"))

    dense = F.col("__n") > width
    chosen = (
        F.when(dense & (F.col("__hi1") > F.col("__lo1")), cell(first, "__lo1", "__hi1"))
        .when(dense & (F.col("__hi2") > F.col("__lo2")), cell(second, "__lo2", "__hi2"))
        .otherwise(F.lit(0).cast("bigint"))
    )
    return joined.withColumn("__cell", chosen).drop("__n", "__lo1", "__hi1", "__lo2", "__hi2")


def ranked(
    df: DataFrame, keys: list[str], order: list[str], step: str = "step", width: int = WIDTH, name: str = "rank"
) -> DataFrame:
    """Add the 0-based position of each row in its group. Rows are put in order inside cells of step ranges only."""
    keys, order = list(keys), list(order)
    cells = _dense_cells(df.withColumn("__range", F.floor(F.col(step) / width)), keys, order, width)
    totals = cells.groupBy(*keys, "__range", "__cell").agg(F.count("*").alias("__k"))
    earlier = Window.partitionBy(*keys).orderBy("__range", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__range", "__cell", F.sum("__k").over(earlier).alias("__before"))
    inside = Window.partitionBy(*keys, "__range", "__cell").orderBy(*order)
    return (
        cells.join(offsets, [*keys, "__range", "__cell"], "left")
        .withColumn(name, (F.coalesce("__before", F.lit(0)) + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("__before", "__range", "__cell")
    )


def moving_average(
    df: DataFrame,
    n: int = WINDOW,
    keys: list[str] = ("metric",),
    order: list[str] = ("step",),
    value: str = "value",
    width: int = WIDTH,
) -> DataFrame:
    """Average and slope of the last ``n`` values up to each row; values are never NULL in a metric's history.

    Rows are cut into blocks by position; the last ``n - 1`` rows of a block are copied into the next one, so every
    frame is whole inside one block and a long series is spread over many tasks.
    """
    keys, order = list(keys), list(order)
    block = max(width, n)
    positions = ranked(df, keys, order, order[0], width, "__rank")
    home = F.floor(F.col("__rank") / block)
    in_tail = F.pmod(F.col("__rank"), F.lit(block)) > block - n
    copies = F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home))
    spread = positions.withColumn("__home", home).withColumn("__block", F.explode(copies))
    frame = Window.partitionBy(*keys, "__block").orderBy("__rank").rowsBetween(1 - n, 0)
    # The slope against consecutive positions needs one more sum only: the spread of the positions is known.
    at = F.pmod(F.col("__rank"), F.lit(block)) + F.when(F.col("__home") < F.col("__block"), 0).otherwise(block)
    held = F.least(F.col("__rank") + 1, F.lit(n))
    tilt = F.col("__weighted") - (at - (held - 1) / 2) * F.col("moving_average") * held
    slope = F.when(held > 1, tilt * 12 / (held * (held * held - 1))).otherwise(0.0)
    return (
        spread.withColumns({
            "moving_average": F.avg(value).over(frame),
            "__weighted": F.sum(F.col(value) * at).over(frame),
        })
        .where(F.col("__home") == F.col("__block"))
        .withColumn("moving_slope", slope)
        .drop("__rank", "__home", "__block", "__weighted")
    )


def running_accuracy(
    df: DataFrame, max_steps: int, keys: list[str] = ("run",), reward: str = "correctness", width: int = WIDTH
) -> DataFrame:
    """Cumulative correct and total answers, accuracy and progress per step, in percent."""
    keys = list(keys)
    per_step = df.groupBy(*keys, "step").agg(
        F.count_if(F.col(reward) > 0).alias("c"), F.count("*").alias("t")
    )
    upto = Window.partitionBy(*keys, "__range").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    summed = _with_range_totals(per_step, keys, "step", width, __c=F.col("c"), __t=F.col("t"))
    return (
        summed.withColumns({
            "correct_answers": (F.col("__c") + F.sum("c").over(upto)).cast("bigint"),
            "total_answers": (F.col("__t") + F.sum("t").over(upto)).cast("bigint"),
        })
        .select(
            *keys,
            "step",
            "correct_answers",
            "total_answers",
            (F.col("correct_answers") / F.col("total_answers") * 100).alias("accuracy"),
            (F.col("step") / max_steps * 100).alias("progress_percent"),
        )
    )


def auto_step(
    df: DataFrame, keys: list[str] = ("tag",), order: list[str] = ("ts", "id"), bucket: Column | None = None,
    width: int = 600,
) -> DataFrame:
    """Number the rows of every tag 0, 1, 2, ... where no step was given.

    ``bucket`` is a number that never falls along ``order`` (by default the seconds of the time stamp); rows are
    numbered inside ranges of it.
    """
    seconds = F.unix_seconds(F.col(order[0]).cast("timestamp")) if bucket is None else bucket
    numbered = ranked(df.withColumn("__bucket", seconds), list(keys), list(order), "__bucket", width, "auto_step")
    return numbered.drop("__bucket")


def every_n(df: DataFrame, n: int, step: str = "step") -> DataFrame:
    """Rows of every n-th step."""
    return df.where(F.col(step) % n == 0)

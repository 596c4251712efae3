"""Roll-ups of rewards, texts and metric values.

Every aggregation is built from partial aggregates over keys that spread a hot group: distinct values, tokens or bins
are counted first, so no group is ever gathered in one task.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.functions.extract import first_between
from rewardloom.functions.formats import ADHERENCE, adheres
from rewardloom.functions.text import n_words, words
from rewardloom.operators.keys import join_on
from rewardloom.operators.trends import ranked
from rewardloom.profiles import V2, Profile

# Bins of the median search per doubling of the magnitude.
BINS_PER_DOUBLING = 256
# Cells into which a bin that holds a middle rank is cut between its smallest and largest value.
CELLS = 4096
NAN_BIN = 1 << 62


def _bin(v: Column) -> Column:
    """A bin number that never falls as the value grows and depends on nothing else; NaN sorts last."""
    magnitude = F.log2(F.abs(v) + 1) * BINS_PER_DOUBLING
    return F.when(F.isnan(v), F.lit(NAN_BIN)).otherwise(F.floor(F.signum(v) * magnitude))


def _anchor(bin_number: Column) -> Column:
    return F.signum(bin_number) * (F.pow(F.lit(2.0), F.abs(bin_number) / BINS_PER_DOUBLING) - 1)


def statistics(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Count, mean, exact median, min, max and population deviation per group, in one pass over the input.

    Values are counted first: ties collapse before the shuffle, and a hot group is spread over its values. The
    moments come from narrow bins of the counted values. The median is looked up through the bins too: the one or two
    bins that hold the middle ranks are cut into cells, and only the cells that hold them are put in order.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("c"))
        .withColumn("bin", _bin(F.col("v")))
    )
    off = F.col("v") - _anchor(F.col("bin"))
    bins = counts.groupBy(*keys, "bin").agg(
        F.sum("c").alias("k"),
        F.sum(F.col("c") * off).alias("s1"),
        F.sum(F.col("c") * off * off).alias("s2"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )
    group, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin")
    bins = bins.withColumn("m", _anchor(F.col("bin")) + F.col("s1") / F.col("k")).withColumns({
        "n": F.sum("k").over(group),
        "mean": F.sum(F.col("m") * F.col("k")).over(group) / F.sum("k").over(group),
        "upto": F.sum("k").over(ordered),
    })
    inside = F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("k"), F.lit(0.0))
    between = F.col("k") * F.pow(F.col("m") - F.col("mean"), 2)
    ranks = {"lower": F.floor((F.col("n") + 1) / 2), "upper": F.floor(F.col("n") / 2) + 1}
    before = F.col("upto") - F.col("k")

    def holder(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") >= rank) & (before < rank), F.struct("bin", before.alias("before"), F.col("lo").alias("low"), F.col("hi").alias("high"))))

    groups = bins.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        F.sqrt(F.sum(inside + between) / F.first("n")).alias("std"),
        F.array_distinct(F.array(*[holder(rank) for rank in ranks.values()])).alias("middle"),
    )
    stats = ("n", "mean", "min", "max", "std")
    middle = groups.select(*keys, *stats, F.inline("middle"))
    share = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))
    cell = F.when(F.col("high") > F.col("low"), F.least(F.floor(share * CELLS), F.lit(CELLS - 1).cast("bigint")))
    held = join_on(counts, middle, [*keys, "bin"]).withColumn("cell", F.coalesce(cell, F.lit(0).cast("bigint")))
    cells = held.groupBy(*keys, "bin", "cell").agg(F.sum("c").alias("k"), F.first("before").alias("b"), F.first("n").alias("n"))
    last = F.col("b") + F.sum("k").over(Window.partitionBy(*keys, "bin").orderBy("cell"))
    cells = cells.withColumn("last", last).withColumn("first", F.col("last") - F.col("k"))
    holds = [(F.col("last") >= rank) & (F.col("first") < rank) for rank in ranks.values()]
    cells = cells.where(holds[0] | holds[1]).select(*keys, "bin", "cell", "first")
    covered = join_on(held, cells, [*keys, "bin", "cell"]).withColumn(
        "at", F.col("first") + F.sum("c").over(Window.partitionBy(*keys, "bin", "cell").orderBy("v"))
    )

    def covers(rank: Column) -> Column:
        return ((F.col("at") >= rank) & (F.col("at") - F.col("c") < rank)).cast("int")

    hits = covers(ranks["lower"]) + covers(ranks["upper"])
    return (
        covered.groupBy(*keys)
        .agg(*[F.first(c).alias(c) for c in stats], (F.sum(F.when(hits > 0, F.col("v") * hits)) / 2).alias("median"))
        .select(*keys, "n", "mean", "median", "min", "max", "std")
    )


def ranked_values(df: DataFrame, keys: list[str], shares: tuple[float, ...], value: str = "value") -> DataFrame:
    """Per group ``n``, ``lo``, ``hi`` and exact quantiles ``q0``, ``q1``, ... at ``shares``, between two values in proportion.

    As in :func:`statistics`, values are counted first and found through bins and cells, so no group is put in order whole.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("c"))
        .withColumn("bin", _bin(F.col("v")))
    )
    group, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin")
    bins = counts.groupBy(*keys, "bin").agg(F.sum("c").alias("_k"), F.min("v").alias("low"), F.max("v").alias("high"))
    bins = bins.withColumns({
        "n": F.sum("_k").over(group), "lo": F.min("low").over(group), "hi": F.max("high").over(group),
        "before": F.sum("_k").over(ordered) - F.col("_k"),
    })
    lower = [F.floor(F.lit(p) * (F.col("n") - 1)) + 1 for p in shares]
    ranks = F.array_distinct(F.array(*[r for low in lower for r in (low, F.least(low + 1, F.col("n")))]))
    inside = F.filter(ranks, lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("_k")))
    wanted = bins.select(*keys, "bin", "n", "lo", "hi", "before", "low", "high", F.explode(inside).alias("rank"))

    spans = wanted.select(*keys, "bin", "before", "low", "high").distinct()
    share = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))
    cell = F.when(F.col("high") > F.col("low"), F.least(F.floor(share * CELLS), F.lit(CELLS - 1).cast("bigint")))
    held = join_on(counts, spans, [*keys, "bin"]).withColumn("cell", F.coalesce(cell, F.lit(0).cast("bigint")))
    cells = held.groupBy(*keys, "bin", "cell").agg(F.sum("c").alias("_k"), F.first("before").alias("before"))
    last = F.col("before") + F.sum("_k").over(Window.partitionBy(*keys, "bin").orderBy("cell"))
    cells = cells.select(*keys, "bin", "cell", last.alias("last"), (last - F.col("_k")).alias("first"))
    met = join_on(cells, wanted, [*keys, "bin"]).where("rank > first and rank <= last")
    places = met.groupBy(*keys, "bin", "cell", "first").agg(F.collect_set("rank").alias("ranks"))
    covered = join_on(held, places, [*keys, "bin", "cell"]).withColumn(
        "at", F.col("first") + F.sum("c").over(Window.partitionBy(*keys, "bin", "cell").orderBy("v"))
    )
    mine = F.filter("ranks", lambda r: (r <= F.col("at")) & (r > F.col("at") - F.col("c")))
    found = covered.select(*keys, F.explode(mine).alias("rank"), "v")
    values = join_on(wanted.select(*keys, "n", "lo", "hi", "rank"), found, [*keys, "rank"]).groupBy(*keys, "n", "lo", "hi").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at")
    )
    out = []
    for i, (p, low) in enumerate(zip(shares, lower, strict=True)):
        a, b = F.col("at")[low], F.col("at")[F.least(low + 1, F.col("n"))]
        out.append((a + (b - a) * (F.lit(p) * (F.col("n") - 1) - (low - 1))).alias(f"q{i}"))
    return values.select(*keys, "n", "lo", "hi", *out)


def length_statistics(df: DataFrame, text: str = "model_output", keys: list[str] = ()) -> DataFrame:
    n = n_words(F.coalesce(F.col(text), F.lit("")))
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_length"),
        F.count("*").alias("num_samples"),
    )


def token_entropy(df: DataFrame, text: str, keys: list[str] = (), tokenizer=words) -> DataFrame:
    """Base-2 entropy of all tokens of a group; 0 for a group without tokens.

    ``tokenizer`` maps a text column to an array column: an expression, or a pandas UDF for anything else. Tokens are
    counted map-side before they are shuffled, so neither a hot group nor a hot token lands in one task uncounted.
    """
    tokens = df.select(*keys, F.explode_outer(tokenizer(F.col(text))).alias("token"))
    counts = tokens.groupBy(*keys, "token").agg(F.count("token").alias("n"))
    entropy = F.log2(F.sum("n")) - F.try_divide(F.sum(F.col("n") * F.log2("n")), F.sum("n"))
    return counts.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.coalesce(F.when(F.sum("n") > 0, entropy), F.lit(0.0)).alias("token_entropy"),
    )


def adherence_rate(df: DataFrame, text: str, keys: list[str] = (), pattern: str = ADHERENCE) -> DataFrame:
    follows = F.coalesce(adheres(F.col(text), pattern), F.lit(False)).cast("int")
    return df.groupBy(*keys).agg(F.coalesce(F.avg(follows), F.lit(0.0)).alias("format_adherence_rate"))


def thought_answer_ratio(df: DataFrame, text: str, keys: list[str] = (), p: Profile = V2) -> DataFrame:
    thought = n_words(first_between(F.col(text), p.thought_open, p.thought_close))
    answer = n_words(first_between(F.col(text), p.answer_open, p.answer_close))
    # size(NULL) is -1 in some modes, so texts without the tags are left out explicitly.
    has_thought = first_between(F.col(text), p.thought_open, p.thought_close).isNotNull()
    has_answer = first_between(F.col(text), p.answer_open, p.answer_close).isNotNull()
    means = df.groupBy(*keys).agg(
        F.avg(F.when(has_thought, thought)).alias("r"), F.avg(F.when(has_answer, answer)).alias("a")
    )
    both = F.col("r").isNotNull() & F.col("a").isNotNull()
    return means.select(
        *keys,
        F.when(both & (F.col("a") > 0), F.try_divide("r", "a")).otherwise(0.0).alias("reasoning_to_answer_ratio"),
        F.when(both, F.col("r")).otherwise(0.0).alias("avg_reasoning_length"),
        F.when(both, F.col("a")).otherwise(0.0).alias("avg_answer_length"),
    )


def bin_index(v: Column, lo: Column, hi: Column, bins: int | Column) -> Column:
    """Index of the equal-width bin, the last one closed; values are checked against the exact bin edges."""
    bins = F.lit(bins) if isinstance(bins, int) else bins
    step = (hi - lo) / bins
    raw = F.least(F.floor((v - lo) / (hi - lo) * bins), (bins - 1).cast("bigint"))
    down = F.when(v < lo + raw * step, 1).otherwise(0)
    up = F.when((v >= lo + (raw + 1) * step) & (raw != bins - 1), 1).otherwise(0)
    return (raw - down + up).cast("bigint")


def _with_range(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``lo`` and ``hi`` of the group; a range of one value is widened by a half on both sides."""
    spans = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    spans = spans.withColumns({
        "lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")),
        "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")),
    })
    if keys:
        return join_on(df, spans, keys)
    return df.withColumns({c: spans.select(c).scalar() for c in ("lo", "hi")})


def histogram(df: DataFrame, keys: list[str] = (), value: str = "value", bins: int = 20) -> DataFrame:
    """Counts per equal-width bin; bins without values are not listed."""
    keys = list(keys)
    binned = _with_range(df.where(F.col(value).isNotNull()), keys, value)
    return (
        binned.groupBy(*keys, "lo", "hi", bin_index(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count("*").alias("n"))
        .withColumn("edge", F.col("lo") + F.col("bin") * ((F.col("hi") - F.col("lo")) / bins))
        .select(*keys, "bin", "edge", "n")
    )


def automatic_histogram(df: DataFrame, keys: list[str] = (), value: str = "value") -> DataFrame:
    """Counts per equal-width bin, the width from each group's own values: the finer of two rules, one of the number of values,
    one of their quartiles (but at most twice as fine as the root of the number). Bins without values are not listed."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    spans = ranked_values(rows, keys, (0.25, 0.75), value)
    width, n = F.col("hi") - F.col("lo"), F.col("n").cast("double")
    quartiles = 2.0 * (F.col("q1") - F.col("q0")) * F.pow(n, F.lit(-1.0 / 3.0))
    finest = F.least(F.greatest(quartiles, width / F.sqrt(n) / 2), width / (F.log2(n) + 1.0))
    flat = F.col("lo") == F.col("hi")
    spans = spans.select(
        *keys,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        F.when(flat, F.lit(1).cast("bigint")).otherwise(F.ceil(F.try_divide(width, finest))).alias("bins"),
    )
    binned = join_on(rows, spans, keys) if keys else rows.withColumns({c: spans.select(c).scalar() for c in ("lo", "hi", "bins")})
    index = bin_index(F.col(value), F.col("lo"), F.col("hi"), F.col("bins"))
    counts = binned.groupBy(*keys, "lo", "hi", "bins", index.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select(*keys, "bins", "bin", (F.col("lo") + F.col("bin") * ((F.col("hi") - F.col("lo")) / F.col("bins"))).alias("edge"), "n")


def kl_divergence(
    df: DataFrame, is_first: Column, keys: list[str] = (), value: str = "value", bins: int = 20, eps: float = 1e-10
) -> DataFrame:
    """KL divergence of the values with ``is_first`` from those without, on a shared grid; 0 if one side is empty.

    Only bin counts are compared: after the partial aggregation at most ``bins`` rows per group are left.
    """
    keys = list(keys)
    sided = df.where(F.col(value).isNotNull()).withColumn("__first", is_first)
    binned = _with_range(sided, keys, value)
    counts = binned.groupBy(
        *keys, bin_index(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin")
    ).agg(
        F.count_if(F.col("__first")).alias("n1"), F.count_if(~F.col("__first")).alias("n2")
    )
    totals = counts.groupBy(*keys).agg(
        F.sum("n1").alias("t1"),
        F.sum("n2").alias("t2"),
        F.collect_list(F.struct("n1", "n2")).alias("grid"),
    )

    def share(n: Column, total: str) -> Column:
        return F.greatest(n / (F.col(total) + eps), F.lit(eps))

    # Bins in which neither side has a value add eps * ln(1) = 0.
    divergence = F.aggregate(
        F.col("grid"),
        F.lit(0.0),
        lambda acc, g: acc + share(g["n1"], "t1") * F.log(share(g["n1"], "t1") / share(g["n2"], "t2")),
    )
    both = (F.col("t1") > 0) & (F.col("t2") > 0)
    return totals.select(*keys, F.when(both, divergence).otherwise(0.0).alias("kl_divergence"))


def correlations(df: DataFrame, names: list[str], keys: list[str] = ()) -> DataFrame:
    """Pearson correlation of every pair of reward columns, from one aggregation; NULL if one of them is constant."""
    pairs = list(combinations(names, 2))

    def correlation(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        spread = [F.stddev_pop(F.when(both, F.col(c))) for c in (a, b)]
        return F.try_divide(F.covar_pop(a, b), spread[0] * spread[1])

    wide = df.groupBy(*keys).agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([F.col(k) for k in keys], [F.col(f"`{a}|{b}`") for a, b in pairs], "pair", "correlation")
    return long.select(
        *keys,
        F.substring_index("pair", "|", 1).alias("reward_a"),
        F.substring_index("pair", "|", -1).alias("reward_b"),
        "correlation",
    )


def group_advantage(
    df: DataFrame, keys: list[str], reward: str = "total_reward", text: str = "model_output", eps: float = 1e-4
) -> DataFrame:
    """Mean and deviation of each prompt's generations, and every generation's distance from them.

    The group is aggregated and joined back instead of windowed, so a hot group is never held in one task. Few groups
    are broadcast; otherwise both sides of the null-safe join are shuffled for it, and only then can adaptive
    execution split a hot group (it cannot where one side already lies by the keys).
    """
    joined = join_on(df, group_rewards(df, keys, reward, text), keys, "left")
    return joined.withColumn("advantage", (F.col(reward) - F.col("reward_mean")) / (F.col("reward_std") + eps))


def group_rewards(
    df: DataFrame, keys: list[str], reward: str = "total_reward", text: str = "model_output"
) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(reward).alias("reward_mean"),
        F.stddev_pop(reward).alias("reward_std"),
        F.avg(n_words(F.col(text))).alias("completion_length"),
        F.count("*").alias("n_generations"),
    )


def batch_accuracy(df: DataFrame, keys: list[str], reward: str = "correctness", weight: float = 4.0) -> DataFrame:
    """Correct answers per batch: counted, and in the rounding form that only knows the mean reward."""
    mean = F.avg(reward)
    return df.groupBy(*keys).agg(
        F.count_if(F.col(reward) > 0).alias("correct"),
        F.count("*").alias("total"),
        F.when(mean > 0, F.rint(mean / weight).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias(
            "rounded_correct"
        ),
    )


def sampled_steps(df: DataFrame, column: str = "step", one_in: int = 10) -> DataFrame:
    """The steps expensive metrics are computed for: a fixed share by their hash, the same on every run and engine."""
    hashed = F.conv(F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.where(F.pmod(hashed, F.lit(one_in)) == 0)


# Text fields that are logged under ``text/``.
TEXT_FIELDS = ("generation", "prediction", "output")
NUMERIC = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")


def metric_tags(df: DataFrame, step: str | None = "step", left_out: tuple[str, ...] = (), order: list[str] = ()) -> DataFrame:
    """Route the columns of a log table to tags: ``(tag, kind, step, number, text, numbers)``.

    A column that no tag fits is an error unless it is ``left_out``. Without ``step`` every tag counts its own steps from 0, in the
    order of the columns ``order``, which are then needed.
    """

    def entry(tag: Column, kind: str, number=None, text=None, numbers=None) -> Column:
        return F.struct(
            tag.alias("tag"),
            F.lit(kind).alias("kind"),
            (number if number is not None else F.lit(None)).cast("double").alias("number"),
            (text if text is not None else F.lit(None)).cast("string").alias("text"),
            (numbers if numbers is not None else F.lit(None)).cast("array<double>").alias("numbers"),
        )

    names = set(df.columns)
    if {"model_output", "question"} <= names:
        tag = F.concat(F.lit("model/output/"), F.substring("question", 1, 50))
        entries = [entry(tag, "text", text=F.col("model_output"))]
    elif {"reward_name", "value"} <= names:
        entries = [entry(F.concat(F.lit("rewards/"), F.col("reward_name")), "scalar", number=F.col("value"))]
    else:
        entries = []
        unknown = []
        for name, kind in df.dtypes:
            if name == step or name in left_out or (step is None and name in order):
                continue
            if kind in NUMERIC or kind.startswith("decimal"):
                entries.append(entry(F.lit(f"metrics/{name}"), "scalar", number=F.col(name)))
            elif kind.startswith("array<") and kind[6:-1] in NUMERIC:
                entries.append(entry(F.lit(f"distributions/{name}"), "histogram", numbers=F.col(name)))
            elif kind == "string" and name in TEXT_FIELDS:
                entries.append(entry(F.lit(f"text/{name}"), "text", text=F.col(name)))
            else:
                unknown.append(f"{name} ({kind})")
        if unknown:
            raise ValueError(f"no tag fits {', '.join(unknown)}")
    if step is None:
        if not order:
            raise ValueError("without steps an order is needed")
        tagged = df.select(*order, F.inline(F.array(*entries)))
        # Tags of few names hold all rows each, so steps are counted inside ranges of the first column.
        counted = ranked(tagged, ["tag"], list(order), order[0], name="step")
        return counted.select("step", "tag", "kind", "number", "text", "numbers")
    return df.select(F.col(step).alias("step"), F.inline(F.array(*entries)))

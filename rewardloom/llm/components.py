"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.tables import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # A number with very many links has them in one partition; a stored side lets adaptive execution split it.
    least = stored(least, "least")
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    met = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """For links ``(a, b)`` between numbers, ``(a, b)`` with the smallest number ``b`` that ``a`` reaches, for every ``a``
    that is not itself the smallest. Links in both directions, repeated or from a number to itself make no difference;
    an empty table gives an empty one. Rounds grow with the logarithm of the longest path; each is stored."""
    state = stored(links.where("a <> b").select("a", "b"), "links")
    mark = None
    while True:
        state = stored(_small_star(_large_star(state)), "links")
        row = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(row):
            return state
        mark = tuple(row)

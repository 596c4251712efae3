"""Storing intermediate tables and numbering rows, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.session import work_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the session's shared folder and read again: lost executors don't matter, and
    what is computed twice from it is the same."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one key and salt that are sorted in one task, if all rows have one key.
SORTED_ROWS = 500_000


def numbered(df: DataFrame, keys: list[str], order: list[str], salt: Column, out: str = "slot", salts: int | None = None) -> DataFrame:
    """Number the rows of each key from 0 without giving a key to one task: rows are numbered inside (key, salt) and
    moved by the sizes of the salts before. There are 64 salts, or more where the rows are so many that one key could have over
    ``SORTED_ROWS`` in each. ``df`` is evaluated three times, so it should be a stored table; ``order`` must be unique inside a key."""
    salts = salts or max(64, -(-df.count() // SORTED_ROWS))
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        salted.groupBy(*keys, "_salt")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(inside) - 1)
    return (
        ranked.join(sizes, [*keys, "_salt"])
        .withColumn(out, (F.col("_rank") + F.col("_before")).cast("long"))
        .drop("_salt", "_rank", "_before")
    )

"""Join helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the key columns are those of the left side."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"__right_{k}" for k in keys])

"""Tables that streams keep: the newest state of every key, and judged deliveries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.operators.keys import join_on

BUCKETS = 16


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders below ``path``; none if it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(place) if f.isDirectory()] if files.exists(place) else []


def _numbers(names: list[str], prefix: str) -> list[int]:
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def newest_batch(spark: SparkSession, path: str, before: int | None = None) -> str | None:
    """The newest folder ``batch_id=N`` below ``path``, if wanted with ``N`` less than ``before``."""
    found = [n for n in _numbers(_folders(spark, path), "batch_id=") if before is None or n < before]
    return f"{path}/batch_id={found[-1]}" if found else None


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class StateTable:
    """The newest row of every key, in buckets by the key's hash.

    A batch rewrites the buckets it has keys of, each as a version of its own (``bucket=B/batch_id=N``, by dynamic partition
    overwrite), from the version before it and its own rows. So a batch that is run again replaces itself, a reader
    takes one version per bucket however many batches there have been, and versions that no repeated batch can need are
    deleted.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def versions(self, before: int | None = None) -> dict[int, str]:
        """The newest version of every bucket, if wanted of batches before one."""
        out = {}
        for bucket in _numbers(_folders(self.spark, self.path), "bucket="):
            newest = newest_batch(self.spark, f"{self.path}/bucket={bucket}", before)
            if newest:
                out[bucket] = newest
        return out

    def read(self, schema=None, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of the newest versions, of some buckets or all; nothing if there are none."""
        paths = [p for b, p in self.versions(before).items() if buckets is None or b in buckets]
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else None

    def write(self, batch: DataFrame, batch_id: int, kept: Column | None = None) -> None:
        """Rows of keys, each at most once, in place of what these keys had. Of the other rows those stay for which ``kept`` is not
        false."""
        # What a stream hands over is worked out anew by every action.
        mine = batch.storageLevel == StorageLevel.NONE
        batch = batch.persist() if mine else batch
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = batch.withColumn("bucket", bucket)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        old = self.read(batch.schema, batch_id, touched)
        if old is not None:
            old = old if kept is None else old.where(F.coalesce(kept, F.lit(True)))
            other = join_on(old, batch.select(*self.keys), self.keys, "left_anti").withColumn("bucket", bucket)
            rows = rows.unionByName(other)
        rows = rows.withColumn("batch_id", F.lit(batch_id)).repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(self.path)
        if mine:
            batch.unpersist()
        for b in touched:
            folder = f"{self.path}/bucket={b}"
            for n in [n for n in _numbers(_folders(self.spark, folder), "batch_id=") if n < batch_id][:-1]:
                delete(self.spark, f"{folder}/batch_id={n}")

"""Generation logs and result files: writing them and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.schemas import GENERATION_LOG
from rewardloom.sources.questions import CSV_FORM, CSV_READ

CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
LOG_COLUMNS = tuple(f.name for f in GENERATION_LOG)
# The short log keeps these columns.
SHORT_LOG = ("timestamp", "question", "answer", "llm_reasoning", "llm_answer")


def log_rows(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Exactly the columns of the log: missing ones empty, others dropped, the time stamp added if absent."""
    if "timestamp" not in df.columns:
        df = df.withColumn("timestamp", F.current_timestamp() if now is None else now)
    fields = [
        F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in GENERATION_LOG
    ]
    keep = ["run"] if "run" in df.columns else []
    return df.select(*keep, *fields)


def write_log(df: DataFrame, path: str, now: Column | None = None, attempt: str = "0") -> None:
    """Add to the log table, one folder per run and ``attempt``. An attempt that is written again replaces what it wrote of the
    same runs before; other attempts and runs stay."""
    rows = log_rows(df, now).withColumn("attempt", F.lit(attempt))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "attempt").parquet(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: what follows reads plain columns instead of scoring every text again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, partition_by: tuple = ()) -> None:
    """CSV with a header; given ``columns`` absent ones are left empty and others dropped."""
    if columns is not None:
        absent = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
        df = df.withColumns(absent).select(*partition_by, *columns)
    df.write.mode("append").partitionBy(*partition_by).csv(path, **CSV_FORM, timestampFormat=CSV_TIME)


def read_csv_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """Wide CSV logs of several runs; ``log_file`` is the file and ``run`` its ``run=`` folder.

    A quoted field may span lines, so a CSV file is read by one task: keep runs in several files, or as Parquet.
    """
    raw = (
        spark.read.schema(GENERATION_LOG)
        .csv(list(paths), **CSV_READ, recursiveFileLookup=True, timestampFormat=CSV_TIME)
        .select("*", F.col("_metadata.file_path").alias("log_file"))
    )
    texts = [f.name for f in GENERATION_LOG if f.dataType.typeName() == "string"]
    filled = raw.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})

    def decoded(c: Column) -> Column:
        return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))

    # A folder name escapes the run's special characters, and the file's address escapes the folder's.
    return filled.withColumn("run", decoded(decoded(F.regexp_extract("log_file", "run=([^/]+)", 1))))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def batch_results(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows of the batch result file."""
    return df.select(F.col(key).alias("id"), "question", "full_response", "model_output")


# Fields of a log record.
RECORD_FIELDS = ("timestamp", "level", "name", "file", "line", "func", "message")
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def json_records(df: DataFrame, fields: tuple[str, ...] = RECORD_FIELDS, time_format: str = TIME_FORMAT) -> DataFrame:
    """One JSON text per log record, only the wanted fields, times in the given format."""
    present = [c for c in fields if c in df.columns]
    if "timestamp" in present:
        df = df.withColumn("timestamp", F.date_format("timestamp", time_format))
    return df.withColumn("record", F.to_json(F.struct(*present), {"ignoreNullFields": "false"}))


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a JSON document."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def dataset_statistics(df: DataFrame, texts: tuple[str, ...], groups: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``field, value, n, mean_chars, max_chars``: of each text column its filled rows and lengths, of each of ``groups``
    the rows per value."""

    def entry(field: str, value: Column, chars: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), chars.cast("int").alias("chars"))

    lengths = [entry(c, F.lit(None), F.length(c)) for c in texts]
    values = [entry(c, F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(None)) for c in groups]
    rows = df.select(F.inline(F.array(*lengths, *values)))
    filled = F.col("chars").isNotNull() | F.col("value").isNotNull()
    return rows.groupBy("field", "value").agg(
        F.count_if(filled).alias("n"), F.avg("chars").alias("mean_chars"), F.max("chars").cast("bigint").alias("max_chars")
    )


def export_dataset(df: DataFrame, path: str, texts: tuple[str, ...] = (), groups: tuple[str, ...] = ()) -> None:
    """A data set as a columnar table, CSV (nested columns as JSON) and JSON lines, and its statistics beside it."""
    if texts or groups:
        dataset_statistics(df, texts, groups).write.mode("overwrite").parquet(f"{path}/statistics")
    df.write.mode("overwrite").parquet(f"{path}/table")
    flat = [
        F.to_json(name).alias(name) if kind.startswith(("array", "struct", "map")) else F.col(name)
        for name, kind in df.dtypes
    ]
    df.select(*flat).write.mode("overwrite").csv(f"{path}/csv", **CSV_FORM)
    df.write.mode("overwrite").json(f"{path}/json")

"""Table schemas: fixed, so that no reader ever infers one."""

from pyspark.sql import types as T

REWARDS = (
    "correctness", "integer", "strict_format", "soft_format", "tag_count", "anti_repetition", "topic_relevance",
)

QA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
])

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

GENERATION = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("sample_id", T.LongType()),
    T.StructField("group_id", T.LongType()),
    T.StructField("step", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("model_output", T.StringType()),
])

GENERATION_LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("global_step", T.LongType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("ground_truth_answer", T.StringType()),
        T.StructField("model_output", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("model_answer", T.StringType()),
        T.StructField("total_reward", T.DoubleType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in REWARDS]
)

REWARD_EVENT = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("sample_id", T.LongType()),
    T.StructField("reward_name", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

METRIC = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("sample_group", T.LongType()),
])

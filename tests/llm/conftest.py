import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

ODD = [
    (None, "a text without a number", None),
    (1, None, "en"),
    (2, "", "en"),
    (3, " \t\n ", None),
    (4, "one", "en"),
    (5, "one two", "en"),
    (6, "one two three four five", "en"),
    (6, "one two three four five", "en"),
    (7, "One TWO three four five", "fr"),
    (8, "x" * 70_000, "en"),
    (9, "été à ß     😀 \x00 end", "fr"),
    (10, "the cat sat on the mat and looked at the dog " * 3000, "en"),
    (12, " ".join(f"word{i}" for i in range(400)), "en"),
    (12, " ".join(f"word{i}" for i in range(300, 355)), "en"),
    (13, " ".join(f"word{i}" for i in range(320, 390)), "en"),
    (11, "<b>not</b> | a & page # * $ % < >", None),
]
NAMES = ("text_", "a", "b", "h", "fp", "key", "n", "pos", "rank", "slot", "size", "m", "shard", "score", "length", "_salt")


@pytest.fixture(scope="session")
def table(spark):
    """A table of (doc_id, text, lang) rows with further columns under names that operators might use themselves."""

    def make(rows):
        kinds = [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())]
        schema = StructType(kinds + [StructField(n, StringType()) for n in NAMES])
        return spark.createDataFrame([(*r, *[None] * (3 - len(r)), *["clash"] * len(NAMES)) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD)


@pytest.fixture(scope="session")
def empty(table):
    return table([])

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rewardloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("work"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate columns over rows of texts and return the values of the column per row, in order."""
    from pyspark.sql import functions as F

    def run(rows, *columns, names=("t",)):
        fields = ", ".join(["i bigint", *[f"{n} string" for n in names]])
        data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, fields)
        out = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
        values = [tuple(r)[1:] for r in out]
        return [v[0] for v in values] if len(columns) == 1 else values

    run.t = F.col("t")
    return run

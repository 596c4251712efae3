"""Every query with SQL gives the rows DuckDB gives on the same tables."""

import os
from pathlib import Path

import brute
import duckdb
import pytest

import __spark_entry__ as driver
from rewardloom.plans.fixtures import Tables
from rewardloom.profiles import V2

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = driver.queries(), driver.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple("" if r[i] is None else repr(r[i]) for i in order) for r in records)


def test_every_oracle_has_a_query():
    assert SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert got == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_detectors_without_sql_over_whole_documents(spark):
    texts = {r.doc_id: r.text for r in Tables(spark, SF).scripted_documents.collect()}
    for name, weight in (("r6_2_repeated_units", brute.unit_weight), ("r6_5_glued_repetitions", brute.glued_weight)):
        got = {r.doc_id: r.weight for r in QUERIES[name](spark, SF).collect()}
        assert got == {i: weight(t) for i, t in texts.items()}, name


def test_scripted_documents_hold_their_whole_texts(spark):
    t = Tables(spark, SF)
    texts = {r.doc_id: r.text for r in t.scripted_documents.collect()}
    assert all(r.text in texts[r.doc_id] for r in t.documents.collect())


@pytest.mark.parametrize("name", ["r6_1_script_runs", "r6_3_punctuation", "r6_6_mixed_scripts", "r6_8_non_latin_runs"])
def test_detectors_find_something(spark, name):
    weights = [r.weight for r in QUERIES[name](spark, SF).collect()]
    assert sum(w > 0 for w in weights) > 0.05 * len(weights)


def test_long_conversations_stay_one_document(spark, tmp_path):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(2500)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["s1_json_questions"](spark, str(tmp_path)).count() == 1250
    assert QUERIES["s6_held_out"](spark, str(tmp_path)).count() == 100
    assert QUERIES["p2_render_messages"](spark, str(tmp_path)).count() == 1
    assert Tables(spark, str(tmp_path)).turns.select("sample_id").distinct().count() == 1250


def test_rewards_without_sql_over_all_generations(spark):
    def key(r):
        return r.run, r.sample_id

    outputs = {key(r): r.model_output for r in Tables(spark, SF).generations.collect()}
    relevance = {key(r): r.reward for r in QUERIES["r7_topic_relevance"](spark, SF).collect()}
    plain = {key(r): r.total_reward for r in QUERIES["r15_total_of_plain_rewards"](spark, SF).collect()}
    rows = QUERIES["r15_total_reward"](spark, SF).collect()
    assert len(rows) == len(outputs)
    for r in rows:
        repetition = brute.repetition_reward(outputs[key(r)], V2.whitelist, V2.whitelist[:5])
        assert r.anti_repetition == pytest.approx(repetition, abs=1e-6)
        assert r.total_reward == pytest.approx(plain[key(r)] + repetition + relevance[key(r)], abs=3e-6)

from types import SimpleNamespace
import json

import pytest
from pyspark.sql import functions as F

from rewardloom.functions import prompts
from rewardloom.session import work_dir
from rewardloom.sources import datasets, generate, logs, questions


def documents(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i bigint, value string")


def test_json_shapes(spark):
    docs = documents(
        spark, '["a", "b"]', '[{"question": "c", "x": 1}, {"question": "d"}]', '{"questions": ["e", "f"], "x": 1}',
        '[{"question": "g"}, {"q": "h"}]', '["i", 1]', '{"other": []}', "[]", "broken", '"text"',
    )
    got = questions.questions_from_json(docs).orderBy("i", "pos").collect()
    assert [(r.i, r.pos, r.question) for r in got] == [
        (0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d"), (2, 0, "e"), (2, 1, "f")]


def test_question_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": ["one", "two\nlines"]}, indent=1))
    (tmp_path / "q.csv").write_text('id,question\n1," a ""b"", c"\n2,"two\nlines"\n')
    (tmp_path / "first.csv").write_text("text,id\nx,1\n")
    (tmp_path / "q.txt").write_text("  one \n\n\t\ntwo\n")

    def read(name):
        return [r.question for r in questions.read_questions(spark, str(tmp_path / name)).collect()]

    assert read("q.json") == ["one", "two\nlines"]
    assert read("q.csv") == [' a "b", c', "two\nlines"]
    assert read("first.csv") == ["x"]
    assert read("q.txt") == ["one", "two"]


def test_held_out_documents(spark):
    sample = '[{"question": "q", "answer": ""}, {"input": "i", "output": "o"}, {"prompt": "p", "target": "t"}, {}]'
    docs = documents(spark, sample, f'{{"samples": 5, "examples": {sample}, "validation": []}}')
    got = datasets.held_out(docs, max_samples=3).orderBy("i", "pos").collect()
    assert [(r.i, r.input, r.expected) for r in got] == [
        (i, *pair) for i in (0, 1) for pair in [("q", ""), ("i", "o"), ("p", "t")]]


def test_held_out_file_and_hash_answers(spark, tmp_path):
    (tmp_path / "held.json").write_text(json.dumps({"data": [{"question": "q", "answer": "7"}]}, indent=2))
    row = datasets.read_held_out(spark, str(tmp_path / "held.json")).first()
    assert (row.input, row.expected) == ("q", "7")
    qa = spark.createDataFrame([("q", "so #### 7 "), ("r", "none")], "question string, answer string")
    got = datasets.hash_answer_set(qa).collect()
    assert [(r.answer, r.prompt[1].content) for r in got] == [("7", "q"), (None, "r")]


@pytest.mark.parametrize("value", ['{"other": []}', '"text"', "broken"])
def test_unknown_held_out_documents_fail(spark, value):
    with pytest.raises(Exception, match="Invalid dataset format"):
        datasets.held_out(documents(spark, value)).collect()


def test_prompt_cache_is_reused_unless_forced(spark):
    path = work_dir(spark, "cache")
    one = spark.createDataFrame([("q", "a")], "question string, answer string")
    two = one.union(one)
    assert datasets.cached_prompts(spark, one, path).count() == 1
    assert datasets.cached_prompts(spark, two, path).count() == 1
    assert datasets.cached_prompts(spark, two, path, force_rebuild=True).count() == 2


def test_split_is_pruned(spark):
    path = work_dir(spark, "splits")
    spark.createDataFrame([("q", "train"), ("r", "test")], "question string, split string").write.partitionBy("split").parquet(path)
    train = datasets.read_split(spark, path)
    assert [r.question for r in train.collect()] == ["q"]
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().executedPlan().toString()


def test_fenced_json_rejects(spark):
    df = spark.createDataFrame([('```json\n{"k": 1}\n``` ',), ('{"k": 2}',), ("oops",), ("```\nnot json\n```",)], "r string")
    got = datasets.fenced_json(df, "r", "k bigint").collect()
    assert [(r.payload.k if r.payload else None, r.reject) for r in got] == [
        (1, None), (2, None), (None, "oops"), (None, "```\nnot json\n```")]


def test_logs_round_trip_texts_as_they_are(spark):
    text = ' "quoted", line\nbreak \\ and blanks \n'
    rows = spark.createDataFrame(
        [("r 1/x+y", 3, text, "", 1.5, "dropped")],
        "run string, global_step bigint, model_output string, model_answer string, total_reward double, extra string",
    )
    path = work_dir(spark, "log")
    logs.write_csv(logs.log_rows(rows, F.lit("2024-01-02 03:04:05").cast("timestamp")), path, logs.LOG_COLUMNS, ("run",))
    back = logs.read_csv_logs(spark, path).first()
    assert (back.run, back.global_step, back.model_output, back.model_answer) == ("r 1/x+y", 3, text, "")
    assert (back.total_reward, back.question, back.correctness, str(back.timestamp)) == (
        1.5, "", None, "2024-01-02 03:04:05")
    table = work_dir(spark, "table")
    logs.write_log(rows, table)
    logs.write_log(rows.withColumn("run", F.lit("other")), table)
    logs.write_log(rows, table, attempt="second")
    # An attempt that is made again replaces itself and nothing else.
    logs.write_log(rows.unionByName(rows), table)
    count = logs.read_log(spark, table).groupBy("run", "attempt").count()
    assert {tuple(r) for r in count.collect()} == {("r 1/x+y", "0", 2), ("other", "0", 1), ("r 1/x+y", "second", 1)}


def test_prompts(evaluate, spark):
    t = evaluate.t
    assert evaluate(["q"], prompts.render_messages(prompts.chat_prompt(t, "sys"), "[{role}|{content}]", "!")) == [
        "[system|sys][user|q]!"]
    assert evaluate(["a b  c"], prompts.truncated_tokens(t, 2)) == [["a", "b"]]
    assert evaluate([("p", "p😀x")], prompts.strip_prompt(F.col("f"), F.col("p")), names=("p", "f")) == ["😀x"]
    assert evaluate(["q"], prompts.question_of(prompts.chat_prompt(t))) == ["q"]


def test_generation_hook(spark):
    df = spark.createDataFrame([("prompt:", "why")], "prompt string, question string")
    got = generate.generate(df, generate.fixed_reply).first()
    assert got.model_output == "<reasoning>Thinking about why</reasoning>\n<answer>42</answer>"
    assert got.full_response == "prompt:" + got.model_output


def test_work_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    first, second = (work_dir(spark, "x") for _ in range(2))
    assert first != second and first.startswith(f"{named}/rewardloom/x-")
    context = spark.sparkContext

    def unset(master, *names):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, *_: None if key == "spark.checkpoint.dir" else spark.conf.get(key)),
            sparkContext=SimpleNamespace(
                getCheckpointDir=lambda: None, _jvm=context._jvm, _jsc=context._jsc, master=master,
                getConf=lambda: SimpleNamespace(contains=lambda key: key in names),
            ),
        )

    for session in (unset("local[4]"), unset("yarn", "spark.sql.warehouse.dir")):
        assert work_dir(session, "x").startswith(spark.conf.get("spark.sql.warehouse.dir"))
    # A cluster's default warehouse is a folder of the driver's machine.
    with pytest.raises(ValueError, match="checkpoint"):
        work_dir(unset("spark://host:7077"), "x")

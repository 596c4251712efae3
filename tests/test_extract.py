import pytest
from pyspark.sql import functions as F

from rewardloom.functions import extract as x
from rewardloom.profiles import SOLUTION_TAGS

# Text, then what follows from the written rules: the tagged answer, the answer with its untagged forms, the last number,
# the text behind the mark, the validation answer, the thought, the answer section, the text behind the answer.
GOLDEN = [
    ("<answer>12</answer>", "12", "12", 12.0, None, "12", "", "12", ""),
    ("<reasoning>a</reasoning><answer> -5\n</answer> tail", "-5", "-5", 5.0, None, "-5", "a", "-5", "tail"),
    ("<answer>1</answer><answer>2</answer>x", "2", "2", 2.0, None, "1", "", "1", "<answer>2"),
    ("only </answer> closed", "only", "only", None, None, "only </answer> closed", "", "", "closed"),
    ("<answer>open", "open", "open", None, None, "<answer>open", "", "", ""),
    ("Final Answer: 42 of 7.", "Final Answer: 42 of 7.", "42", 7.0, None, "Final Answer: 42 of 7.", "", "", ""),
    ("so $\\boxed{7}$ and 1,000", "so $\\boxed{7}$ and 1,000", "7", 0.0, None, "so $\\boxed{7}$ and 1,000", "", "", ""),
    ("**Answer:** 3.5 #### x #### y", "**Answer:** 3.5 #### x #### y", "3.5", 3.5, "x", "**Answer:** 3.5 #### x #### y", "", "", ""),
    ("", "", "", None, None, "", "", "", ""),
    ("</answer> 1 <answer>", "", "", 1.0, None, "</answer> 1 <answer>", "", "", "1 <answer>"),
    (" #### 5\t", "#### 5", "#### 5", 5.0, "5", "#### 5", "", "", ""),
    ("<reasoning>x<reasoning>y</reasoning>", "<reasoning>x<reasoning>y</reasoning>", "<reasoning>x<reasoning>y</reasoning>",
     None, None, "<reasoning>x<reasoning>y</reasoning>", "x", "", ""),
    ("é\n<answer>\n٣ 2.5.\n</answer>\n", "٣ 2.5.", "٣ 2.5.", 2.5, None, "٣ 2.5.", "", "٣ 2.5.", ""),
]


def test_extractions_golden(evaluate):
    t = evaluate.t
    thought, answer, post = x.sections(t)
    got = evaluate(
        [row[0] for row in GOLDEN], x.tagged_answer(t), x.answer_with_fallbacks(t), x.last_number(t), x.hash_answer(t),
        x.validation_answer(t), thought, answer, post,
    )
    for row, values in zip(GOLDEN, got):
        assert values == row[1:], row[0]


@pytest.mark.parametrize("text, expected", [
    ("<answer>1</answer> <answer> 2 </answer>", "2"),
    ("only </answer> closed", "only"),
    ("**Answer:** 3.5", "3.5"),
    ("answer: none", "answer: none"),
    ("Final Answer:\n12", "Final Answer:\n12"),
    ("", ""),
])
def test_answer_golden(evaluate, text, expected):
    assert evaluate([text], x.answer_with_fallbacks(evaluate.t)) == [expected]


def test_numbers_golden(evaluate):
    assert evaluate(["-5", "1,000", "7.", "none", "٣ and 2.5"], x.last_number(evaluate.t)) == [5.0, 0.0, 7.0, None, 2.5]


def test_variables_and_substitution(evaluate):
    t = evaluate.t
    got = evaluate(["a: 1\nb = 2 = 3\nskip\na: 4\nu: x=1\n", ""], x.variables(t))
    assert got == [{"a": "4", "b": "2 = 3", "u": "x=1"}, {}]
    steps = evaluate(
        ["a = 1.5\nb=old\na = 2\nc = a*b"],
        x.substitute(t, F.create_map(F.lit("a"), F.lit("9"), F.lit("b"), F.lit("$1\\x"))),
    )
    assert steps == ["a = 9\nb = $1\\x\na = 2\nc = a*b"]


def test_custom_layout(evaluate):
    good = "x\n <start_working_out>think\nmore<end_working_out>\nso <SOLUTION>5\n</SOLUTION> \ny"
    rows = [good, good.replace("x\n", "x "), "<SOLUTION>5</SOLUTION>", "<SOLUTION> a 0.34 </SOLUTION>"]
    t = evaluate.t
    got = evaluate(rows, x.custom_answer(t, SOLUTION_TAGS), x.first_number_after(t, "<SOLUTION>"))
    assert got == [("5\n", "5"), (None, "5"), (None, "5"), (None, "0.34")]


def test_fenced_payload(evaluate):
    rows = ["```json\n{\"a\": \"```\"}\n```", "{}", "```\nx"]
    assert evaluate(rows, x.fenced_payload(evaluate.t)) == ['{"a": "```"}', "{}", ""]


def test_question_id_is_stable(evaluate):
    got = evaluate(["what"], x.question_id(evaluate.t, F.lit(None).cast("string"), "training", F.lit("2024-02-03").cast("date")))
    assert got == ["training_20240203_4a2028eceac5"]


def test_response_parts(spark):
    df = spark.createDataFrame(
        [([(True, "why "), (False, "because"), (None, "!")],)], "parts array<struct<thought boolean, text string>>"
    )
    thought, answer = x.response_parts(F.col("parts"))
    assert tuple(df.select(thought, answer).first()) == ("why ", "because!")

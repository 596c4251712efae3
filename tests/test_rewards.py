import math

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from rewardloom.functions import answers, formats, relevance, repetition
from rewardloom.functions.extract import sections
from rewardloom.operators.scoring import Rewards, flags, score, to_long, to_wide
from rewardloom.profiles import SOLUTION_TAGS, V1, V2
from rewardloom.schemas import REWARDS

many = settings(
    max_examples=3, deadline=None, suppress_health_check=list(HealthCheck), phases=(Phase.explicit, Phase.generate)
)

WORDS = ["go", "a", "the cat", "sat", "no", "no no", "abab", "abc", "hahaha", "Let x be the", "1", "über", " ", "x"]
GAPS = [" ", " ", " ", " ", "  ", "\n", " \n", "\t", "", ". "]
prose = st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(GAPS)), max_size=40).map(
    lambda parts: "".join(w + g for w, g in parts)
)
SYMBOLS = "aab bc.\"\n 嗨嗨жщ"
noise = st.lists(st.tuples(st.text(SYMBOLS, min_size=1, max_size=4), st.integers(1, 6)), max_size=6).map(
    lambda parts: "".join(unit * n for unit, n in parts)
)
samples = st.lists(prose | noise, min_size=60, max_size=100)


def detectors(t):
    return [
        repetition.repeated_units(t), repetition.repeated_words(t), repetition.glued_repetitions(t),
        repetition.phrases(t), repetition.mixed_scripts(t), F.round(repetition.anti_repetition(t), 9),
    ]


def expected_detectors(text):
    return (
        brute.unit_weight(text), brute.word_weight(text), brute.glued_weight(text),
        brute.phrase_weight(text, V2.whitelist), brute.mixed_weight(text),
        round(brute.repetition_reward(text, V2.whitelist, V2.whitelist[:5]), 9),
    )


@many
@given(samples)
def test_repetition_detectors_agree_with_brute_force(evaluate, rows):
    for text, got in zip(rows, evaluate(rows, *detectors(evaluate.t))):
        want = expected_detectors(text)
        assert got[:-1] == want[:-1], repr(text)
        assert got[-1] == pytest.approx(want[-1], abs=1e-8), repr(text)


GOLDEN = [
    "", " ", "go go go", "go a go a go", "one two go go go", "no no no no no", "aaaaaaaaaa", "abcabcabcabc",
    "the cat sat. the cat sat. the cat sat", "the cat sat the cat sat the", "a  b c a  b c a  b c a b c",
    "we have it we have it we have it", "x" * 60 + " y z " + ("x" * 60 + " y z ") * 3,
    "嗨" * 9, "嗨" * 10, "ж" * 12 + " " + "م" * 11, "abcabв", "ab", "abж", "жabжabжabжa", "aжaжaжaж", "aжaжaжa",
    "aaaжжжaaaжжж", ".....", "....", "\".\"\"\"\"", ".\".\"\"", "    " * 4, "\t \t \t \t ", "hahahaha hahaha",
    "<reasoning> b b b bb bb bb bb bb", "Let $x$ be the. " * 5, "ab ab ab ab", "ab\nab\nab\nab",
    ("lorem ipsum dolor " * 4).strip(), "abcd efg abcd efg abcd efg abcd efg",
]


def test_repetition_golden(evaluate):
    for text, got in zip(GOLDEN, evaluate(GOLDEN, *detectors(evaluate.t))):
        want = expected_detectors(text)
        assert got[:-1] == want[:-1], repr(text)
        assert got[-1] == pytest.approx(want[-1], abs=1e-8), repr(text)


def test_script_runs_and_punctuation(evaluate):
    t = evaluate.t
    rows = ["嗨" * 9, "嗨" * 10, "ж" * 12 + " " + "م" * 11, "a.....b......", "\".\"\"\"\"", ".\".\"\"", "plain"]
    got = evaluate(rows, repetition.script_runs(t), repetition.punctuation(t), repetition.non_latin_repeats(t))
    assert got == [(0, 0, 0), (10, 0, 0), (23, 0, 0), (0, 11, 0), (0, 6, 0), (0, 5, 0), (0, 0, 0)]


def test_non_latin_runs_option(evaluate):
    from dataclasses import replace

    rows = ["жжж а жжж а жжж", "жжж жжж", "ab"]
    assert evaluate(rows, repetition.non_latin_repeats(evaluate.t, replace(V2, non_latin_runs=True))) == [27, 0, 0]


def test_non_latin_runs_are_counted_in_runs_alone(evaluate):
    from dataclasses import replace

    # Runs lie in other words, in longer runs, beside other scripts and beside signs that are no letters.
    rows = ["ab\u0436\u0436\u0436cd \u0436\u0436\u0436\u0436\u0436\u0436\u0436 x", "дададада да дад да\u2019дад", "абв漢漢漢абв “абв” 漢漢漢漢漢漢漢",
            "𠀀𠀀𠀀 𠀀𠀀𠀀 a𠀀𠀀𠀀𠀀", "\u2014\u2014\u2014 \u2014\u2014\u2014 \u2014\u2014\u2014", "", None]
    scripts = [s for s in V2.scripts if s != "Latin"]
    alone = "|".join(f"\\p{{Is{s}}}{{3,}}" for s in scripts)

    def plain(t):
        runs = F.regexp_extract_all(t, F.lit(alone), F.lit(0))
        weights = F.transform(runs, lambda r: F.when(repetition.occurrences(t, r) >= 3, repetition.occurrences(t, r) * F.length(r)).otherwise(0))
        return F.coalesce(F.aggregate(weights, F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0).cast("bigint"))

    profile = replace(V2, non_latin_runs=True)
    got = evaluate(rows, repetition.non_latin_repeats(evaluate.t, profile), plain(evaluate.t))
    assert [a for a, _ in got] == [b for _, b in got] and sum(a > 0 for a, _ in got) >= 3


def test_many_equal_non_latin_runs_are_searched_once(evaluate):
    from dataclasses import replace
    from time import monotonic

    # A hundred words, 60,000 of them: the whole text was searched for each.
    text = " ".join("слово" + "абвгдежзик"[i % 10] + "лмнопрстуф"[i // 10 % 10] for i in range(60_000))
    begin = monotonic()
    assert evaluate([text], repetition.non_latin_repeats(evaluate.t, replace(V2, non_latin_runs=True))) == [60_000 * 600 * 7]
    assert monotonic() - begin < 15


def test_mixed_scripts_beside_signs_and_plain_words(evaluate):
    rows = ["plain “quoted” – words", "abжabжabжabжa’жab", "\u00fcж\u00fcжab", "x\u0301жaжaжaжaжaж", "𠀀a𠀀a𠀀a𠀀a𠀀", "ªжªжª ж", None]
    letters, foreign = repetition.script_class(V2.scripts), repetition.script_class(s for s in V2.scripts if s != "Latin")

    def plain(t):
        runs = F.filter(F.regexp_extract_all(t, F.lit(letters + "{2,}"), F.lit(0)), lambda s: s.rlike(foreign))

        def weight(s):
            changes = repetition.script_changes(repetition._to_codes(s, V2))
            judged = (F.length(changes) > 0) & ~repetition._legitimate(changes, V2)
            return F.when(judged, F.length(s) * F.length(changes)).otherwise(0).cast("bigint")

        return F.coalesce(F.aggregate(F.transform(runs, weight), F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0).cast("bigint"))

    got = evaluate(rows, repetition.mixed_scripts(evaluate.t), plain(evaluate.t))
    assert [a for a, _ in got] == [b for _, b in got] and sum(a > 0 for a, _ in got) >= 4


@pytest.mark.parametrize("name", repetition.WITHOUT_WORDS)
def test_detectors_of_letters_split_no_words(spark, name):
    text = spark.createDataFrame([("a",)], "t string").select(repetition.detector(name, F.col("t")).alias("d"))
    assert "trim(" not in text._jdf.queryExecution().optimizedPlan().toString()


def test_whitelisted_phrases_are_reported_but_not_weighed(evaluate):
    text = "Therefore we go on. Therefore we go on. Therefore we go on."
    found = evaluate([text], repetition.repeated_phrases(evaluate.t))[0]
    assert {(c.phrase, c.whitelisted) for c in found} >= {("Therefore we go", True), ("we go on.", False)}
    assert evaluate([text], repetition.phrases(evaluate.t)) == [brute.phrase_weight(text, V2.whitelist)]


def test_phrases_of_a_record_are_looked_for_once(spark):
    from rewardloom.plans.catalog import QUERIES

    plan = QUERIES["k8_whitelist_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in plan and plan.count("sort_array(") and "shiftleft(" in plan


def test_words_end_at_every_blank(evaluate):
    from rewardloom.functions.text import BLANKS, words, words_in_stretches

    rows = [f"a{b}b {b}c{b}{b}d{b} e \u200bf\x7fg" for b in BLANKS]
    got = evaluate(rows, words(evaluate.t), words_in_stretches(evaluate.t))
    for row, (plain, s) in zip(rows, got):
        assert plain == s["w"] == row.split() and len(s["stretch"]) == len(plain), repr(row)


LINES = ["The total cost is five dollars.", "We add two numbers!", "Cost of five apples", "", "5", "a b c", "привет мир",
         "five five cost", "Ünïcode straße two", "x жж", "ж xx"]


def test_similarity_of_all_pairs(evaluate):
    rows = [(a, b) for a in LINES for b in LINES]
    got = evaluate(rows, relevance.similarity(F.col("a"), F.col("b")), names=("a", "b"))
    for (a, b), value in zip(rows, got):
        assert value == pytest.approx(brute.similarity(a, b), abs=1e-9), (a, b)


sentence = st.lists(st.sampled_from(["cost", "five", "add two", "мир", "x", "7"]), min_size=1, max_size=5).map(" ".join)
body = st.lists(st.tuples(sentence, st.sampled_from([". ", "! ", "?!", "... ", " "])), max_size=8).map(
    lambda parts: "".join(s + e for s, e in parts)
)


@many
@given(st.lists(st.tuples(sentence, body, sentence, body), min_size=40, max_size=60))
def test_relevance_agrees_with_brute_force(evaluate, rows):
    filled = [(q, f"<reasoning>{r * 9}</reasoning><answer>{a * 5}</answer>{p}") for q, r, a, p in rows]
    thought, answer, post = sections(F.col("t"))
    got = evaluate(
        filled, relevance.topic_relevance(F.col("q"), F.col("t")), thought, answer, post, names=("q", "t")
    )
    for (q, _), (value, r, a, p) in zip(filled, got):
        assert value == pytest.approx(brute.relevance_reward(q, r, a, p), abs=1e-9), (q, r)


PERFECT = "<reasoning>\nwhy\n</reasoning>\n<answer>\n25\n</answer>\n"


def test_tag_count(evaluate):
    """A tag in its place is worth 0.125; each character behind the end costs a thousandth."""
    golden = [
        (PERFECT, 0.5), (PERFECT + "x", 0.498), (PERFECT + "four", 0.492), ("<reasoning>\n" * 2, 0.0), ("<reasoning>\n", 0.125),
        ("\n</reasoning>\n", 0.125), ("\n<answer>\nabc", 0.112), ("x\n</answer>", 0.126), ("x\n</answer>\n\n</answer>", 0.0), ("", 0.0),
        ("<reasoning>why</reasoning><answer>25</answer>", 0.0),
    ]
    assert evaluate([t for t, _ in golden], formats.tag_count(evaluate.t)) == pytest.approx([v for _, v in golden])


def test_formats(evaluate):
    t = evaluate.t
    rows = [PERFECT, PERFECT + "x", " " + PERFECT, "</answer><answer></reasoning><reasoning>", "none",
            "<reasoning>a</reasoning> <answer>b</answer> c"]
    got = evaluate(
        rows, formats.strict_format(t), formats.soft_format(t), formats.strict_format(t, V1),
        formats.soft_format(t, V1), formats.tags_balanced(t), formats.malformed(t),
    )
    assert got == [
        (1.0, 0.5, 0.5, 0.0, True, False), (1.0, 0.5, 0.0, 0.0, True, False), (1.0, 0.5, 0.0, 0.0, True, False),
        (1.0, 0.5, 0.0, 0.0, True, True), (0.0, 0.0, 0.0, 0.0, False, False), (1.0, 0.5, 0.0, 0.5, True, False),
    ]


@pytest.mark.parametrize("kind, model, target, reward", [
    ("Float", "1e3", "1000.0001", 1), ("Float", "inf", "Infinity", 1), ("Float", "inf", "5", 0),
    ("Float", "nan", "nan", 0), ("Float", "12d", "12", 0), ("Float", "1_000", "1000", 1), ("Float", "x", "x", 0),
    ("Integer", "3.9", "3", 1), ("Integer", "-3.9", "-3", 1), ("Integer", "inf", "inf", 0), ("Integer", "+07", "7", 1),
    ("Integer", "12345678901234567891", "12345678901234567890", 0), ("Integer", "-0", "0", 1), ("Integer", "-0.5", "0", 1),
    ("Boolean", "YES", "true", 1), ("Boolean", "0", "false", 1), ("Boolean", "maybe", "maybe", 0),
    ("Percentage", "12%", "12", 1), ("Percentage", "12 %", "12.0001%", 1), ("Percentage", "13%", "12%", 0),
    ("Fraction", "1/2", "0.5", 1), ("Fraction", "1/0", "1/0", 1), ("Fraction", "1/0", "2/0", 0),
    ("Fraction", "X", "x", 1), ("Fraction", " 2 / 8", "1/4", 1),
    ("List", "[1, 2", "[1, 2", 0), ("List", "[1, 2]", "[1.0,2.0]", 1), ("List", "[1, 2]", "[2, 1]", 0),
    ("List", "['a', 'b']", '["a","b"]', 1), ("List", "[]", "[]", 1), ("List", "3", "3", 1), ("List", "[1, 'a']", "[1, 'b']", 0),
    ("Matrix", "[[1,2],[3,4]]", "[[1.0, 2], [3, 4]]", 1), ("Matrix", "[[1,2]]", "[[1,2],[]]", 0),
    ("String", " A b", "a B ", 1), ("Other", "a", "b", 0), (None, "Yes", "yes", 1), ("Float", " ", "", 0),
])
def test_typed_answers(evaluate, kind, model, target, reward):
    got = evaluate(
        [(kind, model, target)], answers.verified(F.col("m"), F.col("t"), F.col("k")), names=("k", "m", "t")
    )
    assert got == [float(reward)]


def python_equal(a, b):
    try:
        x, y = float(a), float(b)
    except ValueError:
        return 0.0
    return float(math.isclose(x, y, rel_tol=1e-5))


numerals = st.sampled_from(["1", "1.0", "1.00001", "1.1", " 2 ", "-2", "1e0", ".5", "5e-1", "0", "-0.0", "x", "1_0", "10", "1__0", "1.", "+1", "1f"])


@many
@given(st.lists(st.tuples(numerals, numerals), min_size=60, max_size=100))
def test_float_rule_agrees_with_python(evaluate, rows):
    got = evaluate(rows, answers.verified(F.col("a"), F.col("b"), F.lit("Float")), names=("a", "b"))
    assert got == [python_equal(a, b) for a, b in rows]


def solution(inner):
    return f"<start_working_out>w<end_working_out><SOLUTION>{inner}</SOLUTION>"


def test_custom_tag_rewards(evaluate):
    rows = [(solution(g), a) for g, a in [("5", "5"), (" 5 ", "5"), ("5.2", "5"), ("5.9", "5"), ("9", "5"), ("x", "5"),
                                           ("1", "0"), ("5", "five")]] + [("5", "5")]
    t, a = F.col("t"), F.col("a")
    got = evaluate(
        rows, answers.graded_answer(t, a, SOLUTION_TAGS), answers.numeric_equality(t, a, SOLUTION_TAGS),
        formats.exact_format(t, SOLUTION_TAGS), formats.approximate_format(t, SOLUTION_TAGS), names=("t", "a"),
    )
    assert [r[0] for r in got] == [3.0, 1.5, 0.5, 0.25, -1.0, -0.5, -0.5, -0.5, 0.0]
    assert [r[1] for r in got] == [1.5, 1.5, 0, 0, 0, 0, 0, 0, 0]
    assert [r[2] for r in got] == [3.0] * 8 + [0.0]
    assert [r[3] for r in got] == [2.0] * 8 + [-2.0]


def test_integer_answers_and_result_check(evaluate):
    t = evaluate.t
    rows = ["<answer>12</answer>", "<answer>12\n</answer>", "<answer>²</answer>", "<answer>٣</answer>", "<answer>1.5</answer>", ""]
    assert evaluate(rows, answers.integer_answer(t)) == [1.0, 1.0, 1.0, 1.0, 0.0, 0.0]
    pairs = [("1.0000001", "1"), ("1.1", "1"), (" a", "a "), ("a", "b")]
    checks = evaluate(pairs, answers.result_check(F.col("a"), F.col("b")), names=("a", "b"))
    assert [(c.is_valid, c.errors) for c in checks] == [
        (True, []), (False, ["Answer mismatch"]), (True, []), (False, ["Answer mismatch"])]


def generations(spark):
    rows = [("a", 1, 1, 1, "how much is five squared", "25", PERFECT), ("a", 1, 2, 1, "q", "1", None),
            ("b", 2, 1, 2, "q", None, "")]
    return spark.createDataFrame(
        rows, "run string, step bigint, sample_id bigint, group_id bigint, question string, answer string, model_output string"
    )


def test_score_handles_empty_rows_and_sums_up(spark):
    rows = score(generations(spark)).orderBy("run", "sample_id").collect()
    assert [r.correctness for r in rows] == [4.0, 0.0, 0.0]
    for r in rows:
        assert r.total_reward == pytest.approx(sum(r[n] for n in REWARDS))
    flagged = flags(score(generations(spark))).orderBy("run", "sample_id").first()
    assert flagged.is_correct and flagged.is_balanced and not flagged.is_relevant


def test_custom_rewards_long_and_wide(spark):
    rewards = Rewards(("correctness",)).register("shout", lambda df, p: F.when(df["question"].contains("!"), 1).otherwise(0))
    scored = score(generations(spark), rewards)
    wide = to_wide(to_long(scored, ("correctness", "shout")), ("correctness", "shout"))
    assert {(r.run, r.sample_id, r.correctness, r.shout) for r in wide.collect()} == {
        ("a", 1, 4.0, 0.0), ("a", 2, 0.0, 0.0), ("b", 1, 0.0, 0.0)}


def test_scoring_needs_no_shuffle(spark):
    plan = score(generations(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_literals_of_lists_and_tuples(evaluate):
    pairs = [
        ("1, 2", "1,2"), ("(1, 2)", "(1,2)"), ("((1,2),(3,4))", "((1, 2), (3, 4))"), ("[True, None]", "[True,None]"),
        ("['a', \"b\"]", '["a","b"]'), ("(1, 2,)", "(1, 2)"), ("['True', 1]", "['True',1]"), ("['it\\'s']", '["it\'s"]'),
    ]
    different = [("(1, 2)", "(2, 1)"), ("['True']", "[True]"), ("[1, 2", "[1, 2]x"), ("['(a)']", "['[a]']"), ("", "[]")]
    found = evaluate(pairs + different, answers.same_list(F.col("a"), F.col("b")), names=("a", "b"))
    assert found[: len(pairs)] == [True] * len(pairs)
    assert not any(found[len(pairs) :])

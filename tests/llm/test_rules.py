import os

import duckdb
import pytest

from rewardloom.llm import rules

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_foreign")


def test_odd_rows_equal_sql(odd):
    frame = odd.toPandas()
    duck = duckdb.connect()
    # Rows get numbers of their own: the SQL joins on them.
    frame["doc_id"] = range(len(frame))
    duck.register("documents", frame)
    want = {r[0]: r[1:] for r in duck.sql(f"select doc_id, {', '.join(COLUMNS)} from ({rules.sql()})").fetchall()}
    numbered = odd.sparkSession.createDataFrame(frame[["doc_id", "text"]])
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rules.judged(numbered).collect()}
    assert got == want
    assert sorted(r.doc_id or 0 for r in rules.judged(odd).collect()) == sorted(r.doc_id or 0 for r in odd.collect())


def test_repeats_and_lines(table):
    words = [f"w{i}" for i in range(30)]
    text = " ".join(words + words[:8] + ["x"] + words[4:14])
    rows = [(1, text), (2, "a b\n\na b\n \nc\na b"), (3, " ".join(["on"] * 9)), (4, " ".join(["on"] * 8))]
    got = {r.doc_id: r for r in rules.judged(table(rows)).collect()}
    assert got[1].n_repeat_words == 14 + 8 + 10
    assert (got[2].n_lines, got[2].n_dup_lines) == (4, 2)
    assert got[3].n_repeat_words == 9 and got[4].n_repeat_words == 0


def test_empty(empty):
    assert rules.judged(empty).collect() == []


def test_plan_has_no_exchange_and_no_python(odd):
    plan = rules.judged(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver tables are not here")
def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = rules.judged(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert all(good) and sum(bad) <= len(bad) / 2


#: Clean texts of twenty words or more.
RUSSIAN = "Утром мы вышли из дома и пошли к реке, где уже собрались рыбаки. Вода была спокойной, и над ней медленно поднимался туман, который скоро исчез под солнцем."
POLISH = "Rano wyszliśmy z domu i poszliśmy nad rzekę, gdzie już zebrali się rybacy. Woda była spokojna, a nad nią powoli unosiła się mgła, która wkrótce zniknęła w słońcu."
CHINESE = " ".join(f"早上我们离开家，第{c}次走到河边，那里已经有很多渔夫聚集在一起。" for c in "一二三四五六七八九十百千万东西南北春夏秋冬山")
ITALIAN = "La mattina siamo usciti di casa e siamo andati al fiume, dove i pescatori si erano già riuniti. L'acqua era calma e la nebbia saliva piano sopra di essa."


def test_clean_texts_of_other_languages_stay(table):
    rows = [RUSSIAN, POLISH, CHINESE, ITALIAN]
    assert all(r.kept for r in rules.judged(table(list(enumerate(rows)))).collect())


def test_words_of_no_language_go(table):
    junk = " ".join(["hehend rendblean antionhare thedhely inthedstsh ofwhblest anderbleinea oreres anbleinnd"[i % 40 :] + f"q{i}x" for i in range(40)])
    assert [r.kept for r in rules.judged(table([(1, junk)])).collect()] == [False]


def test_repeated_lines_by_count_and_by_share(table):
    line = "the {} of the lines that are in this text is not like any of them".format
    few = "\n".join([line("first"), line("first"), line("first"), line("second"), line("third")])
    many = "\n".join([*[line(i) for i in range(60)], *[f"line {i} and so on" for i in range(40)], *[f"line {i} and so on" for i in range(40)]])
    rows = [(1, few), (2, many), (3, many + "\nline 0 and so on" * 30)]
    got = {r.doc_id: (r.n_dup_lines, r.n_lines, r.ok_dup_lines) for r in rules.judged(table(rows)).collect()}
    assert got == {1: (2, 5, True), 2: (40, 140, True), 3: (70, 170, False)}

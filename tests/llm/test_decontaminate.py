import random

import pyarrow as pa

from rewardloom.llm import decontaminate
from rewardloom.llm.words import plain_words

VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "")]


def plain(text):
    w = plain_words(pa.array([text]))
    return [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]


def least_distance(item, text):
    """The least edit distance of the item to any part of the text, the long way."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for x in text:
        last, row[0] = row[0], 0
        for i, y in enumerate(item, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != y))
        best = min(best, row[-1])
    return best


def edited(words, edits, rng):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        kind = rng.random()
        words[i] = rng.choice(VOCABULARY) if kind < 0.4 else "" if kind < 0.7 else words[i] + " " + rng.choice(VOCABULARY)
    return " ".join(words).split()


def corpus(rng, share):
    items = [[rng.choice(VOCABULARY) for _ in range(rng.choice([8, 14, 20, 33, 57]))] for _ in range(60)]
    rows = []
    for i in range(240):
        around = [[rng.choice(VOCABULARY) for _ in range(rng.randrange(60))] for _ in range(2)]
        item = items[i % len(items)]
        inside = edited(item, int(len(item) * share), rng) if i % 4 else []
        rows.append((i, " ".join(around[0] + inside + around[1])))
    return rows, items


def searched(spark, table, rows, items):
    benchmark = spark.createDataFrame([(100 + k, " ".join(x), "clash") for k, x in enumerate(items)], "item_id long, text string, start string")
    return decontaminate.leaked(table(rows), benchmark), benchmark


def test_recall_and_exactness(spark, table):
    rng = random.Random(11)
    for share, least in ((0.0, 1.0), (0.1, 0.95), (0.2, 0.9)):
        rows, items = corpus(rng, share)
        found, _ = searched(spark, table, rows, items)
        got = {(r.doc_id, r.item_id - 100): r for r in found.collect()}
        want = {}
        for doc, text in rows:
            words = plain(text)
            for k, item in enumerate(items):
                distance = least_distance(item, words)
                if distance <= int(len(item) * 0.2 + 1e-9):
                    want[doc, k] = distance
        assert got.keys() <= want.keys()
        assert len(got) >= least * len(want) and len(want) > 150
        for key, r in got.items():
            part = plain(dict(rows)[key[0]])[r.start : r.start + r.n_words]
            # The words named do hold the item at the distance named.
            assert least_distance(items[key[1]], part) == r.distance >= want[key]


def test_case_and_punctuation_do_not_hide(spark, table):
    item = [VOCABULARY[i * 7 % 200] for i in range(20)]
    hidden = "*** ".join(w.upper() for w in item) + "!"
    found, _ = searched(spark, table, [(1, "before " + hidden + " after"), (2, "clean text")], [item])
    assert [(r.doc_id, r.distance, r.start, r.n_words) for r in found.collect()] == [(1, 0, 1, 20)]


def test_clean_documents_stay_whole(spark, table):
    rows, items = corpus(random.Random(5), 0.0)
    found, benchmark = searched(spark, table, rows, items)
    leaking = {r.doc_id for r in found.collect()}
    docs = table(rows)
    kept = decontaminate.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(rows))) - leaking)


def test_odd_rows_and_empty_tables(spark, odd, empty, table):
    items = [(1, "the cat sat on the mat and looked at the dog"), (2, None), (3, ""), (4, "one two"), (None, "one two three four five six")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaked(odd, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == {(10, 1, 0), (5, 4, 0), (6, 4, 0), (7, 4, 0), (6, None, 1), (7, None, 1)}
    assert len(found) == 8
    assert decontaminate.leaked(empty, benchmark).collect() == []
    assert decontaminate.leaked(odd, benchmark.where("false")).collect() == []
    assert decontaminate.decontaminated(odd, benchmark.where("false")).count() == odd.count()


def test_items_in_blocks(spark, table, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    rows, items = corpus(random.Random(8), 0.0)
    found, _ = searched(spark, table, rows, items)
    assert len({(r.doc_id, r.item_id) for r in found.collect()}) >= 180


def found_of(items, texts):
    held = decontaminate.items_of(list(range(len(items))), items)
    return {(i, k) for i, k, *_ in decontaminate._search(held, decontaminate.SIMILARITY)(pa.array(texts))}


def test_recall_per_length_and_at_text_ends():
    rng = random.Random(3)
    for n in (6, 7, 8, 9, 12, 15, 17, 23, 29, 30, 33):
        items = [[rng.choice(VOCABULARY) for _ in range(n)] for _ in range(40)]
        for edits, least in ((0, 1.0), (n // 10, 0.95), (n // 5, 0.9)):
            for behind in (0, 1, 2, 30):
                around = [[[rng.choice(VOCABULARY) for _ in range(k)] for k in (rng.randrange(40), behind)] for _ in items]
                texts = [" ".join(a + edited(x, edits, rng) + b) for (a, b), x in zip(around, items)]
                found = found_of([" ".join(x) for x in items], texts)
                want = {(i, i) for i in range(len(texts))}
                assert len(found & want) >= least * len(want), (n, edits, behind)


def test_scripts_without_spaces():
    items = ["今天天气很好我们去公园散步吧", "日本語の文章はこのように書きます", "ภาษาไทยเขียนโดยไม่เว้นวรรค", "plain words that are all cut at blanks"]
    texts = [f"before 前言{x}后记 after" for x in items[:3]] + ["前言，" + items[0].replace("天气", "天气，").replace("公园", "公院") + "。", "今天", items[3]]
    assert found_of(items, texts) == {(0, 0), (1, 1), (2, 2), (3, 0), (5, 3)}
    assert plain("Ab中文cd，é𠀀𠀁x ไท") == ["ab", "中", "文", "cd", "é", "𠀀", "𠀁", "x", "ไ", "ท"]
    # Words with letters of other scripts stay whole, also at a batch's end.
    assert plain("été привет 한국어 €") == ["été", "привет", "한국어", "€"]
    assert plain("中") == ["中"] and plain("") == []


def test_items_without_a_number(spark, table):
    text = "the quick brown fox jumps over the lazy dog and runs off"
    benchmark = spark.createDataFrame([(None, text), (5, "some other words that nobody has ever copied anywhere")], "item_id long, text string")
    docs = table([(1, "it says " + text + " today"), (2, "nothing of the kind is said in this text")])
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.leaked(docs, benchmark).collect()] == [(1, None, 0)]
    assert [r.doc_id for r in decontaminate.decontaminated(docs, benchmark).collect()] == [2]


def test_short_items_are_found_where_all_their_words_follow_each_other(spark, table):
    items = [(1, "Zug"), (2, "two three"), (3, "a b c d e"), (4, "two three"), (5, "中文字"), (6, "?!")]
    rows = [(1, "one, two three two three"), (2, "two"), (3, "three"), (4, "x a b c d e"), (5, "a b c d"), (6, "der zug!"), (7, "這中文字"), (8, None), (9, "")]
    found = decontaminate.leaked(table(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.n_words, r.distance) for r in found) == [
        (1, 2, 1, 2, 0), (1, 4, 1, 2, 0), (4, 3, 1, 5, 0), (6, 1, 1, 1, 0), (7, 5, 1, 3, 0)
    ]

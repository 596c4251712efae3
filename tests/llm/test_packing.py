import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from rewardloom.llm import packing

FILE = packing.word_bpe()


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def check(rows, found, plain, capacity):
    """Every document is there whole, in its pieces; sequences are gapless and hold no more than they can."""
    want = Counter()
    for doc, text in rows:
        ids = plain(text)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in found)
    return len(places), -(-total // capacity)


def test_documents_of_all_lengths(table, plain):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "cat", "Xylophone!!", "été,", "it's"]) for _ in range(rng.choice([0, 1, 9, 30, 31, 60, 150])))) for i in range(300)]
    found = packing.pack(table(rows), FILE, capacity=64).collect()
    used, least = check(rows, found, plain, 64)
    assert used <= least * 1.02 + 2


def test_odd_rows(odd, plain):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(rows, packing.pack(odd, FILE).collect(), plain, packing.CAPACITY)


def test_empty(empty):
    assert packing.pack(empty, FILE).collect() == []


def test_ids_of_pieces(table, plain):
    text = "one two three <|endoftext|> 's  " * 20
    found = packing.pack(table([(1, text)]), FILE, capacity=50, with_ids=True).orderBy("piece").collect()
    assert [i for r in found for i in r.ids] == plain(text)


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_length(seed):
    rng = random.Random(seed)
    capacity = rng.choice([17, 64, 1000, 4096])
    lengths = {rng.randint(1, capacity): rng.randint(1, 5000) for _ in range(rng.choice([1, 5, 300]))}
    runs = packing.best_plan(lengths, capacity)
    held = Counter()
    for count, parts in runs:
        assert count > 0 and sum(parts) <= capacity
        for length in parts:
            held[length] += count
    assert held == lengths


def test_halves_and_thirds_fill_sequences():
    used = sum(n for n, _ in packing.best_plan({2048: 1000, 1365: 3000, 1: 1000, 4096: 7}))
    assert used == 500 + 1000 + 7


def test_equal_lengths_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    from rewardloom.llm.tables import numbered, stored

    rows = stored(spark.range(5000).select((F.col("id") % 3 % 2).alias("k"), "id"), "rows")
    found = numbered(rows, ["k"], ["id"], F.xxhash64("id")).collect()
    by = defaultdict(list)
    for r in found:
        by[r.k].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_special_tokens_have_their_own_ids(table, plain):
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<", "a", "9", "é", " ", "'", "\n"]
    rng = random.Random(12)
    rows = [(1, "hello <|endoftext|> world"), *[(i, "".join(rng.choice(marks) for _ in range(30))) for i in range(2, 200)]]
    check(rows, packing.pack(table(rows), FILE).collect(), plain, packing.CAPACITY)
    assert plain("hello <|endoftext|> world") == [3306, 49407, 1002, packing.END]


def test_ids_of_pieces_are_those_of_whole_texts(plain):
    import pyarrow as pa

    rng = random.Random(12)
    parts = ["a", "B", "z9", "7", "'", "'s", "'LL", ".", ",", "!!", "<", "=", "-", "é", "é", "́", "̸", "—", "ß", "İ", "Σ", "😀", "漢字",
             "\xa0", " ", " ", "\n", "\x00", "<|endoftext|>", "_", "ﬁ", "²", "½", "‍", "K"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(3000)]
    ids, places = packing.Encoder(FILE).encode(pa.array(texts))
    for text, a, b in zip(texts, places[:-1], places[1:], strict=True):
        assert ids[a:b].tolist() == plain(text)[:-1], repr(text)

import hashlib
import random
import re
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from rewardloom.llm import substrings
from rewardloom.llm.bloom import bloom


def brute(rows, window=substrings.WINDOW):
    lines = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = defaultdict(lambda: float("inf"))
    for (doc, _), line in zip(rows, lines):
        for i in range(len(line) - window + 1):
            if doc is not None:
                key = tuple(line[i : i + window])
                least[key] = min(least[key], doc)
    out = []
    for (doc, _), line in zip(rows, lines):
        gone = [False] * len(line)
        for i in range(len(line) - window + 1):
            if doc is not None and least[tuple(line[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(line, gone) if not g)
        out.append((doc, len(line), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    return sorted([tuple(r[c] for c in columns) for r in substrings.substring_dedup(df).collect()], key=str)


def test_cover_holds_every_difference():
    differences = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert differences == set(range(substrings.PERIOD))


def test_passages_equal_brute_force(table):
    rng = random.Random(7)

    def prose(n):
        return [f"w{rng.randrange(60)}" for _ in range(n)]

    passages = [prose(n) for n in (49, 50, 51, 64, 80, 130, 300)] + [["on"] * 120]
    rows = []
    for i in range(160):
        text = prose(rng.choice([0, 3, 40, 90, 200]))
        for _ in range(rng.choice([0, 1, 1, 3])):
            p = rng.choice(passages)
            cut = p[rng.randrange(3) :] if rng.random() < 0.3 else p
            at = rng.randrange(len(text) + 1)
            text[at:at] = cut
        rows.append(((i * 37) % 160, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(500 + i, rows[20][1]) for i in range(5)]
    want = brute(rows)
    assert got(table(rows)) == want
    assert sum(r[2] > 0 for r in want) > 30


def test_kept_text_spans_and_carried_columns(table):
    line = [f"w{i}" for i in range(70)]
    rows = [(1, " ".join(line), "en"), (2, "x  y " + " ".join(line[5:60]) + "\nz", "fr"), (3, "a  b\nc", None)]
    df = substrings.substring_dedup(table(rows), carried=("lang", "text"))
    found = {r.doc_id: r for r in df.collect()}
    assert found[2].kept_text == "x y z" and found[2].spans == [[2, 57]] and found[2].carried.lang == "fr"
    assert found[1].kept_text is None and found[3].kept_text is None and found[3].carried.text == "a  b\nc"


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd) == brute(rows)


def test_rows_that_share_a_number(table):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, line), (1, line), (2, line), (2, line + " more"), (None, line)]
    assert got(table(rows)) == brute(rows)


def test_empty(empty):
    assert got(empty) == []


def test_marked_starts():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(50, 200))
        anchors = rng.choice(n - 19, 3, replace=False)
        want = [i for i in range(n - 49) if any(0 <= a - i < substrings.PERIOD for a in anchors)]
        assert substrings.marked_starts(anchors, n, 50).tolist() == want


def test_rows_that_share_a_number_and_hold_different_texts(table):
    line = [f"w{i}" for i in range(400)]
    rows = [(2, " ".join(line)), (2, " ".join(line[300:355])), (3, " ".join(line[310:390])), (1, " ".join(line[100:180])), (2, " ".join(line[:60]))]
    rows += [(4, " ".join(line)), (4, " ".join(line)), (5, " ".join(line[200:])), (5, "short")]
    want = brute(rows)
    assert got(table(rows)) == want and sum(r[2] > 0 for r in want) > 4


def test_a_filter_lets_all_its_keys_through_and_few_others(spark):
    keys = spark.range(100_000).select((F.col("id") * 7919 - 5).alias("h"))
    found = bloom(keys)
    assert found.holds(np.arange(100_000) * 7919 - 5).all()
    assert found.holds(np.arange(100_000) * 7919 - 4).mean() < 0.03
    assert not bloom(keys.where("false")).holds(np.arange(10)).any()
    # A full filter lets more through, but loses none.
    assert bloom(keys, most=2**20).holds(np.arange(100_000) * 7919 - 5).all()


def test_no_stage_runs_two_python_steps(table):
    line = " ".join(f"w{i}" for i in range(60))
    df = substrings.substring_dedup(table([(1, line), (2, line + " more"), (3, "short")]), carried=("lang",))
    df.collect()
    # A plan names a step above the one it reads from; a scan or an exchange ends the stage.
    inside = False
    for step in df._jdf.queryExecution().executedPlan().toString().splitlines():
        if "MapInArrow" in step:
            assert not inside, step
            inside = True
        elif "Scan" in step or "Exchange" in step:
            inside = False


def test_slices_give_free_memory_back():
    # In a process of its own, whose memory nothing else moves: blocks too small to be mapped alone are freed between some that stay.
    code = """
import os
import pyarrow as pa
from rewardloom.llm import words as W

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

batch = pa.RecordBatch.from_pydict({"text": ["a b", None]})
list(W.slices(iter([batch])))
held = [bytearray(10_000) for _ in range(20_000)]
full = resident()
del held[1::2], held[:-1:2]
held = held[::50]
list(W.slices(iter([batch])))
print(full - resident())
"""
    root = Path(substrings.__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert int(out) > 120e6

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rewardloom.llm import manifest
from rewardloom.llm.tables import stored

KINDS = StructType([
    *[StructField(n, LongType() if n in ("doc_id", "n_chars") else StringType()) for n in manifest.FIELDS],
    *[StructField(n, StringType()) for n in ("tree", "n", "range", "position", "level", "place", "digest", "held", "path", "root", "row")],
])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def small(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    langs = defaultdict(list)
    for row in rows:
        langs[row[2]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels([x[2] for x in sorted(langs[lang], key=lambda x: x[:3])]) for lang in order}
    top = levels([trees[lang][-1][0] for lang in order])
    out = []
    for j, lang in enumerate(order):
        for i, (_, _, digest, row) in enumerate(sorted(langs[lang], key=lambda x: x[:3])):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            proof, now = [], leaf((*row[:4], small(row[4]))) if bad else digest
            for tree, at in ((trees[lang], i), (top, j)):
                for level in tree[:-1]:
                    first = at - at % 8
                    run = level[first : first + 8]
                    proof += run[: at - first] + run[at - first + 1 :]
                    now = sha("".join(run[: at - first] + [now] + run[at - first + 1 :]))
                    at //= 8
            root = top[-1][0]
            out.append((row[0], digest, trees[lang][-1][0], root, sha("".join(proof)), now, now == root))
    return sorted(out, key=str)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, *["clash"] * (len(KINDS) - len(r))) for r in rows], KINDS).repartition(parts)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return sorted([tuple(r) for r in manifest.manifest(docs, tampered, F.translate("text", manifest.UPPER, manifest.LOWER)).collect()], key=str)


def made(n, langs, seed=5):
    rng = random.Random(seed)
    return [(i, rng.choice(["web", None]), rng.choice(langs), rng.choice([i, None]), rng.choice(["Some Text é", "none", None, "", f"A{i}"])) for i in range(n)]


@pytest.fixture
def low(monkeypatch):
    """Ranges of eight leaves, so that small trees have several logs."""
    monkeypatch.setattr(manifest, "LEVELS", 1)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 600])
def test_one_tree_in_ranges(spark, low, n):
    rows = made(n, ["en"])
    assert found(spark, rows) == brute(rows)


def test_many_trees_and_odd_rows(spark, low):
    rows = made(300, [None, "", "en", "é", "e", *[f"l{i}" for i in range(20)]])
    rows += [(None, None, None, None, None), (None, "a", "en", 1, "X"), (None, "a", "en", 1, "X"), (4, "a", "en", 1, "B"), (4, "a", "en", 1, "A")]
    rows += [(5, "same", "en", 0, "Row")] * 20 + [(10**15, "x", "en", 2, "x" * 100_000)]
    assert found(spark, rows) == brute(rows)


def test_trees_of_one_range_and_more(spark):
    rows = made(4500, ["en"]) + made(10, [None, "de"], 6)
    got = found(spark, rows)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_empty_table(spark):
    assert found(spark, [], 1) == []


def postorder(n):
    """Nodes of a tree of n leaves in the order in which a walk leaves them."""
    out = []

    def visit(level, place):
        if level:
            for child in range(place * 8, min(place * 8 + 8, -(-n // 8 ** (level - 1)))):
                visit(level - 1, child)
        out.append((level, place))

    visit(manifest.height(n), 0)
    return out


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 512, 513, 1000])
def test_positions_are_those_of_a_postorder_walk(n):
    assert [manifest.position(level, place, n) for level, place in postorder(n)] == list(range(len(postorder(n))))


def test_a_log_is_written_in_completion_order(spark):
    held = F.struct(F.lit(1).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("tampered")).alias("held")
    leaves = spark.range(100).select(F.lit("t").alias("tree"), F.lit(100).cast("long").alias("n"), F.col("id").alias("rank"), F.md5(F.col("id").cast("string")).alias("digest"), held)
    rows = manifest.log(leaves).collect()
    assert [(r.level, r.place) for r in rows] == postorder(100)
    assert [r.position for r in rows] == list(range(len(rows)))


def test_numbers_of_a_hot_tree_come_from_many_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(manifest, "stored", lambda df, name: seen.append(stored(df, name)) or seen[-1])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tree = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("tree")
        rows = manifest.ranked(spark.range(20_000).select(tree, F.xxhash64("id").alias("k")), ["k"]).where("tree = 'hot'").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [r["rank"] for r in sorted(rows, key=lambda r: r.k)] == list(range(len(rows)))
    assert {r.n for r in rows} == {len(rows)}
    assert seen[0].where("tree = 'hot'").select(F.shiftright("_at", 33)).distinct().count() > 3

import zstandard
import numpy as np
import math
import random

import pytest

from rewardloom.llm import quality


def prose(rng, good):
    words = ["the", "cat", "that", "sat", "under", "an", "old", "tree", "was", "never", "seen", "again"]
    line = [rng.choice(words) for _ in range(rng.randrange(5, 200))]
    return " ".join(line) if good else " ".join(w.upper() + "!!" for w in line)


@pytest.fixture(scope="module")
def corpus(spark, table):
    rng = random.Random(9)
    rows = [(i, prose(rng, i % 3)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "clash") for i in range(500)], "doc_id long, quality int, text string")
    return table(rows), labels


def test_held_out_documents_are_told_apart(corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model).select("doc_id", "score", quality.held_out(quality.F.col("doc_id")).alias("h")).collect()
    assert len(rows) == 600 and all(0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.h or r.doc_id >= 500]
    assert sum((r.score >= 0.3) == (r.doc_id % 3 > 0) for r in unseen) >= 0.97 * len(unseen)


def test_held_out_labels_are_never_learnt(spark, corpus):
    docs, labels = corpus
    changed = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, changed)
    assert a.good == b.good and a.bad == b.bad and (a.weights == b.weights).all()


def test_rejected_documents_go(corpus):
    docs, labels = corpus
    kept = quality.accepted(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i % 3 > 0 for i in ids) >= 395 and sum(i % 3 == 0 for i in ids) <= 10


def test_odd_rows(corpus, odd, empty):
    model = quality.fit(*corpus)
    rows = quality.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2]
    assert quality.scored(empty, model).collect() == []


def test_without_usable_labels(corpus, odd, empty):
    docs, labels = corpus
    for few in (labels.where("false"), labels.where("quality = 1"), labels.where("doc_id = 3")):
        model = quality.fit(docs, few)
        assert {r.score for r in quality.scored(odd, model).collect()} == {0.5}
        assert quality.accepted(odd, model).count() == odd.count()
    assert quality.fit(empty, labels) is None


def test_scores_are_those_of_each_text_alone(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    level, plain = quality.LEVEL, dict(write_content_size=False, write_checksum=False, write_dict_id=False)

    def compressed(parts, dictionary=None):
        held = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        return sum(len(zstandard.ZstdCompressor(level=level, **held, **plain).compress(x)) for x in parts)

    def score(text):
        data = (text or "").encode()
        small = [data[i : i + 1024] for i in range(0, len(data), 1024)] or [b""]
        large = [data[i : i + 65536] for i in range(0, len(data), 65536)] or [b""]
        good, bad = compressed(small, model.good), compressed(small, model.bad)
        d, r, k = (bad - good) / (bad + good), math.log(max(1, len(data)) / compressed(large)), (1 + len(data)) ** -0.5
        x = (np.array([1, d, d * d, r, r * r, d * r, k, k * d]) - model.mean) / model.scale
        return 1 / (1 + math.exp(-min(30, max(-30, float(x @ model.weights)))))

    rows = docs.orderBy("doc_id").limit(60).collect()
    found = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert all(abs(found[r.doc_id] - score(r.text)) < 1e-6 for r in rows)
    assert len({round(x, 6) for x in found.values()}) > 50

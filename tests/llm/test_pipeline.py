"""Every stage of the pipeline against a brute-force version on a small table, and the whole against its stages."""

import random

import pytest
import test_decontaminate
import test_packing
import test_quality
import test_simhash
import test_substrings
from tokenizers import Tokenizer

import corpus_pipeline
from rewardloom.llm import packing, quality

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    words = [f"{a}{b}" for a in "the and that with from this sat ran old tree".split() for b in ["", "s", "ed", "ing", "er", "ly"]]
    passage = " ".join(rng.choice(words) for _ in range(80))
    items = [" ".join(rng.choice(words) for _ in range(24)) for _ in range(10)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    texts = [prose(rng.randrange(40, 160)) for _ in range(160)]
    texts += [test_quality.prose(rng, False) for _ in range(80)]
    texts += [f"{prose(30)} {passage} {prose(30)}" for _ in range(12)] + [passage]
    texts += [f"{prose(30)} {rng.choice(items)} {prose(30)}" for _ in range(12)]
    texts += [texts[3]] * 5 + [texts[4] + " end", None, ""]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(7, texts[7], "en", "src1", 9)]
    labels = [(i, int(i < 160), 0) for i in range(240)]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, KINDS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows that go into and come out of each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.dtypes == docs.dtypes
        out.append((docs, after))
        docs = after
    return dict(zip((n for n, _ in corpus_pipeline.STAGES), out))


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_quality_rejects(spark, sf_dir, stages):
    before, after = stages["quality"]
    model = quality.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = sorted(r.doc_id for r in quality.scored(before, model).collect() if r.score >= 0.3)
    got = sorted(r.doc_id for r in after.collect())
    assert got == want
    assert all(i in got for i in range(160)) and sum(i in got for i in range(160, 240)) < 8


def test_one_of_each_group_stays(stages):
    before, after = (texts(x) for x in stages["near_duplicates"])
    want = sorted({doc for doc, _, root in test_simhash.brute(before) if doc == root})
    assert sorted(doc for doc, _ in after) == want
    assert len(after) < len(before) and set(after) <= set(before)


def test_repeated_words_are_cut(stages):
    before, after = stages["substrings"]
    want = {r[0]: r for r in test_substrings.brute(texts(before))}
    rows = {r.doc_id: r for r in after.collect()}
    assert set(rows) == {d for d, n, gone, _ in want.values() if gone == 0 or gone < n}
    old = dict(texts(before))
    cut = 0
    for doc, r in rows.items():
        _, n, gone, sha = want[doc]
        if gone:
            cut += 1
            assert test_substrings.hashlib.sha256(r.text.encode()).hexdigest() == sha and r.n_chars == len(r.text)
        else:
            assert r.text == old[doc]
    assert cut >= 10


def test_leaking_documents_go(spark, sf_dir, stages):
    before, after = (texts(x) for x in stages["decontamination"])
    items = [test_decontaminate.plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaking = {
        doc for doc, text in before if any(test_decontaminate.least_distance(i, test_decontaminate.plain(text or "")) <= int(len(i) * 0.2) for i in items)
    }
    assert {doc for doc, _ in before} - {doc for doc, _ in after} == leaking and len(leaking) >= 10


def test_packing_holds_all_that_is_left(stages):
    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(packing.word_bpe())
    plain = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END]
    used, least = test_packing.check(texts(before), after.collect(), plain, packing.CAPACITY)
    assert used <= least + 1


def test_run_is_the_stages_one_after_the_other(spark, sf_dir, stages):
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    got, want = (sorted(tuple(r[c] for c in columns) for r in df.collect()) for df in (corpus_pipeline.run(spark, sf_dir), stages["packing"][1]))
    assert got == want


def test_odd_and_empty_tables(spark, odd, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    for n, docs in enumerate((odd, odd.where("false"))):
        docs = docs.select("*", F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
        folder = f"{tmp_path}/{n}"
        docs.write.parquet(f"{folder}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
        at = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = corpus_pipeline.stored(stage(spark, at, folder), name)
            assert after.columns == at.columns
            at = after
        assert corpus_pipeline.run(spark, folder).count() >= at.count()

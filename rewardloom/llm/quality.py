"""Quality scores from compression: one zstandard dictionary learnt from good labelled text, one from bad.

A text is cut into blocks of ``BLOCK`` bytes and each block is compressed with either dictionary, so that the dictionary and
not the text's own history decides, however long the text is. The difference of the two compressed sizes over their sum,
with the text's plain compression ratio and length, goes through a logistic calibration: the score is the probability of
label 1. Language, source, labels and numbers are no inputs.

Fitting uses about ``sample`` labelled documents of either label, a share by the hash of doc_id, none longer than ``LONGEST``
characters and none of the held-out fifth (crc32 of doc_id as text divisible by 5). Half of them make the
dictionaries, the other half the calibration. This bounded sample is all that reaches the driver; scoring is a map over all
documents and whole texts.

Null and empty texts get the score of an empty text. Labels other than 0 and 1 are ignored; of repeated labels the smallest
counts; a missing doc_id is not held out. If either label has no usable text, every score is 0.5. Rows are scored one by
one, repeated rows alike; only ``doc_id`` and ``text`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.llm import words as W

SAMPLE = 3000
LONGEST = 30_000
BLOCK = 1024
PLAIN_BLOCK = 1 << 16
DICTIONARY_BYTES = 64 << 10
#: Blocks that a dictionary is made from; more of the sample's than these only take time.
TRAINED = 160 * DICTIONARY_BYTES // BLOCK
LEVEL = 3
THRESHOLD = 0.3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def _blocks(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, max(1, len(text)), size)]


class Sizes:
    """Compressed sizes of texts under both dictionaries and none."""

    def __init__(self, good: bytes, bad: bytes):
        options = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compressors = []
        for content in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=dictionary, **options))
        self.plain = zstandard.ZstdCompressor(**options)

    def features(self, text: bytes) -> tuple[float, float, float]:
        blocks = _blocks(text, BLOCK)
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.compressors)
        plain = sum(len(self.plain.compress(b)) for b in _blocks(text, PLAIN_BLOCK))
        return (bad - good) / (bad + good), np.log(max(1, len(text)) / plain), 1 / np.sqrt(1 + len(text))


def _design(features: list[tuple[float, float, float]]) -> np.ndarray:
    d, r, k = np.array(features, float).reshape(-1, 3).T
    return np.column_stack([np.ones(len(d)), d, d * d, r, r * r, d * r, k, k * d])


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of at most ``TRAINED`` blocks of the labelled sample, chosen by their hashes."""
    blocks = [b for t in texts for b in _blocks(t, BLOCK)]
    blocks.sort(key=zlib.crc32)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks[:TRAINED]).as_bytes()
    except zstandard.ZstdError:
        # Too little text to train on: the text itself serves.
        return b"".join(blocks)[:DICTIONARY_BYTES]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fitted(rows: list[tuple[int, int, str]]) -> Model | None:
    """The model learnt from (doc_id, label, text) rows; None if a label has no text in either half."""
    halves: list[list[tuple[int, bytes]]] = [[], []]
    seen = {0: 0, 1: 0}
    for _, label, text in sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()[::-1]), r)):
        if text:
            halves[seen[label] % 2].append((label, text.encode()))
            seen[label] += 1
    if min(seen.values()) < 2:
        return None
    good, bad = (_dictionary([t for q, t in halves[0] if q == label]) for label in (1, 0))
    sizes = Sizes(good, bad)
    x = _design([sizes.features(t) for _, t in halves[1]])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[scale < 1e-12] = 0, 1
    y = np.array([q for q, _ in halves[1]], float)
    return Model(good, bad, mean, scale, _logistic((x - mean) / scale, y))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    one_in = F.when(F.col("label") == 0, max(1, counts.get(0, 0) // sample)).otherwise(max(1, counts.get(1, 0) // sample))
    # Each doc_id is there once, so of either label about ``sample`` rows of two numbers come, and never many over twice that.
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), one_in) == 0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= LONGEST)
    # Of rows that share a doc_id one text is enough, so that the bound holds.
    rows = texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return fitted([(r.doc_id, r.label, r.text) for r in rows])


def _scorer(model: Model | None):
    sizes = Sizes(model.good, model.bad) if model else None

    def scores(column: pa.Array) -> np.ndarray:
        if model is None:
            return np.full(len(column), 0.5)
        data, places = W.text_bytes(column)
        whole = data.tobytes()
        x = _design([sizes.features(whole[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)])
        return 1 / (1 + np.exp(-np.clip((x - model.mean) / model.scale @ model.weights, -30, 30)))

    return scores


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in W.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in W.slices(batches):
            yield batch.filter(pa.array(scores(batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

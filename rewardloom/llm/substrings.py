"""Substring dedup by difference-cover anchors.

A window is ``window`` consecutive words of one text. A word is removed if it is covered by a window whose word sequence
also starts in a document with a smaller doc_id.

1. *Anchors.* Only word places that lie in a difference cover modulo ``period`` are hashed, each with the ``window - period
   + 1`` words that begin there. For any two places ``i``, ``j`` the cover holds ``i + k`` and ``j + k`` for some ``k < period``,
   so equal windows share an anchor at the same place inside them, wherever they lie. Six of 31 places are hashed.
2. Anchors found in two documents or more mark the window starts up to ``period - 1`` words before them.
3. *Extension.* The marked windows are compared whole, by 128-bit hashes: the smallest doc_id of each decides. So the
   result is that of comparing all windows, up to a chance of 2**-128 per pair of windows.

Anchors count by distinct texts, so exact copies repeat nothing: a document whose text equals that of a smaller doc_id is removed whole
if it has a window, and its windows need no extension. Anchors and windows move as rows of numbers: once to find what
repeats, pre-aggregated in every task, and then only those that a Bloom filter of the repeated ones lets through, to meet these. A
passage that a third of all documents share is joined with one row, which adaptive execution splits. Only texts with
marked windows or copies are shuffled; all others are judged where they are read.

Null texts have no words; blank and short texts are returned with nothing removed. Rows with the same doc_id are one
document each, whether their texts are equal or not, and do not make each other repeated; rows without doc_id never remove words elsewhere and lose none. Only
``doc_id`` and ``text`` are read. An empty table gives an empty result. A task holds one text and about ten times its bytes, and
filters of 32 MB at most. Texts are known by 64-bit hashes when anchors are counted, and by md5 as copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm import words as W
from rewardloom.llm.bloom import Bloom, bloom
from rewardloom.llm.tables import stored

WINDOW = 50
#: A difference cover modulo 31: every difference occurs.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Seeds of the word hashes and window hashes of the two halves of a window's hash.
SEEDS = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


class Half:
    """One 64-bit half of the hash of word ranges."""

    def __init__(self, word_seed: int, range_seed: int):
        self.of_words, self.of_ranges = W.Hasher(word_seed), W.Hasher(range_seed)

    def hashes(self, w: W.Words, at: np.ndarray, width: int) -> pa.Array:
        return pa.array(self.of_ranges.ranges(self.of_words.words(w), at, at + width).view(np.int64))


def anchor_places(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which anchors begin and the texts they belong to; texts shorter than a window have none."""
    n, width = np.diff(first), window - PERIOD + 1
    text = np.repeat(np.arange(len(n)), np.where(n >= window, n - width + 1, 0))
    starts = np.where(n >= window, n - width + 1, 0)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(starts) - starts, starts)
    chosen = np.isin(np.arange(PERIOD), COVER)[inner % PERIOD]
    return (first[text] + inner)[chosen], text[chosen]


def _anchors(docs: DataFrame, window: int, repeated: Bloom | None = None) -> DataFrame:
    """The anchors of texts ``t``; of those that may be ``repeated`` their places too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = Half(*SEEDS[0])
        for batch in W.slices(batches):
            w = W.words(batch.column("text"))
            at, text = anchor_places(w.first, window)
            h = half.hashes(w, at, window - PERIOD + 1)
            if repeated is not None:
                maybe = repeated.holds(h.to_numpy())
                h, at, text = h.filter(pa.array(maybe)), at[maybe], text[maybe]
            arrays, names = [h, batch.column("t").take(pa.array(text))], ["h", "t"]
            if repeated is not None:
                arrays += [batch.column("doc_id").take(pa.array(text)), pa.array((at - w.first[text]).astype(np.int32))]
                names += ["doc_id", "pos"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, "h long, t long" if repeated is None else "h long, t long, doc_id long, pos int")


def marked_starts(anchors: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Starts of the windows that can hold one of these anchors at a place below ``PERIOD``."""
    edge = np.zeros(n_words + 2, np.int64)
    np.add.at(edge, np.maximum(anchors - (PERIOD - 1), 0), 1)
    np.add.at(edge, anchors + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: n_words - window + 1] > 0)


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words the windows at these starts cover."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n_words), -1)
    return np.cumsum(edge[:n_words]) > 0


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<bigint>>, kept_text string"


def _cut(texts: DataFrame, window: int, carried: list[str], marked: Bloom | None = None) -> DataFrame:
    """Results for rows of doc_id, text, copy (removed whole) and starts (of windows that repeat, or null); none for those whose
    doc_id may be among the ``marked``, which leave here, as another Python step before this one would double the workers."""
    kinds = ", ".join(f"{name} {kind}" for name, kind in texts.select(*carried).dtypes) if carried else ""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            if marked is not None:
                batch = batch.filter(pa.array(~_maybe(batch, marked)))
            out: list[list] = [[], [], [], [], []]
            columns = (batch.column(c).to_pylist() for c in ("text", "copy", "starts"))
            for text, copy, starts in zip(*columns, strict=True):
                line = (text or "").encode().split()
                n = len(line)
                gone = np.zeros(n, bool)
                if copy and n >= window:
                    gone[:] = True
                elif starts:
                    gone = covered(np.array(starts), n, window)
                rest = [x for x, g in zip(line, gone, strict=True) if not g] if gone.any() else line
                whole = b" ".join(rest)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                row = (n, n - len(rest), hashlib.sha256(whole).hexdigest(), edges.reshape(-1, 2).tolist(), whole.decode() if gone.any() else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays, *[batch.column(c) for c in carried]], names)

    return texts.select("doc_id", "text", "copy", "starts", *carried).mapInArrow(run, f"{RESULT}, {kinds}" if kinds else RESULT)


def _marked_windows(texts: DataFrame, window: int, repeated: Bloom | None = None) -> DataFrame:
    """The marked windows of texts; of those that may be ``repeated`` their texts and places too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = [Half(*seeds) for seeds in SEEDS]
        for batch in W.slices(batches):
            w = W.words(batch.column("text"))
            lists = batch.column("anchors")
            at, text = [], []
            for i, anchors in enumerate(lists):
                n = int(w.first[i + 1] - w.first[i])
                starts = marked_starts(np.asarray(anchors.values), n, window)
                at.append(starts + w.first[i])
                text.append(np.full(len(starts), i))
            at, text = np.concatenate(at), np.concatenate(text)
            h = halves[1].hashes(w, at, window)
            if repeated is not None:
                maybe = repeated.holds(h.to_numpy())
                h, at, text = h.filter(pa.array(maybe)), at[maybe], text[maybe]
            arrays, names = [halves[0].hashes(w, at, window), h, batch.column("doc_id").take(pa.array(text))], ["g", "h", "doc_id"]
            if repeated is not None:
                arrays += [batch.column("t").take(pa.array(text)), pa.array((at - w.first[text]).astype(np.int32))]
                names += ["t", "pos"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "g long, h long, doc_id long"
    return texts.select("doc_id", "t", "text", "anchors").mapInArrow(run, schema if repeated is None else f"{schema}, t long, pos int")


def _maybe(batch: pa.RecordBatch, marked: Bloom) -> np.ndarray:
    """Which rows' doc_id may be among the marked ones; none that is null may be."""
    doc = batch.column("doc_id")
    return marked.holds(doc.fill_null(0).to_numpy()) & doc.is_valid().to_numpy(zero_copy_only=False)


def _among(docs: DataFrame, marked: Bloom) -> DataFrame:
    """The rows whose doc_id may be among the marked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_maybe(batch, marked)))

    return docs.mapInArrow(run, docs.schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by a blank), the removed
    ``spans`` of words as [from, to), ``kept_text`` (those words; null if nothing is removed, as the text then stays as it
    is) and, if asked for, ``carried``: a struct of these columns."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    extra = F.struct(*carried).alias("carried") if carried else F.lit(None).cast("string").alias("carried")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", extra)
    known = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("t"))

    # An anchor is repeated if it is found in two different texts.
    repeated = _anchors(known, window).groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    # A stored side has its own exchange before the join, so that adaptive execution can split a hot key's rows.
    repeated = stored(repeated.where("a < b").select("h"), "repeated")
    anchors = _anchors(known, window, bloom(repeated)).join(repeated.hint("shuffle_hash"), "h")
    anchors = anchors.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("anchors"))

    # Rows that share a doc_id may hold different texts, so a copy is known by doc_id and text.
    named = known.select("doc_id", "t", F.md5(F.col("text").cast("binary")).alias("k"))
    least = named.groupBy("k").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    copies = named.join(least, "k").where("doc_id > a").groupBy("doc_id", "t").agg(F.collect_set("k").alias("copied"))
    marks = stored(anchors.join(copies, ["doc_id", "t"], "full"), "marks")

    marked = bloom(stored(marks.select("doc_id").distinct(), "marked"))
    none = F.lit(None).cast("array<int>").alias("starts")
    clean = docs.select("doc_id", "text", F.lit(False).alias("copy"), none, "carried")

    met = _among(docs, marked).withColumn("t", F.xxhash64("text")).join(marks, ["doc_id", "t"], "left")
    copy = F.coalesce(F.array_contains("copied", F.md5(F.col("text").cast("binary"))), F.lit(False))
    met = met.select("doc_id", "t", "text", "carried", "anchors", copy.alias("copy"))
    met = stored(met.withColumn("open", ~F.col("copy") & F.col("anchors").isNotNull()), "met")
    closed = met.where("not open").select("doc_id", "text", "copy", none, "carried")

    open_texts = met.where("open")
    least = _marked_windows(open_texts, window).groupBy("g", "h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    least = stored(least.select("g", "h", "a"), "least")
    windows = _marked_windows(open_texts, window, bloom(least.select("h")))
    later = windows.join(least.hint("shuffle_hash"), ["g", "h"]).where("doc_id > a")
    starts = later.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("starts"))
    extended = open_texts.join(starts, ["doc_id", "t"], "left").select("doc_id", "text", "copy", "starts", "carried")
    parts = [_cut(clean, window, ["carried"], marked), *[_cut(texts, window, ["carried"]) for texts in (closed, extended)]]
    result = parts[0].union(parts[1]).union(parts[2])
    return result if carried else result.drop("carried")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) as k
  from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d)),
repeated as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by k) as least from windows) where least < doc_id),
gone as (select distinct doc_id, i + j as p from repeated, range({WINDOW}) r(j)),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from d),
kept as (select doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from words anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)"""

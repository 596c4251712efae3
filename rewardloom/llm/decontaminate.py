"""Benchmark decontamination by the CGK embedding, bit sampling and exact edit distance.

Texts and items are cut into plain words (lower case, cut at ASCII characters other than letters and digits; each letter of a
script without spaces, such as Chinese, is a word). The CGK walk
reads a word, emits it, and moves on to the next word or stays, as a random function of the step and the word decides. Two
sequences at a small edit distance walk together again soon after each edit, so their walks differ in few places. Sampling
some steps of the walk gives a key that similar sequences share with fair probability; ``repetitions`` independent walks and
samples raise it to the target (0.95 for copies with one word in ten edited, measured in the tests).

A walk is the same for all windows that begin at a word, and the steps are sampled below the size of an item's class, so
one walk serves windows of all item sizes. Walks begin at every ``STRIDE``-th word of a text; items are walked from
``STRIDE`` neighbouring words instead, items of fewer than ``DENSE`` words from every word, and long items from further
words, so that no alignment is lost, at a text's end neither. Small windows have more repetitions, and count only where the
sampled steps stand on three words or more: keys of one or two words are met everywhere. Keys that hit an
item are verified: the edit distance of the whole item to the best place near the hit (Myers' bit-parallel search). An item
is found where at most ``1 - similarity`` of its words are edited; items of fewer than ``LEAST`` words, which allow no edit,
where all their words follow each other, by hashes of as many words at every word.

Items are taken in blocks of at most ``BLOCK`` and held by every task as sorted keys, which bounds what is broadcast; each
block is one pass over all texts, which are neither shuffled nor copied. Items without words (null and empty
ones too) are never found. Items without a number are searched like
others and found with a null ``item_id``. Null and empty texts hold nothing. Repeated rows are judged one by one,
repeated items are found each. Only ``item_id`` and ``text`` of the benchmark and ``text`` of the documents are read, other
columns pass unchanged. An empty table on either side gives no leaks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm import words as W

BLOCK = 20_000
LEAST = 6
STRIDE = 3


class Windows(NamedTuple):
    """A class of windows: steps of the walk, how many are sampled, on how many words they must stand, in how many
    repetitions, and the fewest and most words of items that have such windows."""

    size: int
    sampled: int
    distinct: int
    repetitions: int
    fewest: int
    most: int


#: Items of fewer words have windows at every word.
DENSE = 30
MANY = 2**31
CLASSES = (
    Windows(3, 2, 2, 10, LEAST, 8),
    Windows(4, 3, 1, 8, LEAST, 8),
    Windows(6, 4, 3, 10, 9, DENSE - 1),
    Windows(9, 5, 3, 5, 9, MANY),
    Windows(24, 7, 1, 5, 24, MANY),
    Windows(48, 8, 1, 5, 48, MANY),
)
SIMILARITY = 0.8
#: The seed of the hashes of whole short items.
PHRASE = 0xC2B2AE3D27D4EB4F
LEAK = "doc_id long, item_id long, start int, n_words int, distance int"


class Walk(NamedTuple):
    """One repetition: the seed of its random function and the sampled steps of each class; none of classes with fewer
    repetitions."""

    seed: int
    steps: list[list[int]]


def walks(seed: int = 20) -> list[Walk]:
    rng = np.random.default_rng(seed)
    out = []
    for r in range(max(c.repetitions for c in CLASSES)):
        steps = [sorted(rng.choice(c.size, c.sampled, replace=False).tolist()) if r < c.repetitions else [] for c in CLASSES]
        out.append(Walk(int(rng.integers(1, 2**63)), steps))
    return out


def keys_of(walk: Walk, hashes: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every class the places in ``at`` of the windows that count, and their keys; ``hashes`` must go on for the longest
    walk behind each start."""
    # The high bits of a product are random enough for coins.
    coins = (hashes * np.uint64(walk.seed | 1)) >> np.uint64(16)
    sampled: dict[int, list[int]] = {}
    for c, steps in enumerate(walk.steps):
        for step in steps:
            sampled.setdefault(step, []).append(c)
    keys = [np.full(len(at) if steps else 0, walk.seed + c, np.uint64) for c, steps in enumerate(walk.steps)]
    stood = {c: (np.full(len(at), -1, np.int64), np.zeros(len(at), np.int8)) for c, k in enumerate(CLASSES) if k.distinct > 1 and walk.steps[c]}
    pointer, read = at.astype(np.int64), np.empty(len(at), np.uint64)
    for step in range(max(sampled, default=-1) + 1):
        if step in sampled:
            np.take(hashes, pointer, out=read, mode="clip")
            for c in sampled[step]:
                keys[c] ^= read
                keys[c] *= np.uint64(0x9E3779B97F4A7C15)
                if c in stood:
                    last, words = stood[c]
                    words += last != pointer
                    last[:] = pointer
        np.take(coins, pointer, out=read, mode="clip")
        read >>= np.uint64(step)
        read &= np.uint64(1)
        pointer += read.view(np.int64)
    every = np.arange(len(at))
    places = [np.flatnonzero(stood[c][1] >= k.distinct) if c in stood else every[: len(keys[c])] for c, k in enumerate(CLASSES)]
    return [(place, key[place]) for place, key in zip(places, keys, strict=True)]


class Items(NamedTuple):
    """A block of items: ids, word hashes, for each walk the sorted keys with the item and the word they begin at, and for each number
    of words below ``LEAST`` the sorted hashes of such items with the item."""

    ids: list[int | None]
    words: list[np.ndarray]
    sets: list[frozenset[int]]
    walks: list[Walk]
    keys: list[np.ndarray]
    owner: list[np.ndarray]
    offset: list[np.ndarray]
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def _padded(hashes: np.ndarray) -> np.ndarray:
    return np.concatenate((hashes, np.zeros(max(c.size for c in CLASSES) + 1, np.uint64)))


def items_of(ids: list[int | None], texts: list[str]) -> Items:
    w = W.plain_words(pa.array(texts, pa.string()))
    hashes = W.Hasher().words(w)
    each = [hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    every = walks()
    padded = _padded(hashes)
    # Of each class the items that have its windows, and the words these begin at: in items that are not dense at each of its sizes.
    starts: list[tuple[np.ndarray, np.ndarray]] = []
    for k in CLASSES:
        parts = []
        for i, line in enumerate(each):
            n = len(line)
            if k.fewest <= n <= k.most:
                at = np.arange(n - k.size + 1)
                at = at if n < DENSE else at[at % k.size < STRIDE]
                parts.append((np.full(len(at), i), at))
        starts.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0, int)))
    # Classes of which no item has a window are not walked.
    every = [Walk(walk.seed, [steps if len(starts[c][0]) else [] for c, steps in enumerate(walk.steps)]) for walk in every]
    keys, owner, offset = [], [], []
    for walk in every:
        columns = [(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))]
        for c, (item, at) in enumerate(starts):
            if walk.steps[c]:
                place, key = keys_of(walk, padded, w.first[item] + at)[c]
                columns.append((key, item[place], at[place]))
        row = [np.concatenate(x) for x in zip(*columns, strict=True)]
        order = np.argsort(row[0], kind="stable")
        for held, column in zip((keys, owner, offset), row, strict=True):
            held.append(column[order])
    n = np.diff(w.first)
    short = {}
    for size in range(1, LEAST):
        mine = np.flatnonzero(n == size)
        if len(mine):
            key = W.Hasher(PHRASE).ranges(hashes, w.first[mine], w.first[mine] + size)
            order = np.argsort(key, kind="stable")
            short[size] = key[order], mine[order]
    return Items(list(ids), each, [frozenset(x.tolist()) for x in each], every, keys, owner, offset, short)


def best_place(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any part of ``text``, and where such a part ends first."""
    m = len(pattern)
    at: dict[int, int] = {}
    for i, x in enumerate(pattern):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, x in enumerate(text):
        eq = at.get(x, 0)
        vertical = eq | down
        same = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(same | up)), up & same
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def _hits(items: Items, hashes: np.ndarray, first: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    """Rows of text, item, and the word at which the item would begin, in steps of ``STRIDE``, each once, for all keys that
    meet an item's."""
    n = np.diff(first)
    count = np.where(n >= 1, -(-n // STRIDE), 0)
    text = np.repeat(np.arange(len(n)), count)
    place = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    at = first[text] + place
    padded = _padded(hashes)
    found = [np.zeros((0, 3), np.int64)]
    block = 1 << 14
    for r, walk in enumerate(items.walks):
        sorted_ = items.keys[r]
        if not len(sorted_):
            continue
        for lo in range(0, len(at), block):
            for where, keys in keys_of(walk, padded, at[lo : lo + block]):
                maybe = np.flatnonzero(near[r][(keys >> np.uint64(44)).astype(np.int64)])
                left = np.searchsorted(sorted_, keys[maybe], "left")
                times = np.searchsorted(sorted_, keys[maybe], "right") - left
                i = np.repeat(lo + where[maybe], times)
                hit = np.repeat(left - np.cumsum(times) + times, times) + np.arange(times.sum())
                if len(i):
                    begin = (place[i] - items.offset[r][hit]) // STRIDE
                    found.append(np.unique(np.column_stack((text[i], items.owner[r][hit], begin)), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def _short_hits(items: Items, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, first word and number of words of every short item, at its first place in each text."""
    owner = W.owners(first)
    for size, (keys, mine) in items.short.items():
        at = np.flatnonzero(np.arange(len(hashes)) + size <= first[owner + 1])
        found = W.Hasher(PHRASE).ranges(hashes, at, at + size)
        left = np.searchsorted(keys, found, "left")
        times = np.searchsorted(keys, found, "right") - left
        places = np.repeat(at, times)
        hit = np.repeat(left - np.cumsum(times) + times, times) + np.arange(times.sum())
        pairs, where = np.unique(np.column_stack((owner[places], mine[hit])), axis=0, return_index=True)
        for (text, item), k in zip(pairs.tolist(), where.tolist(), strict=True):
            yield text, item, int(places[k] - first[text]), size


def leaks_of(items: Items, near: list[np.ndarray], column: pa.Array, similarity: float) -> list[tuple[int, int | None, int, int, int]]:
    """(text, item_id, start, n_words, distance) of every item found in the texts, at the closest place, the first of several."""
    w = W.plain_words(column)
    hashes = W.Hasher().words(w)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    sets = items.sets
    for text, item, begin in _hits(items, hashes, w.first, near).tolist():
        pattern = items.words[item]
        m = len(pattern)
        most = math.floor(m * (1 - similarity) + 1e-9)
        known = best.get((text, item))
        if known and known[0] == 0:
            continue
        lo, hi = int(w.first[text]), int(w.first[text + 1])
        low = max(lo, lo + begin * STRIDE - most - STRIDE)
        line = hashes[low : min(hi, lo + begin * STRIDE + m + most + 2 * STRIDE)].tolist()
        # Each of the item's words that is not there costs an edit.
        if len(sets[item].difference(line)) > most:
            continue
        distance, end = best_place(pattern.tolist(), line)
        if distance <= most:
            _, length = best_place(pattern[::-1].tolist(), line[:end][::-1])
            leak = (distance, low - lo + end - length, length)
            best[text, item] = min(known, leak) if known else leak
    best.update({(text, item): (0, start, size) for text, item, start, size in _short_hits(items, hashes, w.first)})
    return [(text, items.ids[item], s, n, d) for (text, item), (d, s, n) in sorted(best.items())]


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of at most about ``BLOCK``; Spark ships a block to the tasks with their function."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    blocks = max(1, math.ceil(items.count() / (BLOCK // 2)))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield items_of([r.item_id for r in block], [r.text for r in block])


def _search(items: Items, similarity: float):
    """A function from a column of texts to the leaks in it."""
    near = []
    for keys in items.keys:
        near.append(np.zeros(1 << 20, bool))
        near[-1][(keys >> np.uint64(44)).astype(np.int64)] = True
    return lambda column: leaks_of(items, near, column, similarity)


def leaked(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``, the words the item takes (``start``, ``n_words``, counted
    from 0 among the document's plain words) and the edit ``distance`` in words."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scanned(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _search(items, similarity)
            for batch in W.slices(batches):
                found = search(batch.column("text"))
                if found:
                    rows, ids, start, n, distance = zip(*found, strict=True)
                    doc = batch.column("doc_id").take(pa.array(rows))
                    counts = [pa.array(x, pa.int32()) for x in (start, n, distance)]
                    yield pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.int64()), *counts], ["doc_id", "item_id", "start", "n_words", "distance"])

        return texts.mapInArrow(run, LEAK)

    parts = [scanned(items) for items in _blocks(benchmark)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents in which no item is found, with all their columns."""

    def kept(state: DataFrame, items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _search(items, similarity)
            for batch in W.slices(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[found[0] for found in search(batch.column("text"))]] = False
                yield batch if clean.all() else batch.filter(pa.array(clean))

        return state.mapInArrow(run, state.schema)

    for items in _blocks(benchmark):
        docs = kept(docs, items)
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

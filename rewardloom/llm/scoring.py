"""Masked pseudo-likelihood of documents under a window network trained on the corpus itself.

Every token is predicted from the ``SIDE`` tokens to its left and right, with itself masked; the log-probabilities summed over a
text are its pseudo-log-likelihood. Tokens are words with A-Z in lower case. The most frequent have numbers of their own, all
others share numbers by their hashes: three and one in four of ``grid * grid`` numbers, where ``grid`` is the fourth root of a
fourth of all words, but ``GRID`` (64) at least, so that the known words grow as the square root of the corpus. A number is
predicted in two steps of ``grid``, its row from the hidden layer and its column from the hidden layer and the row, so a token
costs two small softmaxes. The probability of a word that shares its number is that of the number times the word's exact share
of the number's count in the corpus, so no two words of different counts are scored alike.

1. Words are counted over all texts, summed inside each slice of texts before they are shuffled.
2. Training: all word places of the corpus are dealt to ``SHARE`` rounds, by a hash of text, word and place, so every place
   is learnt from in ``ROUNDS / SHARE`` rounds. In each round every task runs Adam over its texts from the current weights;
   the weights of all tasks are averaged, by the number of places they saw, in blocks that are shuffled and summed apart.
   The driver gets one set of weights.
3. Scoring is a map over all documents and whole texts. Words that share numbers are stored with their documents, once per
   document and word, meet their counts in a join, and are summed by document again. Such a word is none of the known, so no
   key of the join is hot.

Null, empty and blank texts have no tokens: their sum is 0 and their mean null. Places beyond a text's ends are a number of
their own. Rows are scored one by one, repeated rows alike; only ``doc_id`` and ``text`` are read. An empty table gives an empty
result. A task holds a slice of texts, or one longer text and about ten times its bytes; predictions go in batches.
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
from rewardloom.llm.tables import stored

KNOWN, OTHER = 3072, 1024
GRID = 64
SIDE = 2
WIDTH, HIDDEN = 16, 32
#: A place is learnt from in one of so many rounds; there are as many rounds, so none is left out.
SHARE = 2
ROUNDS = 2
#: Tokens predicted at once, whose arrays fit a core's cache, and learnt from at once.
BATCH = 1024
STEP = 1024
#: Weights travel in so many blocks.
BLOCKS = 16


class Weights(NamedTuple):
    """Embeddings of numbers (the last: no word), the hidden layer, and the two softmaxes."""

    embed: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    row: np.ndarray
    row_bias: np.ndarray
    of_row: np.ndarray
    column: np.ndarray
    column_bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self])


def shapes(grid: int) -> tuple[tuple[int, ...], ...]:
    return ((grid * grid + 1, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, grid), (grid,), (grid, HIDDEN), (HIDDEN, grid), (grid,))


SHAPES = shapes(GRID)


def grid_of(total: int) -> int:
    """The side of the square of numbers for a corpus of so many words."""
    return max(GRID, math.isqrt(math.isqrt(total // 4)))


def known_of(grid: int) -> int:
    """How many numbers belong to one word each."""
    return grid * grid * KNOWN // (KNOWN + OTHER)


def weights(flat: np.ndarray) -> Weights:
    out, at, grid = [], 0, GRID
    while sum(math.prod(shape) for shape in shapes(grid)) < len(flat):
        grid += 1
    for shape in shapes(grid):
        size = int(np.prod(shape))
        out.append(flat[at : at + size].reshape(shape).astype(np.float32))
        at += size
    return Weights(*out)


def first_weights(seed: int = 3, grid: int = GRID) -> Weights:
    rng = np.random.default_rng(seed)
    scales = (0.1, (2 * SIDE * WIDTH) ** -0.5, 0, HIDDEN**-0.5, 0, 0.1, HIDDEN**-0.5, 0)
    return Weights(*[(rng.normal(size=shape) * scale).astype(np.float32) for shape, scale in zip(shapes(grid), scales, strict=True)])


class Vocabulary:
    """Numbers of words by their hashes; ``frequent`` are the hashes of the known ones, most frequent first."""

    def __init__(self, frequent: np.ndarray, grid: int = GRID):
        order = np.argsort(frequent)
        self.hashes, self.numbers, self.known, self.none = frequent[order], order, known_of(grid), grid * grid
        # Hashes are looked up by their first bits: few known ones share these, and each is compared whole.
        bits = max(1, 2 + len(frequent).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begins = np.searchsorted(self.hashes >> self.shift, np.arange(2**bits, dtype=np.uint64))
        self.most = int(np.diff(np.append(self.begins, len(frequent))).max())

    def numbers_of(self, hashes: np.ndarray) -> np.ndarray:
        out = self.known + (hashes % np.uint64(self.none - self.known)).astype(np.int64)
        begin = self.begins[hashes >> self.shift]
        for k in range(self.most):
            at = np.minimum(begin + k, len(self.hashes) - 1)
            np.copyto(out, self.numbers[at], where=self.hashes[at] == hashes)
        return out


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = W.words(column)
    return W.Hasher().words(w, W.lowered(w.data)), w.first


STEPS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


def padded(numbers: np.ndarray, first: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers with ``SIDE`` times ``none`` before, between and behind the texts, and where each word lies among them."""
    place = np.arange(len(numbers)) + SIDE * (W.owners(first) + 1)
    out = np.full(len(numbers) + SIDE * len(first), none, np.int64)
    out[place] = numbers
    return out, place


def contexts(numbers: np.ndarray, first: np.ndarray, at: np.ndarray, none: int = KNOWN + OTHER) -> np.ndarray:
    """The numbers around the words at ``at``, the number ``none`` for no word beyond a text's ends."""
    line, place = padded(numbers, first, none)
    return line[place[at][:, None] + STEPS]


def _softmax(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probabilities of the targets, and all probabilities before and by their division. A column is a place: sums over
    columns' entries run along the memory."""
    x -= x.max(axis=0)
    chosen = x[target, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    return chosen - np.log(total), x, total


def forward(w: Weights, around: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Log-probabilities of the targets between their contexts, and what ``gradients`` needs."""
    row, column = np.divmod(target, len(w.row_bias))
    x = w.embed.take(around.ravel(), axis=0).reshape(len(around), -1)
    h = x @ w.hidden
    h += w.hidden_bias
    np.tanh(h, out=h)
    of_rows = w.row.T @ h.T
    of_rows += w.row_bias[:, None]
    log_row, p_row, sum_row = _softmax(of_rows, row)
    k = w.of_row.take(row, axis=0)
    k += h
    of_columns = w.column.T @ k.T
    of_columns += w.column_bias[:, None]
    log_column, p_column, sum_column = _softmax(of_columns, column)
    return log_row + log_column, (around, row, column, x, h, p_row, sum_row, k, p_column, sum_column)


def gradients(w: Weights, held: tuple) -> Weights:
    """The gradient of the mean log-loss."""
    around, row, column, x, h, p_row, sum_row, k, p_column, sum_column = held
    n = len(x)
    places, one = np.arange(n), x.dtype.type(1 / n)
    of_places = np.zeros_like(p_row)
    of_places[row, places] = 1
    p_row *= one / sum_row
    p_column *= one / sum_column
    p_row[row, places] -= one
    p_column[column, places] -= one
    dk = p_column.T @ w.column.T
    dz = p_row.T @ w.row.T
    dz += dk
    slope = h * h
    np.subtract(1, slope, out=slope)
    dz *= slope
    dx = (dz @ w.hidden.T).reshape(-1, WIDTH)
    embed = np.zeros_like(w.embed)
    # Two numbers are added at once, as one complex number, which takes less time than sorting the places and summing runs.
    pairs = np.result_type(dx, np.complex64)
    at = around.reshape(-1, 1) * (WIDTH // 2) + np.arange(WIDTH // 2)
    np.add.at(embed.view(pairs).ravel(), at.ravel(), dx.view(pairs).ravel())
    of_hidden, of_row, of_column = x.T @ dz, (p_row @ h).T, (p_column @ k).T
    return Weights(embed, of_hidden, dz.sum(axis=0), of_row, p_row.sum(axis=1), of_places @ dk, of_column, p_column.sum(axis=1))


class Adam:
    """All weights are one array, which ``w`` shows in parts, so that a step is a few passes over it."""

    def __init__(self, w: Weights, rate: float = 0.01):
        self.all, self.rate, self.step = w.flat(), rate, 0
        ends = np.cumsum([x.size for x in w])[:-1]
        self.w = Weights(*[part.reshape(x.shape) for part, x in zip(np.split(self.all, ends), w, strict=True)])
        self.m, self.v, self.g, self.by = (np.zeros_like(self.all) for _ in range(4))

    def learn(self, around: np.ndarray, target: np.ndarray) -> None:
        _, held = forward(self.w, around, target)
        self.step += 1
        down1, down2 = 1 - 0.9**self.step, 1 - 0.99**self.step
        g, m, v, by = self.g, self.m, self.v, self.by
        np.concatenate([x.ravel() for x in gradients(self.w, held)], out=g)
        m *= 0.9
        np.multiply(g, 0.1, out=by)
        m += by
        v *= 0.99
        by *= g
        by *= 0.1
        v += by
        np.multiply(v, 1 / down2, out=by)
        np.sqrt(by, out=by)
        by += 1e-8
        np.divide(m, by, out=by)
        by *= self.rate / down1
        self.all -= by


def word_counts(texts: DataFrame) -> DataFrame:
    """Hash ``h`` and count ``n`` of every word of all texts, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, most=4 * W.SLICE_BYTES):
            found, counts = np.unique(_hashed(batch.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], ["h", "n"])

    return stored(texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")


def _frequent(counts: DataFrame) -> tuple[np.ndarray, int]:
    """The hashes of the words that are known, and the side of the square of numbers."""
    grid = grid_of(counts.agg(F.sum("n")).first()[0] or 0)
    rows = counts.orderBy(F.desc("n"), "h").limit(known_of(grid)).collect()
    return np.array([r.h for r in rows], np.int64).view(np.uint64), grid


def frequent_words(texts: DataFrame) -> np.ndarray:
    """The hashes of the most frequent words of all texts."""
    return _frequent(word_counts(texts))[0]


def shares(counts: DataFrame, frequent: np.ndarray, grid: int) -> DataFrame:
    """For every word that shares a number: its hash ``h`` and ``share``, the log of its part of the number's count."""

    def unknown(batch: pa.RecordBatch, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, n = batch.column("h").to_numpy().view(np.uint64), batch.column("n").to_numpy()
        number = words.numbers_of(hashes)
        mine = number >= words.known
        return hashes[mine].view(np.int64), n[mine], number[mine]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Vocabulary(frequent, grid), np.zeros(grid * grid, np.int64)
        for batch in batches:
            _, n, number = unknown(batch, words)
            np.add.at(total, number, n)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["number", "n"])

    total = np.zeros(grid * grid, np.int64)
    for r in counts.mapInArrow(add, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).collect():
        total[r.number] = r.n

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(frequent, grid)
        for batch in batches:
            h, n, number = unknown(batch, words)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.log(n / total[number]))], ["h", "share"])

    return counts.mapInArrow(divide, "h long, share double")


def rounds_of(hashes: np.ndarray, first: np.ndarray, share: int) -> np.ndarray:
    """For each word place the round, of ``share``, that learns from it; the whole text, the word and its place decide."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes)))
    text = W.mixed(sums[first[1:]] - sums[first[:-1]])
    owner = W.owners(first)
    place = (np.arange(len(hashes)) - first[owner]).astype(np.uint64)
    return (W.mixed(hashes + text[owner] + place * np.uint64(3)) % np.uint64(share)).astype(np.int64)


def _trained_round(texts: DataFrame, frequent: np.ndarray, flat: np.ndarray, turn: int, share: int) -> np.ndarray:
    size = -(-len(flat) // BLOCKS)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adam, seen = Adam(weights(flat), 0.01 / (1 + turn)), 0
        grid = len(adam.w.row_bias)
        words, step = Vocabulary(frequent, grid), STEP * grid // GRID
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in W.slices(batches):
            hashes, first = _hashed(batch.column("text"))
            numbers = words.numbers_of(hashes)
            at = np.flatnonzero(rounds_of(hashes, first, share) == turn % share)
            if not len(at):
                continue
            held.append((contexts(numbers, first, at, words.none), numbers[at]))
            waiting += len(at)
            if waiting >= step:
                around, target = (np.concatenate(x) for x in zip(*held, strict=True))
                upto = waiting - waiting % step
                for a in range(0, upto, step):
                    adam.learn(around[a : a + step], target[a : a + step])
                held, waiting, seen = [(around[upto:], target[upto:])], waiting - upto, seen + upto
        if waiting:
            around, target = (np.concatenate(x) for x in zip(*held, strict=True))
            adam.learn(around, target)
            seen += waiting
        if seen:
            mine = adam.w.flat().astype(np.float64) * seen
            parts = [mine[a : a + size].tobytes() for a in range(0, len(mine), size)]
            yield pa.RecordBatch.from_pydict({"block": list(range(len(parts))), "seen": [seen] * len(parts), "values": parts})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                n, total = sums.get(row["block"], (0, 0.0))
                sums[row["block"]] = n + row["seen"], total + np.frombuffer(row["values"])
        for block, (n, total) in sums.items():
            yield pa.RecordBatch.from_pydict({"block": [block], "seen": [n], "values": [total.tobytes()]})

    kind = "block long, seen long, values binary"
    learnt = texts.mapInArrow(learn, kind).repartition(BLOCKS, "block").mapInArrow(add, kind)
    rows = learnt.orderBy("block").collect()
    if not rows:
        return flat
    return np.concatenate([np.frombuffer(bytes(r["values"])) / r["seen"] for r in rows]).astype(np.float32)


def train(docs: DataFrame, rounds: int = ROUNDS, share: int = SHARE, counts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The known words' hashes and the flat weights learnt from the texts, whose ``word_counts`` may be given."""
    if rounds < share:
        raise ValueError("with fewer rounds than shares some places would never be learnt from")
    texts = docs.select("text").where("text is not null")
    frequent, grid = _frequent(word_counts(texts) if counts is None else counts)
    flat = first_weights(grid=grid).flat()
    for turn in range(rounds):
        flat = _trained_round(texts, frequent, flat, turn, share)
    return frequent, flat


SCORES = "doc_id long, n_tokens long, log_likelihood double"


def _rare(hashes: np.ndarray, mine: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """For each of ``n`` texts its words of those at ``mine`` with how often it holds them."""
    h, text = hashes[mine], owner[mine]
    order = np.argsort(h)
    # Short numbers of texts are sorted by their digits.
    order = order[np.argsort(text[order].astype(np.min_scalar_type(n)), kind="stable")]
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    begins = np.flatnonzero(new)
    pairs = pa.StructArray.from_arrays([pa.array(h[begins].view(np.int64)), pa.array(np.diff(np.append(begins, len(h))), pa.int32())], ["h", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[begins], np.arange(n + 1)), pa.int32()), pairs)


def scored(docs: DataFrame, frequent: np.ndarray, flat: np.ndarray, counts: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``log_likelihood`` (the sum) and ``mean_log_likelihood``. With the ``counts`` of a corpus that
    holds these texts, words that share a number are told apart by them; without, a word's probability is its number's."""
    grid, exact = len(weights(flat).row_bias), counts is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = Vocabulary(frequent, grid), weights(flat)
        for batch in W.slices(batches):
            hashes, first = _hashed(batch.column("text"))
            numbers = words.numbers_of(hashes)
            line, place = padded(numbers, first, words.none)
            found = np.zeros(len(numbers))
            for a in range(0, len(numbers), BATCH):
                found[a : a + BATCH] = forward(w, line[place[a : a + BATCH, None] + STEPS], numbers[a : a + BATCH])[0]
            n, owner = np.diff(first), W.owners(first)
            total = np.bincount(owner, found, len(n))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(total, pa.float64())]
            names = ["doc_id", "n_tokens", "log_likelihood"]
            if exact:
                columns.append(_rare(hashes, numbers >= words.known, owner, len(n)))
                names.append("rare")
            yield pa.RecordBatch.from_arrays(columns, names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not exact:
        out = texts.mapInArrow(run, SCORES)
    else:
        # Rows may share a doc_id, so they are numbered; stored, they keep their numbers.
        rows = texts.mapInArrow(run, f"{SCORES}, rare array<struct<h: bigint, n: int>>")
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
        rare = rows.select("row", F.inline("rare")).join(shares(counts, frequent, grid).hint("shuffle_hash"), "h")
        rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), (F.col("n") * F.col("share")).alias("log_likelihood"))
        parts = rows.select("row", "doc_id", "n_tokens", "log_likelihood").union(rare).groupBy("row")
        out = parts.agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("log_likelihood").alias("log_likelihood")).drop("row")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = word_counts(docs.select("text").where("text is not null"))
    return scored(docs, *train(docs, counts=counts), counts)

"""Best-fit packing of token sequences by linear grouping.

Documents become token ids and one end id; only those longer than ``capacity`` are cut. How pieces are packed depends on their
lengths alone, so the driver plans on the histogram of lengths (at most ``capacity`` numbers, whatever the size of the corpus):

1. large pieces, sorted by length, are cut into groups of equal cardinality, and every length in a group counts as the
   group's largest;
2. for these few sizes the best configurations (which sizes share a sequence) and their numbers come from the linear
   program over configurations, solved by column generation, rounded down;
3. the pieces themselves are put in the places of their group's size, which leaves a little more room;
4. what is left over and all small pieces, longest first, go where they leave the least room, or into new sequences.

The plan is made for several numbers of groups; the one with the fewest sequences is taken. It is a list of runs of sequences
with equal lengths inside. Every piece is numbered among the pieces of its length without gathering a length in one task,
and its number says which sequence and offset are its own.

Null and empty texts are the end id alone. Repeated rows are packed each; a null doc_id is packed like others. Only ``doc_id``
and ``text`` are read. An empty table gives an empty result. Special tokens' strings, as they are written, have
the special tokens' ids. A task holds one document's ids, and the distinct words of a slice of texts.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm import words as W
from rewardloom.llm.tables import numbered, stored

CAPACITY = 4096
END = 1
#: Large pieces take more than this share of a sequence.
LARGE = 1 / 8
GROUPS = (12, 24, 48)
#: Pieces of text whose ids a worker remembers at most.
REMEMBERED = 1_000_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
Run = tuple[int, tuple[int, ...]]


# --- token ids ---------------------------------------------------------------------------------------------------------


class Encoder:
    """Token ids of whole texts from the ids of their distinct pieces.

    This tokenizer lower-cases texts and never joins characters across white space, nor a letter or digit with a
    punctuation mark behind it, so texts are cut there, and equal pieces have equal ids wherever they stand. The strings of
    its special tokens, as they are written, are pieces of their own. Pieces are known by 64-bit hashes.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        special = sorted((str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in special)) if special else None
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))))
        at = np.searchsorted(self.words, hashes)
        self.words = np.insert(self.words, at, hashes)
        self.begin, self.size = np.insert(self.begin, at, begin), np.insert(self.size, at, size)

    def special_places(self, data: np.ndarray, places: np.ndarray) -> list[tuple[int, int]]:
        """Where the strings of special tokens lie in the texts."""
        if self.special is None:
            return []
        whole = data.tobytes()
        if not self.special.search(whole):
            return []
        edges = zip(places[:-1].tolist(), places[1:].tolist(), strict=True)
        return [m.span() for a, b in edges for m in self.special.finditer(whole, a, b)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (one place more than there are texts)."""
        data, places = W.text_bytes(column)
        found = self.special_places(data, places)
        data = W.lowered(data)
        kind = np.zeros(256, np.uint8)
        kind[33:127] = 2
        kind[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = 1
        kinds = kind[data]
        cuts = np.zeros(len(data), bool)
        cuts[1:] = (kinds[:-1] == 1) & (kinds[1:] == 2)
        for a, b in found:
            cuts[a + 1 : b] = False
            cuts[a] = True
            cuts[b : b + 1] = True
        w = W.split(data, places, W.spaces(), cuts)
        distinct, at, which = np.unique(W.Hasher().words(w), return_index=True, return_inverse=True)
        if len(self.words) + len(distinct) > REMEMBERED:
            self._forget()
        near = np.searchsorted(self.words, distinct)
        new = np.append(self.words, np.uint64(0))[near] != distinct
        new |= near == len(self.words)
        data, spans = w.data.tobytes(), zip(w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True)
        self._learn(distinct[new], [data[a:b].decode() for a, b in spans])
        known = np.searchsorted(self.words, distinct)
        size = self.size[known][which]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.begin[known][which] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[w.first]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of every piece, and its ``ids`` if asked for."""

    # What a broadcast holds lives in a worker process while tasks use it: all tasks of this job that run there share one
    # encoder, and the jobs behind it have its memory back.
    shared = docs.sparkSession.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.get("encoder") or shared.value.setdefault("encoder", Encoder(tokenizer_file))
        for batch in W.slices(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            held: list[np.ndarray] = []
            every, places = encoder.encode(batch.column("text"))
            for i, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)):
                ids = np.append(every[a:b], np.uint32(END)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        held.append(part.astype(np.int32))
            text, piece, start, length, crc = zip(*rows, strict=True)
            arrays = [batch.column("doc_id").take(pa.array(text)), pa.array(piece, pa.int32())]
            arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, f"{PIECE}, ids array<int>" if with_ids else PIECE)


# --- the plan ----------------------------------------------------------------------------------------------------------


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within ``room`` of the greatest worth, by the number of its members."""
    value, chosen = np.zeros(room + 1), []
    for _ in range(room // int(sizes.min())):
        with_one = np.full((len(sizes), room + 1), -1.0)
        for i, size in enumerate(sizes.tolist()):
            with_one[i, size:] = value[: room + 1 - size] + worth[i]
        best = with_one.argmax(axis=0)
        gained = with_one[best, np.arange(room + 1)]
        better = gained > value + 1e-12
        chosen.append(np.where(better, best, -1))
        value = np.where(better, gained, value)
    column, r = np.zeros(len(sizes)), room
    for best in reversed(chosen):
        if best[r] >= 0:
            column[best[r]] += 1
            r -= int(sizes[best[r]])
    return float(value[room]), column


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 1000) -> list[tuple[int, np.ndarray]]:
    """Configurations and how often each is used: the linear program's optimum, rounded down."""
    n = len(sizes)
    columns = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / columns.diagonal())
    for _ in range(rounds):
        used, price = inverse @ demand, inverse.sum(axis=0)
        value, column = _best_configuration(sizes, price, room)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, used / step, np.inf)
        out = int(ratio.argmin())
        columns[:, out] = column
        inverse[out] /= step[out]
        others = np.arange(n) != out
        inverse[others] -= np.outer(step[others], inverse[out])
    used = inverse @ demand
    return [(int(x + 1e-6), columns[:, j]) for j, x in enumerate(used) if x >= 1 - 1e-6]


def _grouped(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """``large`` (length, count; longest first) in groups of equal cardinality; few lengths are a group each."""
    if len(large) <= groups:
        return [[[length, count]] for length, count in large]
    each = -(-sum(c for _, c in large) // groups)
    out: list[list[list[int]]] = [[]]
    room = each
    for length, count in large:
        while count:
            if room == 0:
                out.append([])
                room = each
            n = min(count, room)
            out[-1].append([length, n])
            count, room = count - n, room - n
    return [g for g in out if g]


def _take(queue: deque, most: int) -> tuple[int, int]:
    """Up to ``most`` pieces of the first length in the queue: (length, how many)."""
    length, count = queue[0]
    n = min(count, most)
    if n == count:
        queue.popleft()
    else:
        queue[0][1] -= n
    return length, n


def _substituted(times: int, column: np.ndarray, queues: list[deque]) -> list[Run]:
    """``times`` sequences of a configuration, filled with the pieces of the groups as far as there are any."""
    runs: list[Run] = [(times, ())]
    for g in np.repeat(np.arange(len(column)), column.astype(int)):
        filled: list[Run] = []
        for count, lengths in runs:
            while count and queues[g]:
                length, n = _take(queues[g], count)
                filled.append((n, (*lengths, length)))
                count -= n
            if count:
                filled.append((count, lengths))
        runs = filled
    return [r for r in runs if r[1]]


class _Room:
    """Runs of sequences by the room that is left in them."""

    def __init__(self, runs: list[Run], capacity: int):
        self.capacity, self.by_room, self.rooms = capacity, defaultdict(list), []
        for run in runs:
            self.add(run)

    def add(self, run: Run) -> None:
        room = self.capacity - sum(run[1])
        if not self.by_room[room]:
            insort(self.rooms, room)
        self.by_room[room].append(run)

    def put(self, length: int, count: int) -> None:
        """Best fit for ``count`` pieces of one length."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                if count >= each:
                    self.add((count // each, (length,) * each))
                if count % each:
                    self.add((1, (length,) * (count % each)))
                return
            room = self.rooms[at]
            times, lengths = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.rooms[at]
            n = min(times, count)
            if n < times:
                self.add((times - n, lengths))
            # A run takes as many of this length as fit, one after the other: the tightest room stays the tightest.
            self.add((n, (*lengths, length)))
            count -= n

    def runs(self) -> list[Run]:
        return [run for runs in self.by_room.values() for run in runs]


def planned(lengths: dict[int, int], capacity: int, groups: int) -> list[Run]:
    """Runs (how many sequences, the lengths inside) that hold ``lengths`` (length: count) exactly."""
    full = [(count, (length,)) for length, count in lengths.items() if length == capacity]
    ordered = sorted(((length, count) for length, count in lengths.items() if length < capacity), reverse=True)
    large = [x for x in ordered if x[0] > capacity * LARGE]
    rest = {length: count for length, count in ordered if length <= capacity * LARGE}
    runs: list[Run] = []
    if large:
        queues, sizes = [], []
        for group in _grouped(large, groups):
            if sizes and sizes[-1] == group[0][0]:
                queues[-1].extend(group)
            else:
                queues.append(deque(group))
                sizes.append(group[0][0])
        demand = np.array([sum(c for _, c in q) for q in queues], float)
        for times, column in configurations(np.array(sizes), demand, capacity):
            runs.extend(_substituted(times, column, queues))
        for queue in queues:
            for length, count in queue:
                rest[length] = rest.get(length, 0) + count
    space = _Room(runs, capacity)
    for length in sorted(rest, reverse=True):
        space.put(length, rest[length])
    return full + space.runs()


def best_plan(lengths: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> list[Run]:
    return min((planned(lengths, capacity, g) for g in groups), key=lambda runs: sum(n for n, _ in runs))


class Places:
    """For every (length, number among its length) the sequence and the offset."""

    def __init__(self, runs: list[Run]):
        rows, base = [], 0
        for count, lengths in runs:
            offset = 0
            for length in lengths:
                rows.append((length, base, offset, count))
                offset += length
            base += count
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.length, self.base, self.offset, count = table.T
        first = np.searchsorted(self.length, self.length)
        before = np.cumsum(count) - count
        self.number = before - before[first] if len(table) else before

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.length << 40 | self.number
        at = np.searchsorted(keys, length << 40 | number, side="right") - 1
        return self.base[at] + number - self.number[at], self.offset[at]


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The stored table ``parts`` of pieces with ``sequence_id`` and ``offset``."""
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(best_plan(histogram, capacity))
    counted = numbered(parts, ["length"], ["doc_id", "piece"], F.xxhash64("doc_id", "piece"), "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = places.of(length, number)
            batch = batch.drop_columns(["number"])
            batch = batch.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield batch

    fields = [f"`{name}` {kind}" for name, kind in counted.drop("number").dtypes]
    return counted.select(*counted.drop("number").columns, "number").mapInArrow(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with the sequence and offset it is packed at."""
    return packed(stored(pieces(docs, tokenizer_file, capacity, with_ids), "pieces"), capacity)


def word_bpe() -> str:
    """Where the public tokenizer lies on this machine; the same place is read by the executors."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe()).select(*columns)

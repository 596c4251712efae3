"""Encoding and decoding with merge-type sentencepiece vocabularies.

A text is normalised by the model and cut into letters, the first symbols. An agenda holds every two adjacent symbols whose
letters together are a piece, ordered by the piece's score, then by place; the best are merged, and the merged symbol enters
the agenda with its neighbours, until nothing is left to merge. Letters that are no piece become bytes. Long parts have a heap for
an agenda; of short ones the agendas of all new parts of a slice of texts are one array, of which each part's best is taken at once.

Two letters that follow each other in no piece can never be merged, so a text is cut between them first, and what lies between
two cuts is merged alone; the vocabulary decides where (in ordinary ones, before each blank). Recent parts are remembered with
their ids, twice ``REMEMBERED`` at most, so that a task's memory is bounded and frequent words are merged once.

Every batch is also encoded by the sentencepiece library, and ``agrees`` says of each row whether the ids are the same.
Decoding is the library's.

Null texts are empty; an empty text has the begin and end ids only and decodes to an empty text. Rows are encoded one by one,
repeated rows alike; only ``doc_id`` and ``text`` are read, other columns make no difference. An empty table gives an empty
result. Nothing is shuffled. A task holds a slice of texts, or one longer text and about a hundred times its letters.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from rewardloom.llm import words as W

#: Parts that a task remembers, and the longest one that it remembers, in letters.
REMEMBERED, LONGEST = 1 << 19, 64
BLANK = "▁"
#: The rank of two symbols that make no piece.
NEVER = math.inf
#: The end of an agenda of numbers.
LAST = 2**62
ENCODED = "doc_id long, n_tokens long, ids binary, agrees boolean, decoded string"


def model(path: str) -> bytes:
    """The bytes of a model's file, which the tasks get; an error if its pieces are not made by merging letters."""
    with open(path, "rb") as file:
        data = file.read()
    parsed = sentencepiece_model_pb2.ModelProto.FromString(data)
    kinds = {piece.type for piece in parsed.pieces}
    if parsed.trainer_spec.model_type != parsed.trainer_spec.BPE or sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED in kinds:
        raise ValueError("the vocabulary is not a merge-type one, or has pieces of its user's")
    return data


class Agenda(dict):
    """Ids (as bytes, four each) of the parts of normalised texts; parts that are not remembered are merged."""

    def __init__(self, processor: sentencepiece.SentencePieceProcessor):
        super().__init__()
        self.processor = processor
        ids = range(processor.get_piece_size())
        plain = [i for i in ids if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]
        self.number = {processor.id_to_piece(i): i for i in plain}
        self.rank = {piece: -processor.get_score(i) for piece, i in self.number.items()}
        self.unused = {piece for piece, i in self.number.items() if processor.is_unused(i)}
        self.bytes = {int(processor.id_to_piece(i)[3:5], 16): i for i in ids if processor.is_byte(i)}
        self.meet = {a + b for piece in self.number for a, b in zip(piece, piece[1:], strict=False)}
        self.before: dict[str, bytes] = {}
        self._pairs()
        # Where no piece holds a blank behind another letter, every run of blanks begins a part; characters that meet no other
        # (in ordinary vocabularies, line breaks) are parts of their own.
        inner = any(pair[1] == BLANK != pair[0] for pair in self.meet)
        met = set("".join(self.meet))
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in met)
        apart = f"[{alone}]" if alone else "(?!)"
        self.parts = (lambda text: [text]) if inner else re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|{apart}").findall

    def _pairs(self) -> None:
        """For two adjacent pieces, as one number, the piece they make and its rank among the scores; for letters their pieces."""
        number, most = self.number, self.processor.get_piece_size()
        found = [(number[p[:i]] * most + number[p[i:]], n) for p, n in number.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        order = {r: i for i, r in enumerate(sorted(set(self.rank.values())))}
        ranks = np.zeros(most, np.int64)
        for piece, n in number.items():
            ranks[n] = order[self.rank[piece]]
        self.pairs, self.whole, self.most = pairs[:, 0].copy(), pairs[:, 1].copy(), most
        self.ranks = ranks[self.whole]
        self.letters = np.full(0x110000, -1, np.int64)
        for piece, n in number.items():
            if len(piece) == 1:
                self.letters[ord(piece)] = n

    def _agenda(self, symbol: np.ndarray, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the symbols at ``at`` and behind them what they make, and where it stands on the part's agenda: rank, then place."""
        key = symbol[at] * self.most + symbol[at + 1]
        i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        makes = (self.pairs[i] == key) & (part[at] == part[at + 1])
        return self.whole[i], np.where(makes, self.ranks[i] << 32 | at, LAST)

    def learn(self, parts: list[str]) -> None:
        """Merge many short parts at once: in every round the best pair of each part's agenda."""
        code = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        symbol, part = self.letters[code], np.repeat(np.arange(len(parts)), size)
        # Parts with letters that are no pieces are few, and left to be merged when they are met.
        odd = np.bincount(part, symbol < 0, len(parts)) > 0
        symbol, part = symbol[~odd[part]], part[~odd[part]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pad = np.array([-1])
        whole, key = self._agenda(np.append(symbol, pad), np.append(part, pad), np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            best = np.minimum.reduceat(key, first)
            length = np.diff(np.append(first, len(part)))
            ready = np.repeat(best == LAST, length)
            done.append((part[ready], symbol[ready]))
            at = best[best != LAST] & 0xFFFFFFFF
            symbol[at] = whole[at]
            kept = ~ready
            kept[at + 1] = False
            # Places move down by as many symbols as have gone before them; the agenda's places with them.
            moved = np.cumsum(kept) - 1
            at, key = moved[at], np.where(key == LAST, LAST, key - np.arange(len(key)) + moved)[kept]
            symbol, part, whole = symbol[kept], part[kept], whole[kept]
            near = np.unique(np.concatenate((at, np.maximum(at - 1, 0))))
            whole[near], key[near] = self._agenda(np.append(symbol, pad), np.append(part, pad), near)
        part, symbol = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (part, symbol)
        order = np.argsort(part, kind="stable")
        data, ends = symbol[order].astype("<u4").tobytes(), (np.cumsum(np.bincount(part, minlength=len(parts))) * 4).tolist()
        begin = 0
        for text, end in zip(parts, ends, strict=True):
            if end > begin:
                self.remember(text, data[begin:end])
            begin = end

    def remember(self, part: str, ids: bytes) -> None:
        if len(self) >= REMEMBERED:
            # Parts met again since the last time are kept for one more.
            self.before = dict(self)
            self.clear()
        self[part] = ids

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            if len(part) > LONGEST:
                cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in self.meet]
                if cuts:
                    return b"".join([self[part[a:b]] for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)])
            pieces = self.merged(part) if len(part) > LONGEST else self.merged_short(part)
            numbers = [i for piece in pieces for i in self.ids_of(piece)]
            ids = struct.pack(f"<{len(numbers)}I", *numbers)
            if len(part) > LONGEST:
                return ids
        self.remember(part, ids)
        return ids

    def ids_of(self, piece: str) -> list[int]:
        known = self.number.get(piece)
        if known is not None:
            return [known]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.processor.unk_id()]

    def merged_short(self, part: str) -> list[str]:
        """As ``merged``, of one short part; the agenda of few pairs is a list by place, of which the least is taken."""
        symbols, rank = list(part), self.rank.get
        agenda = [rank(pair, NEVER) for pair in map(add, symbols, part[1:])]
        made: dict[str, tuple[str, str]] = {}
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            whole = symbols[i] + symbols[i + 1]
            if whole in self.unused:
                made[whole] = (symbols[i], symbols[i + 1])
            symbols[i] = whole
            del symbols[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + whole, NEVER)
            if i < len(agenda):
                agenda[i] = rank(whole + symbols[i + 1], NEVER)
        return self.apart(symbols, made) if made else symbols

    @staticmethod
    def apart(symbols: list[str], made: dict[str, tuple[str, str]]) -> list[str]:
        """Pieces that only serve to make others come apart again."""
        while any(s in made for s in symbols):
            symbols = [part for s in symbols for part in made.get(s, (s,))]
        return symbols

    def merged(self, part: str) -> list[str]:
        """The symbols of a part when nothing is left to merge."""
        symbol, rank, last = list(part), self.rank.get, len(part) - 1
        after, before = list(range(1, last + 2)), list(range(-1, last))
        made: dict[str, tuple[str, str]] = {}
        agenda = [(r, i, i + 1, pair) for i, pair in enumerate(map(add, symbol, part[1:])) if (r := rank(pair)) is not None]
        heapify(agenda)
        while agenda:
            _, left, right, whole = heappop(agenda)
            a, b = symbol[left], symbol[right]
            if not a or not b or len(a) + len(b) != len(whole):
                continue  # one of the two has been merged since
            symbol[left], symbol[right] = whole, ""
            if whole in self.unused:
                made[whole] = (a, b)
            behind, ahead = after[right], before[left]
            after[left] = behind
            if behind <= last:
                before[behind] = left
                pair = whole + symbol[behind]
                if (r := rank(pair)) is not None:
                    heappush(agenda, (r, left, behind, pair))
            if ahead >= 0:
                pair = symbol[ahead] + whole
                if (r := rank(pair)) is not None:
                    heappush(agenda, (r, ahead, left, pair))
        return self.apart([s for s in symbol if s], made)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without begin and end, four bytes each."""
        lists = [self.parts(self.processor.normalize(text)) for text in texts]
        if not self.unused:
            new = set().union(*lists).difference(self)
            self.learn([part for part in new if len(part) <= LONGEST and part not in self.before])
        return [b"".join(map(self.__getitem__, parts)) for parts in lists]


@lru_cache(maxsize=1)
def agenda_of(model: bytes) -> Agenda:
    """One agenda for all tasks of a worker."""
    return Agenda(sentencepiece.SentencePieceProcessor(model_proto=model))


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """Per row ``doc_id``, ``n_tokens``, ``ids`` (begin and end included, as little-endian unsigned 32-bit integers), whether the
    library ``agrees``, and the ids ``decoded`` again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_of(model)
        processor = agenda.processor
        begin, end = (np.array([i], "<u4").tobytes() for i in (processor.bos_id(), processor.eos_id()))
        for batch in W.slices(batches):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            ids = [begin + x + end for x in agenda.encode(texts)]
            lists = [np.frombuffer(x, "<u4").tolist() for x in ids]
            agrees = [a == b for a, b in zip(lists, processor.encode(texts, add_bos=True, add_eos=True, num_threads=1), strict=True)]
            arrays = [pa.array([len(x) for x in lists], pa.int64()), pa.array(ids, pa.binary()), pa.array(agrees, pa.bool_())]
            decoded = pa.array(processor.decode(lists, num_threads=1), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays, decoded], ["doc_id", "n_tokens", "ids", "agrees", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), model(public_tokenizers.path("piece_bpe_32k.model")))
    digests = [F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
    return found.select("doc_id", "n_tokens", *digests, "agrees")

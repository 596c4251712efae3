"""Near duplicates by 64-bit SimHash fingerprints, joined on blocks of equal bits.

Two fingerprints that differ in at most ``distance`` bits are equal in all but ``distance`` of ``blocks`` blocks. Each
fingerprint is therefore dealt out once for every choice of ``blocks - distance`` blocks, under the bits of these; close
pairs meet under at least one choice, and their true distance decides. Equal fingerprints are one row before that, and
of those that meet only a link of each to the first of its chain leaves the task, so neither copies nor a dense group of near
copies make pairs. A key that very many fingerprints share is split by parts of its other bits, of which one is equal again. Links become components; every document carries the smallest doc_id it reaches.

Rules: words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z in lower case; shingles are ``width`` words (the whole text if it
has fewer), repeats included; a bit is 1 if it is set in over half of the shingles' XXH64 values. Null, empty and blank
texts have the fingerprint 0 and link like any other. Repeated rows (the same doc_id) stay repeated. Only ``doc_id`` and
``text`` are read; further columns make no difference. An empty table gives an empty result. A text's arrays are held
by one task: about ten times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm import words as W
from rewardloom.llm.components import components
from rewardloom.llm.tables import stored

SEED = 42
BITS = 64
#: Fingerprints of one key that a task connects at once.
MOST = 200_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of a lower-cased text."""
    parts = text.split()
    line = b" ".join(parts)
    if len(parts) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)] if parts else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """The value whose bits are set in over half of ``hashes``; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), block):
        rows = hashes[at : at + block].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if c else "0" for c in 2 * counts > len(hashes)), 2)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            data, places = W.text_bytes(batch.column("text"))
            whole = W.lowered(data).tobytes()
            found = [majority(shingle_hashes(whole[a:b], width)) for a, b in zip(places[:-1], places[1:], strict=True)]
            values = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(values)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask for every choice of the blocks that stay equal, as signed 64-bit numbers."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    bits = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    masks = [sum(chosen) for chosen in combinations(bits, blocks - distance)]
    return [m - 2**BITS if m >= 2 ** (BITS - 1) else m for m in masks]


def forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For every one of the sorted, distinct ``values`` but the first of its chain, itself and that first: what chains of close
    pairs connect. Each value met is compared with all that are not yet met, so a dense group costs little more than a pass."""
    rest, a, b = values, [], []
    while len(rest):
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        for value in queue:
            close = np.bitwise_count(rest ^ value) <= distance
            if close.any():
                found = rest[close]
                rest = rest[~close]
                queue.extend(found)
                a.append(found)
                b.append(np.full(len(found), root))
    none = np.zeros(0, values.dtype)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def sub_masks(mask: int, distance: int) -> list[int]:
    """``mask`` with one of ``distance + 1`` parts of the bits it leaves out each: close values that agree in the mask's bits agree
    in one of these too."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    edges = [len(free) * i // (distance + 1) for i in range(distance + 2)]
    masks = [(mask % 2**BITS) | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [m - 2**BITS if m >= 2 ** (BITS - 1) else m for m in masks]


def _dealt(prints: DataFrame, masks: list[int]) -> DataFrame:
    """Every fingerprint under each choice ``i`` with the bits ``k`` of its mask."""
    choices = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)]
    return prints.select("fp", F.explode(F.array(*choices)).alias("s")).select("s.i", "s.k", "fp")


def links(prints: DataFrame, distance: int = 3, blocks: int = 6, most: int = MOST) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp``, enough to connect all that differ in ``distance`` bits or
    fewer, and none that chains of such pairs don't connect. A key with more than ``most`` fingerprints is dealt out again by
    parts of its other bits."""
    masks = block_masks(blocks, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None

        def connected() -> Iterator[pa.RecordBatch]:
            values = np.concatenate(held) if len(held) > 1 else held[0]
            if len(values) > 1:
                a, b = forest(values, distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        # Keys come one after the other; only the fingerprints of one are held.
        for batch in batches:
            if not batch.num_rows:
                continue
            i, k, fp = (c.to_numpy() for c in batch.columns)
            fp = fp.view(np.uint64)
            edges = np.flatnonzero((i[1:] != i[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.append(0, edges), np.append(edges, len(fp))
            if key is not None and key != (i[0], k[0]):
                yield from connected()
                held = []
            whole = np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1
            if len(starts) > 1:
                held.append(fp[: ends[0]])
                yield from connected()
                for g in whole:
                    held = [fp[starts[g] : ends[g]]]
                    yield from connected()
                held = []
            held.append(fp[starts[-1] :])
            key = (i[-1], k[-1])
        if key is not None:
            yield from connected()

    def linked(dealt: DataFrame) -> DataFrame:
        ordered = dealt.repartition("i", "k").sortWithinPartitions("i", "k", "fp")
        return ordered.mapInArrow(run, "a long, b long")

    dealt = _dealt(prints, masks)
    big = stored(dealt.groupBy("i", "k").agg(F.count("*").alias("n")).where(F.col("n") > most).select("i", "k"), "big")
    if big.isEmpty():
        return linked(dealt)
    small = linked(dealt.join(big, ["i", "k"], "left_anti"))
    held = stored(dealt.join(big, ["i", "k"], "left_semi"), "held")
    parts = len(masks) * (distance + 1)
    again = F.array(*[
        F.struct(F.lit(n * (distance + 1) + j).alias("j"), F.col("fp").bitwiseAND(F.lit(m)).alias("h"))
        for n, mask in enumerate(masks) for j, m in enumerate(sub_masks(mask, distance))
    ])
    mine = F.slice(again, F.col("i") * (distance + 1) + 1, distance + 1)
    split = held.select("fp", F.explode(mine).alias("s")).select((F.col("s.j") + parts).alias("i"), F.col("s.h").alias("k"), "fp")
    return small.union(linked(split))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest doc_id that links reach from the document."""
    prints = stored(fingerprints(docs, width), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), distance, blocks))
    rooted = distinct.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.select("fp", "root").join(classes, "root").select("fp", "component_id")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )

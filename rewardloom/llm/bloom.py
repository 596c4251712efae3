"""Bloom filters of a table's keys, for leaving rows out of a shuffle that a join would drop behind it.

A filter has about sixteen bits a key, ``MOST`` at most (32 MB): with more keys it lets more rows through, which costs rows in the
shuffle and never changes the join's result. The keys are shuffled by block of bits, so the driver gets each block once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rewardloom.llm import words as W

PER_KEY, MOST = 16, 2**28
BLOCK = 2**20


class Bloom:
    """``bits`` of all blocks; a key sets two bits of one block."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.blocks = bits, max(1, len(bits) * 8 // BLOCK)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys may be in the table; those that are not among these are certainly not."""
        out = np.ones(len(keys), bool)
        for bit in places(keys, self.blocks)[1]:
            out &= (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return out


def places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The block of each key, and the numbers of its two bits."""
    x = W.mixed(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    block = ((x >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)
    return block, [block * BLOCK + ((x >> np.uint64(shift)) % np.uint64(BLOCK)).astype(np.int64) for shift in (0, 20)]


def bloom(keys: DataFrame, most: int = MOST) -> Bloom:
    """The filter of a stored table of one column of whole numbers, without nulls."""
    (name,) = keys.columns
    blocks = min(-(-keys.count() * PER_KEY // BLOCK), most // BLOCK)
    if not blocks:
        return Bloom(np.zeros(BLOCK // 8, np.uint8))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(name).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(places(key, blocks)[0]), pa.array(key)], ["block", "key"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block, key = (c.to_numpy() for c in batch.columns)
            bits = places(key, blocks)[1]
            for b in np.unique(block).tolist():
                mine = held.setdefault(b, np.zeros(BLOCK // 8, np.uint8))
                for bit in bits:
                    at = bit[block == b] - b * BLOCK
                    np.bitwise_or.at(mine, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        if held:
            arrays = [pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["block", "bits"])

    rows = keys.mapInArrow(dealt, "block long, key long").repartition("block").mapInArrow(filled, "block long, bits binary").collect()
    whole = np.zeros((blocks, BLOCK // 8), np.uint8)
    for row in rows:
        whole[row["block"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return Bloom(whole.ravel())

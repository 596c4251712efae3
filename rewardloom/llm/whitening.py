"""Whitening of embeddings by shifted Cholesky QR.

The rows, centred, are a tall matrix A. One pass sums its Gram matrix G; with a shift that is a little more than G's rounding
error, G is sure to have a Cholesky factor R1, and the rows of A times the inverse of R1 (a triangular solve per block of
rows) are much nearer to orthogonal than A's. The next passes do the same to them, without a shift where they have become
well conditioned, until the Gram matrix is the identity up to ``CLOSE``, or has ceased to improve, as rows of lower rank make it. With the
factors composed, A = Q R; the last Gram matrix M of Q is kept too, so the singular values and right vectors of M^(1/2) R are those of
A. Squared over n they are the eigenvalues of the covariance and its eigenvectors, to the precision of A itself, where a
decomposition of the covariance would lose all that is below its rounding error.

Entries are counted in 64ths and shifted, ``x = floor(64 * c) + 1000000``, so their sums are exact. A centred entry is
``x - floor(S / n)`` less ``(S mod n) / n``: the large offset is gone before anything is rounded. Every pass sums blocks of rows in
tasks and adds the tasks' sums row by row of the matrix, in a fixed order; the driver gets one matrix of the dimension's size.

Rules: a row whose vector is null, or holds a null, an infinity, no number, or an entry beyond 2**52 in 64ths, is dropped; so is one whose length
is not the most frequent one (of equally frequent ones the largest). The other rows are all fitted and all returned,
repeated ones and those without a number alike. Components without variance, by ``EMPTY`` of the largest deviation, do not exist: so
one row, or equal rows, or an empty table, give no result rows. Of equal variances any orthogonal components may come. Only
the two named columns are read. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
LARGEST = float(2**52)
#: Rows multiplied at once.
BLOCK = 4096
#: A Gram matrix so near to the identity needs no further pass; no more than so many are made.
CLOSE, PASSES = 1e-13, 8
EMPTY = 1e-12


class Fit(NamedTuple):
    """``n`` vectors, their sums per dimension, the composed factor, and of the components: unit rows, variances and their
    parts of the whole."""

    n: int
    sums: list[int]
    factor: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def vectors(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector (of ``size`` entries) and these rows' entries in shifted 64ths; without ``size``, their lengths."""
    column = column.cast(pa.large_list(pa.float64()))
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.list_flatten(column)
    bad = pc.is_null(entries).to_numpy(zero_copy_only=False)
    value = np.floor(pc.fill_null(entries, 0.0).to_numpy(zero_copy_only=False) * SCALE)
    with np.errstate(invalid="ignore"):
        bad = bad | ~(np.abs(value) <= LARGEST)
    row = np.repeat(np.arange(len(length)), np.maximum(length, 0))
    good = (np.bincount(row, bad, len(length)) == 0) & (length >= 0)
    if size is None:
        return good, length[good]
    good &= length == size
    return good, value[good[row]].astype(np.int64).reshape(-1, size) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch], name: str, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            good, x = vectors(part.column(name), size)
            if len(x):
                yield part.filter(pa.array(good)), x


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries less their means, and exactly: ``n`` times them is ``n * whole - rest``."""
    whole = x - np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    return whole - rest / n, whole, rest


def deviations(whole: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """The exact sum of squares of ``n * whole - rest`` per row."""
    most = n * (int(np.abs(whole).max(initial=0)) + 1)
    if most * most * whole.shape[1] < 2**63:
        return ((whole * n - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in whole.tolist()]
    return [x if x < 2**63 else None for x in exact]


def _summed(rows: DataFrame, name: str, size: int, part: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """The sum of ``part`` of all blocks of vectors, a matrix. Tasks send their sums by rows of it, which are added apart."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, name, size):
            total = part(x) if total is None else total + part(x)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": list(range(len(total))), "values": [r.tobytes() for r in total]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(values, kind)
        if held:
            yield pa.RecordBatch.from_pydict({"i": list(held), "values": [r.tobytes() for r in held.values()]})

    schema = "i long, values binary"
    # Sorted by their bytes, the tasks' sums are added in one order, whichever task ends first.
    parts = rows.select(name).mapInArrow(sums, schema).repartition("i").sortWithinPartitions("i", "values").mapInArrow(add, schema)
    return np.array([np.frombuffer(bytes(r["values"]), kind) for r in parts.orderBy("i").collect()])


def _size(rows: DataFrame, name: str) -> tuple[int, int]:
    """The most frequent length of the vectors, and how many have it."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(vectors(batch.column(name))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["size", "n"])

    counts = rows.select(name).mapInArrow(lengths, "size long, n long").groupBy("size").agg(F.sum("n").alias("n"))
    first = counts.orderBy(F.desc("n"), F.desc("size")).first()
    return (first["size"], first["n"]) if first else (0, 0)


def solved(x: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverses of upper triangular factors, first to last, by substitution column by column."""
    for r in factors:
        out = np.empty_like(x, order="F")
        for j in range(len(r)):
            out[:, j] = (x[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        x = out
    return x


def cholesky(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper factor of a Gram matrix, shifted if asked for or if it has none."""
    size, unit = len(gram), np.finfo(np.float64).eps
    shift = 11 * (n * size + size * (size + 1)) * unit * np.linalg.norm(gram, 2) if shifted else 0.0
    # With very many rows the bound on rounding is far from what blocks of sums leave.
    shift = min(shift, 1e-8 * np.trace(gram))
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, size * unit * np.trace(gram))


def fit(rows: DataFrame, name: str, components: int = COMPONENTS) -> Fit | None:
    """The whitening of all vectors of the column ``name``; nothing if there is no variance."""
    size, n = _size(rows, name)
    if not n or not size:
        return None
    # The high and the low parts of the numbers are summed apart, so that no sum overflows.
    halves = _summed(rows, name, size, lambda x: np.stack(((x >> 26).sum(axis=0), (x & (2**26 - 1)).sum(axis=0))), np.int64)
    sums = [(int(a) << 26) + int(b) for a, b in zip(*halves.tolist(), strict=True)]

    factors: list[np.ndarray] = []
    error = math.inf
    while True:

        def gram(x: np.ndarray, done: tuple[np.ndarray, ...] = tuple(factors)) -> np.ndarray:
            q = solved(centred(x, n, sums)[0], list(done))
            return q.T @ q

        m = _summed(rows, name, size, gram, np.float64)
        if not factors:
            if not m.any():
                return None
            # Dimensions of very different spread are made alike first: a diagonal factor.
            spread = np.sqrt(np.diag(m))
            spread = np.where(spread > 0, spread, 1.0)
            factors.append(np.diag(spread))
            m = m / spread / spread[:, None]
            factors.append(cholesky(m, n, shifted=True))
            continue
        last, error = error, float(np.abs(m - np.eye(size)).max())
        if error <= CLOSE or len(factors) > PASSES or (len(factors) > 3 and error > last / 2):
            break
        factors.append(cholesky(m, n, shifted=False))

    factor = factors[0]
    for r in factors[1:]:
        factor = r @ factor
    # Whatever the last passes left of the rows' own Gram matrix belongs to the factor.
    values, vectors_ = np.linalg.eigh((m + m.T) / 2)
    _, singular, right = np.linalg.svd((vectors_ * np.sqrt(np.maximum(values, 0))).T @ factor)
    variances = singular**2 / n
    held = int(min(components, (singular > EMPTY * singular[0]).sum(), n))
    return Fit(n, sums, factor, right[:held], variances[:held], variances[:held] / variances.sum())


def projected(x: np.ndarray, found: Fit) -> np.ndarray:
    return centred(x, found.n, found.sums)[0] @ found.components.T / np.sqrt(found.variances)


def identity_error(rows: DataFrame, name: str, found: Fit) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""

    def moments(x: np.ndarray) -> np.ndarray:
        w = projected(x, found)
        return np.vstack((w.T @ w, w.sum(axis=0)))

    m = _summed(rows, name, len(found.sums), moments, np.float64) / found.n
    return float(np.abs(m[:-1] - np.outer(m[-1], m[-1]) - np.eye(len(found.variances))).max())


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, name: str, key: str, components: int = COMPONENTS) -> DataFrame:
    """For every row with a vector and every component, from 1: ``key``, ``component``, ``n``, ``deviation`` (of n times the vector
    from the sums, squared), ``whitened``, ``explained`` and ``identity_error``."""
    found = fit(rows, name, components)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {WHITENED}"
    names = [key, *[part.split()[0] for part in WHITENED.split(", ")]]
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, size, held = identity_error(rows, name, found), len(found.sums), len(found.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, name, size):
            _, whole, rest = centred(x, found.n, found.sums)
            each = np.repeat(np.arange(len(x)), held)
            deviation = pa.array(deviations(whole, rest, found.n), pa.int64()).take(pa.array(each))
            same = [pa.array(np.tile(v, len(x))) for v in (np.arange(1, held + 1, dtype=np.int32), np.full(held, found.n), found.explained, np.full(held, error))]
            w = pa.array(projected(x, found).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(each)), same[0], same[1], deviation, w, same[2], same[3]], names)

    return rows.select(key, name).mapInArrow(run, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "vec_id")

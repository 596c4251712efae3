"""Merkle manifest of a dataset, written as a postorder log.

Every row is a leaf; the leaves of a ``lang``, by rising doc_id, are the leaves of one tree, and the trees' roots, by lang, are
those of a last one. Every ``ARITY`` consecutive nodes become the digest of theirs, the last run of a level may be smaller.

1. *Log.* A builder takes an aligned range of ``ARITY ** LEVELS`` leaves of one tree and writes its nodes in the order in which
   they are complete: a node right behind the last of those below it. As all subtrees before a leaf are complete, the
   position of a node in the whole tree's log is known from sizes alone: with ``e`` leaves up to its last one it is ``e - 1`` leaves,
   ``(e - 1) // ARITY ** k`` nodes of each level ``k`` before that leaf, and the levels below the node. So builders write apart from
   each other. The roots of the ranges are the leaves of the next log, until one node is left.
2. *Proofs* go down again. An extractor reads a range of a log by position, addresses the siblings of every leaf by the same
   closed form, folds the leaf up to the range's root and from there along the path that the log above gave this range. A
   range of a lower log gets one path, so proofs are never joined row by row.

Numbers of leaves come from a sort by ranges: the place inside a sorted partition plus the sizes of those before it. Neither
a large lang nor a doc_id with very many rows is held by one task; builders and extractors hold one range.

Rules: a field is ``-`` if null, otherwise its bytes' count, ``:`` and its bytes. Null langs are a tree, the first. Rows without
doc_id come first in their lang and are never tampered with; rows with the same doc_id are leaves each, ordered by digest.
Only ``doc_id``, ``source``, ``lang``, ``n_chars`` and ``text`` are read; other columns make no difference. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.tables import stored

ARITY, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a log: the tree, its number of leaves, the range, position, level and place in the level, the digest, and of leaves
#: what belongs to them.
LOG = "tree string, n long, range long, position long, level int, place long, digest string"
#: The path of a leaf upwards: of each run on the way the place in it and the digests of its siblings.
PATH = "array<struct<place: int, siblings: array<string>>>"


def field(value: Column) -> Column:
    binary = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(binary).cast("string"), F.lit(":"), binary))


def leaf(text: Column) -> Column:
    """The digest of a row with this text."""
    return F.sha2(F.concat(*[field(text if name == "text" else F.col(name)) for name in FIELDS]).cast("binary"), 256)


def node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(n: int) -> int:
    """The level of the root of a tree of ``n`` leaves."""
    level = 0
    while ARITY**level < n:
        level += 1
    return level


def position(level: int, place: int, n: int) -> int:
    """Where a node stands in the postorder log of a tree of ``n`` leaves."""
    last = min((place + 1) * ARITY**level, n) - 1
    before, size = last, last
    while size:
        size //= ARITY
        before += size
    return before + level


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with their ``rank`` by ``order``, which must be unique, in their ``tree``, and the tree's size ``n``."""
    line = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    line = stored(line.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33).alias("_part")
    parts = line.groupBy("tree", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("_n").over(Window.partitionBy("tree")).alias("n")
    parts = parts.select("tree", "_part", whole, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    numbered = line.withColumn("_part", part).join(parts, ["tree", "_part"]).withColumn("rank", F.col("_at") + F.col("_base"))
    return numbered.drop("_at", "_part", "_base")


def _ranges(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of sorted batches, range by range."""
    rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True))
    for key, group in groupby(rows, itemgetter(0, 1)):
        yield key, list(group)


def log(leaves: DataFrame) -> DataFrame:
    """The stored log of trees whose leaves have ``tree``, ``n``, ``rank``, ``digest`` and ``held`` (what belongs to a leaf)."""
    width = ARITY**LEVELS
    kind = f"{LOG}, held {leaves.schema['held'].dataType.simpleString()}"
    held_type = pa.struct([("doc_id", pa.int64()), ("tampered", pa.string())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, number), rows in _ranges(batches, ("tree", "range", "n", "rank", "digest", "held")):
            n = rows[0][2]
            top = min(LEVELS, height(n))
            out: list[tuple] = []
            open_: list[list[str]] = [[] for _ in range(top + 1)]
            for _, _, _, rank, digest, held in rows:
                out.append((position(0, rank, n), 0, rank, digest, held))
                open_[0].append(digest)
                level, place = 0, rank
                # A run is complete when it is full or the tree ends.
                while level < top and (len(open_[level]) == ARITY or rank == n - 1):
                    digest, open_[level] = node(open_[level]), []
                    level, place = level + 1, place // ARITY
                    open_[level].append(digest)
                    out.append((out[-1][0] + 1, level, place, digest, None))
            at, levels, places, digests, helds = zip(*out, strict=True)
            same = [pa.array([x] * len(out), t) for x, t in ((tree, pa.string()), (n, pa.int64()), (number, pa.int64()))]
            columns = [pa.array(at, pa.int64()), pa.array(levels, pa.int32()), pa.array(places, pa.int64()), pa.array(digests, pa.string())]
            names = ["tree", "n", "range", "position", "level", "place", "digest", "held"]
            yield pa.RecordBatch.from_arrays([*same, *columns, pa.array(helds, held_type)], names)

    dealt = leaves.withColumn("range", F.expr(f"rank div {width}")).select("tree", "range", "n", "rank", "digest", "held")
    dealt = dealt.repartition("tree", "range").sortWithinPartitions("tree", "range", "rank")
    return stored(dealt.mapInArrow(build, kind), "log")


def tops(nodes: DataFrame) -> DataFrame:
    """The roots of the ranges of a log, as the leaves of the next one."""
    width = ARITY**LEVELS
    last = sum([(F.col("n") > ARITY**level).cast("int") for level in range(LEVELS)], F.lit(0))
    held = F.lit(None).cast("struct<doc_id: bigint, tampered: string>").alias("held")
    n = F.ceil(F.col("n") / width).cast("long").alias("n")
    return nodes.where(F.col("level") == last).select("tree", n, F.col("range").alias("rank"), "digest", held)


def _siblings(at: dict[int, str], level: int, place: int, n: int) -> list[str]:
    """The digests of a node's run without its own, addressed by position."""
    count = -(-n // ARITY**level)
    first = place - place % ARITY
    return [at[position(level, p, n)] for p in range(first, min(first + ARITY, count)) if p != place]


def _upwards(rows: list[tuple], first: int) -> Iterator[tuple[tuple, list[tuple[int, list[str]]]]]:
    """Of every leaf of a range, its row and the runs on the way up to the range's root. ``rows`` hold position, level,
    place and digest from column ``first`` on, behind the tree's size."""
    n = rows[0][first - 1]
    at = {row[first]: row[first + 3] for row in rows}
    top = min(LEVELS, height(n))
    seen: dict[tuple[int, int], list[str]] = {}
    for row in rows:
        level, place = row[first + 1 : first + 3]
        if level:
            continue
        runs = []
        for up in range(top):
            if up == 0 or (up, place) not in seen:
                seen[up, place] = _siblings(at, up, place, n)
            runs.append((place % ARITY, seen[up, place]))
            place //= ARITY
        yield row, runs


NAMES = ("tree", "range", "n", "position", "level", "place", "digest", "held", "path", "subroot", "root")


def _read(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """A log in ranges, with the path of each range in its first row."""
    met = nodes.join(above.select("tree", F.col("rank").alias("range"), "path", "subroot", "root"), ["tree", "range"])
    first = (F.col("level") == 0) & (F.col("place") == F.col("range") * ARITY**LEVELS)
    met = met.withColumns({c: F.when(first, F.col(c)) for c in ("path", "subroot", "root")})
    return met.select(*NAMES).repartition("tree", "range").sortWithinPartitions("tree", "range", "position")


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``tree``, ``rank`` and the ``path`` to the root of every leaf of a log, given those of the ranges' roots."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), rows in _ranges(batches, NAMES):
            upper, subroot, root = rows[0][8:]
            ranks, paths = [], []
            for row, runs in _upwards(rows, 3):
                ranks.append(row[5])
                paths.append([{"place": p, "siblings": s} for p, s in runs] + upper)
            kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))
            same = [pa.array([x] * len(ranks), pa.string()) for x in (tree, subroot, root)]
            yield pa.RecordBatch.from_arrays([same[0], pa.array(ranks, pa.int64()), pa.array(paths, kind), *same[1:]], ["tree", "rank", "path", "subroot", "root"])

    return stored(_read(nodes, above).mapInArrow(extract, f"tree string, rank long, path {PATH}, subroot string, root string"), "paths")


def fold(digest: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its proof lead to."""
    for place, siblings in path:
        digest = node([*siblings[:place], digest, *siblings[place:]])
    return digest


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(nodes: DataFrame, above: DataFrame) -> DataFrame:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _ranges(batches, NAMES):
            upper, subroot, root = rows[0][8:]
            upper = [(x["place"], x["siblings"]) for x in upper]
            tail = "".join(s for _, siblings in upper for s in siblings).encode()
            out = []
            for row, runs in _upwards(rows, 3):
                digest, held = row[6], row[7]
                proof = hashlib.sha256("".join([s for _, siblings in runs for s in siblings]).encode())
                proof.update(tail)
                folded = fold(held["tampered"] or digest, [*runs, *upper])
                out.append((held["doc_id"], digest, subroot, root, proof.hexdigest(), folded, folded == root))
            kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return _read(nodes, above).mapInArrow(extract, PROOFS)


def _logs(leaves: DataFrame) -> list[DataFrame]:
    """The logs of some trees from the leaves up, until each tree is one node; the last item is these nodes."""
    logs = []
    while True:
        logs.append(log(leaves))
        leaves = tops(logs[-1])
        if (leaves.agg(F.max("n")).first()[0] or 0) <= 1:
            return [*logs, leaves]


def manifest(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """Per row ``doc_id``, its ``leaf``, the ``subroot`` of its lang and the ``root`` of the dataset; the digest of its proof; and the
    root that the proof leads to from the row as it is found later, with the text ``changed`` where ``tampered``."""
    held = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.when(tampered, leaf(changed)).alias("tampered")).alias("held")
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang")).alias("tree")
    # Rows of one doc_id and digest are told apart by a number that the stored table keeps.
    rows = docs.select(tree, leaf(F.col("text")).alias("digest"), held, F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "leaves")
    *logs, subroots = _logs(ranked(rows.withColumn("doc_id", F.col("held.doc_id")), ["doc_id", "digest", "row"]))

    # The roots of the langs are the leaves of the last tree; its leaves' numbers lead back to the langs.
    last = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest", "held")
    last = stored(ranked(last, ["lang"]), "subroots")
    *over, roots = _logs(last)
    none = F.array().cast(PATH).alias("path")
    above = roots.select("tree", "rank", none, F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(over):
        above = _down(nodes, above)
    above = last.join(above.drop("tree", "subroot"), "rank").select(
        F.col("lang").alias("tree"), F.lit(0).cast("long").alias("rank"), "path", F.col("digest").alias("subroot"), "root"
    )
    for nodes in reversed(logs[1:]):
        above = _down(nodes, above)
    return _proofs(logs[0], above)


#: The letters that tampering makes small.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, tampered, F.translate("text", UPPER, LOWER))


def sql(levels: int = 12, top: int = 4) -> str:
    """The same in SQL, for trees of at most ``ARITY ** levels`` leaves and ``ARITY ** top`` langs."""

    def text(name: str) -> str:
        kind = f"{name}::varchar"
        return f"coalesce(strlen({kind}) || ':' || {kind}, '-')"

    def digest(body: str) -> str:
        return "sha256(" + " || ".join([*map(text, FIELDS[:-1]), body]) + ")"

    bits = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))"
    crc = f"xor(4294967295::ubigint, list_reduce([4294967295::ubigint] || list_transform(string_split(doc_id::varchar, ''), lambda z: ascii(z)::ubigint), lambda c, b: {bits}))"
    out = [
        f"d as (select *, {digest(text('text'))} as leaf, case when {crc} % 3 = 0 then "
        f"{digest(text(f'''translate(text, '{UPPER}', '{LOWER}')'''))} end as bad from documents)",
        "l0 as (select lang, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n, leaf as h from d)",
    ]

    def run(source: str, key: str, level: int) -> str:
        over = f"over (partition by {key}, i // {ARITY} order by i rows between"
        return (
            f"select {key}, i, n, h, case when n > 1 then coalesce(string_agg(h, '') {over} unbounded preceding and 1 preceding), '') else '' end as a, "
            f"case when n > 1 then coalesce(string_agg(h, '') {over} 1 following and unbounded following), '') else '' end as z from {source}"
        )

    def up(source: str, key: str) -> str:
        return (
            f"select {key}, i // {ARITY} as i, any_value((n + {ARITY - 1}) // {ARITY}) as n, "
            f"case when any_value(n) > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end as h from {source} group by {key}, i // {ARITY}"
        )

    for level in range(levels):
        out += [f"s{level} as materialized ({run(f'l{level}', 'lang', level)})", f"l{level + 1} as materialized ({up(f'l{level}', 'lang')})"]
    out.append(
        f"t0 as (select lang, 1 as t, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n, h as h from l{levels})"
    )
    for level in range(top):
        out += [f"u{level} as materialized ({run(f't{level}', 't', level)})", f"t{level + 1} as materialized ({up(f't{level}', 't')})"]
    out.append(
        "r as (select d.*, row_number() over (partition by d.lang order by doc_id nulls first, leaf) - 1 as i, t0.i as j, t0.h as subroot, "
        f"(select h from t{top}) as root from d join t0 on d.lang is not distinct from t0.lang)"
    )
    # Each step appends the siblings and, where there are several nodes, folds what has been reached.
    out.append("f0 as (select *, coalesce(bad, leaf) as g, '' as p from r)")
    step = 0
    for prefix, key, at, count in (("s", "lang", "i", levels), ("u", "1", "j", top)):
        for level in range(count):
            same = "s.lang is not distinct from f.lang and " if prefix == "s" else ""
            out.append(
                f"f{step + 1} as materialized (select f.* replace (case when s.n > 1 then sha256(s.a || f.g || s.z) else f.g end as g, f.p || s.a || s.z as p) "
                f"from f{step} f join {prefix}{level} s on {same}s.i = f.{at} // {ARITY**level})"
            )
            step += 1
    return (
        "with " + ",\n".join(out) + f"\nselect doc_id, leaf, subroot, root, sha256(p) as proof_sha256, g as folded_root, g = root as verified from f{step}"
    )

"""Shards of even size that keep linked documents together, by balanced label propagation.

Documents with equal texts are linked. Every linked document begins in a shard by its hash. In each round a group's members
look where most of their neighbours are and move there as far as the quotas and ``SLACK`` allow, counting those who leave; a
hot group so fills one shard after the other. Rounds end when nothing moves. Then each shard takes the linked documents it
holds, up to its quota, and the documents without links (and, group by group, what is over a quota) fill the rest: the law is
``rows``, the numbers of documents in the shards are at most one apart.

All steps are joins and aggregations of numbers; texts are read once and never move. Moves are granted to buckets of
documents in order of their hashes, and ranks come from salted windows, so neither a hot group nor a shard is gathered in one
task. The driver sees one number per pair of shards and round and says how many may move. Every round is stored in the session's shared folder.

Null texts count as empty ones (which are equal texts). Repeated rows are placed each. Only ``doc_id`` and ``text`` are read; a
null doc_id is placed like others. With fewer documents than shards some shards are empty; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.tables import numbered, stored

SHARDS = 16
ROUNDS = 10
#: Buckets by which room is dealt: so many by group, times so many by document.
BUCKETS = 64
#: A group is hot if it is more than such a part of all documents.
HOT = 1000
#: How far a shard may exceed its quota before the last step.
SLACK = 0.1


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes and 1), ``text_crc32`` and ``g``, the number of the text's group."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.md5(text).alias("g"),
    )


def _loads(state: DataFrame, n: int) -> list[int]:
    found = {r.shard: r.n for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [found.get(s, 0) for s in range(n)]


def granted(wanted: list[list[int]], load: list[int], quota: list[int]) -> list[list[int]]:
    """How many of ``wanted[i][j]`` moves from shard ``i`` to ``j`` may take place so that no shard exceeds its quota: moves into
    a shard that would are cut in proportion, which may cut others in turn, until all fit but for a hundredth."""
    n = len(load)
    allowed = [[float(x) for x in row] for row in wanted]
    for _ in range(1000):
        tight = False
        for j in range(n):
            into = sum(allowed[i][j] for i in range(n))
            over = load[j] + into - sum(allowed[j]) - quota[j]
            if into > 0 and over > max(0.5, 0.01 * quota[j]):
                tight = True
                for i in range(n):
                    allowed[i][j] *= max(0.0, 1 - over / into)
        if not tight:
            break
    # Whole numbers that keep the sum of every shard's arrivals.
    whole = [[0] * n for _ in range(n)]
    for j in range(n):
        upto = 0.0
        for i in range(n):
            whole[i][j] = int(upto + allowed[i][j] + 1e-9) - int(upto + 1e-9)
            upto += allowed[i][j]
    return whole


def _wishes(state: DataFrame, closed: set[int]) -> DataFrame:
    """The state with the ``target`` each document wants to move to (null: none) and its ``bucket``."""
    counts = state.groupBy("g", "shard").agg(F.count("*").alias("n"))
    # Ties go by hashes of group and shard, so that groups in balance don't all choose the same shard.
    pull = F.struct(F.col("n"), F.xxhash64("g", "shard").alias("tie"), F.col("shard"))
    best = counts.where(~F.col("shard").isin(*closed)) if closed else counts
    best = best.groupBy("g").agg(F.max(pull).alias("best"))
    flows = counts.join(best, "g").where(F.col("best") > pull).select("g", "shard", F.col("best.shard").alias("target"))
    bucket = F.pmod(F.xxhash64("g"), F.lit(BUCKETS)) * BUCKETS + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(BUCKETS))
    return state.join(flows, ["g", "shard"], "left").withColumn("bucket", bucket)


def propagated(linked: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``linked`` with the ``shard`` that label propagation gives each document."""
    n = len(quota)
    # Shards begin even, so that as many can come as go.
    rows = stored(linked.withColumn("one", F.lit(1)), "linked")
    spread = numbered(rows, ["one"], ["doc_id", "g"], F.xxhash64("doc_id", F.lit(2)), "number")
    state = stored(spread.select(*linked.columns, (F.col("number") % n).cast("int").alias("shard")), "shards")
    load = _loads(state, n)
    room = [math.ceil(q * (1 + SLACK)) for q in quota]
    for _ in range(rounds):
        # Whoever would have to be turned away from a full shard looks elsewhere.
        closed = {j for j in range(n) if load[j] >= 0.95 * room[j]}
        wishes = stored(_wishes(state, closed), "wishes")
        sums = wishes.where("target is not null").groupBy("shard", "target", "bucket").agg(F.count("*").alias("n"))
        wanted = [[0] * n for _ in range(n)]
        for r in sums.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect():
            wanted[r.shard][r.target] = r.n
        allowed = granted(wanted, load, room)
        if not any(map(any, allowed)):
            break
        upto = Window.partitionBy("shard", "target").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        limit = F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in allowed])[F.col("shard")], F.col("target") + 1)
        cuts = sums.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") <= limit)
        # A row for each pair of shards.
        cuts = F.broadcast(cuts.groupBy("shard", "target").agg(F.max("bucket").alias("cut")))
        after = wishes.join(cuts, ["shard", "target"], "left")
        shard = F.when(F.col("bucket") <= F.col("cut"), F.col("target")).otherwise(F.col("shard"))
        state = stored(after.withColumn("shard", shard).select(*state.columns), "shards")
        load = _loads(state, n)
    return state


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot``, the place in the shard, gapless from 0."""
    rows = stored(documents(docs), "documents")
    total = rows.count()
    groups = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    groups = stored(groups.select("g", (F.col("n") * HOT > total).alias("hot")), "groups")
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    marked = rows.join(groups, "g", "left")
    state = propagated(marked.where("hot is not null"), quota, rounds)

    # Groups stand together where ranks are given, but for hot ones.
    together = F.when(F.coalesce("hot", F.lit(True)), F.xxhash64("doc_id")).otherwise(F.xxhash64("g"))
    held = stored(numbered(state, ["shard"], ["g", "doc_id"], together), "held")
    limit = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1)
    taken = [min(q, load) for q, load in zip(quota, _loads(held, shards), strict=True)]
    columns = ["doc_id", "size", "text_crc32"]
    inside = held.where(F.col("slot") < limit).select(*columns, "shard", "slot")

    rest = [*columns, "g", "hot", F.lit(1).alias("one")]
    loose = marked.where("hot is null").select(*rest).union(held.where(F.col("slot") >= limit).select(*rest))
    loose = numbered(stored(loose, "loose"), ["one"], ["g", "doc_id"], together, "place")
    # Loose documents fill the shards one after the other: shard s takes the places from begin[s] on.
    begin, at = [], 0
    for q, t in zip(quota, taken, strict=True):
        begin.append(at)
        at += q - t
    shard = F.lit(0)
    slot = F.col("place") + taken[0]
    for s in range(1, shards):
        here = F.col("place") >= begin[s]
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("place") - begin[s] + taken[s]).otherwise(slot)
    return inside.union(loose.select(*columns, shard.alias("shard"), slot.alias("slot")))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    found = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

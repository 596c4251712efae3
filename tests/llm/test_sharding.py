import random
import zlib
from collections import Counter, defaultdict

import pytest

from rewardloom.llm import sharding


def check(rows, found, shards=sharding.SHARDS):
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def cut(rows, found):
    """The share of a group's members outside the shard that holds most of them, over all groups."""
    by = defaultdict(Counter)
    for r in found:
        by[r.text_crc32][r.shard] += 1
    linked = [c for c in by.values() if sum(c.values()) > 1]
    return sum(sum(c.values()) - max(c.values()) for c in linked) / max(1, sum(sum(c.values()) for c in linked))


def test_groups_stay_together_and_shards_even(table):
    rng = random.Random(6)
    rows = [(i, f"text {rng.randrange(300)}" if i % 2 else f"alone {i}") for i in range(2003)]
    found = sharding.sharded(table(rows)).collect()
    check(rows, found)
    assert cut(rows, found) < 0.02


def test_a_hot_group_gathers_in_some_shards(table):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 6}") for i in range(1500)]
    found = sharding.sharded(table(rows)).collect()
    check(rows, found)
    hot = Counter(r.shard for r in found if r.text_crc32 == zlib.crc32(b"hot"))
    # Dealt by chance, six of sixteen shards would hold about 0.4 of it.
    assert sum(sorted(hot.values())[-6:]) > 0.5 * sum(hot.values())
    others = [r for r in found if r.text_crc32 != zlib.crc32(b"hot")]
    assert cut(rows, others) < 0.15


def test_all_linked(table):
    rows = [(i, f"pair {i // 2}") for i in range(800)]
    found = sharding.sharded(table(rows)).collect()
    check(rows, found)
    assert cut(rows, found) < 0.1


@pytest.mark.parametrize("n", [1, 5, 16, 17])
def test_few_documents(table, n):
    rows = [(i, "same") for i in range(n)]
    check(rows, sharding.sharded(table(rows)).collect())


def test_odd_rows(odd):
    check([(r.doc_id, r.text) for r in odd.collect()], sharding.sharded(odd).collect())


def test_empty(empty):
    assert sharding.sharded(empty).collect() == []


def test_no_python_in_the_plan(table):
    rows = table([(1, "a"), (2, "a"), (3, "b")])
    plan = sharding.sharded(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def optimum(sizes, quota):
    """The fewest members outside their group's main shard, over all ways to deal the groups' members out."""
    best = [10**9]

    def place(k, room, lost):
        if lost >= best[0]:
            return
        if k == len(sizes):
            best[0] = lost
            return

        def deal(s, left, most):
            if s == len(room):
                if left == 0:
                    place(k + 1, tuple(room_now), lost + sizes[k] - most)
                return
            for n in range(min(left, room_now[s]) + 1):
                room_now[s] -= n
                deal(s + 1, left - n, max(most, n))
                room_now[s] += n

        room_now = list(room)
        deal(0, sizes[k], 0)

    place(0, tuple(quota), 0)
    return best[0]


SMALL = (((3,) * 20, 4), ((5,) * 12, 3), ((2,) * 40, 4), ((10,) * 8, 4), ((4, 4, 4), 3), ((20,) * 6, 3), ((30, 30, 20, 20, 20), 2))


def test_small_tables_against_a_hash_and_the_exhaustive_optimum(table):
    """All these groups fit in whole; propagation is no exact search, but loses far less than a placement by hash."""
    assert optimum((4, 4, 4), (4, 4, 4)) == 0 and optimum((3, 3, 2), (4, 4)) == 1 and optimum((7, 2), (3, 3, 3)) == 4
    losses = []
    for sizes, shards in SMALL:
        rows = [(1000 * g + i, f"group {g}") for g, n in enumerate(sizes) for i in range(n)]
        found = sharding.sharded(table(rows), shards=shards).collect()
        check(rows, found, shards)
        hashed = [Counter(zlib.crc32(str(1000 * g + i).encode()) % shards for i in range(n)) for g, n in enumerate(sizes)]
        losses.append((round(cut(rows, found) * sum(sizes)), sum(sum(c.values()) - max(c.values()) for c in hashed)))
    assert all(lost < by_hash for lost, by_hash in losses)
    assert 3 * sum(lost for lost, _ in losses) < sum(by_hash for _, by_hash in losses)
    assert any(lost == 0 for lost, _ in losses)

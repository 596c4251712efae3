import random
import re

import numpy as np
import xxhash

from rewardloom.llm import simhash


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return sorted([(r[0], p, least[g]) for r, p, g in zip(rows, prints, group)], key=str)


def got(df):
    return sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()], key=str)


def near_copies(n, rng):
    words = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        if rng.random() < 0.3:
            words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 60, 120]))]
        copy = list(words)
        for _ in range(rng.choice([0, 0, 1, 2])):
            copy[rng.randrange(len(copy))] = rng.choice("abc")
        rows.append((1000 - i, " ".join(copy)))
    return rows


def test_components_equal_brute_force(table):
    rows = near_copies(150, random.Random(3))
    assert got(table(rows)) == brute(rows)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd) == brute(rows)


def test_empty(empty):
    assert got(empty) == []


def test_forest_connects_what_chains_connect():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 2**9, 60).astype(np.uint64) << np.uint64(7))
    roots = dict(zip(*(x.tolist() for x in simhash.forest(values, 1)), strict=True))
    group = {v: v for v in values.tolist()}
    for x in group:
        for y in group:
            if (x ^ y).bit_count() <= 1 and group[x] != group[y]:
                low, high = sorted((group[x], group[y]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert roots == {x: g for x, g in group.items() if x != g}


def test_every_close_pair_meets(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        x = rng.getrandbits(64)
        pairs.append((x, x ^ sum(1 << b for b in rng.sample(range(64), 3))))
    signed = [x - 2**64 if x >= 2**63 else x for p in pairs for x in p]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).distinct().collect()
    found = {frozenset((r.a % 2**64, r.b % 2**64)) for r in found}
    assert found == {frozenset(p) for p in pairs}


def test_a_key_with_many_fingerprints_is_split(spark):
    rng = random.Random(21)
    # Half of all share their upper 32 bits, and lie about a few centres.
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(600):
        x = (centres[0] >> 32 << 32) | (rng.choice(centres) & 0xFFFFFFFF)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(32)
        values.add(x)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    prints = spark.createDataFrame(signed, "fp long").repartition(3)

    def classes(found):
        root = {v: v for (v,) in signed}

        def top(v):
            while root[v] != v:
                v = root[v]
            return v

        for r in found.collect():
            root[top(r.a)] = top(r.b)
        groups = {}
        for (v,) in signed:
            groups.setdefault(top(v), set()).add(v)
        return sorted(map(sorted, groups.values()))

    whole = classes(simhash.links(prints))
    assert classes(simhash.links(prints, most=20)) == whole and max(map(len, whole)) > 20
    want = {(a, b) for (a,) in signed for (b,) in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    where = {v: i for i, group in enumerate(whole) for v in group}
    assert all(where[a] == where[b] for a, b in want)

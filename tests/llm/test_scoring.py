import math
import random

import numpy as np
import pyarrow as pa
import pytest

from rewardloom.llm import scoring


def prose(rng, n):
    """Words in which each depends on its neighbours."""
    pairs = [("the", "cat"), ("a", "dog"), ("some", "birds"), ("no", "fish")]
    return " ".join(x for _ in range(n) for x in (*rng.choice(pairs), rng.choice(["sat", "ran"])))


@pytest.fixture(scope="module")
def trained(table):
    rng = random.Random(1)
    docs = table([(i, prose(rng, 60)) for i in range(300)])
    return docs, *scoring.train(docs, rounds=3, share=1)


def brute(text, frequent, flat):
    """The pseudo-log-likelihood word by word, with plain loops."""
    w = scoring.weights(flat)
    hashes, _ = scoring._hashed(pa.array([text]))
    number = {h: i for i, h in enumerate(frequent.tolist())}
    ids = [number.get(h, scoring.KNOWN + h % scoring.OTHER) for h in hashes.tolist()]
    total = 0.0
    for i, target in enumerate(ids):
        around = [ids[j] if 0 <= j < len(ids) else scoring.KNOWN + scoring.OTHER for j in (i - 2, i - 1, i + 1, i + 2)]
        x = [float(v) for k in around for v in w.embed[k]]
        h = [math.tanh(sum(a * float(b) for a, b in zip(x, w.hidden[:, k])) + float(w.hidden_bias[k])) for k in range(scoring.HIDDEN)]

        def log_probability(state, matrix, bias, chosen):
            logits = [sum(a * float(b) for a, b in zip(state, matrix[:, k])) + float(bias[k]) for k in range(scoring.GRID)]
            return logits[chosen] - math.log(sum(math.exp(v) for v in logits))

        row, column = divmod(target, scoring.GRID)
        total += log_probability(h, w.row, w.row_bias, row)
        total += log_probability([a + float(b) for a, b in zip(h, w.of_row[row])], w.column, w.column_bias, column)
    return total, len(ids)


def test_scores_equal_brute_force(trained, table):
    _, frequent, flat = trained
    rows = [(1, "The cat sat the DOG ran"), (2, "unknown"), (3, ""), (4, "a a a"), (5, None)]
    found = {r.doc_id: r for r in scoring.scored(table(rows), frequent, flat).collect()}
    for doc, text in rows:
        total, n = brute(text or "", frequent, flat)
        assert found[doc].n_tokens == n and found[doc].log_likelihood == pytest.approx(total, abs=1e-3)
        assert found[doc].mean_log_likelihood == (pytest.approx(total / n, abs=1e-3) if n else None)


def test_both_sides_are_used(trained, table):
    _, frequent, flat = trained
    rng = random.Random(77)
    rows, words = [], prose(rng, 2000).split()
    rows.append((1, " ".join(words)))
    shuffled = list(words)
    rng.shuffle(shuffled)
    rows.append((2, " ".join(shuffled)))
    found = {r.doc_id: r.mean_log_likelihood for r in scoring.scored(table(rows), frequent, flat).collect()}
    counts = {w: words.count(w) / len(words) for w in set(words)}
    unigram = sum(p * math.log(p) for p in counts.values())
    assert found[1] > unigram + 0.5 and found[1] > found[2] + 1


def test_gradients():
    rng = np.random.default_rng(5)
    flat = rng.normal(size=sum(int(np.prod(s)) for s in scoring.SHAPES)) * 0.3
    w = scoring.Weights(*[x.astype(np.float64) for x in scoring.weights(flat)])
    around, target = rng.integers(0, scoring.KNOWN, (9, 4)), rng.integers(0, scoring.KNOWN, 9)
    found = scoring.gradients(w, scoring.forward(w, around, target)[1])
    for x, g in zip(w, found):
        places = [np.unravel_index(np.abs(g).argmax(), g.shape), tuple(0 for _ in g.shape)]
        for place in places:
            old, losses = x[place], []
            for step in (1e-5, -1e-5):
                x[place] = old + step
                losses.append(-scoring.forward(w, around, target)[0].mean())
            x[place] = old
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[place], abs=1e-6)


def test_frequent_words_are_counted_over_all_texts(table):
    rows = [(i, "b a A " + "c" * (i % 3)) for i in range(50)]
    found = scoring.frequent_words(table(rows).repartition(4))
    hashes, _ = scoring._hashed(pa.array(["a b c"]))
    assert found[0] == hashes[0] and found[1] == hashes[1] and hashes[2] in found


def test_odd_rows(odd, empty):
    frequent, flat = scoring.train(odd)
    found = scoring.scored(odd, frequent, flat).collect()
    assert len(found) == odd.count() and all(r.log_likelihood <= 0 for r in found)
    assert scoring.scored(empty, *scoring.train(empty)).collect() == []


def test_every_place_is_learnt_from(table):
    rng = random.Random(4)
    texts = [prose(rng, 20), prose(rng, 20) + " rare", "one", "", "the cat " * 40]
    hashes, first = scoring._hashed(pa.array(texts))
    rounds = scoring.rounds_of(hashes, first, scoring.SHARE)
    # As the query trains: each place has its round among those that are run.
    assert scoring.ROUNDS >= scoring.SHARE and set(rounds.tolist()) == set(range(scoring.SHARE))
    # The same word at the same place may have another round in another text.
    same = pa.array([f"the cat {i}" for i in range(40)])
    assert len(set(scoring.rounds_of(*scoring._hashed(same), scoring.SHARE)[::3].tolist())) == scoring.SHARE
    with pytest.raises(ValueError):
        scoring.train(table([(1, "a b c")]), rounds=1, share=2)


def test_words_that_share_a_number_are_told_apart(table):
    rng = random.Random(9)
    # More words than numbers, once or more often each; repeated rows, rows that share a doc_id, and rows without words.
    words = [f"w{i}" for i in range(6000)]
    lines = [" ".join(words[i] for i in rng.sample(range(6000), 40)) + " " + prose(rng, 4) for _ in range(400)]
    rows = [(i // 2, x) for i, x in enumerate(lines)] + [(0, lines[0]), (0, lines[0]), (None, lines[1]), (7, ""), (8, None)]
    docs = table(rows).repartition(3).cache()
    counts = scoring.word_counts(docs.select("text").where("text is not null"))
    frequent, flat = scoring.train(docs, counts=counts)
    assert len(frequent) == scoring.KNOWN
    known = set(frequent.tolist())
    held, total = {}, {}
    for _, text in rows:
        for h in scoring._hashed(pa.array([text]))[0].tolist():
            held[h] = held.get(h, 0) + 1
    for h, n in held.items():
        total[h % scoring.OTHER] = total.get(h % scoring.OTHER, 0) + (0 if h in known else n)
    want = []
    for (doc, text), r in zip(rows, scoring.scored(table(rows).coalesce(1), frequent, flat).collect()):
        assert r.doc_id == doc
        of_words = [math.log(held[h] / total[h % scoring.OTHER]) for h in scoring._hashed(pa.array([text]))[0].tolist() if h not in known]
        want.append((doc is None, doc or 0, r.n_tokens, r.log_likelihood + sum(of_words)))
    found = [(r.doc_id is None, r.doc_id or 0, r.n_tokens, r.log_likelihood) for r in scoring.scored(docs, frequent, flat, counts).collect()]
    assert len(found) == len(want)
    for a, b in zip(sorted(found), sorted(want)):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-2)
    # The shares of the words under one number are a whole.
    parts = {}
    for r in scoring.shares(counts, frequent, scoring.GRID).collect():
        parts.setdefault((r.h % 2**64) % scoring.OTHER, []).append(math.exp(r.share))
    assert parts and all(sum(x) == pytest.approx(1) for x in parts.values())


def test_known_words_grow_with_the_corpus(table, monkeypatch):
    assert scoring.grid_of(0) == scoring.GRID and scoring.known_of(scoring.GRID) == scoring.KNOWN
    assert scoring.grid_of(4 * 200**4) == 200 and scoring.known_of(200) == 30_000
    monkeypatch.setattr(scoring, "grid_of", lambda total: 70)
    docs = table([(1, " ".join(f"w{i}" for i in range(5000)))])
    counts = scoring.word_counts(docs.select("text"))
    frequent, flat = scoring.train(docs, counts=counts)
    assert len(frequent) == 3675 and scoring.weights(flat).row.shape == (scoring.HIDDEN, 70)
    r = scoring.scored(docs, frequent, flat, counts).first()
    assert r.n_tokens == 5000 and -20 < r.mean_log_likelihood < 0


def test_words_are_looked_up_by_their_first_bits():
    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 2**64, 5000, np.uint64)
    # Hashes that share their first bits, and the least and greatest.
    close = hashes[:40] ^ np.uint64(1)
    hashes = np.concatenate((hashes, close, np.array([0, 2**64 - 1], np.uint64)))
    for n in (0, 1, 300, scoring.KNOWN):
        frequent = rng.permutation(np.unique(np.concatenate((hashes[:n], hashes[-42:] if n > 100 else hashes[:0]))))[: scoring.KNOWN]
        number = {h: i for i, h in enumerate(frequent.tolist())}
        want = [number.get(h, scoring.KNOWN + h % scoring.OTHER) for h in hashes.tolist()]
        words = scoring.Vocabulary(frequent)
        assert words.numbers_of(hashes).tolist() == want
        # A few comparisons a word, not a search among all known ones.
        assert words.most <= 8


def test_contexts_end_with_their_texts():
    numbers, first = np.arange(9), np.array([0, 0, 3, 3, 4, 9, 9])
    found = scoring.contexts(numbers, first, np.arange(9), 99).tolist()
    texts = [list(range(a, b)) for a, b in zip(first[:-1], first[1:])]
    want = [[t[i + s] if 0 <= i + s < len(t) else 99 for s in (-2, -1, 1, 2)] for t in texts for i in range(len(t))]
    assert found == want


def test_a_step_of_adam_by_its_formula():
    rng = np.random.default_rng(6)
    w = scoring.first_weights()
    adam, plain = scoring.Adam(w), [x.astype(np.float64) for x in w]
    m, v = ([np.zeros_like(x) for x in plain] for _ in range(2))
    assert all(x.base is not None and np.shares_memory(x, adam.all) for x in adam.w)
    for step in range(1, 4):
        around, target = rng.integers(0, scoring.KNOWN, (300, 4)), rng.integers(0, scoring.KNOWN, 300)
        double = scoring.Weights(*plain)
        grads = scoring.gradients(double, scoring.forward(double, around, target)[1])
        for x, g, a, b in zip(plain, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        adam.learn(around, target)
    # In single precision, a gradient near zero may take its step the other way.
    for x, y in zip(plain, adam.w):
        assert np.mean(np.abs(x - y) > 1e-4) < 0.01

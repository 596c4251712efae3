"""Plain restatements of the definitions, for small texts."""

import math
import re
from collections import Counter
from itertools import groupby

import regex

SCRIPTS = ("Latin Devanagari Thai Arabic Cyrillic Han Hiragana Katakana Hangul Tamil Telugu Kannada Malayalam").split()


def script(ch):
    return next((s for s in SCRIPTS if regex.fullmatch(rf"\p{{Script={s}}}", ch)), None)


def word_weight(text):
    return sum(
        len(w) * n
        for w, n in ((w, sum(1 for _ in run)) for w, run in groupby(x for x in text.split() if len(x) > 1))
        if n >= 3
    )


def unit_weight(text):
    return sum(len(m[1]) for m in re.finditer(r"(.{2,}?)\1{3,}", text))


def glued_weight(text):
    return sum(
        len(m[1]) * ((m.end() - m.start()) // len(m[1])) for m in re.finditer(r"([a-zA-Z]{2,})\1{2,}", text)
    )


def phrase_weight(text, whitelist=()):
    words = text.split()
    grams = Counter(" ".join(words[i:i + n]) for n in (3, 4, 5) for i in range(len(words) + 1 - n))
    return sum(
        positions * len(g) * text.count(g)
        for g, positions in grams.items()
        if len(g) <= 50 and text.count(g) > 2 and not any(re.search(p, g) for p in whitelist)
    )


def mixed_weight(text):
    total = 0
    for known, run in groupby(text, key=lambda ch: script(ch) is not None):
        segment = list(run)
        changes = [s for s, _ in groupby(map(script, segment))][1:] if known else []
        seen = Counter(changes)
        fine = min(seen.values(), default=3) >= 3 and len(changes) <= 6 and len(changes) / (len(changes) + 1) >= 0.4
        if changes and not fine:
            total += len(segment) * len(changes)
    return total


def majority(text):
    tally = Counter(s for s in map(script, text) if s)
    return tally.most_common(1)[0][0] if tally else None


def similarity(a, b):
    if not (a and b):
        return 0.0
    if majority(a) != majority(b):
        return 0.4
    ta, tb = (Counter(re.findall(r"\w\w+", "".join(c if c.isalnum() else " " for c in t.lower()))) for t in (a, b))
    if not ta and not tb:
        return 0.4
    idf = {t: 1 if t in ta and t in tb else math.log(1.5) + 1 for t in {*ta, *tb}}
    dot = sum(ta[t] * tb[t] * idf[t] ** 2 for t in idf)
    norm = math.prod(math.sqrt(sum((c[t] * idf[t]) ** 2 for t in idf)) for c in (ta, tb))
    return min(1.0, 1.2 * dot / norm) if norm else 0.0


def repetition_reward(text, whitelist, markers):
    math_text = "<reasoning>" in text or any(re.search(p, text) for p in markers)
    threshold, base = (5, 1.5) if math_text else (2, 2.0)
    weights = {
        0.05: sum(len(m) for m in regex.findall(
            r"\p{Han}{10,}|\p{Arabic}{10,}|\p{Tamil}{10,}|\p{Cyrillic}{10,}", text)),
        0.1: unit_weight(text),
        0.03: sum(len(m) for m in re.findall(r'[.]{5,}|"[.]"{3,}|[.]"[.]"{2,}', text)),
        0.08: word_weight(text),
        0.15: glued_weight(text),
        0.2: mixed_weight(text),
        0.12: phrase_weight(text, whitelist),
    }
    loss = sum(w * math.log(n - threshold + 1, base) for w, n in weights.items() if n > threshold)
    return max(-0.06 * loss, -4.0)


def relevance_reward(question, thought, answer, post):
    def sentences(t):
        return [s for s in (m.strip() for m in re.findall(r"[^.!?]+[.!?]*", t)) if s]

    lines = sentences(thought)
    off = sum(similarity(question, s) < 0.3 for s in lines)
    drift = sum(similarity(a, b) < 0.3 for a, b in zip(lines, lines[1:]))
    excess = max(len(thought) - 500, 0) + max(len(answer) - 100, 0)
    return -(excess / 1000 + 0.3 * len(sentences(post)) + 0.2 * off + 0.5 * drift)


def entropy(tokens):
    n = len(tokens)
    return -sum(c / n * math.log2(c / n) for c in Counter(tokens).values()) if n else 0.0

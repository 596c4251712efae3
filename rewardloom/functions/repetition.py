"""Repetition detectors. Every one works inside its row: scoring needs no shuffle, however long or skewed the texts."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions.text import (
    BLANK_CLASS, any_pattern, has, let, occurrences, runs, starts, total_length, words, words_in_stretches,
)
from rewardloom.profiles import V2, Profile


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# Runs of ten or more letters of one script; repeated units; repeated punctuation; glued repetitions.
SCRIPT_RUNS = r"\p{IsHan}{10,}|\p{IsArabic}{10,}|\p{IsTamil}{10,}|\p{IsCyrillic}{10,}"
REPEATED_UNIT = r"(?d)(.{2,}?)\1{3,}"
PUNCTUATION = r'[.]{5,}|["][.]["]{3,}|[.]["][.]["]{2,}'


# No supported script but Latin has letters below this range: one comparison per character instead of twelve look-ups.
_MAYBE_FOREIGN = "[\\u0370-\\x{10FFFF}]"
# Other letters, and the words of both that hold a letter of the range above. A word is tried at its first letter only.
_LOW = "A-Za-z\\u00aa\\u00ba\\u00c0-\\u036f"
_FOREIGN_WORD = f"(?<![{_LOW}])[{_LOW}]*+{_MAYBE_FOREIGN}[{_LOW}\\u0370-\\x{{10FFFF}}]*+"
UNIT_IN_WORD = r"(?d)(.{2,}?)\1{3}"
UNIT_FROM_BLANK = f"(?d)([{BLANK_CLASS.replace('\t-', '\t\x0b-')}].*?)\\1\\1"


def maybe_foreign(text: Column) -> Column:
    """False only if every letter is Latin. Pure ASCII, the usual case, is told by comparing two lengths."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(_MAYBE_FOREIGN)


def script_runs(text: Column) -> Column:
    found = F.when(maybe_foreign(text), total_length(_all(text, SCRIPT_RUNS)))
    return F.coalesce(found, F.lit(0).cast("bigint"))


def _thrice(seq: Column) -> Column:
    """An element equals its two successors."""
    return F.exists(
        starts(seq, 3), lambda i: (F.get(seq, i) == F.get(seq, i + 1)) & (F.get(seq, i) == F.get(seq, i + 2))
    )


def repeated_units(text: Column, w: Column | None = None) -> Column:
    """Length of every unit that follows itself at least three times (of the unit, not of the run).

    The search tries every unit at every character of a line. Tests that can miss no match go first, on the text and
    then on each of its lines, as a match never leaves its line. A unit without blanks repeats inside one word; a
    unit of blanks only is a run of eight blanks. Any other run of four units holds, for b gaps in the unit, 4b-1
    whole words of period b: three equal words in a row for b = 1, and a word triple at three places for b > 1; it
    also holds three copies of the unit counted from its first blank.
    """

    def without_gaps(part: Column, seq: Column) -> Column:
        in_word = F.exists(seq, lambda x: (F.length(x) >= 8) & x.rlike(UNIT_IN_WORD))
        return in_word | (F.length(part) - total_length(seq) >= F.size(seq) + 6)

    def with_gaps(seq: Column) -> Column:
        triples = F.transform(starts(seq, 3), lambda i: F.concat_ws(" ", *_gram(seq, i, 3)))
        return _thrice(seq) | let(F.sort_array(triples), _thrice)

    def searchable(line: Column) -> Column:
        return let(
            words(line),
            lambda seq: without_gaps(line, seq) | (with_gaps(seq) & line.rlike(UNIT_FROM_BLANK)),
        )

    found = F.aggregate(
        F.filter(F.split(text, "\n"), searchable),
        F.lit(0).cast("bigint"),
        lambda n, line: n + total_length(_all(line, REPEATED_UNIT, 1)),
    )
    suspicious = let(words(text) if w is None else w, lambda seq: without_gaps(text, seq) | with_gaps(seq))
    return F.when(suspicious, found).otherwise(F.lit(0).cast("bigint"))


def punctuation(text: Column) -> Column:
    # Each alternative holds one of these, and a plain search is far cheaper than the pattern.
    there = has(text, ".....") | has(text, '"."""') | has(text, '.".""')
    return F.coalesce(F.when(there, total_length(_all(text, PUNCTUATION))), F.lit(0).cast("bigint"))


def word_runs(text: Column, p: Profile = V2, w: Column | None = None) -> Column:
    """``array<struct<word, n>>``: words repeated in sequence; too short words neither count nor break a run."""

    def of_words(seq: Column) -> Column:
        found = F.filter(runs(seq), lambda r: r["size"] >= p.min_repeats)
        return F.transform(
            found, lambda r: F.struct(F.get(seq, r["start"]).alias("word"), r["size"].cast("bigint").alias("n"))
        )

    return let(F.filter(words(text) if w is None else w, lambda x: F.length(x) >= p.min_word_chars), of_words)


def repeated_words(text: Column, p: Profile = V2, w: Column | None = None) -> Column:
    """Characters in runs of the same word."""
    return F.aggregate(
        word_runs(text, p, w), F.lit(0).cast("bigint"), lambda total, r: total + F.length(r["word"]) * r["n"]
    )


def glued_repetitions(text: Column, p: Profile = V2, w: Column | None = None) -> Column:
    """``abcabcabc``: unit length times the number of times it follows itself. Letters never leave their word."""
    pattern = f"([a-zA-Z]{{{p.min_word_chars},}})\\1{{{p.min_repeats - 1},}}"
    shortest = p.min_word_chars * p.min_repeats

    def of_word(x: Column) -> Column:
        matches = F.arrays_zip(_all(x, pattern, 0).alias("run"), _all(x, pattern, 1).alias("unit"))
        return F.aggregate(
            matches,
            F.lit(0).cast("bigint"),
            lambda n, m: n + F.length(m["unit"]) * F.floor(F.length(m["run"]) / F.length(m["unit"])),
        )

    glued = F.filter(words(text) if w is None else w, lambda x: (F.length(x) >= shortest) & x.rlike(pattern))
    return F.aggregate(glued, F.lit(0).cast("bigint"), lambda n, x: n + of_word(x))


# One character per script, none of which belongs to a script itself.
_CODES = "0123456789:;<=>?"


def script_class(scripts) -> str:
    return "[" + "".join(f"\\p{{Is{s}}}" for s in scripts) + "]"


def _to_codes(segment: Column, p: Profile) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, f"\\p{{Is{s[1]}}}", _CODES[s[0]]), enumerate(p.scripts), segment)


def script_changes(codes: Column) -> Column:
    """The scripts changed *to*, in order: script runs collapsed to one character each, without the first."""
    return F.substring(F.regexp_replace(codes, r"(.)\1+", "$1"), 2, 1 << 30)


def _legitimate(changes: Column, p: Profile) -> Column:
    """Ordinary multilingual text. The counts are taken over the list of changes, not over the characters."""
    n = F.length(changes)
    often_enough = F.forall(
        F.array_distinct(F.split(changes, "")), lambda code: occurrences(changes, code) >= p.min_script_chars
    )
    return (n - 1 <= p.max_consecutive_changes) & (n / (n + 1) >= p.min_script_ratio) & often_enough


def mixed_script_segments(text: Column, p: Profile = V2) -> Column:
    """``array<struct<segment, changes>>`` of letter runs that hop between scripts.

    Looking up a letter's script is dear, so only words that may hold a foreign letter are searched for runs of letters, and
    only runs that are not of one script alone are turned into codes.
    """
    letters = script_class(p.scripts)
    one_script = "^(?:" + "|".join(f"\\p{{Is{s}}}++" for s in p.scripts) + r")\z"
    found_in = F.transform(_all(text, _FOREIGN_WORD), lambda word: _all(word, letters + "{2,}"))
    candidates = F.filter(F.flatten(found_in), lambda s: ~s.rlike(one_script))

    def judged(segment: Column) -> Column:
        return let(
            script_changes(_to_codes(segment, p)),
            lambda ch: F.when(
                (F.length(ch) > 0) & ~_legitimate(ch, p),
                F.struct(segment.alias("segment"), F.length(ch).cast("bigint").alias("changes")),
            ),
        )

    found = F.filter(F.transform(candidates, judged), lambda s: s.isNotNull())
    return F.when(maybe_foreign(text), found)


def mixed_scripts(text: Column, p: Profile = V2) -> Column:
    found = mixed_script_segments(text, p)
    total = F.aggregate(
        found, F.lit(0).cast("bigint"), lambda n, s: n + F.length(s["segment"]) * s["changes"]
    )
    return F.coalesce(total, F.lit(0).cast("bigint"))


def repeated_phrases(text: Column, p: Profile = V2, s: Column | None = None) -> Column:
    """``array<struct<phrase, positions, n, whitelisted>>``: phrases seen at least ``min_repeats`` times.

    ``n`` counts non-overlapping occurrences of the phrase as a piece of the raw text, so its first and last word may
    be parts of longer words there. At every occurrence the words strictly inside the phrase are whole words, the word
    before them ends with the phrase's first word, the word after them begins with its last, and all gaps are single
    spaces. Positions are therefore sorted by (last letter of the first word, inner words, first letter of the last
    word); groups smaller than ``min_repeats`` are left out, and occurrences are looked for inside a group. Most positions
    go before that by a 32-bit hash of their key, sorted as one number with the position: equal keys have equal hashes. Only
    where they lie close enough to overlap is the text itself searched. All occurrences of a longer phrase share the
    group of its first words, so each size looks at the positions the size before has left.
    """

    def of_sizes(st: Column, positions: Column, sizes: tuple[int, ...]) -> Column:
        size = sizes[0]
        fitting = F.filter(positions, lambda i: i <= F.size(st["w"]) - size)
        hashed = F.sort_array(F.transform(fitting, lambda i: _hashed(st["w"], i, size)))
        likely = let(hashed, lambda g: F.filter(g, _frequent_key(g, p.min_repeats, _hash)))
        sorted_keys = F.sort_array(F.transform(likely, lambda h: _keyed(st["w"], _position(h), size)))
        frequent = let(sorted_keys, lambda g: F.filter(g, _frequent_key(g, p.min_repeats, lambda x: x["key"])))

        def counted_and_longer(kept: Column) -> Column:
            counted = _by_group(kept, lambda members: _counted(text, st, members, size, p))
            if len(sizes) == 1:
                return counted
            return F.concat(counted, of_sizes(st, F.transform(kept, lambda g: g["i"]), sizes[1:]))

        return let(frequent, counted_and_longer)

    sizes, white = tuple(sorted(p.phrase_words)), any_pattern(p.whitelist)
    found = let(
        words_in_stretches(text) if s is None else s, lambda st: of_sizes(st, starts(st["w"], sizes[0]), sizes)
    )
    return F.transform(
        found,
        lambda c: F.struct(
            c["phrase"].alias("phrase"), c["positions"].alias("positions"), c["n"].alias("n"),
            c["phrase"].rlike(white).alias("whitelisted"),
        ),
    )


def _gram(seq: Column, i: Column, size: int) -> list[Column]:
    return [F.get(seq, i + d) for d in range(size)]


def _key_parts(seq: Column, i: Column, size: int) -> list[Column]:
    first, *inner, last = _gram(seq, i, size)
    return [F.substring(first, -1, 1), *inner, F.substring(last, 1, 1)]


def _keyed(seq: Column, i: Column, size: int) -> Column:
    return F.struct(F.concat_ws(" ", *_key_parts(seq, i, size)).alias("key"), i.alias("i"))


def _hashed(seq: Column, i: Column, size: int) -> Column:
    """The key's hash in the upper half of a number, the position in the lower half."""
    return F.shiftleft(F.hash(*_key_parts(seq, i, size)).cast("bigint"), 32) + i


def _hash(x: Column) -> Column:
    return F.shiftright(x, 32)


def _position(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _frequent_key(grouped: Column, k: int, key):
    """Test of ``filter``: in a sorted group of k or more, the ends of some k neighbours share the member's key."""

    def test(x: Column, i: Column) -> Column:
        windows = [
            reduce(lambda a, b: a & b, [key(F.get(grouped, i + d)) == key(x) for d in (lo, lo + k - 1) if d != 0])
            for lo in range(1 - k, 1)
        ]
        return F.coalesce(reduce(lambda a, b: a | b, windows), F.lit(False))

    return test


def _by_group(kept: Column, of_group) -> Column:
    """Apply ``of_group`` to the positions of each group of a sorted array, and put the results together."""

    def one(r: Column) -> Column:
        members = F.transform(F.slice(kept, r["start"] + 1, r["size"]), lambda g: g["i"])
        return let(members, of_group)

    return F.flatten(F.transform(runs(kept, lambda g: g["key"]), one))


def _counted(text: Column, st: Column, members: Column, size: int, p: Profile) -> Column:
    """The repeated phrases among the positions of one group."""
    w, stretch = st["w"], st["stretch"]

    def occurs(phrase: Column) -> Column:
        first, last = F.substring_index(phrase, " ", 1), F.substring_index(phrase, " ", -1)

        def here(i: Column) -> Column:
            end = i + (size - 1)
            spaced = F.get(stretch, i) == F.get(stretch, end)
            return spaced & F.get(w, i).endswith(first) & F.get(w, end).startswith(last)

        def number(at: Column) -> Column:
            close = F.exists(starts(at, 2), lambda k: F.get(at, k + 1) - F.get(at, k) < size)
            found = F.when(close, occurrences(text, phrase)).otherwise(F.size(at).cast("bigint"))
            return F.when(F.size(at) >= p.min_repeats, found).otherwise(F.lit(0).cast("bigint"))

        return let(F.filter(members, here), number)

    def of_grams(grams: Column) -> Column:
        short = F.filter(F.array_distinct(grams), lambda g: F.length(g) <= p.max_phrase_chars)
        counted = F.transform(
            short,
            lambda g: F.struct(
                g.alias("phrase"),
                F.size(F.filter(grams, lambda x: x == g)).cast("bigint").alias("positions"),
                occurs(g).alias("n"),
            ),
        )
        return F.filter(counted, lambda c: c["n"] >= p.min_repeats)

    return let(F.transform(members, lambda i: F.concat_ws(" ", *_gram(w, i, size))), of_grams)


def phrase_weight(phrases: Column) -> Column:
    """Every position of a repeated phrase adds its length times its count."""
    return F.aggregate(
        phrases,
        F.lit(0).cast("bigint"),
        lambda total, c: total
        + F.when(c["whitelisted"], F.lit(0)).otherwise(c["positions"] * F.length(c["phrase"]) * c["n"]),
    )


def phrases(text: Column, p: Profile = V2, s: Column | None = None) -> Column:
    return phrase_weight(repeated_phrases(text, p, s))


def non_latin_repeats(text: Column, p: Profile = V2) -> Column:
    """Repeated non-Latin runs.

    As defined the detector wants one run of each of the twelve scripts in a row, and then takes every such
    sequence for legitimate text, so it is always 0. ``non_latin_runs`` counts each run of one script instead.
    """
    if not p.non_latin_runs:
        return F.lit(0).cast("bigint")
    pattern = "|".join(f"\\p{{Is{s}}}{{{p.min_repeats},}}" for s in p.scripts if s != "Latin")
    found = F.transform(_all(text, f"{_MAYBE_FOREIGN}{{{p.min_repeats},}}"), lambda part: _all(part, pattern))

    # A run occurs only inside runs of its script, so these are searched, not the text, and once for all equal runs.
    def weighed(seq: Column) -> Column:
        def total(joined: Column) -> Column:
            def of_run(run: Column, times: Column) -> Column:
                return let(
                    occurrences(joined, run), lambda n: F.when(n >= p.min_repeats, n * F.length(run) * times).otherwise(0)
                )

            return F.aggregate(
                runs(seq), F.lit(0).cast("bigint"), lambda sum_, r: sum_ + of_run(F.get(seq, r["start"]), r["size"])
            )

        return let(F.array_join(seq, " "), total)

    weight = let(F.sort_array(F.flatten(found)), weighed)
    return F.coalesce(F.when(maybe_foreign(text), weight), F.lit(0).cast("bigint"))


# Detector name -> column of (text, profile, words of the text in stretches).
DETECTORS = {
    "consecutive_script": lambda text, p, s: script_runs(text),
    "pattern": lambda text, p, s: repeated_units(text, s["w"]),
    "punctuation": lambda text, p, s: punctuation(text),
    "word": lambda text, p, s: repeated_words(text, p, s["w"]),
    "no_space_word": lambda text, p, s: glued_repetitions(text, p, s["w"]),
    "mixed_script": lambda text, p, s: mixed_scripts(text, p),
    "phrase": phrases,
    "non_latin": lambda text, p, s: non_latin_repeats(text, p),
}


# These look at letters alone.
WITHOUT_WORDS = ("consecutive_script", "punctuation", "mixed_script", "non_latin")


def detector(name: str, text: Column, p: Profile = V2) -> Column:
    if name in WITHOUT_WORDS:
        return DETECTORS[name](text, p, None)
    return let(words_in_stretches(text), lambda s: DETECTORS[name](text, p, s))


def is_math(text: Column, p: Profile = V2) -> Column:
    return has(text, p.thought_open) | text.rlike(any_pattern(p.whitelist[: p.math_markers]))


def detector_counts(text: Column, p: Profile = V2) -> Column:
    """All detectors as one struct; the text is split into words once."""

    def all_of(s: Column) -> Column:
        return F.struct(
            *[DETECTORS[name](text, p, s).cast("bigint").alias(name) for name, _ in p.repetition_weights]
        )

    return let(words_in_stretches(text), all_of)


def penalty(counts: Column, math: Column, p: Profile = V2) -> Column:
    """Logarithmic penalty of each detector beyond the tolerated count; a struct of counts in, a reward out."""
    threshold = F.when(math, p.math_context.threshold).otherwise(p.general_context.threshold)
    log_base = F.when(math, log(p.math_context.log_base)).otherwise(log(p.general_context.log_base))

    def total(context: Column) -> Column:
        def one(name: str, weight: float) -> Column:
            return F.ln(F.greatest(counts[name] - context["threshold"], F.lit(0)) + 1) * weight

        weighted = reduce(lambda a, b: a + b, [one(name, weight) for name, weight in p.repetition_weights])
        return weighted / context["log_base"]

    context = F.struct(threshold.alias("threshold"), log_base.alias("log_base"))
    return F.greatest(0.0 - let(context, total) * p.repetition_scale, F.lit(p.repetition_floor))


def anti_repetition(text: Column, p: Profile = V2) -> Column:
    return let(detector_counts(text, p), lambda counts: penalty(counts, is_math(text, p), p))

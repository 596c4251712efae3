"""Small text expressions the extraction and reward columns are built from."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that Python's strip() and split() know; the same class works in Java and RE2.
BLANK_CLASS = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = "".join(ch for ch in map(chr, range(0x3001)) if re.match(f"[{BLANK_CLASS}]", ch))
# Blanks as Java finds them fastest: one range lets most letters go before all others are tried.
_BLANK = f"[\\x00-\\x20\\x7f-\\u3000&&[{BLANK_CLASS}]]"
BLANK_RUN = f"{_BLANK}+"

# Numbers as Python's float() reads them once stripped and lower-cased.
PY_FLOAT = r"^[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?|inf|infinity|nan)\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(seq: Column, size: int = 1) -> Column:
    """The positions at which ``size`` elements of an array are left."""
    return F.when(F.size(seq) >= size, F.sequence(F.lit(0), F.size(seq) - size)).otherwise(
        F.array().cast("array<int>")
    )


def runs(seq: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """``array<struct<start, size>>`` of the stretches of neighbours with the same key."""
    heads = F.filter(
        starts(seq), lambda i: (i == 0) | (key(F.get(seq, i)) != key(F.get(seq, i - 1)))
    )

    def sized(h: Column) -> Column:
        return F.transform(
            h, lambda i, j: F.struct(i.alias("start"), (F.coalesce(F.get(h, j + 1), F.size(seq)) - i).alias("size"))
        )

    return let(heads, sized)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """White-space separated words; no word gives an empty array. Splitting is far cheaper than matching words."""
    text = strip(c)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, BLANK_RUN))


# A gap between words that is anything but one space.
_OTHER_BLANK = f"[\\x00-\\x1f\\x7f-\\u3000&&[{BLANK_CLASS.replace(chr(32), chr(31))}]]"
OTHER_GAP = f" {_BLANK}+|{_OTHER_BLANK}{_BLANK}*"


def words_in_stretches(c: Column) -> Column:
    """``struct<w, stretch>``: the words of a text, and for each the number of its stretch of single-spaced words."""
    text = strip(c)
    pieces = F.when(text != "", F.transform(F.split(text, OTHER_GAP), lambda s: F.split(s, " ")))

    def numbered(parts: Column) -> Column:
        return F.struct(
            F.flatten(parts).alias("w"),
            F.flatten(F.transform(parts, lambda part, i: F.array_repeat(i, F.size(part)))).alias("stretch"),
        )

    return let(F.coalesce(pieces, F.array().cast("array<array<string>>")), numbered)


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


def occurrences(text: Column, part: Column | str) -> Column:
    """Non-overlapping occurrences of a literal; byte lengths are stored, so neither side is scanned for them."""
    part = F.lit(part) if isinstance(part, str) else part
    gone = F.octet_length(text) - F.octet_length(F.replace(text, part, F.lit("")))
    return (gone / F.octet_length(part)).cast("bigint")


def count_is_one(text: Column, part: str) -> Column:
    return occurrences(text, part) == 1


def has(c: Column, part: str) -> Column:
    return c.contains(F.lit(part))


def has_all(c: Column, *parts: str) -> Column:
    result = has(c, parts[0])
    for part in parts[1:]:
        result = result & has(c, part)
    return result


def literal_pattern(part: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|/])", r"\\\1", part)


def part_after(c: Column, separator: str, index: int) -> Column:
    """Element ``index`` of a split by a literal."""
    return F.get(F.split(c, literal_pattern(separator)), F.lit(index))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match, NULL when there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def total_length(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0).cast("bigint"), lambda n, m: n + F.length(m))


def py_float(c: Column) -> Column:
    """Python's float(): underscores between digits count, a trailing type letter does not; NULL if unreadable."""
    clean = F.lower(strip(c))
    return F.when(clean.rlike(PY_FLOAT), F.replace(clean, F.lit("_"), F.lit("")).try_cast("double"))


def any_pattern(patterns: tuple[str, ...]) -> str:
    """One regular expression that finds what any of ``patterns`` finds in Python."""
    return "(?d)" + "|".join(f"(?:{p})" for p in patterns).replace(r"\d", r"\p{Nd}")


def sentences(c: Column, pattern: str) -> Column:
    """Trimmed, non-empty sentences in reading order."""
    return F.filter(
        F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), strip),
        lambda s: s != "",
    )


def normalised(c: Column) -> Column:
    return F.lower(strip(c))

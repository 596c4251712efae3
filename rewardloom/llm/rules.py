"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Measures of a whole text (null and empty: all 0):

* ``n_words``, ``word_chars``: runs of ``[^\\x20\\x09-\\x0D]`` and the code points in them;
* ``n_symbols``: characters of ``[#*$%&|<>]``;
* ``n_lines``, ``n_dup_lines``: lines (cut at ``\\n``) that hold a word, and those equal to an earlier one;
* ``n_repeat_words``: words in windows of ``WINDOW`` words that occur twice or more in the text, the first included;
* ``n_stop_words``: words that are a stop word of any of the known languages when in lower case;
* ``n_foreign``: letters that none of the known languages is written with.

The stop words of a text are judged where its letters may be those of a known language, and the length of its words where it is
written mostly with such letters: the words of other languages are not known, and some don't part them by blanks. A few repeated
lines are no fault in a short text.

Windows are compared by 64-bit hashes inside one text. ``base_failed`` and ``kept`` are never null. Rows are judged one
by one: repeated rows get the same verdict, an empty table gives an empty result, and only ``doc_id`` and ``text`` are
read, whatever further columns there are. There is no exchange and no Python in the plan; a very long text costs
n log n in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words, and symbols.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8

#: Letters outside the alphabets of the known languages, by ranges of scripts: Latin letters of other languages, and other scripts.
FOREIGN = r"[ÃãÅåÕõØøÐðÞþÝý\x{100}-\x{151}\x{154}-\x{177}\x{179}-\x{24F}\x{370}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}\x{F900}-\x{FDFF}\x{10000}-\x{1BFFF}\x{20000}-\x{3FFFF}]"

#: Frequent function words of English, German, French, Spanish, Italian, Portuguese, Dutch and Indonesian.
STOP_WORDS = (
    "the of and to a in is that for it as was with be by on not he are this at from or have an they which one you had"
    " der die und das von zu mit den ist des dem im nicht ein eine auf für sich auch es"
    " le la les de du et que qui dans un une est pour pas sur au par avec ce"
    " el los las en y se su con para una por es al lo como del"
    " il che di non della dei nel sono più gli anche alla ma"
    " o os as um uma não no na do da dos das em ao mais mas"
    " het een van niet zijn dat op te voor met aan ook er maar"
    " yang dan dengan untuk tidak ini itu dari pada adalah akan oleh"
).split()


class Rule(NamedTuple):
    """A text passes if ``low <= numerator / denominator <= high``, or the numerator is at most ``few``, or ``foreign`` of its
    characters or more are letters of no known language."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float
    few: int = -1
    foreign: float = 2.0


#: The method's own rules; the base rules stand in ``judged``.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0, foreign=0.5),
    Rule("symbols", "n_symbols", "word_chars", 0.0, 0.05),
    Rule("stop_words", "n_stop_words", "n_words", 0.03, 0.8, foreign=0.02),
    Rule("dup_lines", "n_dup_lines", "n_lines", 0.0, 0.3, few=2),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where lambdas inside ``use`` refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(windows: Column, width: int) -> Column:
    """How many words the windows cover whose hash occurs again, for the hashes of all windows in order."""

    def spread(sorted_: Column) -> Column:
        def again(s: Column, k: Column) -> Column:
            h = s["h"]
            return F.coalesce(F.get(sorted_, k - 1)["h"] == h, F.lit(False)) | F.coalesce(
                F.get(sorted_, k + 1)["h"] == h, F.lit(False)
            )

        return bound(F.array_sort(F.transform(F.filter(sorted_, again), lambda s: s["i"])), added)

    def added(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(bound(F.array_sort(pairs), spread))


def _of_words(words: Column) -> Column:
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.struct(
        n.alias("n_words"),
        F.when(n < WINDOW + 1, 0).otherwise(bound(hashes, lambda h: _covered(h, WINDOW))).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop_words"),
    )


def _of_lines(lines: Column) -> Column:
    n = F.size(lines)
    return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(lines))).alias("n_dup_lines"))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measures of every text, as bigints."""
    text = F.coalesce("text", F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    once = docs.select(
        "doc_id",
        bound(F.regexp_extract_all(text, F.lit(WORD), 0), _of_words).alias("w"),
        bound(full, _of_lines).alias("l"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).alias("n_symbols"),
        # ASCII texts, the usual case, are told by comparing two lengths.
        F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.regexp_count(text, F.lit(FOREIGN))).alias("n_foreign"),
    )
    names = ("w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words", "w.n_stop_words", "n_foreign")
    return once.select("doc_id", *[F.col(n).cast("long").alias(n.split(".")[-1]) for n in names])


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures, ``base_failed``, one boolean per rule and ``kept``."""
    table = measured(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    def verdict(r: Rule) -> Column:
        ratio = F.coalesce(F.try_divide(r.numerator, r.denominator).between(r.low, r.high), F.lit(False))
        return ratio | (F.col(r.numerator) <= r.few) | (F.col("n_foreign") >= r.foreign * F.greatest("word_chars", F.lit(1)))

    verdicts = [verdict(r).alias(f"ok_{r.name}") for r in rules]
    table = table.select("*", failed.alias("base_failed"), *verdicts)
    kept = ~F.col("base_failed")
    for r in rules:
        kept = kept & F.col(f"ok_{r.name}")
    return table.withColumn("kept", kept)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_foreign"
    )


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    passes = " and ".join(
        f"(coalesce({r.numerator}::double / nullif({r.denominator}, 0) between {r.low} and {r.high}, false) "
        f"or {r.numerator} <= {r.few} or n_foreign >= {r.foreign} * greatest(coalesce(word_chars, 0), 1))"
        for r in rules
    )
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
words as (select doc_id, t, regexp_extract_all(t, '{WORD}') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from d),
windows as (select doc_id, i, w[i:i + {WINDOW - 1}] as k from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from words)),
again as (select doc_id, i from windows qualify count(*) over (partition by doc_id, k) > 1),
covered as (select doc_id, count(distinct i + j) as n from again, range({WINDOW}) r(j) group by doc_id),
m as (select w.doc_id, len(w)::bigint as n_words, list_sum(list_transform(w, lambda x: length(x)))::bigint as word_chars,
  len(regexp_extract_all(t, '{SYMBOL}'))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
  len(l)::bigint as n_lines, len(list_filter(w, lambda x: lower(x) in ({stop})))::bigint as n_stop_words,
  len(regexp_extract_all(t, '{FOREIGN}'))::bigint as n_foreign
  from words w left join covered c on c.doc_id = w.doc_id)
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_foreign,
 (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
 not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and {passes} as kept
from m"""

"""Topic relevance: sentence-wise similarity with the question and with the sentence before."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions.extract import sections
from rewardloom.functions.repetition import maybe_foreign, script_class
from rewardloom.functions.text import let, runs, sentences
from rewardloom.profiles import V2, Profile

# Inverse document frequency over two texts with smoothing: 1 for a shared term, this for any other.
UNSHARED_IDF_SQ = (math.log(3 / 2) + 1) ** 2
NOT_A_TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, at least two long."""
    return F.filter(F.split(F.lower(text), NOT_A_TERM), lambda t: F.length(t) >= 2)


def majority_script(text: Column, p: Profile = V2) -> Column:
    """The script most letters belong to; on a tie the one seen first; 'Unknown' without letters."""

    def tally(script: Column) -> Column:
        pattern = F.concat(F.lit("\\p{Is"), script, F.lit("}"))
        n = F.length(text) - F.length(F.regexp_replace(text, pattern, F.lit("")))
        return F.struct(n.alias("n"), (-F.regexp_instr(text, pattern)).alias("first"), script.alias("s"))

    tallies = F.transform(F.array(*map(F.lit, p.scripts)), tally)
    best = let(F.array_max(tallies), lambda b: F.when(b["n"] > 0, b["s"]))
    latin_only = F.when(text.rlike(r"\p{IsLatin}"), "Latin")
    foreign = script_class(s for s in p.scripts if s != "Latin")
    has_foreign = maybe_foreign(text) & text.rlike(foreign)
    return F.coalesce(F.when(has_foreign, best).otherwise(latin_only), F.lit("Unknown"))


def term_vector(text: Column, p: Profile = V2) -> Column:
    """``struct<blank, script, terms, counts, sq>``: distinct terms in order, their counts, the sum of squares."""

    def counted(s: Column) -> Column:
        def vector(r: Column) -> Column:
            counts = F.transform(r, lambda x: x["size"].cast("double"))
            return F.struct(
                (text == "").alias("blank"),
                majority_script(text, p).alias("script"),
                F.transform(r, lambda x: F.get(s, x["start"])).alias("terms"),
                counts.alias("counts"),
                F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x).alias("sq"),
            )

        return let(runs(s), vector)

    return let(F.sort_array(terms(text)), counted)


def cosine(u: Column, v: Column) -> Column:
    """TF-IDF cosine of two term vectors, the frequencies being fitted on just these two texts."""

    def of_shared(shared: Column) -> Column:
        def pair(term: Column) -> Column:
            return F.struct(
                F.get(u["counts"], (F.array_position(u["terms"], term) - 1).cast("int")).alias("a"),
                F.get(v["counts"], (F.array_position(v["terms"], term) - 1).cast("int")).alias("b"),
            )

        def from_pairs(pairs: Column) -> Column:
            def total(f) -> Column:
                return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + f(x))

            def norm_sq(sq: Column, side: str) -> Column:
                return sq * UNSHARED_IDF_SQ - total(lambda x: x[side] * x[side]) * (UNSHARED_IDF_SQ - 1)

            return total(lambda x: x["a"] * x["b"]) / F.sqrt(norm_sq(u["sq"], "a") * norm_sq(v["sq"], "b"))

        return F.when(F.size(shared) == 0, 0.0).otherwise(let(F.transform(shared, pair), from_pairs))

    return let(F.array_intersect(u["terms"], v["terms"]), of_shared)


def vector_similarity(u: Column, v: Column, p: Profile = V2) -> Column:
    no_terms = (F.size(u["terms"]) == 0) & (F.size(v["terms"]) == 0)
    return (
        F.when(u["blank"] | v["blank"], 0.0)
        .when((u["script"] != v["script"]) | no_terms, p.cross_script_similarity)
        .otherwise(F.least(F.lit(1.0), cosine(u, v) * p.same_script_boost))
    )


def similarity(a: Column, b: Column, p: Profile = V2) -> Column:
    return let(term_vector(a, p), lambda u: let(term_vector(b, p), lambda v: vector_similarity(u, v, p)))


def relevance_parts(question: Column, text: Column, p: Profile = V2) -> Column:
    """``struct<thought_excess, answer_excess, post_sentences, off_topic, drifts>``, the counts behind the reward."""
    thought, answer, post = sections(text, p)

    def excess(part: Column, limit: int) -> Column:
        return F.greatest(F.length(part) - limit, F.lit(0)).cast("bigint")

    def counts(q: Column):
        def of_vectors(vs: Column) -> Column:
            # A similarity is computed once and compared there; only the number of misses leaves the row.
            off = F.filter(vs, lambda v: vector_similarity(q, v, p) < p.similarity_threshold)
            drift = F.filter(
                vs, lambda v, i: (i > 0) & (vector_similarity(F.get(vs, i - 1), v, p) < p.similarity_threshold)
            )
            return F.struct(
                F.size(off).cast("bigint").alias("off_topic"), F.size(drift).cast("bigint").alias("drifts")
            )

        return of_vectors

    def in_row(s: Column) -> Column:
        vectors = F.transform(sentences(s["thought"], p.sentence_pattern), lambda x: term_vector(x, p))
        judged = let(term_vector(question, p), lambda q: let(vectors, counts(q)))
        return let(
            judged,
            lambda j: F.struct(
                excess(s["thought"], p.max_thought_chars).alias("thought_excess"),
                excess(s["answer"], p.max_answer_chars).alias("answer_excess"),
                F.size(sentences(s["post"], p.sentence_pattern)).cast("bigint").alias("post_sentences"),
                j["off_topic"].alias("off_topic"),
                j["drifts"].alias("drifts"),
            ),
        )

    return let(F.struct(thought.alias("thought"), answer.alias("answer"), post.alias("post")), in_row)


def relevance_penalty(parts: Column, p: Profile = V2) -> Column:
    terms = [
        (parts["thought_excess"] + parts["answer_excess"]) / 100 * p.excess_per_100,
        parts["post_sentences"] * p.post_answer_sentence,
        parts["off_topic"] * p.off_topic_sentence,
        parts["drifts"] * p.topic_drift,
    ]
    return 0.0 - reduce(lambda a, b: a + b, terms)


def topic_relevance(question: Column, text: Column, p: Profile = V2) -> Column:
    return let(relevance_parts(question, text, p), lambda parts: relevance_penalty(parts, p))

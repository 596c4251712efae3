"""SQL fragments shared by the oracle statements."""

from __future__ import annotations

from rewardloom.functions.text import BLANK_CLASS, BLANKS
from rewardloom.profiles import SCRIPTS, V2


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"trim({e}, {lit(BLANKS)})"


def words(e: str) -> str:
    split = f"regexp_split_to_array({strip(e)}, {lit(f'[{BLANK_CLASS}]+')})"
    return f"(case when {strip(e)} = '' then [] else {split} end)"


def occurrences(e: str, part: str) -> str:
    return f"((length({e}) - length(replace({e}, {part}, ''))) // length({part}))"


def after_last(e: str, part: str) -> str:
    return f"string_split({e}, {part})[-1]"


def has(e: str, *parts: str) -> str:
    return "(" + " and ".join(f"contains({e}, {lit(p)})" for p in parts) + ")"


TAGS = OPEN, CLOSE, *_ = (V2.thought_open, V2.thought_close, "<answer>", "</answer>")


def tagged_answer(e: str) -> str:
    return strip(f"string_split(string_split({e}, '<answer>')[-1], '</answer>')[1]")


def answer(e: str) -> str:
    return (
        f"case when {has(e, '<answer>', '</answer>')} then {tagged_answer(e)} else coalesce("
        f"nullif(regexp_extract({e}, 'Final Answer:.*?(\\d+)', 1), ''), "
        f"nullif(regexp_extract({e}, '\\$\\\\boxed\\{{(\\d+)\\}}\\$', 1), ''), "
        f"nullif(regexp_extract({e}, '(?i)(?:\\*\\*)?(?:answer|solution)(?:\\*\\*)?:.*?(\\d+(?:\\.\\d+)?)', 1), ''), "
        f"{tagged_answer(e)}) end"
    )


def first_between(e: str, opening: str, closing: str) -> str:
    return strip(f"regexp_extract({e}, {lit(f'(?s){opening}(.*?){closing}')}, 1)")


def section(e: str, opening: str, closing: str) -> str:
    inside = f"string_split(string_split({e}, {lit(opening)})[2], {lit(closing)})[1]"
    return f"case when {has(e, opening, closing)} then {strip(inside)} else '' end"


def post_answer(e: str) -> str:
    return f"case when {has(e, '</answer>')} then {strip(f'''string_split({e}, '</answer>')[2]''')} else '' end"


def sentences(e: str) -> str:
    pieces = f"regexp_extract_all({e}, '[^.!?]+[.!?]*')"
    return f"list_filter(list_transform({pieces}, lambda s: {strip('s')}), lambda s: s <> '')"


def tag_count(e: str) -> str:
    def one(part: str) -> str:
        return f"case when {occurrences(e, part)} = 1 then "

    ro, rc, ao, ac = (
        f"concat('{OPEN}', chr(10))", f"concat(chr(10), '{CLOSE}', chr(10))",
        "concat(chr(10), '<answer>', chr(10))", "concat(chr(10), '</answer>')",
    )
    acn = "concat(chr(10), '</answer>', chr(10))"
    return (
        f"(({one(ro)} 0.125 else 0 end) + ({one(rc)} 0.125 else 0 end)"
        f" + ({one(ao)} 0.125 - length({after_last(e, acn)}) * 0.001 else 0 end)"
        f" + ({one(ac)} 0.125 - (length({after_last(e, ac)}) - 1) * 0.001 else 0 end))::double"
    )


def is_digits(e: str) -> str:
    return f"regexp_matches({e}, '^[0-9]+$')"


def number(e: str) -> str:
    return f"try_cast({strip(e)} as double)"


def terms(e: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({e}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 2)"


def majority_script(e: str) -> str:
    tallies = ", ".join(
        f"{{'n': length({e}) - length(regexp_replace({e}, '\\p{{{s}}}', '', 'g')), 's': '{s}'}}" for s in SCRIPTS
    )
    best = f"list_reverse_sort([{tallies}])[1]"
    return f"case when {best}.n > 0 then {best}.s else 'Unknown' end"


def similarity_steps(pairs: str) -> list[tuple[str, str]]:
    """Steps from ``pairs (id, a, b)`` to ``sims (id, sim)``: term counts of both texts, joined on the term."""

    def counts(side: str) -> str:
        return (
            f"select id, t, count(*)::double as n from (select id, unnest({terms(side)}) as t from pairs) "
            "group by id, t"
        )

    c = "pow(ln(1.5) + 1, 2)"
    return [
        ("pairs", pairs),
        ("ta", counts("a")),
        ("tb", counts("b")),
        ("shared", "select ta.id, sum(ta.n * tb.n) as dot, sum(ta.n * ta.n) as sa, sum(tb.n * tb.n) as sb "
                   "from ta join tb on ta.id = tb.id and ta.t = tb.t group by ta.id"),
        ("qa", "select id, sum(n * n) as q from ta group by id"),
        ("qb", "select id, sum(n * n) as q from tb group by id"),
        ("sims", "select pairs.id as id, case when a = '' or b = '' then 0.0 "
                 f"when ({majority_script('a')}) <> ({majority_script('b')}) then 0.4 "
                 "when qa.q is null and qb.q is null then 0.4 "
                 f"else least(1.0, 1.2 * coalesce(dot / sqrt((qa.q * {c} - sa * ({c} - 1)) * (qb.q * {c} - sb * ({c} - 1))), 0)) "
                 "end as sim from pairs left join shared on shared.id = pairs.id "
                 "left join qa on qa.id = pairs.id left join qb on qb.id = pairs.id"),
    ]


def statistics(value: str) -> str:
    v = f"cast({value} as double)"
    return (
        f"count({value}) as n, round(avg({v}), 6) as mean, round(median({v}), 6) as median, "
        f"round(min({v}), 6) as min, round(max({v}), 6) as max, round(stddev_pop({v}), 6) as std"
    )


def bin_index(v: str, lo: str, hi: str, bins: int | str) -> str:
    last = f"({bins} - 1)"
    raw = f"least(cast(floor(({v} - {lo}) / ({hi} - {lo}) * {bins}) as bigint), {last})"
    step = f"(({hi} - {lo}) / {bins})"
    return (
        f"({raw} - case when {v} < {lo} + {raw} * {step} then 1 else 0 end"
        f" + case when {v} >= {lo} + ({raw} + 1) * {step} and {raw} <> {last} then 1 else 0 end)"
    )

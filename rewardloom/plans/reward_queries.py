"""Queries of the rewards, one by one and together."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import answers, formats, relevance, repetition
from rewardloom.functions.extract import last_number, validation_answer
from rewardloom.functions.text import py_float
from rewardloom.operators.pairing import pair_similarities, question_sentence_pairs
from rewardloom.operators.scoring import BUILT_IN, Rewards, score, to_long, to_wide
from rewardloom.plans import sql as q
from rewardloom.plans.fixtures import Tables
from rewardloom.plans.registry import query
from rewardloom.plans.sources_queries import EVALUATED
from rewardloom.plans.text_queries import CUSTOM, KEY, output, SOLUTIONS, solution_tagged
from rewardloom.profiles import PROFILES, SCRIPTS, SOLUTION_TAGS, THINK_TAGS, V1, V2
from rewardloom.schemas import REWARDS



def reward(name: str, profile=V2):
    def run(t: Tables) -> DataFrame:
        g = t.generations
        return g.select(*KEY, F.round(BUILT_IN[name](g, profile), 6).alias("reward"))

    return run


def reward_sql(expression: str) -> str:
    return f"select run, sample_id, round(cast({expression} as double), 6) as reward from generations"


R1 = f"case when {q.answer('model_output')} = answer then 4.0 else 0 end"
R2 = f"case when {q.is_digits('(' + q.answer('model_output') + ')')} then 1.0 else 0 end"
R3 = f"case when {q.has('model_output', *q.TAGS)} then 1.0 else 0 end"
R4 = f"case when {q.has('model_output', q.OPEN, q.CLOSE)} then 0.5 else 0 end"
R5 = q.tag_count("model_output")

query("r1_correctness", reward_sql(R1))(reward("correctness"))
query("r2_integer_answer", reward_sql(R2))(reward("integer"))
query("r3_strict_format", reward_sql(R3))(reward("strict_format"))
query("r4_soft_format", reward_sql(R4))(reward("soft_format"))
query("r5_tag_count", reward_sql(R5))(reward("tag_count"))


#: The SQL of each detector's weight per ``doc_id``, with its steps inside.
WEIGHTS: dict[str, str] = {}


def nested(sql: str, steps: list[tuple[str, str]]) -> str:
    if not steps:
        return sql
    recursive = "recursive " if any(name.startswith("recursive ") for name, _ in steps) else ""
    return f"with {recursive}" + ", ".join(f"{name.removeprefix('recursive ')} as ({body})" for name, body in steps) + " " + sql


def detect(query_name: str, name: str, sql: str, steps: list[tuple[str, str]] = ()) -> None:
    """Register a detector's query over the scripted documents, and its SQL for all of them together."""
    WEIGHTS[name] = nested(sql, list(steps))
    query(query_name, sql, steps)(detector(name))


def detector(name: str, profile=V2):
    def run(t: Tables) -> DataFrame:
        return t.scripted_documents.select("doc_id", repetition.detector(name, F.col("text"), profile).alias("weight"))

    return run


def lengths(pattern: str) -> str:
    found = f"list_transform(regexp_extract_all(text, '{pattern}'), lambda m: length(m))"
    return f"select doc_id, cast(coalesce(list_sum({found}), 0) as bigint) as weight from scripted_documents"


detect("r6_1_script_runs", "consecutive_script", lengths(r"\p{Han}{10,}|\p{Arabic}{10,}|\p{Tamil}{10,}|\p{Cyrillic}{10,}"))
# A run of period p >= 2 and four units or more has six equal letters p places on at each of its first places. Places with the
# same p that follow each other are one run; at every place the shortest unit counts, and the walk goes on behind its run.
detect("r6_2_repeated_units", "pattern", """
select doc_id, cast(coalesce(any_value(w), 0) as bigint) as weight from scripted_documents left join (
  select doc_id, sum(walk.total) as w from walked group by doc_id) using (doc_id) group by doc_id""", [
    ("lines", """
select doc_id, unnest(l) as line, generate_subscripts(l, 1) as li from (
  select doc_id, string_split(text, chr(10)) as l from scripted_documents)"""),
    ("six", """
select doc_id, li, n, i, substr(line, i, 6) as g from (
  select doc_id, li, line, length(line) as n, unnest(range(1, length(line) - 4)) as i from lines where length(line) >= 8)"""),
    ("same", """
select a.doc_id, a.li, a.i, b.i - a.i as p from six a join six b
  on a.doc_id = b.doc_id and a.li = b.li and a.g = b.g and b.i >= a.i + 2 and (b.i - a.i) * 4 <= a.n"""),
    ("unit_runs", """
select doc_id, li, p, min(i) as low, max(i) + 5 as high from (
  select *, i - row_number() over (partition by doc_id, li, p order by i) as island from same)
group by doc_id, li, p, island having max(i) + 6 - min(i) >= 3 * p"""),
    ("heads", """
select doc_id, li, i, min(p) as p, arg_min(high + p, p) as last from (
  select doc_id, li, p, high, unnest(range(low, high - 3 * p + 2)) as i from unit_runs) group by doc_id, li, i"""),
    ("walked", """
select doc_id, li, list_reduce(list_prepend({'i': 0, 'p': 0, 'last': 0, 'behind': 1, 'total': 0},
    list({'i': i, 'p': p, 'last': last, 'behind': 0, 'total': 0} order by i)),
  lambda a, c: case when c.i >= a.behind then {'i': c.i, 'p': c.p, 'last': c.last,
    'behind': c.i + c.p * ((c.last - c.i + 1) // c.p), 'total': a.total + c.p} else a end) as walk
from (select doc_id, li, i::bigint as i, p::bigint as p, last::bigint as last from heads) group by doc_id, li"""),
])
detect("r6_3_punctuation", "punctuation", lengths('[.]{5,}|["][.]["]{3,}|[.]["][.]["]{2,}'))
detect("r6_4_repeated_words", "word", """
select doc_id, cast(coalesce(w, 0) as bigint) as weight from scripted_documents left join (
  select doc_id, sum(length(word) * n) as w from (
    select doc_id, word, count(*) as n from (
      select doc_id, word, row_number() over (partition by doc_id order by i)
        - row_number() over (partition by doc_id, word order by i) as island
      from words where length(word) >= 2) group by doc_id, word, island having count(*) >= 3) group by doc_id)
using (doc_id)""", [("words", f"""
select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from (
  select doc_id, {q.words('text')} as w from scripted_documents)""")])
# The longest unit that follows itself twice is taken at every letter, then the walk goes on behind its run.
detect("r6_5_glued_repetitions", "no_space_word", """
select doc_id, cast(sum(coalesce(w, 0)) as bigint) as weight from (
  select doc_id, unnest(case when len(l) > 0 then l else [''] end) as word from (
    select doc_id, """ + q.words("text") + """ as l from scripted_documents))
left join (select word, max(w) as w from walk group by word) using (word) group by doc_id""", [
    ("recursive units", f"""
select distinct word from (select unnest({q.words('text')}) as word from scripted_documents) where length(word) >= 6"""),
    ("walk(word, p, w)", """
select word, cast(1 as bigint), cast(0 as bigint) from units
union all
select word, case when unit is null then p + 1 else p + unit * times end, w + coalesce(unit * times, 0) from (
  select *, list_filter(range((length(word) - p + 1) // unit, 2, -1),
    lambda k: substr(word, p, unit * k) = repeat(substr(word, p, unit), k))[1] as times
  from (select *, list_filter(range((length(word) - p + 1) // 3, 1, -1),
      lambda n: regexp_full_match(substr(word, p, n), '[a-zA-Z]+') and substr(word, p + n, 2 * n) = repeat(substr(word, p, n), 2))[1]
      as unit from walk where p <= length(word) - 5))"""),
])
LETTERS = "".join(f"\\p{{{s}}}" for s in SCRIPTS)
FOREIGN = "".join(f"\\p{{{s}}}" for s in SCRIPTS if s != "Latin")
CODES = "segment"
for code, script in zip("0123456789:;<", SCRIPTS):
    CODES = f"regexp_replace({CODES}, '\\p{{{script}}}', '{code}', 'g')"
detect("r6_6_mixed_scripts", "mixed_script", """
select doc_id, cast(coalesce(w, 0) as bigint) as weight from scripted_documents left join (
  select doc_id, sum(length(segment) * len(c)) as w from changes
  where len(c) > 0 and not (len(c) <= 6 and len(c) / (len(c) + 1) >= 0.4
    and len([x for x in list_distinct(c) if len([y for y in c if y = x]) < 3]) = 0)
  group by doc_id) using (doc_id)""", [
    ("segments", f"""
select doc_id, segment from (select doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]{{2,}}')) as segment
  from scripted_documents where regexp_matches(text, '[{FOREIGN}]')) where regexp_matches(segment, '[{FOREIGN}]')"""),
    ("codes", f"select doc_id, segment, string_split({CODES}, '') as k from segments"),
    ("changes", "select doc_id, segment, [k[i] for i in range(2, len(k) + 1) if k[i] <> k[i - 1]] as c from codes"),
])

PHRASE_STEPS = [
    ("lists", f"select doc_id, text, {q.words('text')} as w from scripted_documents"),
    ("placed", "select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from lists"),
    ("led", """
select doc_id, word as w1, lead(word, 1) over o as w2, lead(word, 2) over o as w3, lead(word, 3) over o as w4,
  lead(word, 4) over o as w5 from placed window o as (partition by doc_id order by i)"""),
    ("grams", "\nunion all ".join(
        f"select doc_id, {n} as size, concat_ws(' ', {', '.join(f'w{i}' for i in range(1, n + 1))}) as phrase, "
        f"concat_ws(' ', right(w1, 1), {', '.join(f'w{i}' for i in range(2, n))}, left(w{n}, 1)) as key "
        f"from led where w{n} is not null" for n in (3, 4, 5))),
    ("keys", "select doc_id, size, key from grams group by all having count(*) >= 3"),
    ("candidates", """
select doc_id, phrase, count(*) as positions from grams join keys using (doc_id, size, key)
where length(phrase) <= 50 group by doc_id, phrase"""),
    ("counted", f"""
select doc_id, phrase, positions, {q.occurrences('text', 'phrase')} as n from candidates join lists using (doc_id)"""),
    ("repeated", "select * from counted where n >= 3"),
]
WHITE = " or ".join(f"regexp_matches(phrase, {q.lit(p)})" for p in V2.whitelist)

detect("r6_7_repeated_phrases", "phrase", f"""
select doc_id, cast(coalesce(w, 0) as bigint) as weight from scripted_documents left join (
  select doc_id, sum(positions * length(phrase) * n) as w from repeated where not ({WHITE}) group by doc_id)
using (doc_id)""", PHRASE_STEPS)
detect("r6_8_non_latin_repeats", "non_latin", "select doc_id, cast(0 as bigint) as weight from scripted_documents")
RUNS = "|".join(f"\\p{{{s}}}{{3,}}" for s in SCRIPTS if s != "Latin")
query("r6_8_non_latin_runs", f"""
select doc_id, cast(coalesce(list_sum(list_transform(regexp_extract_all(text, '{RUNS}'),
  lambda r: case when {q.occurrences('text', 'r')} >= 3 then {q.occurrences('text', 'r')} * length(r) else 0 end)), 0) as bigint) as weight
from scripted_documents""")(detector("non_latin", replace(V2, non_latin_runs=True)))

AUDIT = replace(V2, whitelist=(r"\b(and|the|und|et|de|die|la) ",))


@query("k8_whitelist_audit", """
select doc_id, concat(left(text, 500), case when length(text) > 500 then '...' else '' end) as excerpt, phrase, n, positions
from repeated join scripted_documents using (doc_id) where regexp_matches(phrase, '\\b(and|the|und|et|de|die|la) ')""",
       PHRASE_STEPS)
def k8(t: Tables) -> DataFrame:
    """Repeated phrases that were let pass, with the start of their text, as a side table of the repetition reward."""
    found = F.filter(repetition.repeated_phrases(F.col("text"), AUDIT), lambda c: c["whitelisted"])
    excerpt = F.concat(F.substring("text", 1, 500), F.when(F.length("text") > 500, "...").otherwise(""))
    rows = t.scripted_documents.select("doc_id", excerpt.alias("excerpt"), F.explode(found).alias("c"))
    return rows.select("doc_id", "excerpt", "c.phrase", "c.n", "c.positions")


@query("k8_whitelist_records", """
select doc_id, concat(left(any_value(text), 500), case when length(any_value(text)) > 500 then '...' else '' end) as excerpt,
  string_agg(phrase, '|' order by phrase) as phrases
from repeated join scripted_documents using (doc_id) where regexp_matches(phrase, '\\b(and|the|und|et|de|die|la) ') group by doc_id""",
       PHRASE_STEPS)
def k8_records(t: Tables) -> DataFrame:
    """One record per text: its start and all phrases that were let pass."""
    found = F.filter(repetition.repeated_phrases(F.col("text"), AUDIT), lambda c: c["whitelisted"])
    excerpt = F.concat(F.substring("text", 1, 500), F.when(F.length("text") > 500, "...").otherwise(""))
    # Taken out of an array of one, as a filter on the phrases would be pushed below them and look for them a second time.
    listed = F.array(F.sort_array(F.transform(found, lambda c: c["phrase"])))
    rows = t.scripted_documents.select("doc_id", excerpt.alias("excerpt"), F.explode(F.filter(listed, lambda l: F.size(l) > 0)).alias("l"))
    return rows.select("doc_id", "excerpt", F.array_join("l", "|").alias("phrases"))


# The detectors read generations in place of the scripted documents.
COUNT_STEPS = [
    ("scripted_documents", """
select row_number() over (order by run, sample_id) as doc_id, run, step, sample_id, model_output as text from generations"""),
    *[(f"weight_{name}", sql) for name, sql in WEIGHTS.items()],
    ("counts", "select doc_id, run, step, sample_id, text, " + ", ".join(f"weight_{n}.weight as {n}" for n, _ in V2.repetition_weights)
     + " from scripted_documents " + " ".join(f"join weight_{n} using (doc_id)" for n, _ in V2.repetition_weights)),
]
MATH = " or ".join([f"contains(text, '{q.OPEN}')", *[f"regexp_matches(text, {q.lit(p)})" for p in V2.whitelist[: V2.math_markers]]])
BEYOND = " + ".join(f"ln(greatest({name} - threshold, 0) + 1) * {weight}" for name, weight in V2.repetition_weights)
PENALTY_STEPS = [
    *COUNT_STEPS,
    ("contexts", f"""
select *, case when math then {V2.math_context.threshold} else {V2.general_context.threshold} end as threshold,
  case when math then ln({V2.math_context.log_base}) else ln({V2.general_context.log_base}) end as log_base
from (select *, {MATH} as math from counts)"""),
    ("penalties", f"""
select run, step, sample_id, greatest(cast(0 - ({BEYOND}) / log_base * {V2.repetition_scale} as double), {V2.repetition_floor}) as penalty
from contexts"""),
]
query("r6_anti_repetition", "select run, sample_id, round(penalty, 6) as reward from penalties", PENALTY_STEPS)(reward("anti_repetition"))


@query("r6_detector_counts", "select run, sample_id, " + ", ".join(n for n, _ in V2.repetition_weights) + " from counts", COUNT_STEPS)
def r6_counts(t: Tables) -> DataFrame:
    counted = t.generations.select(*KEY, repetition.detector_counts(output()).alias("c"))
    return counted.select(*KEY, "c.*")


RELEVANCE_STEPS = [
    ("parts", f"""
select row_number() over (order by run, sample_id) as id, run, sample_id, question,
  {q.section('model_output', q.OPEN, q.CLOSE)} as thought,
  {q.section('model_output', '<answer>', '</answer>')} as answer, {q.post_answer('model_output')} as post
from generations"""),
    ("s", f"""
select id, question, unnest(l) as sentence, generate_subscripts(l, 1) as pos from (
  select id, question, {q.sentences('thought')} as l from parts)"""),
    *q.similarity_steps("""
select id * 1000000 + pos * 2 as id, question as a, sentence as b from s
union all select id * 1000000 + pos * 2 + 1, lag(sentence) over (partition by id order by pos), sentence from s
  qualify pos > 1"""),
    ("misses", """
select id // 1000000 as id, count(*) filter (id % 2 = 0) as off_topic, count(*) filter (id % 2 = 1) as drifts
from sims where sim < 0.3 group by 1"""),
]


RELEVANCE = f"""cast(0 - (greatest(length(thought) - 500, 0) + greatest(length(answer) - 100, 0)) / 100 * 0.1
    - len({q.sentences('post')}) * 0.3 - coalesce(off_topic, 0) * 0.2 - coalesce(drifts, 0) * 0.5 as double)"""


@query("r7_topic_relevance", f"""
select run, sample_id, greatest(length(thought) - 500, 0) as thought_excess,
  greatest(length(answer) - 100, 0) as answer_excess, len({q.sentences('post')}) as post_sentences,
  coalesce(off_topic, 0) as off_topic, coalesce(drifts, 0) as drifts,
  round({RELEVANCE}, 6) as reward
from parts left join misses using (id)""", RELEVANCE_STEPS)
def r7(t: Tables) -> DataFrame:
    g = t.generations.withColumn("p", relevance.relevance_parts(F.col("question"), output()))
    return g.select(*KEY, "p.*", F.round(relevance.relevance_penalty(F.col("p")), 6).alias("reward"))


@query("r8_text_similarity", "select pairs.sample_id, round(sim, 6) as similarity from sims join pairs using (id)",
       q.similarity_steps("select sample_id as id, sample_id, question as a, body as b from turns"))
def r8(t: Tables) -> DataFrame:
    sim = relevance.similarity(F.col("question"), F.col("body"))
    return t.turns.select("sample_id", F.round(sim, 6).alias("similarity"))


M, TG = q.strip("model_answer"), q.strip("target")
CLOSE = "abs({a} - {b}) <= 1e-5 * greatest(abs({a}), abs({b}))"
SAME = f"lower({M}) = lower({TG})"


def _num(e: str) -> str:
    return f"try_cast({e} as double)"


def _bool(e: str) -> str:
    return (f"(case when lower({e}) in ('true', 'yes', '1') then true "
            f"when lower({e}) in ('false', 'no', '0') then false end)")


def _frac(e: str) -> str:
    split = f"string_split({e}, '/')"
    return f"(case when contains({e}, '/') then {_num(split + '[1]')} / {_num(split + '[2]')} else {_num(e)} end)"


def _pct(e: str) -> str:
    return f"({_num('replace(' + e + chr(44) + chr(39) + '%' + chr(39) + chr(44) + chr(39) * 2 + ')')} / 100)"


VERIFIED = f"""case when {M} = '' then false
 when answer_type = 'Float' then {CLOSE.format(a=_num(M), b=_num(TG))}
 when answer_type = 'Integer' then trunc({_num(M)}) = trunc({_num(TG)})
 when answer_type = 'Boolean' then {_bool(M)} = {_bool(TG)}
 when answer_type = 'Percentage' then {CLOSE.format(a=_pct(M), b=_pct(TG))}
 when answer_type = 'Fraction' then coalesce({CLOSE.format(a=_frac(M), b=_frac(TG))}, false) or {SAME}
 when answer_type = 'List' then try_cast(try_cast({M} as json) as double[]) = try_cast(try_cast({TG} as json) as double[])
 when answer_type = 'Matrix' then try_cast(try_cast({M} as json) as double[][]) = try_cast(try_cast({TG} as json) as double[][])
 else {SAME} end"""
TYPED = f"select sample_id, answer_type, category, case when coalesce({VERIFIED}, false) then 1.0 else 0 end::double as reward from typed_answers"


def verified(t: Tables) -> DataFrame:
    reward = answers.verified(F.col("model_answer"), F.col("target"), F.col("answer_type"))
    return t.typed_answers.select("sample_id", "answer_type", "category", reward.alias("reward"))


query("r9_typed_verification", TYPED)(verified)
for number, kinds in (
    ("r9_1_numbers", ("Float", "Integer")), ("r9_2_booleans", ("Boolean",)), ("r9_3_percentages", ("Percentage",)),
    ("r9_4_fractions", ("Fraction",)), ("r9_5_lists", ("List", "Matrix")),
    ("r9_6_texts", ("Multiple Choice", "Expression", "Unmapped")),
):
    listed = ", ".join(f"'{k}'" for k in kinds)
    query(number, f"select sample_id, reward from ({TYPED}) where answer_type in ({listed})")(
        lambda t, kinds=kinds: verified(t).where(F.col("answer_type").isin(*kinds)).select("sample_id", "reward")
    )


def solution_reward(name: str):
    def run(t: Tables) -> DataFrame:
        g = solution_tagged(t)
        return g.select(*KEY, BUILT_IN[name](g, SOLUTION_TAGS).alias("reward"))

    return run


def solution_sql(expression: str) -> str:
    return f"select run, sample_id, cast({expression} as double) as reward from solutions"


S = [("solutions", SOLUTIONS)]
GUESS = f"(case when regexp_matches(o, '{CUSTOM}') then regexp_extract(o, '{CUSTOM}', 1) end)"
RATIO = f"({q.number(GUESS)} / nullif({q.number('answer')}, 0))"
query("r10_exact_format", solution_sql(f"case when regexp_matches(o, '{CUSTOM}') then 3.0 else 0 end"), S)(
    solution_reward("exact_format"))
query("r11_approximate_format", solution_sql(" + ".join(
    f"(case when {q.occurrences('o', q.lit(tag))} = 1 then 0.5 else -0.5 end)" for tag in SOLUTION_TAGS.tags)), S)(
    solution_reward("approximate_format"))
query("r12_graded_answer", solution_sql(f"""
case when {GUESS} is null then 0 when {GUESS} = answer then 3.0 when {q.strip(GUESS)} = {q.strip('answer')} then 1.5
  when {RATIO} is null then -0.5 when {RATIO} between 0.9 and 1.1 then 0.5 when {RATIO} between 0.8 and 1.2 then 0.25
  else -1.0 end"""), S)(solution_reward("graded_answer"))
query("r13_numeric_equality", solution_sql("""
case when try_cast(nullif(regexp_extract(o, '(?s)<SOLUTION>.*?([\\d.]+)', 1), '') as double) = try_cast(answer as double)
  then 1.5 else 0 end"""), S)(solution_reward("numeric_answer"))


@query("r14_first_generation_profile", f"""
select run, sample_id,
  cast(case when {q.tagged_answer('model_output')} = answer then 2.0 else 0 end as double) as correctness,
  cast(case when {q.is_digits(q.tagged_answer('model_output'))} then 0.5 else 0 end as double) as integer,
  cast(case when regexp_matches(model_output, '^{q.OPEN}\\n.*?\\n{q.CLOSE}\\n<answer>\\n.*?\\n</answer>\\n$')
    then 0.5 else 0 end as double) as strict_format,
  cast(case when regexp_matches(model_output, '^{q.OPEN}.*?{q.CLOSE}\\s*<answer>.*?</answer>')
    then 0.5 else 0 end as double) as soft_format,
  round({R5}, 6) as tag_count
from generations""")
def r14(t: Tables) -> DataFrame:
    names = ("correctness", "integer", "strict_format", "soft_format", "tag_count")
    scored = score(t.generations, Rewards(names), V1)
    return scored.select(*KEY, *names[:-1], F.round("tag_count", 6).alias("tag_count"))


ALL_STEPS = [
    *PENALTY_STEPS, *RELEVANCE_STEPS,
    ("relevances", f"select run, sample_id, {RELEVANCE} as relevance from parts left join misses using (id)"),
    ("scored", f"""
select run, step, sample_id, cast({R1} as double) as correctness, cast({R2} as double) as integer, cast({R3} as double) as strict_format,
  cast({R4} as double) as soft_format, {R5} as tag_count, penalty as anti_repetition, relevance as topic_relevance
from generations join penalties using (run, step, sample_id) join relevances using (run, sample_id)"""),
    ("totals", f"select *, {' + '.join(REWARDS)} as total_reward from scored"),
]


@query("r15_total_reward", "select run, sample_id, " + ", ".join(f"round({n}, 6) as {n}" for n in (*REWARDS, "total_reward")) + " from totals",
       ALL_STEPS)
def r15(t: Tables) -> DataFrame:
    scored = score(t.generations)
    return scored.select(*KEY, *[F.round(n, 6).alias(n) for n in (*REWARDS, "total_reward")])


@query("r15_total_of_plain_rewards", f"""
select run, sample_id, round({R1} + {R2} + {R3} + {R4} + {R5}, 6) as total_reward from generations""")
def r15_plain(t: Tables) -> DataFrame:
    scored = score(t.generations, Rewards(REWARDS[:5]))
    return scored.select(*KEY, F.round("total_reward", 6).alias("total_reward"))


VALIDATED = f"""
select run, sample_id, lower({q.strip(f'''case when regexp_matches(model_output, '(?s)<answer>(.*?)</answer>')
  then {q.first_between('model_output', '<answer>', '</answer>')} else model_output end''')}) = lower({q.strip('answer')})
  as is_correct from generations"""


@query("r16_validation_correctness", VALIDATED)
def r16(t: Tables) -> DataFrame:
    return t.generations.select(
        *KEY, answers.matches_expected(validation_answer(output()), F.col("answer")).alias("is_correct")
    )


@query("r17_numeric_correctness", "select run, sample_id, predicted_answer, is_correct from evaluated",
       [("evaluated", EVALUATED)])
def r17(t: Tables) -> DataFrame:
    rows = t.generations.withColumn("predicted_answer", last_number(output()))
    return rows.select(
        *KEY, "predicted_answer",
        answers.near(F.col("predicted_answer"), py_float(F.col("answer"))).alias("is_correct"),
    )


@query("r18_result_check", f"""
select sample_id, is_valid, case when is_valid then '' else 'Answer mismatch' end as errors from (
  select sample_id, coalesce(case when {q.number('model_answer')} is not null and {q.number('target')} is not null
    then abs({q.number('model_answer')} - {q.number('target')}) < 1e-6
    else {q.strip('model_answer')} = {q.strip('target')} end, false) as is_valid from typed_answers)""")
def r18(t: Tables) -> DataFrame:
    check = answers.result_check(F.col("model_answer"), F.col("target"))
    return t.typed_answers.select("sample_id", check.alias("c")).select(
        "sample_id", "c.is_valid", F.array_join("c.errors", ";").alias("errors")
    )


THINK = f"replace(replace(model_output, '{q.OPEN}', '<think>'), '{q.CLOSE}', '</think>')"


@query("r19_other_tag_names", f"""
select run, sample_id, cast({R3} as double) as strict_format, cast({R4} as double) as soft_format,
  round({R5}, 6) as tag_count from generations""")
def r19(t: Tables) -> DataFrame:
    g = t.generations.withColumn("model_output", F.expr(THINK))
    return g.select(
        *KEY, formats.strict_format(output(), THINK_TAGS).alias("strict_format"),
        formats.soft_format(output(), THINK_TAGS).alias("soft_format"),
        F.round(formats.tag_count(output(), THINK_TAGS), 6).alias("tag_count"),
    )


@query("e1_custom_reward", f"""
select run, sample_id, round(cast({R1} as double) + length(question) * cast(0.001 as double), 6) as total_reward
from generations""")
def e1(t: Tables) -> DataFrame:
    """A reward of the user's own, as an expression of the columns it names."""
    rewards = Rewards(("correctness",)).register("length_bonus", lambda df, p: F.length("question") * 0.001)
    scored = score(t.generations, rewards)
    return scored.select(*KEY, F.round("total_reward", 6).alias("total_reward"))


@query("e1_reward_table", f"""
select run, sample_id, round(length(question) * cast(0.001 as double), 6) as length_bonus,
  round(length(translate(lower(question), 'bcdfghjklmnpqrstvwxyz', '')) / greatest(length(question), 1), 6) as open_letters,
  round(cast({R1} as double) + length(question) * cast(0.001 as double)
    + length(translate(lower(question), 'bcdfghjklmnpqrstvwxyz', '')) / greatest(length(question), 1), 6) as total_reward
from generations""")
def e1_table(t: Tables) -> DataFrame:
    """Two rewards of the user's own from one pass of a table function over the questions."""

    @F.udtf(returnType="length_bonus double, open_letters double")
    class Letters:
        def eval(self, question: str):
            other = sum(c not in "bcdfghjklmnpqrstvwxyz" for c in question.lower())
            yield len(question) * 0.001, other / max(len(question), 1)

    names = ("length_bonus", "open_letters")
    rewards = Rewards(("correctness",)).register_table(names, Letters, ("question",))
    return score(t.generations, rewards).select(*KEY, *[F.round(n, 6).alias(n) for n in (*names, "total_reward")])


LONG = f"""
select run, step, sample_id, 'correctness' as reward_name, cast({R1} as double) as value from generations
union all select run, step, sample_id, 'integer', cast({R2} as double) from generations
union all select run, step, sample_id, 'strict_format', cast({R3} as double) from generations
union all select run, step, sample_id, 'soft_format', cast({R4} as double) from generations
union all select run, step, sample_id, 'tag_count', {R5} from generations"""
PLAIN = REWARDS[:5]


def long_rewards(t: Tables) -> DataFrame:
    """The five rewards that SQL can restate, one row per value."""
    return to_long(score(t.generations, Rewards(PLAIN)), PLAIN)


@query("e2_long_rewards", "select run, step, sample_id, reward_name, round(value, 6) as value from long",
       [("long", LONG)])
def e2(t: Tables) -> DataFrame:
    return long_rewards(t).withColumn("value", F.round("value", 6))


@query("e5_profiles", f"""
select 'v2' as profile, run, sample_id, cast({R1} as double) as correctness from generations
union all select 'v1', run, sample_id, cast(case when {q.tagged_answer('model_output')} = answer then 2.0 else 0 end as double)
from generations""")
def e5(t: Tables) -> DataFrame:
    g = t.generations
    parts = [
        g.select(F.lit(n).alias("profile"), *KEY, BUILT_IN["correctness"](g, PROFILES[n]).alias("correctness"))
        for n in ("v2", "v1")
    ]
    return parts[0].unionByName(parts[1])


@query("a9_rewards_long_and_wide", f"""
select run, step, sample_id, cast({R1} as double) as correctness, cast({R2} as double) as integer,
  cast({R3} as double) as strict_format, cast({R4} as double) as soft_format, round({R5}, 6) as tag_count
from generations""")
def a9(t: Tables) -> DataFrame:
    return to_wide(long_rewards(t), PLAIN).withColumn("tag_count", F.round("tag_count", 6))


@query("j5_sentences_with_question", """
select sample_id, pos - 1 as pos, question, sentence, lag(sentence) over (partition by id order by pos) as previous,
  round(qs.sim, 6) as to_question, round(ps.sim, 6) as to_previous
from s join (select id, sample_id from base) using (id) left join sims qs on qs.id = s.id * 1000000 + pos * 2
left join sims ps on ps.id = s.id * 1000000 + pos * 2 + 1""", [
    ("base", "select row_number() over (order by sample_id) as id, sample_id, question, body from turns"),
    ("s", f"""select id, question, unnest(l) as sentence, generate_subscripts(l, 1) as pos from (
      select id, question, {q.sentences('body')} as l from base)"""),
    *RELEVANCE_STEPS[2:-1],
])
def j5(t: Tables) -> DataFrame:
    pairs = pair_similarities(question_sentence_pairs(t.turns, "question", "body", "sample_id"))
    return pairs.withColumns({c: F.round(c, 6) for c in ("to_question", "to_previous")})


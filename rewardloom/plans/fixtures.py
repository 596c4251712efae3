"""The driver tables and the three tables derived from them, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom import session
from rewardloom.profiles import V2


# A sample is named by its conversation and turn in one number; no conversation has that many turns.
TURNS_MOST = 1_000_000_000


class Tables:
    """Tables of one scale, read lazily; a query touches only what it names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return session.scan(self.spark, f"{self.sf_dir}/{name}.parquet")

    def work(self, name: str) -> str:
        return session.work_dir(self.spark, name)

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @cached_property
    def scripted_documents(self) -> DataFrame:
        """``doc_id, text``: the documents, some with words of other scripts, dots, quotes and glued repetitions."""
        return self.spark.sql(SCRIPTED.replace("from documents", "from {documents}"), documents=self.documents)

    @cached_property
    def conversations(self) -> DataFrame:
        return self.read("conversations")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def turns(self) -> DataFrame:
        """User turns with the assistant's reply: ``sample_id, conv_id, turn, question, body, truth, b``."""
        c = self.conversations
        user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
        reply = c.where("role = 'assistant'").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("body")
        )
        return user.join(reply, ["conv_id", "turn"]).select(
            (F.col("conv_id") * TURNS_MOST + F.col("turn")).alias("sample_id"),
            "conv_id",
            "turn",
            "question",
            "body",
            F.pmod(F.col("conv_id") * 7 + F.col("turn") * 13, F.lit(100)).cast("string").alias("truth"),
            F.pmod(F.col("conv_id") + F.col("turn"), F.lit(10)).alias("b"),
        )

    @cached_property
    def generations(self) -> DataFrame:
        """``run, sample_id, group_id, step, question, answer, model_output`` of the runs base and tuned."""
        both = self.turns.withColumn("run", F.explode(F.array(F.lit("base"), F.lit("tuned"))))
        v = F.when((F.col("run") == "tuned") & F.col("b").isin(4, 5), 0).otherwise(F.col("b"))

        def tagged(answer: str):
            return F.format_string(
                f"{V2.thought_open}\n%s\n{V2.thought_close}\n<answer>\n{answer}\n</answer>\n", "body", "truth"
            )

        output = (
            F.when(v == 4, F.col("body"))
            .when(v == 5, tagged("%s1"))
            .when(v == 6, F.format_string("<answer>%s</answer>", "truth"))
            .when(v == 7, F.format_string("%s\nFinal Answer: it is %s", "body", "truth"))
            .when(v == 8, F.format_string("%s $\\boxed{%s}$", "body", "truth"))
            .when(v == 9, F.format_string(f"{V2.thought_open}%s{V2.thought_close} <answer>%s</answer> %1$s", "body", "truth"))
            .otherwise(tagged("%s"))
        )
        return both.select(
            "run",
            "sample_id",
            F.col("conv_id").alias("group_id"),
            F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(20)).alias("step"),
            "question",
            F.col("truth").alias("answer"),
            output.alias("model_output"),
        )

    @cached_property
    def typed_answers(self) -> DataFrame:
        """``sample_id, answer_type, category, target, model_answer``, one row per order."""
        return self.spark.sql(
            TYPED_ANSWERS.replace("from orders", "from {orders}"), orders=self.read("orders")
        )

    @cached_property
    def metric_log(self) -> DataFrame:
        """``metric, step, value, ts, sample_group``, one row per event."""
        return self.spark.sql(METRIC_LOG.replace("from events", "from {events}"), events=self.events)


TURNS = f"""
select u.conv_id*{TURNS_MOST}+u.turn as sample_id, u.conv_id, u.turn, u.text as question, a.text as body,
  cast((u.conv_id*7+u.turn*13)%100 as varchar) as truth, (u.conv_id+u.turn)%10 as b
from conversations u join conversations a on a.conv_id=u.conv_id and a.turn=u.turn+1
where u.role='user' and a.role='assistant'
"""

GENERATIONS = f"""
select run, sample_id, conv_id as group_id, (conv_id*3+turn)%20 as step, question, truth as answer,
 case v
 when 4 then body
 when 5 then concat('{V2.thought_open}',chr(10),body,chr(10),'{V2.thought_close}',chr(10),'<answer>',chr(10),truth,'1',chr(10),'</answer>',chr(10))
 when 6 then concat('<answer>',truth,'</answer>')
 when 7 then concat(body,chr(10),'Final Answer: it is ',truth)
 when 8 then concat(body,' $',chr(92),'boxed{{',truth,'}}$')
 when 9 then concat('{V2.thought_open}',body,'{V2.thought_close} <answer>',truth,'</answer> ',body)
 else concat('{V2.thought_open}',chr(10),body,chr(10),'{V2.thought_close}',chr(10),'<answer>',chr(10),truth,chr(10),'</answer>',chr(10)) end as model_output
from (select 'base' as run, turns.*, b as v from turns
      union all select 'tuned' as run, turns.*, case when b in (4,5) then 0 else b end as v from turns)
"""

TYPED_ANSWERS = """
select o_orderkey as sample_id,
 case o_orderkey%10 when 0 then 'Float' when 1 then 'Integer' when 2 then 'Boolean' when 3 then 'Percentage' when 4 then 'Fraction'
  when 5 then 'List' when 6 then 'Matrix' when 7 then 'Multiple Choice' when 8 then 'Expression' else 'Unmapped' end as answer_type,
 case o_orderkey%5 when 0 then 'cat_a' when 1 then 'cat_b' else 'cat_c' end as category,
 case o_orderkey%10 when 0 then concat(cast(o_orderkey as varchar(20)),'.5') when 1 then cast(o_orderkey as varchar(20))
  when 2 then 'True' when 3 then concat(cast(o_orderkey%100 as varchar(20)),'%') when 4 then concat(cast(1+o_orderkey%7 as varchar(20)),'/4')
  when 5 then concat('[1, ',cast(o_orderkey%9 as varchar(20)),']') when 6 then concat('[[1, 2], [3, ',cast(o_orderkey%9 as varchar(20)),']]')
  when 7 then 'B' when 8 then 'x+1' else o_orderpriority end as target,
 case when o_orderkey%3=0 then '' when o_orderkey%3=1 then
  case o_orderkey%10 when 0 then concat(' ',cast(o_orderkey as varchar(20)),'.50 ') when 1 then concat(cast(o_orderkey as varchar(20)),'.9')
  when 2 then 'yes' when 3 then concat(cast(o_orderkey%100 as varchar(20)),'.0') when 4 then concat(cast(2*(1+o_orderkey%7) as varchar(20)),'/8')
  when 5 then concat('[1.0,',cast(o_orderkey%9 as varchar(20)),']') when 6 then concat('[[1,2],[3,',cast(o_orderkey%9 as varchar(20)),']]')
  when 7 then ' b ' when 8 then 'X+1' else lower(o_orderpriority) end
 else 'wrong' end as model_answer
from orders
"""

SCRIPTED = """
select doc_id, case doc_id % 10
 when 0 then concat(text, ' ', repeat('漢', cast(9 + doc_id % 7 as int)))
 when 1 then concat(text, ' ', repeat('привет', 3), ' ', repeat('привет', 3), ' ', repeat('привет', 3))
 when 2 then concat(text, ' wait', repeat('.', cast(4 + doc_id % 4 as int)), ' ".', repeat('"', 4), ' ')
 when 3 then concat('abcабвabcабвabcабвabcабв ', text, ' abcдеж')
 when 4 then concat(text, ' مرحبامرحبا', repeat('漢字', 6))
 when 5 then concat(repeat('да', 6), ' ', repeat('да', 6), ' ', repeat('да', 6), ' ', text)
 when 6 then concat('go go go ', repeat('ha', cast(2 + doc_id % 5 as int)), ' abABabABabAB ', text)
 else text end as text from documents
"""

METRIC_LOG = "select event_type as metric, event_id as step, value, ts, user_id as sample_group from events"

_CTES = {
    "turns": TURNS, "generations": GENERATIONS, "typed_answers": TYPED_ANSWERS, "metric_log": METRIC_LOG,
    "scripted_documents": SCRIPTED,
}


def with_tables(sql: str, *extra: tuple[str, str]) -> str:
    """Put the derived tables a statement names (and ``extra`` steps) in front of it as common table expressions."""
    needed, text, own = [], sql + " ".join(body for _, body in extra), {name for name, _ in extra}
    for name in ("generations", "turns", "typed_answers", "metric_log", "scripted_documents"):
        if name in text and name not in own:
            needed.insert(0, (name, _CTES[name]))
            text += _CTES[name]
    steps = [*needed, *extra]
    if not steps:
        return sql
    recursive = "recursive " if any(name.startswith("recursive ") for name, _ in steps) else ""
    parts = [f"{name.removeprefix('recursive ')} as ({body})" for name, body in steps]
    return f"with {recursive}" + ", ".join(parts) + " " + sql

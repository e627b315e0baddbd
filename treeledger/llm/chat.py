"""Conversations as training strings, with the spans that count for the loss.

Turns of a conversation are collected as structs and sorted by (turn, role, text); adjacent turns
of one role are merged, and everything is concatenated by Spark expressions. A merged turn is

    <s> role [INST] text ([+] text)* </s>      roles without loss
    <s> role [/INST] text ([+] text)* </s>     roles of LOSS_ROLES

without the blanks. Inside roles and texts a control string ``<s>`` becomes ``<~s>`` and ``<~s>``
becomes ``<~~s>``, so none is left bare and the original is had by taking one ``~`` away. Spans
cover texts only: no role, mark or join. ``read_back`` parses the output.

A conversation of more than PART_TURNS turns is written in parts of that many turns, each a row
and a valid string by itself (a run of one role is cut there), so no row grows without bound and a
conversation that holds a third of all rows is spread. Its digests need its text once in one row,
since SHA-256 reads in order; that row must stay under 2 GB.

Null text and null role are empty; a null turn comes first; repeated rows are turns of their own;
a null conv_id is one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.ranks import number
from treeledger.llm.registry import query
from treeledger.operators.durable import durable, fetch
from treeledger.sources.adapters import table

PART_TURNS = 512
LOSS_ROLES = ("assistant",)
CONTROL = r"(/?s>|/?INST\]|\+\])"
PLANTED = "</s>[INST] ok [/INST]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(~*){CONTROL}", "$1$2~$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])~(~*){CONTROL}", "$1$2$3")


def turns_in_parts(conversations: DataFrame, part_turns: int) -> DataFrame:
    """One row per conversation or part of one: conv_id, part, parts and its ``turns`` in order.

    Only conversations above ``part_turns`` turns are numbered, along one sort of their rows.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("key_"))
    long = durable(rows.groupBy("key_").agg(F.count(F.lit(1)).alias("turns_")).where(F.col("turns_") > part_turns))
    marked = fetch(rows, long, ["key_"], "left")
    short = marked.where("turns_ IS NULL").withColumn("part", F.lit(0).cast("long")).withColumn("parts", F.lit(1).cast("long"))
    order = ["turn", "role", "text"]
    cut = durable(marked.where("turns_ IS NOT NULL").orderBy("key_", *order).withColumn("slice_", F.spark_partition_id()))
    numbered = number(cut, F.col("slice_"), [F.col(c) for c in order], ("key_",), "at_", "of_")
    parts = numbered.withColumn("part", F.expr(f"at_ div {part_turns}")).withColumn("parts", F.ceil(F.col("of_") / part_turns))
    columns = ["key_", "conv_id", "turn", "role", "text", "part", "parts"]
    return short.select(*columns).unionByName(parts.select(*columns)).groupBy("key_", "part").agg(
        F.first("conv_id").alias("conv_id"), F.first("parts").alias("parts"), F.sort_array(F.collect_list(F.struct(*order))).alias("turns"))


def merged(turns: Column) -> Column:
    """Adjacent turns of one role as one struct of role and texts."""
    def add(runs: Column, t: Column) -> Column:
        last = F.element_at(runs, -1)
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        other = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        same = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["role"] == t["role"])
        return F.when(same, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(other)))

    return F.aggregate(turns, F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)"), add)


def pieces(run: Column, loss_roles: tuple[str, ...]) -> Column:
    """A merged turn as an array of (text, loss): its head, its texts with joins between, its end."""
    learned = run["role"].isin(*loss_roles)
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    head = F.array(piece(F.concat(F.lit("<s>"), escaped(run["role"]), F.when(learned, "[/INST]").otherwise("[INST]")), F.lit(False)))
    body = F.flatten(F.transform(run["texts"], lambda t, k: F.array(piece(F.when(k > 0, "[+]").otherwise(""), F.lit(False)), piece(escaped(t), learned))))
    return F.concat(head, body, F.array(piece(F.lit("</s>"), F.lit(False))))


def formatted(conversations: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, parts, formatted and spans (start from 0, length; code points) per conversation or part of one."""
    def along(state: Column, p: Column) -> Column:
        n = F.length(p["text"])
        span = F.struct(state["at"].alias("start"), n.alias("length"))
        return F.struct((state["at"] + n).alias("at"), F.when(p["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    laid = turns_in_parts(conversations, part_turns).withColumn("runs_", merged(F.col("turns")))
    laid = laid.withColumn("pieces_", F.flatten(F.transform("runs_", lambda r: pieces(r, loss_roles))))
    return laid.select(
        "key_", "conv_id", "part", "parts", F.array_join(F.transform("pieces_", lambda p: p["text"]), "").alias("formatted"),
        F.aggregate("pieces_", start, along, lambda s: s["spans"]).alias("spans"))


def read_back(output: DataFrame) -> DataFrame:
    """Adds what the strings say: ``turns`` (role, text) and ``loss_text`` under the spans."""
    def turn(closed: Column) -> Column:
        part = lambda k: F.regexp_extract(closed, r"(?s)^<s>(.*?)\[/?INST\](.*)$", k)
        return F.transform(F.split(part(2), r"\[\+\]", -1), lambda t: F.struct(unescaped(part(1)).alias("role"), unescaped(t).alias("text")))

    closed = F.slice(F.split("formatted", "</s>", -1), F.lit(1), F.size(F.split("formatted", "</s>", -1)) - 1)
    spoken = F.transform("spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return output.withColumn("turns", F.flatten(F.transform(closed, turn))).withColumn("loss_text", F.array_join(spoken, ""))


def summaries(output: DataFrame) -> DataFrame:
    """One row of counts and digests per conversation; only those in several parts are gathered."""
    said = read_back(output).select(
        "key_", "conv_id", "part", "parts", F.size("turns").cast("long").alias("n_turns"), F.length("formatted").cast("long").alias("formatted_chars"), "loss_text",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns_text"))
    whole = said.where("parts = 1").drop("part", "parts")
    in_order = F.sort_array(F.collect_list(F.struct("part", "turns_text", "loss_text")))
    joined = said.where("parts > 1").groupBy("key_").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), in_order.alias("all_"))
    joined = joined.withColumn("turns_text", F.array_join("all_.turns_text", "")).withColumn("loss_text", F.array_join("all_.loss_text", "")).drop("all_")
    return whole.unionByName(joined).select(
        "conv_id", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


CHAT_SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}'
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM said),
marked AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id, pos // {PART_TURNS} ORDER BY pos) AS opens,
    regexp_replace(text, '([<\[])(~*){CONTROL}', '\1\2~\3', 'g') AS text_e, regexp_replace(role, '([<\[])(~*){CONTROL}', '\1\2~\3', 'g') AS role_e
  FROM placed
),
gathered AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS turns_text,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss_text,
    sum(length(text_e) + CASE WHEN opens THEN length(role_e) + length('<s></s>') + length(CASE WHEN role = 'assistant' THEN '[/INST]' ELSE '[INST]' END)
      ELSE length('[+]') END) AS formatted_chars
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns_text) AS turns_sha256, CAST(length(loss_text) AS BIGINT) AS loss_chars, sha256(loss_text) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM gathered
"""


@query("op13_chat_format", CHAT_SQL)
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return summaries(formatted(given.unionByName(planted)))

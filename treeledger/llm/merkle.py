"""Document fingerprints that locate edits: a Merkle tree over sentences, paragraphs and sections.

A paragraph is a line, its leaves are its sentences (cut after ``. ! ?`` and a space, the
space kept). A leaf is 16 hex digits of SHA-256 and its length; a paragraph digests its
leaves; a section ends at a paragraph whose digest ends in 0-3, so an edit moves no later
border; the root digests the sections. Equal roots mean equal texts. Two trees are alike
by the characters under the distinct leaves they share (2 shared / both), and
``changed_sections`` names the branches of one that the other lacks.

DataFrame functions only. Null text is the empty text (one empty leaf); very long texts
stay one row; repeated rows give equal trees; an empty table gives no rows; extra columns
are dropped. Rows with equal doc_id are ordered by text, a null doc_id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeledger.llm.registry import query
from treeledger.sources.adapters import table

MAX_SLICES = 32_768
MARK = "\x1f"


def short(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def leaves(text: Column) -> Column:
    """Paragraphs of leaf tokens ``digest:length``."""
    def token(leaf):
        return F.concat(short(leaf), F.lit(":"), F.length(leaf).cast("string"))

    return F.transform(F.split(text, "\n"), lambda p: F.transform(F.split(F.regexp_replace(p, r"([.!?]) ", f"$1 {MARK}"), MARK), token))


def paragraphs(leaf_lists: Column) -> Column:
    return F.transform(leaf_lists, lambda tokens: short(F.array_join(tokens, ",")))


def sections(paragraph_digests: Column) -> Column:
    """Section digests; borders depend on the paragraph before them only."""
    chain = F.array_join(F.transform(
        paragraph_digests, lambda p: F.concat(p, F.when(F.substring(p, 16, 1).isin("0", "1", "2", "3"), ";").otherwise(","))), "")
    return F.transform(F.split(F.regexp_replace(chain, "[;,]$", ""), ";"), short)


def root(section_digests: Column) -> Column:
    return F.sha2(F.array_join(section_digests, ","), 256)


def add_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Columns ``<prefix>leaves``, ``paragraphs``, ``sections``, ``root`` for one text column."""
    df = df.withColumn(f"{prefix}leaves", leaves(F.col(text)))
    df = df.withColumn(f"{prefix}paragraphs", paragraphs(F.col(f"{prefix}leaves")))
    df = df.withColumn(f"{prefix}sections", sections(F.col(f"{prefix}paragraphs")))
    return df.withColumn(f"{prefix}root", root(F.col(f"{prefix}sections")))


def encoded(prefix: str) -> Column:
    """The whole tree as text: root/sections/paragraphs/leaves by paragraph."""
    return F.concat_ws(
        "/", f"{prefix}root", F.array_join(f"{prefix}sections", ","), F.array_join(f"{prefix}paragraphs", ","),
        F.array_join(F.transform(f"{prefix}leaves", lambda tokens: F.array_join(tokens, ",")), ";"),
    )


def weight(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, t: acc + F.substring(t, 18, 20).cast("long"))


def likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """1 for equal roots, else the share of characters under leaves both trees hold."""
    left, right = F.array_distinct(F.flatten(f"{a}leaves")), F.array_distinct(F.flatten(f"{b}leaves"))
    df = df.withColumn("left_", left).withColumn("right_", right)
    df = df.withColumn("shared_", 2 * weight(F.array_intersect("left_", "right_"))).withColumn("both_", weight(F.col("left_")) + weight(F.col("right_")))
    ratio = F.when(F.col(f"{a}root") == F.col(f"{b}root"), 1.0).when(F.col("both_") == 0, 0.0).otherwise(F.col("shared_") / F.col("both_"))
    return df.withColumn(out, ratio).drop("left_", "right_", "shared_", "both_")


def changed_sections(a: str, b: str) -> Column:
    """Sections of tree ``a`` that tree ``b`` lacks: where the texts differ."""
    return F.array_except(f"{a}sections", f"{b}sections")


def slice_of(key: Column, borders: list[int]) -> Column:
    """How many borders are at or below the key, by bisection."""
    if not borders:
        return F.lit(0)
    known, rounds = F.array(*map(F.lit, borders)), len(borders).bit_length()

    def halve(acc, _):
        mid = F.expr("1") * 0 + F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_, below = acc["lo"] < acc["hi"], F.element_at(known, F.least(mid + 1, F.lit(len(borders)))) <= key
        return F.struct(
            F.when(open_ & below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(borders)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda acc: acc["lo"])


def with_next_text(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``next_text``: the text of the next document by ascending doc_id, after the last the first.

    Rows are dealt by doc_id quantiles and shuffled once. The first document of each slice
    is also dealt to the slice before it, as the follower of that slice's last document.
    """
    lowest = F.lit(-(2**63)).cast("long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), lowest).alias("order_"))
    slices = min(MAX_SLICES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = F.array(*(F.lit(i / slices) for i in range(1, slices)))
    found = rows.agg(F.percentile_approx("order_", shares, F.lit(4 * slices)).alias("q")).first().q
    sliced = rows.withColumn("slice_", slice_of(F.col("order_"), sorted(set(found or []))))
    firsts = sorted((r.slice_, r.order_) for r in sliced.groupBy("slice_").agg(F.min("order_").alias("order_")).collect())
    if not firsts:
        return rows.select("doc_id", "text", F.lit(None).cast("string").alias("next_text"))
    before = {order: firsts[i - 1][0] for i, (_, order) in enumerate(firsts)}
    own = F.struct(F.col("slice_"), F.lit(False).alias("follower_"))
    other = F.struct(F.element_at(F.map_from_arrays(F.array(*map(F.lit, before)), F.array(*map(F.lit, before.values()))), F.col("order_")).alias("slice_"), F.lit(True).alias("follower_"))
    dealt = sliced.withColumn("to_", F.explode(F.when(F.col("order_").isin(list(before)), F.array(own, other)).otherwise(F.array(own))))
    along = Window.partitionBy("slice_").orderBy("follower_", "order_", "text")
    return (
        dealt.select("doc_id", "text", "order_", "to_.slice_", "to_.follower_")
        .withColumn("next_text", F.lead("text").over(along)).where("not follower_").select("doc_id", "text", "next_text")
    )


def edited_text() -> Column:
    """The last quarter of ``text`` replaced by as much of the start of ``next_text``."""
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))


def tree_sql(source: str, texts: list[str]) -> str:
    """CTEs that add the tree of each text column to ``source``."""
    out, last = [], source
    for t in texts:
        def adds(name, expr, base):
            out.append(f"{t}_{name}_step AS (SELECT *, {expr} AS {t}_{name} FROM {base})")
            return f"{t}_{name}_step"
        last = adds("leaves", f"list_transform(string_split({t}, chr(10)), lambda p: list_transform(string_split("
                    f"regexp_replace(p, '([.!?]) ', '\\1 ' || chr(31), 'g'), chr(31)), lambda s: substr(sha256(s), 1, 16) || ':' || length(s)))", last)
        last = adds("paragraphs", f"list_transform({t}_leaves, lambda l: substr(sha256(array_to_string(l, ',')), 1, 16))", last)
        last = adds("sections", "list_transform(string_split(regexp_replace(array_to_string(list_transform("
                    f"{t}_paragraphs, lambda p: p || CASE WHEN substr(p, 16, 1) IN ('0', '1', '2', '3') THEN ';' ELSE ',' END), ''), '[;,]$', ''), ';'), "
                    "lambda s: substr(sha256(s), 1, 16))", last)
        last = adds("root", f"sha256(array_to_string({t}_sections, ','))", last)
        last = adds("distinct", f"list_distinct(flatten({t}_leaves))", last)
        last = adds("weight", f"coalesce(list_sum(list_transform({t}_distinct, lambda x: CAST(substr(x, 18) AS BIGINT))), 0)", last)
    return ",\n".join(out), last


def encoded_sql(t: str) -> str:
    return (f"{t}_root || '/' || array_to_string({t}_sections, ',') || '/' || array_to_string({t}_paragraphs, ',') || '/' || "
            f"array_to_string(list_transform({t}_leaves, lambda l: array_to_string(l, ',')), ';')")


def likeness_sql(a: str, b: str) -> str:
    shared = f"coalesce(list_sum(list_transform(list_intersect({a}_distinct, {b}_distinct), lambda x: CAST(substr(x, 18) AS BIGINT))), 0)"
    return (f"CASE WHEN {a}_root = {b}_root THEN 1.0::DOUBLE WHEN {a}_weight + {b}_weight = 0 THEN 0.0::DOUBLE "
            f"ELSE 2 * {shared}::DOUBLE / ({a}_weight + {b}_weight)::DOUBLE END")


_STEPS, _LAST = tree_sql("texts", ["text", "edited", "next_text"])
MERKLE_SQL = f"""
WITH rows_ AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nexts AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
  FROM rows_ WINDOW w AS (ORDER BY doc_id NULLS FIRST, text)
),
texts AS (
  SELECT *, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM nexts
),
{_STEPS}
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {encoded_sql("text")} AS fingerprint,
  {encoded_sql("edited")} AS edited_fingerprint, {likeness_sql("text", "edited")} AS near_edited, {likeness_sql("text", "next_text")} AS near_next,
  CAST(len(list_filter(list_distinct(text_sections), lambda s: NOT list_contains(edited_sections, s))) AS INTEGER) AS changed_sections
FROM {_LAST}
"""


@query("op5_merkle_tree", MERKLE_SQL)
def op5_merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next_text(table(spark, sf_dir, "documents")).withColumn("edited", edited_text())
    for text in ("text", "edited", "next_text"):
        rows = add_tree(rows, text, f"{text}_")
    rows = likeness(likeness(rows, "text_", "edited_", "near_edited"), "text_", "next_text_", "near_next")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        encoded("text_").alias("fingerprint"), encoded("edited_").alias("edited_fingerprint"), "near_edited", "near_next",
        F.size(changed_sections("text_", "edited_")).alias("changed_sections"),
    )

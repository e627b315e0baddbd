"""Regular-expression aliases beside a nested loop."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from treeledger.operators import identity

SURE = {
    r"\x62illing": "illing", "billing": "billing", r"\Qa.b(c\E+x": "a.b(c", "bill(ing)?s": "bill", "colou?r-x": "colo", "ab{0,1}cde": "cde", "[abc]+def[^]x]ghij": "ghij",
    "a|bcd": "", "(?i)BILL": "bill", "(?x) a b c": "", r"\d+-prod\.zip": "-prod.zip", "x+yz": "", "abc+de": "abc", r"\p{L}end-of": "end-of", "(a(b[)])c)tail": "tail",
    r"\\Qabc": r"\qabc", "inv[[a-c]&&[b]]oice": "oice", "": "", "abc*+d": "", "abcd*?e": "abc", r"\u0041bcd": "bcd", "Ünion": "nion",
}


@pytest.mark.parametrize("pattern", SURE)
def test_required_literal(pattern):
    assert identity.required_literal(pattern) == SURE[pattern]


def nested_loop(names, patterns):
    pairs = names.crossJoin(patterns).where(F.expr("name rlike pattern"))
    return pairs.groupBy("id").agg(F.min(F.struct("alias_id", "artifact")).alias("a")).select("id", "a.alias_id", "a.artifact")


def test_random_patterns_equal_a_nested_loop(spark):
    rng = random.Random(3)
    atoms = ["a", "b", "ab", "abc", "c-1", r"\x62", r"\Qa.b\E", ".", "[ab]", "[^c]", r"\.", r"\d", "(ab|c)", "(?:a)", "^", "$", "A"]
    marks = ["", "", "", "", "?", "*", "+", "{2}", "{0,1}", "+?", "*+"]
    patterns = ["".join(x if x in "^$" else x + rng.choice(marks) for x in rng.choices(atoms, k=rng.randrange(1, 6))) for _ in range(400)] + ["(?i)ABC", "a|c-1", "(", "[", "*a", None, ""]
    names = ["".join(rng.choices(["a", "b", "c", "-", "1", ".", "A", "abc"], k=rng.randrange(0, 9))) for _ in range(300)] + ["billing-77.zip", None, ""]
    names_ = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    table = spark.createDataFrame([(k * 7 % 1009, f"f{k}", p, True) for k, p in enumerate(patterns)], "alias_id long, artifact string, pattern string, is_regex boolean")
    compiled = table.where(~F.coalesce(F.col("pattern").isin("(", "[", "*a"), F.lit(True)))
    assert rows(identity.alias_match(names_, table)) == rows(nested_loop(names_, compiled))


def test_more_loose_patterns_than_a_batch(spark, monkeypatch):
    monkeypatch.setattr(identity, "BATCH", 7)
    names = spark.createDataFrame([(k, f"n{k}.zip") for k in range(50)], "id long, name string")
    table = spark.createDataFrame([(k, f"f{k}", f"[n]{k}[.]", True) for k in range(60)], "alias_id long, artifact string, pattern string, is_regex boolean")
    assert rows(identity.alias_match(names, table)) == [(k, k, f"f{k}") for k in sorted(range(50), key=lambda k: repr((k, k, f"f{k}")))]


def broadcast_explodes(df) -> list[str]:
    """Generators below a broadcast in the plan of ``df``."""
    found, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        if depth is None and "BroadcastExchange" in line:
            depth = at
        if depth is not None and "Generate" in line:
            found.append(line.strip())
    return found


def small_tables(spark):
    """Tables whose estimated size is far below what their grams take."""
    names = spark.range(300).select("id", F.concat(F.lit("svc-"), "id", F.lit("-x.zip")).alias("name"))
    table = spark.range(300).select(F.col("id").alias("alias_id"), F.lit("a").alias("artifact"), (F.col("id") % 2 == 0).alias("is_regex"), F.concat(F.lit("svc-"), "id", F.lit("-")).alias("pattern"))
    return names, table


def test_no_exploded_side_is_broadcast(spark):
    names, table = small_tables(spark)
    assert broadcast_explodes(identity.alias_match(names, table.drop("is_regex"))) == []
    assert broadcast_explodes(identity.alias_match(names, table.where("is_regex"))) == []
    known = names.select(F.col("name").alias("artifact"), F.upper("name").alias("slug"))
    assert broadcast_explodes(identity.resolve_names(table.select(F.col("alias_id").alias("id"), F.col("pattern").alias("name")), known)) == []
    assert rows(identity.alias_match(names, table)) == sorted([(k, k, "a") for k in range(300)], key=repr)


@pytest.mark.parametrize("size", [200, 2000])
def test_candidates_grow_with_the_texts(spark, size):
    names = spark.range(size).select(F.concat(F.lit("has-rare"), "id", F.lit("-name.zip")).alias("t")).withColumn("_id", F.xxhash64("t"))
    pieces = spark.range(size).select(F.concat(F.lit("rare"), "id", F.lit("-")).alias("n")).withColumn("p", F.col("n"))
    assert size <= identity.candidates(names, "t", pieces, "n", "p").count() <= 3 * size


def test_pattern_meets_names_on_its_rarest_piece():
    assert identity.required_literals(r" #0*12345[0-9]?\.zip$") == ["12345", ".zip"]

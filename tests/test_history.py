"""Numbering, selection, identity and set operators on small inputs."""

from helpers import rows
from pyspark.sql import functions as F

from treeledger.operators import history, identity, sets


def test_retention_and_latest(spark):
    v = spark.createDataFrame([("a", s) for s in range(1, 7)] + [("b", 1)], "artifact string, seq int")
    assert rows(history.retention(v, 2), "artifact", "seq") == [("a", 5), ("a", 6), ("b", 1)]
    assert history.retention(v, 0).count() == 7
    assert rows(history.latest_version(v, ["seq"]), "artifact", "seq") == [("a", 6), ("b", 1)]


def test_merge_renumbers_and_loses_nothing(spark):
    v = spark.createDataFrame([("a", 1, "d1"), ("a", 2, "d4"), ("b", 1, "d2"), ("b", 2, "d3"), ("c", 9, "d0")], "artifact string, seq int, at string")
    m = spark.createDataFrame([("b", "a")], "source string, target string")
    out = history.merge_artifacts(v, m, ["at", "seq"])
    assert rows(out, "artifact", "origin", "seq", "new_seq") == [("a", "a", 1, 1), ("a", "a", 2, 4), ("a", "b", 1, 2), ("a", "b", 2, 3), ("c", "c", 9, 9)]


def test_selectors(spark):
    v = spark.createDataFrame([("a", s) for s in (1, 3, 7)], "artifact string, seq int")
    asked = ["latest", "v3", "-2", "-9", "5", "x", None, "first"]
    s = spark.createDataFrame([("a", q, 1) for q in asked] + [("none", "latest", 0)], "artifact string, selector string, default_offset int")
    got = {(r["artifact"], r["selector"]): (r["seq"], r["reason"]) for r in history.resolve_selectors(v, s).collect()}
    assert got[("a", "latest")] == (7, None) and got[("a", "v3")] == (3, None) and got[("a", "-2")] == (3, None) and got[("a", None)] == (3, None)
    assert got[("a", "-9")] == (None, "only 3 versions") and got[("a", "5")] == (None, "not found") and got[("a", "x")] == (None, "not understood")
    assert got[("a", "first")] == (1, None) and got[("none", "latest")] == (None, "no versions")


def test_identity_chain(spark):
    arrivals = spark.createDataFrame([
        (1, "x.zip", "Forced", None, None), (2, "my-alias-77.zip", None, None, None), (3, "rule_42.zip", None, None, None),
        (4, "code.zip", None, '{"FunctionName": "side"}', None), (5, "ORDERS-final (1).zip", None, None, None), (6, "billing-2026-01-15.zip", None, None, None),
        (7, "download.zip", None, None, "real-name"), (8, "package.zip", None, None, "index.js"), (9, "a1b2c3d4e5f6.zip", None, None, None)],
        "id int, file_name string, override string, sidecar string, top_entry string")
    known = spark.createDataFrame([("orders", "orders")], "artifact string, slug string")
    aliases = spark.createDataFrame([(1, "aliased", "ALIAS-7")], "alias_id long, artifact string, pattern string")
    got = {r["id"]: (r["name"], r["strategy"], r["confidence"]) for r in identity.identify(arrivals, known, aliases, (("rule_([0-9]+)", "ruled-$1"),)).collect()}
    assert got == {
        1: ("Forced", "explicit", "high"), 2: ("aliased", "alias", "high"), 3: ("ruled-42", "config-rule", "high"), 4: ("side", "sidecar-json", "high"),
        5: ("orders", "known-function", "high"), 6: ("billing", "filename", "medium"), 7: ("real-name", "zip-top-level", "low"),
        8: ("unknown-package", "fallback", "low"), 9: ("unknown-a1b2c3d4", "fallback", "low")}


def test_contains_join_equals_nested_loop(spark):
    import random

    rng = random.Random(1)
    names = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 8))) for _ in range(60)]
    parts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(30)]
    a = spark.createDataFrame(list(enumerate(names)), "i int, h string")
    b = spark.createDataFrame(list(enumerate(parts)), "j int, n string")
    assert rows(identity.contains_join(a, b, "h", "n"), "i", "j") == sorted(((i, j) for i, x in enumerate(names) for j, y in enumerate(parts) if y in x), key=repr)


def test_dependency_changes_collapse(spark):
    schema = "artifact string, manager string, name string, version string, is_declared boolean"
    old = spark.createDataFrame([("f", "pip", "boto3", "1", True), ("f", "pip", "Boto3", "1", False), ("f", "npm", "gone", None, True)], schema)
    new = spark.createDataFrame([("f", "pip", "boto3", "2", True), ("f", "pip", "boto3", "2", False), ("f", "pip", "new", None, True)], schema)
    out = sets.collapse_declared(sets.keyed_diff(old, new, ["artifact"]), ["artifact"])
    assert rows(out, "kind", "name", "old_version", "new_version", "is_declared") == [
        ("added", "new", None, None, True), ("changed", "boto3", "1", "2", False), ("removed", "gone", None, None, True)]


def test_findings_ignore_the_line(spark):
    schema = "kind string, path string, detail string, line_no int"
    old = spark.createDataFrame([("k", "a", "d", 1), ("k", "b", None, 1)], schema)
    new = spark.createDataFrame([("k", "a", "d", 9), ("k", "c", "d", 2)], schema)
    out = sets.findings_delta(old, new, ["kind", "path", "detail"])
    assert rows(out, "path", "status") == [("b", "fixed"), ("c", "new")]


def test_headline_of_latest_step(spark):
    a = spark.createDataFrame([("x",), ("y",)], "artifact string")
    steps = spark.createDataFrame([("x", 1, 2), ("x", 2, 3), ("y", 1, 2)], "artifact string, old_seq int, new_seq int")
    records = spark.createDataFrame([("x", 2, 3, "h", "low", "done"), ("y", 1, 2, "p", "low", "pending")], "artifact string, old_seq int, new_seq int, headline string, risk string, status string")
    assert rows(history.latest_headlines(a, steps, records), "artifact", "headline", "risk") == [("x", "h", "low"), ("y", None, None)]


def test_edits_and_cascade(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, label string")
    edits = spark.createDataFrame([(1, "new"), (2, None)], "id int, label string")
    assert rows(sets.apply_edits(base, edits, ["id"], ["label"])) == [(1, "new"), (2, None), (3, "c")]
    kept = sets.cascade_delete({"t": (base, ["id"])}, base.where(F.col("id") == 2).select("id"))
    assert rows(kept["t"], "id") == [(1,), (3,)]


def test_arrivals_without_an_artifact_are_judged(spark):
    df = spark.createDataFrame([(1, 10, None, "k", "z1", "t"), (2, 11, None, "k", "z2", "t"), (3, 12, "a", "k", "z2", None)],
                               "event_id int, ts long, artifact string, kind string, archive_key string, tree_key string")
    assert rows(history.ingest_outcomes(df), "event_id", "status", "seq") == [(1, "new", 1), (2, "unchanged", 1), (3, "duplicate-download", None)]

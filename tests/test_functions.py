"""Column functions on tables of cases."""

import pytest
from pyspark.sql import functions as F

from treeledger.functions import labels, paths, text
from treeledger.options import VENDOR_GLOBS


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_names(spark):
    cases = {
        "fn (1)": "fn", "orders-2026-01-15": "orders", "orders-2026-01-15-1030 (2)": "orders", "orders_20260115-1030": "orders",
        "svc-" + "a1" * 16: "svc", "job-1700000000": "job", "app-final": "app", "repo-main": "repo", "repo-v1.2.3": "repo",
        "repo-2.0.0-rc1": "repo", "repo-a1b2c3d": "repo", "word-defaced": "word-defaced", "name-v2": "name-v2", "name-2": "name-2",
        "x-12345678-1234-1234-1234-123456789abc": "x", "plain": "plain", "order-processor": "order-processor",
    }
    assert dict(zip(cases, column(spark, list(cases), paths.clean_name))) == cases


def test_cleaning_twice_changes_nothing(spark):
    once = column(spark, ["a-final-final", "b (1) (2)", "c-main-2026-01-01"], paths.clean_name)
    assert column(spark, once, paths.clean_name) == once


def test_meaningless(spark):
    cases = {"x": True, "package": True, "Download": True, "a1b2c3d4e5f6": True, "42": True, "abcdefghijklmnopqrstuvwxyz0": True, "etl": False, "order-processor": False}
    assert dict(zip(cases, column(spark, list(cases), paths.looks_meaningless))) == cases


def test_language(spark):
    cases = {"a/b.PY": "python", "x.mjs": "javascript", "notes.rst": "rst", "Dockerfile": "dockerfile", "a/Makefile": "makefile", ".env": "text", "x.env": "dotenv", "noext": "text", "a.tar.gz": "binary"}
    assert dict(zip(cases, column(spark, list(cases), paths.language_label))) == cases


def test_globs(spark):
    cases = {
        "node_modules/x.js": True, "node_modules": True, "a/b/node_modules/c/d.js": True, "x/site-packages/y.py": True, "site-packages/y.py": True,
        "boto3-1.0.dist-info/METADATA": True, "vendor/x": True, "a/vendor/x": False, "myvendor/x": False, "src/app.py": False, "p/__pycache__/m.pyc": True,
    }
    assert dict(zip(cases, column(spark, list(cases), lambda c: paths.is_vendored(c, VENDOR_GLOBS)))) == cases
    assert column(spark, ["a1.py", "ab.py", "a/b.py"], lambda c: paths.matches_any(c, ["a[0-9].py", "a?b.py"])) == [True, False, True]


def test_slug(spark):
    cases = {"Café Münster": "Cafe-Munster", "  a//b  ": "a-b", "con": "_con", "COM1.zip": "_COM1.zip", "***": "unnamed", "a--b": "a-b", "x" * 200: "x" * 200}
    assert dict(zip(cases, column(spark, list(cases), paths.slugify))) == cases
    assert column(spark, ["x" * 200], lambda c: paths.slugify(c, longest=120)) == ["x" * 120]


def test_ref_and_module(spark):
    cases = {"myrepo-1.2.3": "v1.2.3", "myrepo-main": "main", "myrepo-a1b2c3d": "a1b2c3d", "r-v2.0-rc1": "v2.0-rc1", "plain": None, "repo-v2": None}
    assert dict(zip(cases, column(spark, list(cases), paths.ref_label))) == cases
    assert column(spark, ["a/b.py", "c.mjs"], paths.module_name) == ["a.b", "c"]


def test_rename_parts(spark):
    df = spark.createDataFrame([
        (1, "site-packages/boto3-1.34.0.dist-info/METADATA", "site-packages/boto3-1.35.20.dist-info/METADATA"),
        (2, "src/app/old.py", "src/app/new.py"), (3, "abc", "xyz"), (4, "a/b.py", "a/b.py.bak"), (5, "src/handlers/db.py", "src/services/db.py")], "i int, o string, n string")
    parts = paths.rename_parts(F.col("o"), F.col("n"))
    got = [tuple(r) for r in df.orderBy("i").select(*[parts[k] for k in ("prefix", "was", "now", "suffix")]).collect()]
    assert got == [
        ("site-packages/boto3-1.", "34.0", "35.20", ".dist-info/METADATA"), ("src/app/", "old", "new", ".py"), ("", "abc", "xyz", ""),
        ("a/b.py", "", ".bak", ""), ("src/", "handlers", "services", "/db.py")]


def test_pair_key(spark):
    df = spark.createDataFrame([("a/util.py", "python"), ("src/h.js", "javascript"), ("lib/h.ts", "typescript")], "p string, l string")
    assert [r[0] for r in df.select(paths.pair_key(F.col("p"), F.col("l"))).collect()] == ["util.py|", "h|ecmascript", "h|ecmascript"]


def test_lines(spark):
    assert column(spark, ["", "a", "a\n", "a\n\nb", "\n"], text.lines_of) == [[], ["a"], ["a"], ["a", "", "b"], [""]]
    assert column(spark, ["", "a", "a\n", "a\n\nb"], text.line_count) == [0, 1, 1, 3]
    assert column(spark, ["", "ab\nabcd\n"], text.mean_line_length) == [0.0, 3.0]


def test_whitespace_key(spark):
    a, b, c = column(spark, ["\tfoo  bar \r\n\n x", "foo bar\nx\n", "foobar\nx"], text.whitespace_key)
    assert a == b != c


def test_text_sniff(spark):
    values = [bytearray(v) for v in (b"", b"abc", b"a\x00b", "é".encode(), b"plain text only \xe9 here", b"\xff\xfe\xfd\xfca")]
    assert column(spark, values, text.is_probably_text, "binary") == [True, True, False, True, True, False]


def test_entropy(spark):
    got = column(spark, ["aaaa", "abab", "abcd"], lambda c: F.round(text.shannon_entropy(c), 6))
    assert got == [0.0, 1.0, 2.0]


@pytest.mark.parametrize("value,label", [(0, "0 B"), (512, "512 B"), (1536, "1.5 KB"), (1024 ** 2, "1.0 MB"), (5 * 1024 ** 4, "5.0 TB"), (3 * 1024 ** 5, "3.0 PB")])
def test_human_size(spark, value, label):
    assert column(spark, [value], labels.human_size, "bigint") == [label]


def test_age(spark):
    import datetime as dt

    now = dt.datetime(2026, 1, 31)
    ages = [30, 60, 3600 * 5, 86400, 86400 * 3, 86400 * 21, 86400 * 90]
    got = column(spark, [now - dt.timedelta(seconds=s) for s in ages], lambda c: labels.age_label(c, F.lit("2026-01-31").cast("timestamp")), "timestamp")
    assert got == ["just now", "1 minute ago", "5 hours ago", "yesterday", "3 days ago", "3 weeks ago", "2025-11-02"]


def test_renames_and_slugs_name_each_step_once(spark):
    """The plan must not repeat a step for every use of its result."""
    from treeledger.functions import paths

    df = spark.createDataFrame([("a/b-1.0/x.txt", "a/b-2.0/x.txt"), ("same", "same"), ("", "a"), (None, "a"), ("con.txt", "...")], "a string, b string")
    found = df.withColumn("p", paths.rename_struct(F.col("a"), F.col("b"))).select("a", "b", "p.*", paths.slugify(F.col("a")).alias("slug"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2 and plan.count("translate(") == 1
    got = [tuple(r) for r in found.collect()]
    assert got[:3] == [
        ("a/b-1.0/x.txt", "a/b-2.0/x.txt", "a/b-", "1", "2", ".0/x.txt", "a-b-1.0-x.txt"), ("same", "same", "same", "", "", "", "same"), ("", "a", "", "", "a", "", "unnamed")]
    assert got[3][-1] is None and got[4][-1] == "_con.txt"

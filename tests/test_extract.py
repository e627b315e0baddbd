"""References, entry points, dependencies, findings and redaction on small trees."""

import io
import zipfile

from helpers import rows
from pyspark.sql import functions as F

from treeledger.operators import dependencies, extract, findings, review
from treeledger.options import ArchiveOptions
from treeledger.sources import archives, manifest

SCHEMA = "artifact string, seq int, path string, content string, mode int"


def tree(spark, files):
    return spark.createDataFrame([("fn", 1, p, c, 420) for p, c in files.items()], SCHEMA)


PYTHON = {
    "lambda_function.py": 'import os\nimport boto3\nT = os.environ["TABLE_NAME"]\nR = os.environ.get("AWS_REGION")\nd = boto3.resource("dynamodb")\n\ndef lambda_handler(event, context):\n    return 1\n',
    "requirements.txt": "boto3>=1.34\nrequests[security]==2.0 ; python_version>'3'\n# note\n-r base.txt\nhttps://x.y/pkg.zip?z=1\nlib @ git+https://x/lib\nbare\n",
    "site-packages/boto3-1.34.0.dist-info/METADATA": "Metadata-Version: 2\nName: boto3\nVersion: 1.34.0\n\nName: not-this\n",
    "site-packages/x.py": 'os.environ["VENDORED"]\n',
}


def test_python_package(spark):
    files = tree(spark, PYTHON)
    refs = extract.extract_refs(files)
    assert rows(extract.distinct_refs(refs), "kind", "name") == [("env", "TABLE_NAME"), ("service", "dynamodb")]
    assert ("AWS_REGION",) in rows(extract.distinct_refs(refs, include_reserved=True), "name")
    best = extract.entry_points(files).orderBy("rank").first()
    assert (best["handler"], best["score"]) == ("lambda_function.lambda_handler", 100)
    runtime = extract.score_runtimes(files).first()
    assert (runtime["runtime"], runtime["confidence"]) == ("python", "high")
    assert rows(dependencies.dependencies(files), "name", "version", "is_declared") == sorted([
        ("bare", None, True), ("boto3", "1.34.0", False), ("boto3", "1.34", True), ("lib", "git+https://x/lib", True), ("pkg.zip", None, True), ("requests", "2.0", True)], key=repr)


def test_node_package(spark):
    files = tree(spark, {
        "index.mjs": "export const handler = async (e) => process.env.A;\n", "package.json": '{"dependencies": {"lodash": "^4.17"}, "devDependencies": {"jest": 29}}',
        "node_modules/lodash/package.json": '{"name": "lodash", "version": "4.17.21"}', "node_modules/lodash/dist/package.json": '{"name": "inner", "version": "1"}',
        "node_modules/@s/p/package.json": '{"name": "@s/p", "version": "2.0"}'})
    assert extract.entry_points(files).first()["handler"] == "index.handler"
    assert extract.score_runtimes(files).first()["runtime"] == "nodejs"
    assert rows(dependencies.dependencies(files), "name", "version", "is_declared") == sorted([
        ("lodash", "^4.17", True), ("jest", None, True), ("lodash", "4.17.21", False), ("@s/p", "2.0", False)], key=repr)


def test_other_manifests(spark):
    files = tree(spark, {
        "go.mod": "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgolang.org/x v0.1.0 // indirect\n)\nrequire example.com/c v2.0.0\n",
        "pom.xml": "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency><dependency><artifactId>solo</artifactId></dependency>",
        "Gemfile.lock": "GEM\n  specs:\n    rake (13.0.1)\n      dep (>= 1)\n",
        "yarn.lock": '# v1\n\nlodash@^4.0.0:\n  version "4.17.21"\n  resolved "x"\n\n"left-pad@1":\n  version "1.3.0"\n',
        "package-lock.json": '{"packages": {"": {"name": "root"}, "node_modules/a": {"version": "1.0"}, "node_modules/x/node_modules/b": {"version": "2.0"}}}',
        "pyproject.toml": '[project]\nname = "p"\ndependencies = [\n  "httpx[http2]>=0.27",\n  "rich",\n]\n\n[tool.poetry.dependencies]\npython = "^3.11"\nfoo = "1.0"\nbar = {version = "2.0", extras = ["x"]}\n'})
    got = rows(dependencies.dependencies(files), "manager", "name", "version")
    assert got == sorted([
        ("go", "github.com/a/b", "v1.2.3"), ("go", "golang.org/x", "v0.1.0"), ("go", "example.com/c", "v2.0.0"), ("maven", "g:a", "${v}"), ("maven", "solo", None),
        ("gem", "rake", "13.0.1"), ("npm", "lodash", "4.17.21"), ("npm", "a", "1.0"), ("npm", "b", "2.0"), ("pip", "httpx", "0.27"), ("pip", "rich", None),
        ("pip", "foo", "1.0"), ("pip", "bar", "2.0")] + ([("npm", "left-pad", "1.3.0")]), key=repr)


def test_older_lock_layout(spark):
    files = tree(spark, {"package-lock.json": '{"dependencies": {"a": {"version": "1.0"}, "b": 3}}'})
    assert rows(dependencies.dependencies(files), "name", "version") == [("a", "1.0"), ("b", None)]


AWS_KEY = "AKIA" + "IOSFODNN7EXAMPLE"


def test_placeholders_are_skipped(spark):
    files = tree(spark, {"a.py": f'KEY = "{AWS_KEY}"\npassword = "changeme"\npassword = "s3cr3t-Tr0ub4dor-x9"\ntoken = os.environ["TOKEN"]\nDEBUG = True\n'})
    found = findings.findings(files).collect()
    assert sorted((f["kind"], f["line_no"]) for f in found) == [("aws-access-key-id", 1), ("debug-flag", 5), ("hardcoded-credential", 3)]
    details = {f["kind"]: f["detail"] for f in found}
    assert details["aws-access-key-id"] == "AKIA…LE (20 chars)" and details["debug-flag"] == "DEBUG = True"
    assert all(AWS_KEY not in f["detail"] for f in found)


def test_redaction(spark):
    stripe = "sk_" + "live_" + "4eC39HqLyjWDarjtT1zdp7dc"
    lines = [f'STRIPE = "{stripe}"', 'token = "a8Fq2LzP9xW4mB7nK3vR6tY1uJ5hC0dE"', "return build_response_for_customer_order_items(event)",
             "x a8Fq2LzP9xW4mB7nK3vR6tY1uJ5hC0dE y", 'password = "changeme1"']
    df = spark.createDataFrame(list(enumerate(lines)), "i int, content string")
    got = {r["i"]: (r["redacted"], r["redactions"]) for r in findings.redact(df, "content").collect()}
    assert got[0] == ('STRIPE = "«redacted stripe-key»"', 1) and got[1][1] == 1 and "a8Fq" not in got[1][0]
    assert got[2] == (lines[2], 0) and got[3] == ("x «redacted high-entropy string» y", 1) and got[4][1] == 1
    again = findings.redact(spark.createDataFrame([(i, t) for i, (t, _) in got.items()], "i int, content string"), "content")
    assert {r["i"]: r["redacted"] for r in again.collect()} == {i: t for i, (t, _) in got.items()}


def zip_bytes(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, data in members.items():
            zf.writestr(name, data)
    return out.getvalue()


def test_archive_policy(spark, tmp_path):
    (tmp_path / "many.zip").write_bytes(zip_bytes({f"f{i}": b"x" for i in range(10)}))
    (tmp_path / "big.zip").write_bytes(zip_bytes({"f": b"0" * 100_000}))
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    (tmp_path / "ok.zip").write_bytes(zip_bytes({"wrap/a.py": b"print(1)\n", "wrap/sub/b.txt": b"two", "../evil": b"x", "__MACOSX/q": b"", "wrap/.DS_Store": b""}))
    zips = archives.archives(spark, str(tmp_path))
    admitted, refused = archives.split_archives(zips, ArchiveOptions(max_files=5, max_bytes=1000))
    why = {r["archive"].rsplit("/", 1)[1]: r["reject_reason"] for r in refused.collect()}
    assert set(why) == {"many.zip", "big.zip", "bad.zip"} and why["many.zip"] == "archive has 10 entries (limit 5)" and why["bad.zip"].startswith("not a valid zip")
    members = archives.expand_members(zips, admitted)
    files = members.select(F.lit("ok").alias("artifact"), F.lit(1).alias("seq"), F.col("member").alias("path"), F.decode("payload", "UTF-8").alias("content"))
    lifted = archives.strip_common_root(files)
    assert rows(lifted, "path", "content", "wrapper") == [("a.py", "print(1)\n", "wrap"), ("sub/b.txt", "two", "wrap")]


def test_wrapper_is_kept_beside_a_root_file(spark):
    kept = archives.strip_common_root(tree(spark, {"wrap/a": "1", "setup.py": "2"}))
    assert rows(kept, "path") == [("setup.py",), ("wrap/a",)]
    nested = archives.strip_common_root(tree(spark, {"w/src/a": "1", "w/src/b": "2"}))
    assert rows(nested, "path") == [("src/a",), ("src/b",)]


def test_folder_scan(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.py").write_text("a\n")
    (tmp_path / "y.txt").write_text("b\n")
    assert rows(archives.folder_files(spark, str(tmp_path)), "path", "size") == [("d/e/x.py", 2), ("y.txt", 2)]


def test_manifest_defaults_rebuild_and_index(spark, tmp_path):
    docs = spark.createDataFrame([
        ("slug/versions/0003-aa", '{"artifact": "fn", "seq": 3, "ingested_at": "2026-01-03", "files": [{"path": "a", "sha256": "s"}]}'),
        ("slug/versions/0002-bb", '{"ingested_at": "2026-01-01"}'), ("slug/versions/zzz", '{"artifact": "slug", "ingested_at": "2026-01-02"}'), ("other/versions/0001-c", "{broken")], "folder string, document string")
    parsed = manifest.parse_manifests(docs)
    assert rows(manifest.manifest_files(parsed), "artifact", "seq", "path", "mode", "lang") == [("fn", 3, "a", 420, "text")]
    assert manifest.corrupt_manifests(parsed).count() == 1
    rebuilt = manifest.rebuild_versions(parsed.where(~F.col("document").startswith("{broken")))
    assert rows(rebuilt, "artifact", "new_seq", "healed") == [("fn", 3, False), ("slug", 1, True), ("slug", 2, True)]
    index = str(tmp_path / "index")
    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "artifact string, seq int, v string")
    manifest.write_index(df, index)
    manifest.write_index(spark.createDataFrame([("a", 2, "z")], df.schema), index)
    assert rows(manifest.read_index(spark, index), "artifact", "seq", "v") == [("a", 2, "z"), ("b", 1, "y")]
    manifest.export_version(manifest.read_index(spark, index), "a", 2, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_answers_and_citations(spark):
    fenced = 'Sure! Here:\n```json\n{"headline": "Saved", "risk": "Medium", "changes": [{"kind": "FIX", "title": "t", "files": ["b/app.py"]}, {"kind": "odd", "title": "u"}, {"kind": "fix"}], "risks": [{"level": "High", "title": "r"}], "checklist": ["Add X", " "]}\n```'
    df = spark.createDataFrame([(1, fenced), (2, "The handler now publishes. It also returns 201."), (3, "a {stray brace {\"headline\": \"h\"}")], "id int, text string")
    got = {r["id"]: r for r in review.parse_answers(df).collect()}
    assert got[1]["headline"] == "Saved" and got[1]["risk"] == "medium" and [c["kind"] for c in got[1]["changes"]] == ["fix", "other"]
    assert got[1]["risks"][0]["kind"] == "high" and got[1]["checklist"] == ["Add X"]
    assert not got[2]["structured"] and got[2]["headline"] == "The handler now publishes." and "201" in got[2]["summary"]
    assert got[3]["structured"] and got[3]["headline"] == "h"
    known = spark.createDataFrame([("f", p) for p in ("src/a/util.py", "src/b/util.py", "helpers/db.py", "a/b.py")], "artifact string, path string")
    asks = spark.createDataFrame([("f", c) for c in ("db.py", "util.py", "`helpers/db.py:12`", "a/b.py", "/new/helpers/db.py", "nope")], "artifact string, cited string")
    assert dict(rows(review.resolve_citations(asks, known, ["artifact"]), "cited", "path")) == {
        "db.py": "helpers/db.py", "util.py": None, "`helpers/db.py:12`": "helpers/db.py", "a/b.py": "a/b.py", "/new/helpers/db.py": "helpers/db.py", "nope": None}


def test_answers_are_whole_unless_limited(spark):
    import json

    from treeledger.options import AnswerOptions

    item = {"title": "t" * 500, "detail": "d" * 2000}
    text = json.dumps({"headline": "h" * 500, "summary": "s" * 5000, "changes": [item] * 12, "risks": [item] * 11, "checklist": ["c" * 400] * 10})
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = review.parse_answers(df).first()
    assert [len(got[c]) for c in ("headline", "summary", "changes", "risks", "checklist")] == [500, 5000, 12, 11, 10]
    assert len(got["changes"][11]["title"]) == 500 and len(got["risks"][10]["detail"]) == 2000 and len(got["checklist"][9]) == 400
    cut = review.parse_answers(df, options=AnswerOptions(changes=8, headline_chars=160)).first()
    assert (len(cut["changes"]), len(cut["headline"]), len(cut["risks"])) == (8, 160, 11)


def test_greedy_fill_and_sections_in_small_pieces(spark):
    import random

    rng = random.Random(2)
    data = [("f", i, rng.randrange(1, 60), rng.randrange(3, 30)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, pos long, size long, title_chars long")
    room, want = 900, []
    for _, i, size, _ in data:
        want.append((i, size <= room))
        room -= size if size <= room else 0
    for step in (7, 1000):
        got = review.greedy_fill(df, ["k"], [F.col("pos")], F.col("size"), 900, task_items=step)
        assert rows(got.orderBy("pos"), "pos", "included") == sorted(want, key=repr)
    sections = df.withColumn("body_chars", F.col("size") * 40).withColumn("head_chars", F.lit(400))
    whole = review.pack_sections(sections, ["k"], [F.col("pos")], "head_chars", 30_000)
    pieces = review.pack_sections(sections, ["k"], [F.col("pos")], "head_chars", 30_000, task_items=9)
    assert rows(whole, "pos", "included", "quoted_chars") == rows(pieces, "pos", "included", "quoted_chars")
    assert 0 < whole.where("included").count() < 200


def test_brief_lines_and_overflow(spark):
    schema = "artifact string, kind string, manager string, name string, old_version string, new_version string, is_declared boolean"
    deps = spark.createDataFrame([("f", "changed", "pip", "boto3", "1", "2", False), ("f", "added", "pip", "new", None, None, True), ("f", "removed", "npm", "old", "3", None, True)], schema)
    part = review.section(deps, ["artifact"], [F.col("name")], review.dependency_line(), 1, "Dependency changes", 2)
    overview = spark.createDataFrame([("f", "# f")], "artifact string, text string")
    assert review.brief(overview, part, ["artifact"]).first()["brief"] == (
        "# f\n\n## Dependency changes\n- boto3 (pip, installed): 1 → 2\n- new (pip, declared): added at unspecified version\n- … and 1 more")

"""Comparison behaviour on small trees."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from treeledger.operators import changes, facts, similar, snapshot
from treeledger.options import ArchiveOptions, CompareOptions

SCHEMA = "artifact string, seq int, path string, content string, mode int"


def tree(spark, old, new):
    data = [("fn", s, p, c, 420) for s, files in ((1, old), (2, new)) for p, c in files.items()]
    return spark.createDataFrame(data, SCHEMA)


def compare(spark, old, new, **options):
    files = tree(spark, old, new)
    return changes.file_changes(changes.renamed_and_changed(files, 1, 2, **options), files), files


def kinds(df):
    return rows(df.where(~F.col("is_hidden")), "kind", "path", "old_path")


def body(n, tag=""):
    return "".join(f"value_{i} = {i} {tag if i == 0 else ''}\n" for i in range(n))


def test_same_tree_has_no_changes(spark):
    out, _ = compare(spark, {"a.py": "x\n"}, {"a.py": "x\n"})
    assert out.count() == 0


def test_exact_rename(spark):
    out, _ = compare(spark, {"util.py": body(5)}, {"helpers/util.py": body(5)})
    assert kinds(out) == [("renamed", "helpers/util.py", "util.py")]


def test_rename_with_edit_counts_lines(spark):
    out, _ = compare(spark, {"util.py": body(5)}, {"helpers/tools.py": body(5) + "more = 1\nand_more = 2\n"})
    assert kinds(out) == [("renamed", "helpers/tools.py", "util.py")]
    assert out.first()["added_lines"] == 2


def test_script_ported_to_typescript(spark):
    out, _ = compare(spark, {"h.js": "const a = 1\nconst b = 2\nconst c = 3\n"}, {"h.ts": "const a: number = 1\nconst b = 2\nconst c = 3\n"})
    assert kinds(out) == [("renamed", "h.ts", "h.js")]
    assert (out.first()["added_lines"], out.first()["removed_lines"]) == (1, 1)


def test_unrelated_languages_stay_apart(spark):
    out, _ = compare(spark, {"h.py": body(6)}, {"h.js": body(6, "x")})
    assert [k for k, *_ in kinds(out)] == ["added", "removed"]


def test_many_files_moved_and_edited(spark):
    old = {f"src/m{i:03d}.py": body(8, f"file {i}") + f"own_{i} = {i}\n" for i in range(160)}
    new = {f"lib/m{i:03d}.py": body(8, f"file {i}") + f"own_{i} = {i + 1}\n" for i in range(160)}
    out, _ = compare(spark, old, new)
    found = kinds(out)
    assert len(found) == 160 and all(k == "renamed" and p.split("/")[1] == o.split("/")[1] for k, p, o in found)


def test_lopsided_trees(spark):
    old = {f"old{i}.py": body(10, f"keep {i}") + f"a{i} = {i}\nb{i} = {i}\n" * 5 for i in range(3)}
    new = {f"new{i}.py": "".join(f"other_{i}_{j} = {j}\n" for j in range(12)) for i in range(197)}
    new |= {f"moved{i}.py": old[f"old{i}.py"] + "tail = 1\n" for i in range(3)}
    out, _ = compare(spark, old, new)
    assert [(p, o) for k, p, o in kinds(out) if k == "renamed"] == [(f"moved{i}.py", f"old{i}.py") for i in range(3)]


def test_copies_pair_in_path_order(spark):
    out, _ = compare(spark, {"a/x": "same", "b/x": "same", "c/x": "same"}, {"d/x": "same", "e/x": "same"})
    assert kinds(out) == [("removed", "c/x", None), ("renamed", "d/x", "a/x"), ("renamed", "e/x", "b/x")]


def test_vendored_edit_is_hidden_and_counted(spark):
    out, _ = compare(spark, {"site-packages/b/i.py": "v = 1\n", "x/site-packages/b/i.py": "v = 1\n"}, {"site-packages/b/i.py": "v = 2\n", "x/site-packages/b/i.py": "v = 2\n"})
    counted = changes.change_counts(out).first()
    assert kinds(out) == [] and counted["vendored_hidden"] == 2 and counted["modified"] == 0


def test_lock_file_is_listed_without_counts(spark):
    out, _ = compare(spark, {"package-lock.json": "{}\n"}, {"package-lock.json": "{1}\n"})
    row = out.first()
    assert (row["kind"], row["skipped_reason"], row["added_lines"]) == ("modified", "ignored by config", 0)


def test_whitespace_and_wide_files(spark):
    wide = "x" * 900
    out, _ = compare(spark, {"a.py": "if x:\n\ty()\n", "b.js": wide + "1\n", "c.py": "foo bar\n"}, {"a.py": "if x:\n    y()\n", "b.js": wide + "2\n", "c.py": "foobar\n"})
    found = {r["path"]: (r["whitespace_only"], r["long_lines"], r["added_lines"]) for r in out.collect()}
    assert found == {"a.py": (True, False, 0), "b.js": (False, True, 0), "c.py": (False, False, 1)}


def test_mode_only_change(spark):
    files = spark.createDataFrame([("f", 1, "run.sh", "x\n", 420), ("f", 2, "run.sh", "x\n", 493)], SCHEMA)
    out = changes.file_changes(changes.renamed_and_changed(files, 1, 2), files)
    assert kinds(out) == [("mode-changed", "run.sh", None)]


def moves(spark, old, new, min_files=3):
    out, files = compare(spark, old, new)
    listed = files.where("seq = 1").select("artifact", F.lit(1).alias("old_seq"), F.lit(2).alias("new_seq"), "path")
    return out, changes.directory_moves(out, listed, min_files)


def test_partial_move(spark):
    old = {f"handlers/m{i:02d}.py": body(4, f"h{i}") for i in range(20)}
    new = {(f"lambda/handlers/m{i:02d}.py" if i < 8 else p): c for i, (p, c) in enumerate(old.items())}
    _, found = moves(spark, old, new)
    assert rows(found, "old_dir", "new_dir", "moved", "total_in_old_dir", "whole_dir") == [("handlers", "lambda/handlers", 8, 20, False)]


def test_edited_members_and_rows(spark):
    old = {f"h/m{i:02d}.py": body(9, f"h{i}") for i in range(20)}
    new = {p.replace("h/", "g/h/"): c + ("edit = 1\n" if i < 3 else "") for i, (p, c) in enumerate(old.items())}
    out, found = moves(spark, old, new)
    assert rows(found, "moved", "edited", "whole_dir") == [(20, 3, True)]
    assert rows(changes.change_rows(out, found), "row_kind", "moved", "edited") == [("move", 20, 3)]
    root = changes.folder_rollup(changes.tree_rows(out, found)).where("folder = ''").first()
    assert root["files"] == 20 and root["added_lines"] == 3


def test_two_moves_stay_two_and_small_ones_fold_nothing(spark):
    old = {f"{d}-1.0/f{i}.py": body(4, f"{d}{i}") for d in ("boto", "core") for i in range(3)}
    new = {p.replace("-1.0", "-2.0"): c for p, c in old.items()}
    _, found = moves(spark, old, new)
    assert found.count() == 2
    _, none = moves(spark, {"a/x.py": body(4, "x"), "a/y.py": body(4, "y")}, {"b/x.py": body(4, "x"), "b/y.py": body(4, "y")})
    assert none.count() == 0


@pytest.mark.parametrize("limit", [1, 10_000])
def test_tree_hash_ignores_order_and_mode(spark, limit):
    import hashlib

    files = {f"d/{i}": f"c{i}" for i in range(40)}
    a = spark.createDataFrame([("f", 1, p, c, 420) for p, c in files.items()] + [("f", 2, p, c, 493) for p, c in reversed(files.items())], SCHEMA)
    got = {r["seq"]: r["tree_hash"] for r in facts.tree_hash(facts.file_facts(a), ArchiveOptions(max_files=limit)).collect()}
    lines = "\n".join(f"{hashlib.sha256(c.encode()).hexdigest()}  {p}" for p, c in sorted(files.items()))
    assert got == {1: hashlib.sha256(lines.encode()).hexdigest(), 2: hashlib.sha256(lines.encode()).hexdigest()}


def greedy(pairs):
    used_n, used_o, out = set(), set(), []
    for ratio, new, old in sorted(pairs, reverse=True):
        if new not in used_n and old not in used_o:
            used_n.add(new)
            used_o.add(old)
            out.append((new, old, ratio))
    return sorted(out)


@pytest.mark.parametrize("task_pairs", [5, 100_000])
def test_greedy_match_equals_one_by_one(spark, task_pairs):
    import random

    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(25)}", f"o{rng.randrange(25)}"): rng.randrange(1, 6) / 5 for _ in range(150)}
    data = [(1, n, o, r) for (n, o), r in pairs.items()]
    df = spark.createDataFrame(data, "k int, new_path string, old_path string, ratio double")
    got = similar.greedy_match(df, ["k"], "new_path", "old_path", task_pairs=task_pairs)
    assert rows(got, "new_path", "old_path", "ratio") == greedy([(r, n, o) for (n, o), r in pairs.items()])


@pytest.mark.parametrize("seed", [1, 2])
def test_tied_blocks_equal_one_by_one(spark, seed):
    """Random blocks of equal scores, whole and with holes, and edges across them."""
    import random

    rng, pairs = random.Random(seed), {}
    for b in range(8):
        score = rng.choice([0.6, 0.8, 0.8, 1.0])
        for n in range(rng.randrange(1, 6)):
            for o in range(rng.randrange(1, 6)):
                if b % 3 or rng.random() < 0.8:
                    pairs[f"n{b}{n}", f"o{b}{o}"] = score
    for _ in range(12):
        pairs.setdefault((f"n{rng.randrange(8)}{rng.randrange(6)}", f"o{rng.randrange(8)}{rng.randrange(6)}"), rng.choice([0.6, 0.8, 1.0]))
    df = spark.createDataFrame([(1, n, o, r) for (n, o), r in pairs.items()], "k int, new_path string, old_path string, ratio double")
    got = similar.greedy_match(df, ["k"], "new_path", "old_path", task_pairs=4)
    assert rows(got, "new_path", "old_path", "ratio") == greedy([(r, n, o) for (n, o), r in pairs.items()])


def test_a_block_of_equal_pairs_takes_few_rounds(spark, monkeypatch):
    df = spark.range(90_000).selectExpr("1 AS k", "printf('n%03d', id div 300) AS new_path", "printf('o%03d', id % 300) AS old_path", "0.9D AS ratio")
    taken, one_round = [], similar._one_round
    monkeypatch.setattr(similar, "_one_round", lambda *a: taken.append(1) or one_round(*a))
    got = similar.greedy_match(df, ["k"], "new_path", "old_path", task_pairs=2500)
    assert rows(got, "new_path", "old_path") == [(f"n{k:03d}", f"o{k:03d}") for k in range(300)] and len(taken) <= 5


def test_similar_contents_loses_no_pair(spark):
    """Prefix filtering against scoring every pair."""
    import random
    from collections import Counter

    rng = random.Random(11)
    common = [f"common {i}" for i in range(4)]
    texts = {(s, f"{s}{i}"): [rng.choice(common) if rng.random() < .5 else f"line {rng.randrange(30)}" for _ in range(rng.randrange(1, 14))] for s in (False, True) for i in range(40)}
    data = [("f", 1, 2, s, name, "\n".join(ls) + "\n") for (s, name), ls in texts.items()]
    df = spark.createDataFrame(data, "artifact string, old_seq int, new_seq int, is_new boolean, sha256 string, content string")
    got = {(r["old_sha"], r["new_sha"]): round(r["ratio"], 6) for r in similar.similar_contents(df, 0.55).collect()}
    want = {}
    for (s, a), x in texts.items():
        for (t, b), y in texts.items():
            if not s and t:
                ratio = 2 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y))
                if ratio >= 0.55 - 1e-9:
                    want[(a, b)] = round(ratio, 6)
    assert got == want


def test_options_are_the_documented_defaults():
    assert (CompareOptions().rename_threshold, CompareOptions().min_moved_files, CompareOptions().max_compare_bytes) == (0.55, 3, None)


def test_banded_pairs_give_the_same_renames(spark):
    """Copies and near copies in number, same and other names: both ways agree."""
    import random

    rng = random.Random(8)
    common = [f"shared {i} = {i}" for i in range(12)]

    def texts(side):
        out = {}
        for i in range(60):
            base = common[:rng.choice([8, 10, 12])] if rng.random() < .8 else [f"rare {rng.randrange(5)} {j}" for j in range(6)]
            own = [f"{side} only {i}" * rng.choice([1, 1, 40])] if rng.random() < .6 else [f"{side} tail"]
            name = rng.choice(["LICENSE", f"f{rng.randrange(40)}.py", f"x{i}.py"])
            out[f"{side}{rng.randrange(9)}/{name}"] = "\n".join(base + own) + "\n"
        return out

    files = tree(spark, texts("old"), texts("new"))
    diff = snapshot.stored_changes(snapshot.with_roles(facts.file_facts(files), 1, 2))
    left = snapshot.without_renamed(diff, snapshot.exact_renames(diff))
    direct = rows(similar.similar_renames(left, files), "new_path", "old_path", "ratio")
    banded = rows(similar.similar_renames(left, files, direct_pairs=0), "new_path", "old_path", "ratio")
    assert len(direct) > 20 and banded == direct


def test_band_of_lone_copy_groups_is_the_diagonal(spark):
    step = ("f", 1, 2)
    groups = spark.createDataFrame([(*step, "o", "n", 0.9)], "artifact string, old_seq int, new_seq int, old_handle string, new_handle string, ratio double")
    members = spark.createDataFrame([(*step, side, h, f"{h}{i:03d}") for side, h, count in ((False, "o", 50), (True, "n", 40)) for i in range(count)],
                                    "artifact string, old_seq int, new_seq int, is_new boolean, handle string, path string")
    pairs = similar.banded_pairs(groups, members)
    assert rows(pairs, "new_path", "old_path") == [(f"n{i:03d}", f"o{i + 10:03d}") for i in range(40)]


def test_many_artifacts_and_steps_at_once(spark):
    versions = {("a", 1): {"x.py": "1\n"}, ("a", 3): {"x.py": "2\n"}, ("a", 4): {"y.py": "2\n"}, ("b", 1): {"z": "q\n"}, ("b", 2): {"z": "q\n"}}
    data = [(a, s, p, c, 420) for (a, s), files in versions.items() for p, c in files.items()]
    files = spark.createDataFrame(data, SCHEMA)
    from treeledger.operators import history

    steps = history.version_steps(files.select("artifact", "seq").distinct())
    out = changes.file_changes(changes.renamed_and_changed(files, steps=steps), files)
    assert rows(out, "artifact", "old_seq", "new_seq", "kind", "path") == [("a", 1, 3, "modified", "x.py"), ("a", 3, 4, "renamed", "y.py")]
    none = spark.createDataFrame([("b", 1, 2, "n")], "artifact string, old_seq int, new_seq int, name string")
    totals = changes.comparison_totals(out)
    assert rows(changes.comparison_layers(steps, totals, {"deps": none.where("false")}), "artifact", "new_seq", "is_empty") == [("a", 3, False), ("a", 4, False), ("b", 2, True)]
    assert rows(changes.comparison_layers(steps, totals, {"deps": none}).where("artifact = 'b'"), "deps", "is_empty") == [(1, False)]


def test_text_that_is_gone_is_said_to_be_missing(spark):
    files = tree(spark, {"a.py": "1\n", "b.py": "1\n"}, {"a.py": "2\n", "b.py": "2\n"})
    records = changes.renamed_and_changed(files, 1, 2)
    held = files.where("not (path = 'b.py' and seq = 1)")
    assert rows(changes.file_changes(records, held), "path", "skipped_reason") == [("a.py", None), ("b.py", "missing from the archive")]


def test_summary_words(spark):
    df = spark.createDataFrame([(2, 0, 1, 0, 52, 24, 5, 1, 0), (0, 0, 0, 0, 0, 0, 0, 0, 0), (0, 0, 3, 0, 0, 0, 0, 2, 1)], "added int, removed int, modified int, renamed int, vendored int, al int, rl int, env int, secret int")
    head = changes.headline({k: F.col(k) for k in ("added", "removed", "modified", "renamed", "vendored")})
    effect = changes.impact(F.col("al"), F.col("rl"), {"env var": F.col("env"), "secret": F.col("secret")})
    assert [r[0] for r in df.select(changes.summary_line(head, effect)).collect()] == [
        "2 added, 1 modified, 52 vendored · +24/-5 lines · new: 1 env var", "no file changes", "3 modified · new: 2 env vars, 1 secret"]


def test_many_changed_keys_send_measures_not_texts(spark, monkeypatch):
    """Above the broadcast limit, line hashes and measures meet the keys; the outcome is the same and no text is shuffled."""
    from functools import partial

    from treeledger.operators import changes, durable, similar

    texts = [("a.txt", "x\ny\n", "x\nz\nz"), ("b.txt", "k  l", "k l"), ("c.txt", "", "new"), ("d.txt", "w" * 900, "w" * 901), ("e.txt", "m\nm", None)]
    found = [("p", s, path, t, 420) for path, *sides in texts for s, t in enumerate(sides, 1) if t is not None]
    found += [("p", 1, "old/f.txt", "1\n2\n3\n4", 420), ("p", 2, "new/f.txt", "1\n2\n3\n5", 420)]
    files = spark.createDataFrame(found, "artifact string, seq int, path string, content string, mode int")

    def run():
        records = changes.renamed_and_changed(files, 1, 2)
        measured = changes.text_measures(records, files)
        return records, measured, sorted(map(repr, changes.file_changes(records, files).collect()))

    few = run()[2]
    for module in (changes, similar):
        monkeypatch.setattr(module, "fetch_measured", partial(durable.fetch_measured, limit=0))
    records, measured, many = run()
    assert many == few and any("renamed" in r for r in few)
    plan = measured._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert not any("Exchange" not in line and "Sort [content" in line for line in plan.split("\n"))
    joined = measured._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    assert "whitespace" in joined or "transform(split(" in joined  # measured below the join


@pytest.mark.parametrize("limit", [0, 100_000])
def test_lines_stay_behind_the_shuffle_of_their_file(spark, monkeypatch, limit):
    """A changed file goes to the shuffle as one row a side: no line carries its keys there, and no hash of a content does."""
    from functools import partial

    from treeledger.operators import durable

    monkeypatch.setattr(changes, "fetch_measured", partial(durable.fetch_measured, limit=limit))
    files = tree(spark, {"a.txt": "x\nx\nx\ny", "b.txt": "", "c.txt": "k  l\n", "d.txt": "gone\ngone"}, {"a.txt": "x\nz\nz", "b.txt": "\n", "c.txt": " k l", "e.txt": "p\np\nq"})
    records = changes.renamed_and_changed(files, 1, 2)
    out = changes.file_changes(records, files)
    assert rows(out, "path", "kind", "added_lines", "removed_lines", "skipped_reason") == [
        ("a.txt", "modified", 2, 3, None), ("b.txt", "modified", 1, 0, None), ("c.txt", "modified", 0, 0, "whitespace only"),
        ("d.txt", "removed", 0, 2, None), ("e.txt", "added", 3, 0, None)]
    plan = changes.text_measures(records, files)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and not any("hashpartitioning" in line and "h2#" in line for line in plan.split("\n"))
    whole = out._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    assert "content_differs" in whole.split("\n")[1]  # what the hashes tell is known below the join


def test_a_sieve_loses_no_key_and_passes_few_others(spark):
    """Whatever the number of bits, every wanted row passes; with enough of them hardly any other does."""
    from treeledger.operators import durable

    big = spark.range(40_000).selectExpr("concat('a', id % 7) AS artifact", "CAST(id % 2 AS INT) AS seq", "concat('p/', id) AS at", "CAST(id AS DOUBLE) AS d")
    keys = durable.durable(big.where("hash(at) % 5 = 0").withColumn("seq", F.col("seq").cast("bigint")))
    on, wanted = ["artifact", "seq", "at"], keys.count()
    for bits, most in ((durable.SIEVE_BITS, wanted + 100), (100_000, 20_000), (1_000, 40_000)):
        passed = durable.sieved(big, keys, on, bits)
        assert wanted <= passed.count() <= most
        assert keys.join(passed, on, "left_anti").isEmpty()
    assert durable.sieved(big, keys, ["d"]).count() == 40_000  # equal doubles need not have equal strings


def test_measures_above_the_limit_are_sieved_and_shuffled_once(spark):
    """Rows that no key wants stay behind, and rows dealt by some of the keys need no second shuffle; doubles and nulls join as ever."""
    from treeledger.operators import durable

    big = spark.createDataFrame(
        [("p", 1, "a", "x"), ("p", 2, "a", "y"), ("p", 2, "a", "again"), ("p", 1, "b", None), ("p", 1, None, "n"), ("q", 1, "a", "z")],
        "artifact string, seq int, at string, content string")
    keys = durable.durable(spark.createDataFrame(
        [("p", 1, "a", 5), ("p", 1, "a", 6), ("p", 2, "a", 5), ("p", 1, "b", 7), ("p", 1, None, 8), ("r", 1, "a", 9)], "artifact string, seq int, at string, step int"))
    on = ["artifact", "seq", "at"]
    few, many = (durable.fetch_measured(big, keys, on, [F.upper("content").alias("up")], limit=limit, by=["artifact", "at"]) for limit in (100, 0))
    picked = [*on, "step", "up"]
    assert rows(many, *picked) == rows(few, *picked) and many.count() == 5
    plan = many.groupBy("artifact", "at", "up").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(artifact") == 1 and "LeftSemi" in plan

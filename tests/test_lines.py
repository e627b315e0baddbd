"""Content differences beside plain versions."""

import random

from helpers import rows

from pyspark.sql import functions as F

from treeledger.operators import alignment, lines, similar
from treeledger.options import CompareOptions


def pairs(spark, data):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "id int, old_content string, new_content string")


def edits(seed, n=14):
    rng, data = random.Random(seed), []
    for _ in range(n):
        old = [f"line {rng.randrange(12)}" for _ in range(rng.randrange(0, 25))]
        new = [x for x in old if rng.random() > .2] + [f"new {rng.randrange(5)}" for _ in range(rng.randrange(0, 4))]
        data.append(("\n".join(old), "\n".join(new)))
    return [*data, ("", "a\nb"), ("a\nb", ""), ("a\nb\nc\nd", "c\nd\na\nb"), ("x\n" * 5 + "y", "x\n" * 7 + "y")]


def plain_match(old, new):
    """The same rule stated item by item."""
    unique = [(old.index(x), new.index(x)) for x in old if old.count(x) == 1 and new.count(x) == 1]
    steady = [(i, j) for i, j in unique if all((i < p) == (j < q) for p, q in unique if (p, q) != (i, j))]
    out = list(steady)
    for (i, j), (p, q) in zip([(-1, -1), *steady], [*steady, (len(old), len(new))]):
        k = 1
        while i + k < p and j + k < q and old[i + k] == new[j + k]:
            out.append((i + k, j + k))
            k += 1
        m = 1
        while p - m >= i + k and q - m >= j + k and old[p - m] == new[q - m]:
            out.append((p - m, q - m))
            m += 1
    return sorted(out)


def test_matching_equals_plain_rule(spark):
    data = edits(4)
    split = [[t.split("\n") if t else [] for t in pair] for pair in data]
    items = spark.createDataFrame([(k, side == 1, n + 1, x) for k, pair in enumerate(split) for side, seq in enumerate(pair) for n, x in enumerate(seq)], "id int, is_new boolean, no long, item string")
    got = rows(alignment.matched(items, ["id"]), "id", "old_no", "new_no")
    assert got == sorted(((k, i + 1, j + 1) for k, (old, new) in enumerate(split) for i, j in plain_match(old, new)), key=repr)


def test_line_ops_rebuild_both_sides(spark):
    data = edits(5)
    whole = lines.line_ops(pairs(spark, data), ["id"], CompareOptions(context_lines=1000)).collect()
    near = lines.line_ops(pairs(spark, data), ["id"]).collect()
    for k, (a, b) in enumerate(data):
        mine = [o for o in whole if o["id"] == k]
        if a != b:
            assert [o["line"] for o in sorted((o for o in mine if o["old_no"]), key=lambda o: o["old_no"])] == (a.split("\n") if a else [])
            assert [o["line"] for o in sorted((o for o in mine if o["new_no"]), key=lambda o: o["new_no"])] == (b.split("\n") if b else [])
        assert sum(o["op"] != "keep" for o in mine) == sum(o["op"] != "keep" for o in near if o["id"] == k)


def test_hunks_hold_three_lines_of_context(spark):
    old = [f"l{k}" for k in range(40)]
    new = [*old[:10], "x", *old[10:30], *old[31:]]
    got = rows(lines.line_ops(pairs(spark, [("\n".join(old), "\n".join(new))]), ["id"]), "hunk", "op")
    assert got == sorted([(1, "keep")] * 6 + [(1, "add")] + [(2, "keep")] * 6 + [(2, "del")], key=repr)


def test_gates_come_first(spark):
    data = [("a\n\tb\n", "a\n  b\n"), ("x" * 900, "x" * 900 + "1"), ("same", "same")]
    assert lines.line_ops(pairs(spark, data), ["id"]).count() == 0
    assert lines.line_ops(pairs(spark, [("a", "bb")]), ["id"], CompareOptions(max_compare_bytes=1)).count() == 0


def test_pair_lines(spark):
    old = "keep\nvalue = compute(alpha, 1)\nzzzz qqqq\nmid\nlast = 1\nend\n"
    new = "keep\nvalue = compute(alpha, 2)\nmid\nlast = 2\nend\n"
    script = lines.line_script(pairs(spark, [(old, new)]), ["id"])
    assert rows(lines.pair_lines(script, ["id"]), "old_no", "new_no") == [(2, 2), (5, 4)]


def test_rewrite_behind_a_new_line_is_paired(spark):
    old = "keep\nvalue = compute(alpha, 1)\nother = load(beta, gamma)\n\nend\n"
    new = "keep\n# quite another remark here\nvalue = compute(alpha, 2)\nother = load(beta, delta)\nend\n"
    script = lines.line_script(pairs(spark, [(old, new)]), ["id"])
    assert rows(lines.pair_lines(script, ["id"]), "old_no", "new_no") == [(2, 3), (3, 4)]


def test_pair_lines_equals_every_pair(spark):
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 6)))
    script = [(k, 0, op, n if op == "del" else None, n if op == "add" else None, line()) for k in range(12) for op in ("del", "add") for n in range(1, 2 + rng.randrange(7))]
    df = spark.createDataFrame(script, "id int, gap long, op string, old_no long, new_no long, item string")

    def words(x):
        return set(x.split(" ")) - {""} | ({" "} if " " in x else set())

    want = []
    for k in range(12):
        olds, news = ({r[3] or r[4]: words(r[5]) for r in script if r[0] == k and r[2] == op} for op in ("del", "add"))
        scored = [(round(2 * len(a & b) / (len(a) + len(b)), 6) if a or b else 1.0, i, j) for i, a in olds.items() for j, b in news.items()]
        used_old, used_new = set(), set()
        for r, i, j in sorted((s for s in scored if s[0] >= .5), key=lambda s: (-s[0], s[1], s[2])):
            if i not in used_old and j not in used_new:
                used_old.add(i)
                used_new.add(j)
                want.append((k, i, j, r))
    assert rows(lines.pair_lines(df, ["id"]), "id", "old_no", "new_no", "ratio") == sorted(want, key=repr)


def test_changed_span_does_not_overlap(spark):
    got = lines.with_changed_span(pairs(spark, [("aaa", "aaaa"), ("abcd", "abXd"), ("", "x"), ("ab", "ab")]))
    assert rows(got, "head", "tail", "was", "now") == [(0, 0, "", "x"), (2, 0, "", ""), (2, 1, "c", "X"), (3, 0, "", "a")]


def test_long_line_edits(spark):
    base = "e){var t=" + "a=1;" * 300
    old, new = base + "const n=1;mid m=3;tail", base + "const n=22;mid m=4;tail"
    got = lines.long_line_edits(pairs(spark, [(old, new), ("x" * 5000, "y" * 5000)]), ["id"]).orderBy("id", "at").collect()
    assert [(r["before"], r["after"]) for r in got[:2]] == [("1", "22"), ("3", "4")]
    assert new[got[0]["at"]:].startswith("22") and got[0]["trail"].startswith(";mid") and new[got[1]["at"]:].startswith("4;tail")
    assert (got[2]["before"], got[2]["after"]) == ("x" * 5000, "y" * 5000)


def test_word_spans(spark):
    df = spark.createDataFrame([(1, "a = foo(1)", "a = foo(2)"), (2, "abc", "xyz"), (3, "s", "s")], "id int, before string, after string")
    got = {r["id"]: (r["old_spans"], r["new_spans"]) for r in lines.word_spans(df, ["id"]).collect()}
    assert got == {1: ([[8, 9]], [[8, 9]]), 2: ([], []), 3: ([], [])}


def test_one_moved_line_costs_only_itself(spark):
    old = [f"line {k}" for k in range(40)]
    new = [*old[1:], old[0]]
    df = pairs(spark, [("\n".join(old), "\n".join(new))])
    got = rows(lines.line_ops(df, ["id"], CompareOptions(context_lines=0)), "op", "old_no", "new_no")
    assert got == [("add", None, 40), ("del", 1, None)]


def test_gaps_have_anchors_of_their_own(spark):
    assert sorted(alignment.align(list("xaxbxmyaxbx"), list("axbmaxb"))) == [(1, 0), (2, 1), (3, 2), (5, 3), (7, 4), (8, 5), (9, 6)]


def test_rename_survives_a_moved_line(spark):
    old = [f"line {k}" for k in range(20)]
    contents = spark.createDataFrame([("a", 1, 2, False, "o", "\n".join(old)), ("a", 1, 2, True, "n", "\n".join([*old[1:], old[0]]))],
                                     "artifact string, old_seq int, new_seq int, is_new boolean, sha256 string, content string")
    scores = spark.createDataFrame([("a", 1, 2, "o", "n")], "artifact string, old_seq int, new_seq int, old_class string, new_class string")
    assert rows(similar.with_ordered_ratio(scores, contents, .55), "ratio") == [(.95,)]


def test_ordered_ratio_by_the_rule_of_the_sql(spark):
    """Crossing lines and gaps with anchors of their own, where ``aligned`` matches more."""
    import duckdb
    from treeledger.operators import similar
    from treeledger.operators.alignment import aligned, matched, sql_matched

    texts = {"o1": "a\nb\nc\nd\ne\nf", "n1": "f\na\nb\nc\nd\ne", "o2": "x\na\nx\nb\ny\ny", "n2": "y\na\ny\nb\nx\nz"}
    contents = spark.createDataFrame([("p", 1, 2, k[0] == "n", k, v) for k, v in texts.items()], "artifact string, old_seq int, new_seq int, is_new boolean, sha256 string, content string")
    pairs = spark.createDataFrame([("p", 1, 2, f"o{k}", f"n{k}") for k in (1, 2)], "artifact string, old_seq int, new_seq int, old_class string, new_class string")

    def ratios(match):
        return {r.old_class: r.ratio for r in similar.with_ordered_ratio(pairs, contents, 0.0, match).collect()}

    items = ", ".join(f"({k}, {side}, {i}, '{line}')" for k in (1, 2) for side, name in (("false", "o"), ("true", "n")) for i, line in enumerate(texts[f"{name}{k}"].split("\n"), 1))
    want = duckdb.sql(f"WITH it AS (SELECT * FROM (VALUES {items}) AS v(pair, is_new, no, item)), {sql_matched('it', 'pair')} SELECT pair, 2.0 * count(*) / 12 FROM matched GROUP BY pair").fetchall()
    assert {k: v for k, v in ratios(matched).items() if v} == {f"o{k}": float(v) for k, v in want}
    assert ratios(aligned)["o1"] > ratios(matched)["o1"]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_token_delta_counts_a_key_where_it_lies(spark):
    """Repeated and null keys are one group, texts without words give no row, and no row per word is made."""
    df = spark.createDataFrame([(1, "a b a", "a c"), (1, "b", "b  b"), (None, "x", None), (None, "x", "x"), (2, "", ""), (3, None, None), (4, None, "p.q")], "id int, old_content string, new_content string")
    got = lines.token_delta(df, ["id"])
    assert rows(got, "id", "old_tokens", "new_tokens", "shared", "added_tokens", "removed_tokens", "similarity") == sorted(
        [(1, 6, 6, 4, 2, 2, .666667), (None, 2, 1, 1, 0, 1, .666667), (4, 0, 3, 0, 3, 0, .0)], key=repr)
    assert "Generate" not in plan(got)


def test_row_script_equals_the_script_of_shuffled_items(spark):
    df = pairs(spark, edits(11)).withColumns({c: F.split(c, "\n") for c in ("old_content", "new_content")})
    items = lines.numbered_sides(df, ["id"], F.col("old_content"), F.col("new_content"))
    columns = ("id", "gap", "op", "old_no", "new_no", "item")
    for whole, match in ((alignment.align, alignment.aligned), (alignment.steady, alignment.matched)):
        script = alignment.row_script(df, ["id"], F.col("old_content"), F.col("new_content"), whole)
        assert rows(script, *columns) == rows(alignment.edit_script(items, ["id"], match), *columns)


def test_line_ops_match_where_the_texts_lie(spark):
    """One shuffle, of the lines that are shown."""
    got = plan(lines.line_ops(pairs(spark, edits(5)), ["id"])).split("== Physical Plan ==")[1]
    assert got.count("Exchange ") == 1 and "FlatMapGroupsInPandas" not in got


def test_long_line_edits_are_the_same_by_both_routes(spark):
    rng = random.Random(3)
    data = [tuple(" ".join(rng.choice("abcdefghijkl") for _ in range(30)) for _ in range(2)) for _ in range(20)]
    near, shared = (lines.long_line_edits(pairs(spark, data), ["id"], whole=n) for n in (10**6, 40))
    columns = ("id", "at", "before", "after", "lead", "trail")
    assert rows(near, *columns) == rows(shared, *columns)


def test_small_groups_are_assigned_together(spark):
    """Many groups to a call, each on its own, with keys that a float cannot hold."""
    big = 2**60
    data = [(g, left, right, float((left * right + (g or 0)) % 3)) for g in [None, *range(big, big + 40)] for left in (1, 2) for right in (1, 2)]
    df = spark.createDataFrame(data, "k bigint, l int, r int, ratio double")
    want = []
    for g in {d[0] for d in data}:
        used = set()
        for _, a, b, s in sorted((d for d in data if d[0] == g), key=lambda d: (-d[3], -d[1], -d[2])):
            if ("l", a) not in used and ("r", b) not in used:
                used |= {("l", a), ("r", b)}
                want.append((g, a, b, s))
    got = similar.greedy_match(df, ["k"], "l", "r")
    assert rows(got, "k", "l", "r", "ratio") == sorted(want, key=repr)
    assert "_bundle" in plan(got)

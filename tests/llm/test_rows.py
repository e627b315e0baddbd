"""Mixing, shards and fingerprints beside plain versions, and their edge cases."""

import collections
import hashlib
import zlib

import brute

from treeledger.llm import merkle, mixing, sharding
from treeledger.llm.registry import QUERIES

EDGES = [
    (1, "One. Two! Three?\nFour", "en", "a", 3), (2, "One. Two! Three?\nFour", "en", "a", 3), (3, None, None, None, None), (4, "", "de", "b", 0),
    (None, "no id", "en", "b", 5), (6, "é" * 20_000 + ".\n" + "x. " * 3000, "fr", "c", 1), (6, "again six", "fr", "c", 1), (7, "a.\x1fb", "x", "d", 2),
    (8, "a. b", "x", "d", 2), (8, "a. b", "x", "d", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_dir(spark, tmp_path, rows=EDGES):
    clash = spark.createDataFrame([(*r, k, "key", k) for k, r in enumerate(rows)], SCHEMA + ", copy_ int, key_ string, shard int")
    clash.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return clash


def test_mixture(spark):
    rows = [(k, "s0" if k % 3 else f"s{k % 7}", f"text {k}") for k in range(600)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, source string, text string, copy_ string, carried0_ int")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert [(r.doc_id, r.source, r.text) for r in got.collect()] == [r for r, _ in brute.mixture(rows, mixing.SEED)]


def test_mixture_meets_targets(spark):
    docs = spark.createDataFrame([(k, "big" if k % 10 else "small") for k in range(8000)], "doc_id long, source string")
    out = collections.Counter(r.source for r in mixing.mixed(docs, weights={"big": 1, "small": 3}, total=12_000).collect())
    assert abs(out["small"] - 9000) < 400 and abs(out["big"] - 3000) < 250
    many = mixing.mixed(docs.limit(3), total=3 * 2000.0).count()
    assert abs(many - 6000) < 500


def test_edges(spark, tmp_path):
    docs = edge_dir(spark, tmp_path)
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and mixing.mixed(docs.limit(0)).count() == 0
    shards = QUERIES["op8_stratified_shards"](spark, str(tmp_path)).collect()
    assert sorted(r.shard * 0 + r.slot for r in shards) == [0] * 10 and len({r.shard for r in shards}) == 10
    text = {(d, t): (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in EDGES}
    assert sorted((r.size, r.text_crc32) for r in shards) == sorted(text[r[:2]] for r in EDGES)
    edge_dir(spark, tmp_path, [])
    for name in ("op1_poisson_mix", "op5_merkle_tree", "op8_stratified_shards", "op10_previous_factors", "op7_variable_best_fit"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_shards_match_the_mixture(spark):
    docs = spark.createDataFrame([(k, "x" * (k % 9), "hot" if k % 3 else f"s{k % 11}") for k in range(5000)], "doc_id long, text string, source string")
    rows = sharding.stratified_shards(docs, 16).collect()
    counts, of = collections.Counter(r.shard for r in rows), collections.Counter((r.shard, r.source) for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in range(16))
    for source, n in collections.Counter(r.source for r in rows).items():
        assert all(abs(of[s, source] - n / 16) <= 1 + n / 5000 * 12 for s in range(16)), source


def plain_tree(text):
    short = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    paragraphs, leaves = [], []
    for p in text.split("\n"):
        mine, last = [], 0
        for k in range(len(p) - 1):
            if p[k] in ".!?" and p[k + 1] == " ":
                mine.append(p[last:k + 2])
                last = k + 2
        mine.append(p[last:])
        mine = [q for m in mine for q in m.split("\x1f")]
        leaves.append([f"{short(x)}:{len(x)}" for x in mine])
        paragraphs.append(short(",".join(leaves[-1])))
    sections, run = [], []
    for k, p in enumerate(paragraphs):
        run.append(p)
        if p[15] in "0123" or k == len(paragraphs) - 1:
            sections.append(short(",".join(run)))
            run = []
    return hashlib.sha256(",".join(sections).encode()).hexdigest(), sections, leaves


def test_fingerprints(spark, tmp_path):
    edge_dir(spark, tmp_path)
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint[:64], r.fingerprint.split("/")[1], round(r.near_edited, 9)) for r in QUERIES["op5_merkle_tree"](spark, str(tmp_path)).collect())
    order = sorted(((d, t or "") for d, t, *_ in EDGES), key=lambda r: (brute.LOWEST if r[0] is None else r[0], r[1].encode()))
    want = collections.Counter()
    for k, (d, t) in enumerate(order):
        follower = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + follower[:cut]
        (root, sections, leaves), (other, _, changed) = plain_tree(t), plain_tree(edited)
        a, b = ({x for p in tree for x in p} for tree in (leaves, changed))
        size = lambda s: sum(int(x[17:]) for x in s)
        near = 1.0 if root == other else 2 * size(a & b) / (size(a) + size(b)) if size(a) + size(b) else 0.0
        want[(d, len(t), hashlib.sha256(edited.encode()).hexdigest(), root, ",".join(sections), round(near, 9))] += 1
    assert got == want
    assert plain_tree("a.\x1fb")[0] != plain_tree("a. b")[0]


def test_many_slices_give_the_same_followers(spark):
    docs = spark.createDataFrame([((k * 37) % 1001, f"t{k}") for k in range(1001)], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in merkle.with_next_text(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert got == {d: text[(d + 1) % 1001] for d in text}

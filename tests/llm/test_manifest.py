"""The manifest tree beside a plain one."""

import collections
import hashlib
import zlib

from treeledger.llm import manifest
from treeledger.llm.registry import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [
    (4, "a\nb", "en", "x", 3), (8, "a\nb", "en", "x", 3), (None, "no id\n", None, "x", 5), (6, None, "fr", None, None), (6, "", "fr", None, 0), (6, "", "fr", None, 0),
    (1, "é\n" * 30_000, "fr", "é", 1), (2, "z", "de", "z", 1), (3, "\n", "de", "z", 1), (4, "a\nb", "en", "x", 3),
]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climbed(nodes):
    """The top of a list of nodes, and per node its (left, right) siblings."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 3 * 3:p // 3 * 3 + 3]
            paths[k].append(("".join(run[:p % 3]), "".join(run[p % 3 + 1:])))
        nodes, at = [sha(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], paths


def plain(rows):
    by_source, out = collections.defaultdict(list), collections.Counter()
    for r in rows:
        by_source[r[3]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        members = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = (members, *climbed([leaf(*r) for r in members]))
    root, tops = climbed([trees[s][1] for s in order])
    for s, top in zip(order, tops):
        members, subroot, paths = trees[s]
        for r, path in zip(members, paths):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf(r[0], r[1].replace("\n", "") if tampered else r[1], *r[2:])
            for left, right in path + top:
                node = sha(left, node, right)
            out[(r[0], leaf(*r), subroot, root, sha(*(x for pair in path + top for x in pair)), node, node == root)] += 1
    return out


def result(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_edges(spark, tmp_path):
    clash = spark.createDataFrame([(*r, "g", 1, "p") for r in EDGES], SCHEMA + ", `group` string, at int, digest string")
    clash.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = result(QUERIES["op11_merkle_manifest"](spark, f"{tmp_path}/a"))
    assert got == plain(EDGES)
    assert {k[6] for k in got} == {True, False}
    for name, rows in (("one", EDGES[:1]), ("none", [])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert result(QUERIES["op11_merkle_manifest"](spark, f"{tmp_path}/{name}")) == (plain(rows) if rows else {})


def test_blocks_of_any_depth_give_one_tree(spark):
    rows = [(k * 7 % 400, f"t{k}\n", "en", "hot" if k % 3 else f"s{k % 90}", k) for k in range(400)]
    docs, want = spark.createDataFrame(rows, SCHEMA), plain(rows)
    for depth in (1, 2, 5):
        out = manifest.manifest(docs, depth=depth)
        got = {r.doc_id: (r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in out.collect()}
        assert len(got) == 400
        for doc_id, leaf_, subroot, root, proof, *_ in want:
            assert got[doc_id][:3] == (leaf_, subroot, root) and sha(*(x for s in got[doc_id][3] for x in s)) == proof
            node = leaf_
            for left, right in got[doc_id][3]:
                node = sha(left, node, right)
            assert node == root

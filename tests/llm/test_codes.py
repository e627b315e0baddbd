"""Vector codes beside a plain version of Lloyd's rounds."""

import hashlib
import math

import numpy as np

from treeledger.llm import codes
from treeledger.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, rounds=6, entries=16):
    """vec_id, code, error, label_error, codebooks_sha256 of rows of one length."""
    kept = [(i, [math.floor(min(max(4096 * x, -2**26), 2**26)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    n = len(kept[0][1])
    cut = lambda v, p: v[p * n // 8:(p + 1) * n // 8]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, part: min(range(len(books[p])), key=lambda e: (far(part, books[p][e]), e))
    for _ in range(rounds):
        for p in range(8):
            of = [near(p, cut(v, p)) for _, v, _ in kept]
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), o in zip(kept, of) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], {}
    for i, v, label in kept:
        code = [near(p, cut(v, p)) for p in range(8)]
        error = sum(far(cut(v, p), books[p][e]) for p, e in enumerate(code))
        by[label] = by.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in code), error, label))
    return sorted(((i, c, e, by[label], digest) for i, c, e, label in out), key=repr)


def query(spark, folder, rows):
    spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", row_id int, length int, code string").write.parquet(f"{folder}/embeddings.parquet")
    return sorted((tuple(r) for r in QUERIES["op12_member_lloyd"](spark, str(folder)).collect()), key=repr)


def vector(k, width=16):
    return [float(np.float32(math.sin(k * 12.9898 + j * 78.233))) for j in range(width)]


def test_equals_plain_rounds(spark, tmp_path):
    rows = [(k * 3 % 211, vector(k), k % 4 if k % 5 else None) for k in range(211)]
    rows += [(300, None, 1), (301, [float("nan")] * 16, 1), (302, [1.0, None] * 8, 1), (303, [float("inf")] * 16, 1), (304, [0.0] * 16, 2), (305, [9e9] + [-3e5] * 15, 2)]
    rows += [(None, vector(900), 1), (7, vector(7), 3), (7, vector(7), 3)] + [(1000 + k, vector(5), 9) for k in range(120)]
    assert query(spark, tmp_path, rows) == plain(rows)


def test_few_and_no_rows(spark, tmp_path):
    rows = [(k, vector(k), None) for k in range(5)] + [(9, vector(1), None)]
    assert query(spark, tmp_path / "few", rows) == plain(rows)
    assert query(spark, tmp_path / "none", []) == [] == query(spark, tmp_path / "null", [(1, None, 1)])


def test_each_length_has_its_own_codebooks(spark, tmp_path):
    rows = {n: [(100 * n + k, vector(k, n), n) for k in range(20)] for n in (3, 0, 20)}
    got = query(spark, tmp_path, [r for part in rows.values() for r in part])
    assert got == sorted((r for part in rows.values() for r in plain(part)), key=repr)


def test_only_changed_members_move(spark):
    rows = codes.integers(spark.createDataFrame([(k, vector(k, 8), 0) for k in range(500)], SCHEMA))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    books = codes.first_codebooks(rows, codes.ENTRIES)
    members = codes.settle(rows, books, partitions)
    homes = members.mapPartitionsWithIndex(lambda k, records: ((k == to) for to, _ in records)).collect()
    assert all(homes)
    after = codes.summed(members, books, partitions)
    changed = codes.judged(members, after, partitions).map(lambda r: (r[0], len(r[2][1]))).reduceByKey(lambda a, b: a + b).collectAsMap()
    assert changed[True] + changed[False] == 500 * 8 and changed[True] < changed[False]
    final, _ = codes.trained(rows)
    assert final.getNumPartitions() == partitions
    assert all(final.mapPartitionsWithIndex(lambda k, records: ((k == to) for to, _ in records)).collect())

import random

import brute
import numpy as np
import pytest

from treeledger.llm import suffixes


def passages():
    rng = random.Random(3)
    base = ["".join(rng.choice(["ab", "é", "xyz ", "q", "lorem ", "ß", "\n"]) for _ in range(rng.choice([5, 40, 200]))) for _ in range(12)]
    rows = []
    for k in range(100):
        parts = []
        for _ in range(rng.randrange(5)):
            b = rng.choice(base)
            parts.append(b[rng.randrange(len(b)):][:rng.choice([20, 60, 300])])
        rows.append((k if k % 17 else None, "".join(parts) if k % 23 else None))
    return rows + [(5, base[0] * 3), (500, "a" * 3000), (501, "a" * 700 + "b" * 60), (502, "b" * 60), (503, "x" * 49), (504, "x" * 49), (505, base[1] + base[2]), (505, base[1] + base[2]), (506, base[1] + base[2]), (None, base[1] + base[2] + base[3])]


def digests(docs):
    dealt, spans = suffixes.removal_plan(docs, suffixes.LEAST)
    return dealt.groupBy("chunk__").cogroup(spans.groupBy("chunk")).applyInArrow(suffixes.digests, suffixes.DIGESTS)


def test_equals_brute_force(spark):
    rows = passages()
    got = digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute.removal_digests(rows)


def test_whole_table_equals_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    from treeledger.llm.registry import QUERIES

    got = QUERIES["op10_previous_factors"](spark, str(small_dir)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute.removal_digests([tuple(r) for r in docs.collect()])


def test_pieces_of_long_texts_cover_every_window(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 100)
    data = np.arange(1000, dtype=np.int64).astype(np.uint8)
    seen = set()
    for text, starts, rows, at in suffixes.pieces(data, np.array([0, 30, 650, 1000]), 50):
        for k, (row, s) in enumerate(zip(rows, at)):
            seen |= {(int(row), int(s) + w) for w in range(starts[k + 1] - starts[k] - 49)}
    assert seen == {(1, w) for w in range(571)} | {(2, w) for w in range(301)}


def test_kept_texts_lose_whole_characters_only(spark):
    rows = [(d, t, k, f"c{k}", None) for k, (d, t) in enumerate(passages()) if d is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int, order__ string, spans int")
    kept = suffixes.without_repeats(docs)
    assert kept.columns == docs.columns
    want = {r[2]: (brute.kept_text(*x) if r[1] is not None else None) for r, x in zip(rows, brute.removed([r[:2] for r in rows]))}
    assert {r.chunk: r.text for r in kept.collect()} == want
    assert suffixes.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 40])
def test_united(n):
    rng = np.random.default_rng(n)
    spans = np.column_stack([rng.integers(0, 3, n), rng.integers(0, 60, n), np.zeros(n, int)]).astype(np.int32)
    spans[:, 2] = spans[:, 1] + rng.integers(1, 9, n)
    marks = np.zeros((3, 80), bool)
    for r, lo, hi in spans:
        marks[r, lo:hi] = True
    got = np.zeros((3, 80), bool)
    out = suffixes.united(spans)
    for r, lo, hi in out:
        assert not got[r, max(0, lo - 1):hi + 1].any()
        got[r, lo:hi] = True
    assert (got == marks).all()

import random

import brute

from treeledger.llm import packing
from treeledger.llm.packing import Packing


def test_equals_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        options = Packing(lengths=(8, 16, 32), quadratic=64.0, start=2.0)
        sizes = sorted((rng.randrange(1, 33) for _ in range(rng.randrange(60))), reverse=True)
        assert packing.pack(sizes, options) == brute.packed(sizes, options)


def check(rows, sizes, options):
    """Every token is packed once; sequences do not overflow, overlap or keep a needless length."""
    whole, held = {}, {}
    for r in rows:
        if r.n_tokens:
            whole.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
            held.setdefault((r.sequence_id, r.sequence_length), []).append((r.position, r.n_tokens))
    assert {d: sum(n for _, n in p) for d, p in whole.items()} == {d: n for d, n in sizes.items() if n}
    assert len({s for s, _ in held}) == len(held)
    for (_, length), parts in held.items():
        used = 0
        for at, n in sorted(parts):
            assert at == used
            used += n
        assert length == min(c for c in options.lengths if c >= used)


def test_whole_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    options = Packing(group_items=50)
    rows = packing.best_fit(docs, options).collect()
    check(rows, {r.doc_id: len(r.text.split()) for r in docs.collect()}, options)
    one = packing.best_fit(docs).where("n_tokens > 0").collect()
    sizes = sorted((r.n_tokens for r in one), reverse=True)
    want = brute.packed(sizes, Packing())
    assert sorted((r.n_tokens, r.sequence_id & 0xFFFFFFFF, r.sequence_length, r.position) for r in one) == sorted((n, *w) for n, w in zip(sizes, want))


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "w " * 10_000, "d"), (5, "w", "e"), (5, "w", "e"), (None, "x y", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group string")
    out = packing.best_fit(docs).collect()
    assert sum(r.n_tokens for r in out) == 10_004 and len(out) == 9
    assert all(r.sequence_id is None for r in out if r.doc_id in (1, 2, 3))
    assert sorted(r.n_tokens for r in out if r.doc_id == 4) == [1808, 4096, 4096]
    assert packing.best_fit(docs.limit(0)).count() == 0

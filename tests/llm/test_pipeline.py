"""run() beside a brute-force version of its stages."""

import brute
import numpy as np

import corpus_pipeline
from treeledger.llm import langid, mixing
from treeledger.llm.packing import Packing


def test_run_equals_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    net = langid.learned(docs)
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    bodies = [t.encode() for _, _, t in rows]
    pooled, _ = langid.label_documents(net, np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)]))
    rows = [r for r, p in zip(rows, pooled) if any(c.isalpha() for c in r[2]) and p.max() >= 0.3]
    least = {d: c for d, _, c in brute.similar([(d, t) for d, _, t in rows], 5, 80)}
    rows = [r for r in rows if least[r[0]] == r[0]]
    rows = [(d, s, brute.kept_text(*x)) for (d, s, _), x in zip(rows, brute.removed([(d, t) for d, _, t in rows]))]
    rows = [r for r, _ in brute.mixture(rows, mixing.SEED)]
    longest = max(Packing().lengths)
    items, empty = [], 0
    for d, _, t in rows:
        n = len(t.split())
        items += [(d, k, min(longest, n - k * longest)) for k in range(-(-n // longest))]
        empty += n == 0
    got = corpus_pipeline.run(spark, str(small_dir)).collect()
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in got if r.n_tokens) == sorted(items)
    assert sum(r.n_tokens == 0 for r in got) == empty
    sizes = sorted((n for *_, n in items), reverse=True)
    want = sorted((n, *w) for n, w in zip(sizes, brute.packed(sizes, Packing())))
    assert sorted((r.n_tokens, r.sequence_id & 0xFFFFFFFF, r.sequence_length, r.position) for r in got if r.n_tokens) == want


def test_stages_keep_the_columns_and_bear_odd_rows(spark):
    rows = [(k, f"the words of document {k} and more of them number {k * 7}", "en", "s0", 9, "x", k) for k in range(40)]
    rows += [(100, None, None, None, None, None, 1), (101, "", "en", "s1", 0, "y", 2), (3, rows[3][1], "en", "s0", 9, "x", 3), (None, "a text without id", "en", None, 1, "", 4), (7, rows[7][1] + " long" * 40_000, "en", "s0", 9, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, chunk string, component_id long")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "unused")
            assert now.dtypes == docs.dtypes
        assert corpus_pipeline.STAGES[-1][1](spark, now, "unused").count() >= 0
    language = corpus_pipeline.STAGES[0][1](spark, docs, "unused")
    assert language.where("doc_id in (100, 101)").count() == 0 and language.count() == len(rows) - 2

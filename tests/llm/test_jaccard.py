import random

import brute
import pytest

from treeledger.llm import jaccard

EDGES = [None, "", "  \n", "One", "one", "One two", "one\ttwo", "É x", "é x", "a b c", "A  b\nC"]


def near_copies(seed):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(300)]
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 11, 14, 30, 200, 700]))]
        for c in range(rng.choice([1, 2, 8, 20])):
            words = list(base)
            for _ in range(rng.randrange(max(2, len(base) // 12))):
                p = rng.randrange(len(words))
                words[p:p + rng.randrange(2)] = [rng.choice(vocabulary)]
            rows.append((len(rows), (" " if c % 2 else "\t\n").join(words)))
    return rows + [(len(rows) + k, t) for k, t in enumerate(EDGES)]


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 1024), (5, 80, 4)])
def test_equals_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(words)
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Rule(words, percent)).collect()
    assert sorted(tuple(r) for r in got) == brute.similar(rows, words, percent)


def test_signatures_meet(spark):
    """Sets at the allowed distance share a signature, whatever their sizes."""
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (5, 9, 10, 18, 19, 57, 130, 700, 1500, 5000):
        for percent in (80, 90):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            differ = size * (100 - percent) // (100 + percent)
            for drop in (0, differ // 2, differ):
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**64, differ - drop, dtype=np.uint64)]))
                shared = len(np.intersect1d(a, b))
                if 100 * shared >= percent * (len(a) + len(b) - shared) and not np.array_equal(a, b):
                    assert np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)).size, (size, percent, drop)


def test_very_long_words_and_texts():
    import numpy as np

    text = b"ab " * 10 + b"x" * jaccard.PIECE + b" yy " + b"z" * (jaccard.PIECE + 5) + b" q " + b"x" * jaccard.PIECE
    hashes = jaccard.word_hashes(np.frombuffer(text, np.uint8))
    assert len(hashes) == 15 and hashes[10] == hashes[-1] and len(set(hashes.tolist())) == 5


def test_ties_nulls_extra_columns_and_empty_tables(spark):
    text = "one two three four five six"
    rows = [(7, text, 1, "a"), (3, text, 2, "b"), (None, text, 3, "c"), (3, text, 4, "b"), (None, "alone here", 5, None), (9, None, 6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, node string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()}
    assert got == {(7, 2, 3), (3, 2, 3), (None, 2, 3), (None, 1, None), (9, 0, 9)}
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.n for r in kept.collect()) in ([2, 5, 6], [4, 5, 6])
    assert jaccard.similar_documents(docs.limit(0)).count() == 0 and jaccard.one_of_each(docs.limit(0)).count() == 0


def test_null_and_repeated_ids_are_linked_by_their_own_texts(spark):
    base, other, third = (" ".join(f"{w}{k}" for k in range(30)) for w in "abc")
    rows = [(5, base), (None, base + " more"), (None, other), (None, other), (7, third), (7, base), (8, third + " more"), (7, "")]
    got = sorted((tuple(r) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()), key=repr)
    assert got == sorted([(5, 5), (None, 5), (None, None), (None, None), (7, 7), (7, 5), (8, 7), (7, 7)], key=repr)
    kept = sorted(jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=repr)
    assert sorted((tuple(r) for r in kept), key=repr) == sorted([(5, base), (None, other), (7, third), (7, "")], key=repr)


def test_a_hot_row_without_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.range(9000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", f"IF(id % 3 = 0, '{text}', concat_ws(' ', 'own', id, id + 1, id + 2, id + 3, id + 4, id + 5)) AS text")
    assert jaccard.one_of_each(docs).count() == 6001


@pytest.mark.parametrize("pairs", [50, 1 << 18])
def test_buckets_join_families_and_keep_large_strangers_apart(monkeypatch, pairs):
    """All sets share one key, the families some more; no sketch lets strangers through, whatever their size."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    rng, sets, family = np.random.default_rng(3), [], []
    for f, size in enumerate((30, 300, 790, 810, 1500, 1700, 3100, 3300, 5000)):
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        for _ in range(6):
            sets.append(np.unique(np.concatenate([base[size // 25:], rng.integers(0, 2**64, size // 25, dtype=np.uint64)])))
            family.append(f)
    order = rng.permutation(len(sets))
    docs, sizes = np.arange(len(sets)) * 10, np.array([len(sets[k]) for k in order])
    folds = [jaccard.folded(jaccard.parity_sketch(sets[k]), int(jaccard.fold_words(len(sets[k])))).tobytes() for k in order]
    keys = np.concatenate([np.zeros(len(sets), np.uint64), np.array([family[k] + 1 for k in order], np.uint64)])
    places = np.tile(np.arange(len(sets), dtype=np.int32), 2)
    row = ([keys.tobytes()], [places.tobytes()], [docs.tobytes()], [sizes.tobytes()], [b"".join(folds)])
    got = jaccard.candidate_forest(pa.table(dict(zip(("keys", "places", "docs", "sizes", "folds"), row))), 80).to_pydict()
    root = dict(zip(got["b"], got["a"]))
    families = {}
    for d, k in zip(docs.tolist(), order.tolist()):
        families.setdefault(family[k], set()).add(root.get(d, d))
    assert [len(x) for x in families.values()] == [1] * 9 and len(set.union(*families.values())) == 9


def test_empty_ranges_sign_small_sets_only():
    import numpy as np

    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64)) for _ in range(2))
    assert not np.intersect1d(jaccard.signatures(a, 80), jaccard.signatures(b, 80)).size
    assert all(empties for size in (5, 50, 300) for *_, empties in jaccard.bands(size, 80))

import brute
import numpy as np
import pytest

from treeledger.llm import neardup


def linked(rows, least=0.95):
    usable = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[k][1] for k in usable], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= least
    np.fill_diagonal(links, False)
    root = brute.components(len(usable), zip(*np.nonzero(links)))
    out = {k: (0, rows[k][0]) for k in range(len(rows))}
    for i, k in enumerate(usable):
        out[k] = (int(links[i].sum()), min(rows[j][0] for h, j in enumerate(usable) if root[h] == root[i]))
    return sorted((d, *out[k], out[k][1] == d) for k, (d, _) in enumerate(rows))


@pytest.mark.parametrize("options", [neardup.Quantiser(), neardup.Quantiser(residents=16, queries=32, sample=100)])
def test_equals_brute_force(spark, options):
    rng, rows = np.random.default_rng(0), []
    for _ in range(50):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 30)):
            rows.append((len(rows) * 7 % 5003, (centre + rng.standard_normal(16) * rng.choice([0, 0.1, 0.25])).tolist()))
    rows += [
        (9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [1.0] * 8), (9004, [None] + [1.0] * 15), (9005, rows[0][1]),
        (9006, [3 * x for x in rows[0][1]]), (9007, [float("inf")] + [1.0] * 15), (9008, []),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    assert sorted(tuple(r) for r in neardup.near_vectors(df, options).collect()) == linked(rows)


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([(1, None), (None, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in neardup.near_vectors(df).collect()} == {(1, 0, 1, True), (None, 0, None, True)}
    assert neardup.near_vectors(df.limit(0)).count() == 0
    one = spark.createDataFrame([(5, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in neardup.near_vectors(one).collect()} == {(5, 2, 2, False), (2, 2, 2, True), (None, 2, 2, False)}


def test_every_length_is_searched(spark):
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0]), (6, [2.0]), (7, [2.0]), (8, [0.0, 1.0, 0.0, 0.0])]
    got = {tuple(r) for r in neardup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 0, 8, True)}

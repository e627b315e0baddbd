"""The tree of digests of a version equals a plain loop over its sorted entries."""

import hashlib

import pytest
from helpers import rows

from treeledger.operators import facts


def plain_root(entries, fan):
    nodes = sorted(entries)
    level = ["  ".join((sha, path)) for path, sha in nodes]
    while True:
        level = [hashlib.sha256("\n".join(level[i:i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return level[0]


@pytest.fixture(scope="module")
def versions():
    sizes = {("a", 1): 1, ("a", 2): 3, ("a", 3): 4, ("b", 1): 9, ("b", 2): 10, ("b", 3): 28, (None, 1): 5}
    return {v: [(f"d{i % 3}/é{i}", hashlib.sha256(f"{v}{i}".encode()).hexdigest()) for i in range(n)] for v, n in sizes.items()}


@pytest.fixture(scope="module")
def table(spark, versions):
    data = [(*v, path, sha) for v, entries in versions.items() for path, sha in entries]
    return spark.createDataFrame(data, "artifact string, seq long, path string, sha256 string")


@pytest.mark.parametrize("fan", [2, 3, 100])
def test_equals_plain_loop(table, versions, fan):
    wanted = sorted(((*v, len(e), plain_root(e, fan)) for v, e in versions.items()), key=repr)
    assert rows(facts.tree_root(table, fan)) == wanted


def test_root_of_a_small_version_is_its_flat_hash(table):
    assert rows(facts.tree_root(table), "artifact", "seq", "tree_root") == rows(facts.tree_hash(table), "artifact", "seq", "tree_hash")


def test_nulls_repeats_and_empty_table(spark):
    odd = spark.createDataFrame([("a", 1, None, "x"), ("a", 1, "p", None), ("a", 1, "p", None)], "artifact string, seq long, path string, sha256 string")
    assert rows(facts.tree_root(odd, 2)) == [("a", 1, 3, plain_root([("", "x"), ("p", ""), ("p", "")], 2))]
    assert rows(facts.tree_root(odd.limit(0))) == []


def test_fan_of_one_is_refused(table):
    with pytest.raises(ValueError):
        facts.tree_root(table, 1)

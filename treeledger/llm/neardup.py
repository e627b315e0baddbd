"""Near-duplicate vectors by product quantisation, without losing a link.

Coarse centroids cut space into inverted lists; the residual of a vector to its centroid
is coded in subspaces. Three bounds make the search exact, whatever the index was fitted on:

* probes: a vector within the radius of x that lies in list c is on c's side of the plane
  between c and x's own centroid, so only lists whose plane is within the radius are probed;
* codes: the distance from x to a coded vector, read from lookup tables, differs from the
  true one by at most the stored coding error, so only pairs within radius + error stay;
* rerank: the pairs that stay are compared by cosine in double precision.

The index is fitted on at most ``sample`` distinct vectors, chosen by a digest. Equal vectors
become one weighted vector first. Lists and the queries on them are cut into blocks of
bounded size, so a list with a third of all vectors is many tasks; a block returns link
counts and the forest of its links, never the pairs.

Vectors of one length are compared; each length has an index of its own. Vectors that are
null, empty, zero, or hold null or non-finite components link with nothing. A null vec_id is never a component's id; rows that share
a vec_id count as one vector; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.bytesets import joined, packed
from treeledger.llm.components import components
from treeledger.llm.registry import query
from treeledger.operators.durable import durable
from treeledger.sources.adapters import table

NULL_ID = 2**63 - 1
ASSIGNED = "id long, weight long, vector binary, list int, code binary, coded double, error double, probes array<int>"
SLACK = 1e-4  # over the rounding of lookup tables held in single precision


@dataclass(frozen=True)
class Quantiser:
    cosine: float = 0.95
    sample: int = 20_000
    subspaces: int = 8
    codes: int = 256
    most_lists: int = 2048
    rounds: int = 8
    residents: int = 2048
    queries: int = 4096
    seed: int = 3


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]
    radius: float


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def means(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    """Lloyd's k-means; a centroid without points stays where it is."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = squared(x, centres).argmin(1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.column_stack([np.bincount(near, x[:, d], len(centres)) for d in range(x.shape[1])])
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def fit(vectors: np.ndarray, lists: int, options: Quantiser) -> Index:
    rng = np.random.default_rng(options.seed)
    centroids = means(vectors, lists, options.rounds, rng)
    rest = vectors - centroids[squared(vectors, centroids).argmin(1)]
    cuts = np.linspace(0, vectors.shape[1], min(options.subspaces, vectors.shape[1]) + 1).astype(int).tolist()
    books = [means(rest[:, a:b], min(options.codes, max(1, len(vectors) // 4)), options.rounds, rng) for a, b in zip(cuts, cuts[1:])]
    return Index(centroids, books, cuts, float(np.sqrt(2 - 2 * options.cosine)) + 1e-6)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def assigned(batches, index: Index):
    """Each vector with its list, code, length of the coded vector squared, coding error and lists to probe (its own and later ones)."""
    c = index.centroids
    apart = np.sqrt(squared(c, c))
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = np.array(batch.column("vector").to_pylist(), np.float64)
        x = unit(raw)
        far = squared(x, c)
        own = far.argmin(1)
        near = far[np.arange(len(x)), own]
        probes = (far - near[:, None] <= 2 * index.radius * apart[own] + 1e-9) & (np.arange(len(c))[None] >= own[:, None])
        probes[np.arange(len(x)), own] = True
        rest = x - c[own]
        codes = np.column_stack([squared(rest[:, a:b], book).argmin(1) for book, a, b in zip(index.books, index.cuts, index.cuts[1:])]).astype(np.uint8)
        coded = c[own] + np.concatenate([book[codes[:, m]] for m, book in enumerate(index.books)], axis=1)
        error = np.linalg.norm(x - coded, axis=1)
        rows = list(zip(batch.column("id").to_pylist(), batch.column("weight").to_pylist(), map(bytes, raw), own.tolist(), map(bytes, codes), (coded * coded).sum(1).tolist(), error.tolist()))
        import pyarrow as pa

        out = packed(rows, "id long, weight long, vector binary, list int, code binary, coded double, error double")
        yield from out.append_column("probes", pa.array([np.flatnonzero(p).tolist() for p in probes], pa.list_(pa.int32()))).to_batches()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between nodes: every node and the least node it reaches through them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def block_links(residents, queries, index: Index, options: Quantiser):
    """Links between one block of a list and one block of the queries on it: (a, b, n) rows, b null for link counts."""
    if not residents.num_rows or not queries.num_rows:
        return packed([], "a long, b long, n long")
    dims = index.centroids.shape[1]
    rid, rw, coded, error = (residents.column(c).to_numpy() for c in ("id", "weight", "coded", "error"))
    rv = joined(residents.column("vector").to_pylist(), np.float64).reshape(-1, dims)
    codes = joined(residents.column("code").to_pylist(), np.uint8).reshape(len(rid), -1)
    qid, qw = queries.column("id").to_numpy(), queries.column("weight").to_numpy()
    own = np.array(queries.column("own").to_pylist(), bool)
    qv = joined(queries.column("vector").to_pylist(), np.float64).reshape(-1, dims)
    centroid = index.centroids[residents.column("list")[0].as_py()]
    rn, left, right, counts_r, counts_q = np.linalg.norm(rv, axis=1), [], [], np.zeros(len(rid), np.int64), np.zeros(len(qid), np.int64)
    for k in range(0, len(qid), 256):
        q = qv[k:k + 256]
        x = unit(q)
        dot = np.repeat((x @ centroid).astype(np.float32)[:, None], len(rid), axis=1)
        for m, (book, a, b) in enumerate(zip(index.books, index.cuts, index.cuts[1:])):
            dot += (x[:, a:b] @ book.T).astype(np.float32)[:, codes[:, m]]
        near = np.sqrt(np.maximum(1 + coded[None] - 2 * dot, 0)) <= index.radius + error[None] + SLACK
        near &= ~own[k:k + 256, None] | (qid[k:k + 256, None] < rid[None])
        i, j = np.nonzero(near)
        if len(i) * 8 > near.size:
            cosine = (q @ rv.T / (np.linalg.norm(q, axis=1)[:, None] * rn[None]))[i, j]
        else:
            cosine = np.concatenate([np.einsum("ij,ij->i", q[i[s:s + 4096]], rv[j[s:s + 4096]]) for s in range(0, len(i), 4096)] or [np.zeros(0)]) / (np.linalg.norm(q, axis=1)[i] * rn[j])
        i, j = i[cosine >= options.cosine] + k, j[cosine >= options.cosine]
        counts_q += np.bincount(i, rw[j], len(qid)).astype(np.int64)
        counts_r += np.bincount(j, qw[i], len(rid)).astype(np.int64)
        left.append(qid[i])
        right.append(rid[j])
    nodes, roots = forest(np.concatenate(left), np.concatenate(right))
    rows = [(int(a), None, int(n)) for ids, counts in ((qid, counts_q), (rid, counts_r)) for a, n in zip(ids, counts) if n]
    rows += [(int(a), int(b), 0) for a, b in zip(nodes, roots) if a != b]
    return packed(rows, "a long, b long, n long")


def blocks(counts: DataFrame, size: int, lists: int) -> list[int]:
    """Blocks that each list is cut into; as many numbers as lists."""
    found = {r["list"]: r.n for r in counts.collect()}
    return [max(1, -(-found.get(k, 0) // size)) for k in range(lists)]


def length_links(classes: DataFrame, many: int, options: Quantiser) -> DataFrame:
    """Link counts and forests (see ``block_links``) of ``many`` distinct vectors of one length, stored."""
    sample = classes.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(options.sample).collect()
    lists = min(options.most_lists, max(1, round(many**0.5 / 4)))
    index = fit(unit(np.array([r.vector for r in sample])), lists, options)
    lists = len(index.centroids)
    known = durable(classes.mapInArrow(lambda it: assigned(it, index), ASSIGNED))
    asks = known.select("id", "weight", "vector", F.col("list").alias("home"), F.explode("probes").alias("list"))
    in_list, on_list = (F.array(*map(F.lit, b)) for b in (
        blocks(known.groupBy("list").agg(F.count(F.lit(1)).alias("n")), options.residents, lists),
        blocks(asks.groupBy("list").agg(F.count(F.lit(1)).alias("n")), options.queries, lists)))
    spot = F.col("list") + 1

    def dealt(df, own, other, own_blocks, other_blocks):
        mine = df.withColumn(own, F.pmod(F.xxhash64("id"), F.element_at(own_blocks, spot)).cast("int"))
        return mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.element_at(other_blocks, spot) - 1)))

    residents = dealt(known.drop("probes"), "r", "q", in_list, on_list)
    queries = dealt(asks.withColumn("own", F.col("home") == F.col("list")).drop("home"), "q", "r", on_list, in_list)
    keys = ["list", "r", "q"]
    return durable(residents.groupBy(keys).cogroup(queries.groupBy(keys)).applyInArrow(lambda r, q: block_links(r, q, index, options), "a long, b long, n long"))


def near_vectors(vectors: DataFrame, options: Quantiser = Quantiser()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    value = F.col("embedding")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(value, lambda x: x != 0)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("id"), value.cast("array<double>").alias("vector"), F.coalesce(finite, F.lit(False)).alias("usable"))
    classes = durable(rows.where("usable").groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    sizes = classes.groupBy(F.size("vector").alias("d")).count().where("count > 1").orderBy("d").collect()
    found = classes.select(F.col("id").alias("node"), F.col("vector").alias("same"), "weight")
    others, part = F.lit(0), F.col("node")
    if sizes:
        told = [length_links(classes.where(F.size("vector") == r.d), r["count"], options) for r in sizes]
        told = reduce(DataFrame.unionByName, told)
        counts = told.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
        parts = components(told.where("b is not null").select("a", "b"))
        found = found.join(counts, "node", "left").join(parts, "node", "left")
        others, part = F.coalesce("others", F.lit(0)), F.coalesce("component", "node")
    found = found.select("same", (others + F.col("weight") - 1).alias("n_links"), part.alias("part"))
    out = rows.join(found, F.col("usable") & (F.col("vector") == F.col("same")), "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("part", "id").alias("part"))
    return out.select(
        F.nullif("id", F.lit(NULL_ID)).alias("vec_id"), "n_links", F.nullif("part", F.lit(NULL_ID)).alias("component_id"), (F.col("id") == F.col("part")).alias("kept"))


NEAR_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(embedding) = (SELECT mode(len(embedding)) FROM embeddings)
),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id, vec_id <= coalesce(l.b, vec_id) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""


@query("op3_product_quantised", NEAR_SQL)
def op3_product_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))

"""Array helpers over UTF-8 bytes: rolling hashes, sliding minima, packed columns."""

from __future__ import annotations

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
WEIGHTS = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def power(n: int) -> np.uint64:
    return np.uint64(pow(MULTIPLIER, n, 2**64))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` bytes, built by doubling the run length."""
    doubled, size = {1: WEIGHTS[data]}, 1
    while 2 * size <= k:
        h = doubled[size]
        doubled[2 * size] = h[:-size] * power(size) + h[size:]
        size *= 2
    out, done, n = None, 0, len(data) - k + 1
    for size in sorted(doubled, reverse=True):
        if done + size <= k:
            part = doubled[size][done:done + n]
            out = part.copy() if out is None else out * power(size) + part
            done += size
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:size - width], x[width - size:]) if size < width else x


def binary_parts(table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    import pyarrow as pa

    array = table.column(name).cast(pa.large_binary()).combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], pa.large_binary())
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = array.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data, offsets


def packed(rows: list[tuple], schema: str):
    """Rows as an Arrow table; ``schema`` as for Spark, of the types below."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def joined(parts: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def by_bucket(buckets: np.ndarray, count: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that sorts by bucket (stably) and (bucket, from, to) of the buckets that occur."""
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(count + 1))
    return order, [(b, int(edges[b]), int(edges[b + 1])) for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist()]

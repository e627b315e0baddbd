"""Links between documents whose word-shingle sets are similar, by PartEnum signatures.

Sets of one size band that are similar enough differ in at most k elements. The hash range
is cut into parts of first level, so that one of them holds at most one difference, and each
of these into three parts of second level, of which two are then equal: one signature for
every two of the three. Similar sets share a signature; a set that may reach into the next
band also signs there. Large sets need few of so many parts: where there would be more than
``MANY_PARTS``, the range is cut into parts of ``SPARE`` differences each at most on average and the first
``MANY_PARTS`` sign. Elements are hashed, so one of these has at most one difference but for a
chance below 1e-15 (a part has with probability 0.199 or more), and longer signatures meet fewer strangers.
Two empty ranges are equal in any two sets. A band leaves such signatures out as soon as the chance that a linked
pair has no other one is below 1e-15 (from about 70 parts on), since they would join large strangers.

1. Documents become (size, set digest, sketch); equal sets become one class, and only its
   least document takes part further.
2. Chunks send their distinct signatures to buckets, which answer those that occur twice,
   with the count of frequent ones.
3. Documents that share a signature meet in a bucket, those of a frequent signature in tiles
   of bounded size. Sizes and folded sketches leave candidate pairs, of which a bucket returns
   a forest: documents that may link end up in one candidate group. A bucket joins them key by key and
   compares only what it has not joined yet, so a family of copies costs it no list of pairs.
4. Groups are cut into tiles of bounded size and compared by whole sketches. A spanning forest of the
   closest pairs is checked exactly on the sets, and then every pair the sketches allow whose ends
   are not yet connected. So all links between components are found, and the pairs inside
   a component of near copies are never written out.

A sketch keeps the parity of the elements in each of its bits, two bits or more for an element. Its
differing bits are never more than the differing elements, so it only rejects pairs that
cannot link. Signatures travel in five bytes and sets in six-byte hashes: chance equality of
signatures costs a comparison, of element hashes (2 ** -48 a pair) an element.

Nodes are classes of equal sets, named by their least doc_id; where that is null or names two
classes (rows that share a doc_id), by a 61-bit digest of the set above all doc_ids under 2 ** 61. So rows are
linked by their own text only, whatever their doc_ids. Null and wordless texts have empty sets and no
links; a null doc_id never is a component's id (null if the component has no other); an empty table gives no
rows; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import exp

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.bytesets import LOWER, MULTIPLIER, WEIGHTS, binary_parts, by_bucket, joined, mixed, packed
from treeledger.llm.columns import veiled
from treeledger.llm.components import components
from treeledger.llm.neardup import forest
from treeledger.llm.registry import query
from treeledger.operators.durable import durable, fetch
from treeledger.sources.adapters import table

NULL_ID = 2**63 - 1
COPY = -(2**63)
CHUNK_ROWS = 4096
LEAST_CHUNKS = 64
BLOCK = 512
PIECE = 1 << 18
FOLD_WORDS = (8, 16, 32, 64)
FOLD_ELEMENTS = 100
AT_ONCE = 1 << 22
PAIRS = 1 << 18
BAND_GROWTH = 1.3
SECOND, MISSED = 3, 1
MANY_PARTS = 160
SPARE = 3
CHANCE = 1e-15

DESCRIBED = "doc long, t long, n long, a long, b long, sketch binary"
SIGNED = "chunk int, doc long, a long, n long, fold binary, signs binary"
SENT = "bucket int, chunk int, once binary, many binary, counts binary"
ANSWERS = "chunk int, names binary, frequent binary, totals binary"
MEETING = "bucket int, keys binary, places binary, docs binary, sizes binary, folds binary"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SALTS = mixed(np.arange(1, 8, dtype=np.uint64)) | np.uint64(1)
POWERS = np.cumprod(np.append(np.uint64(1), np.full(PIECE, MULTIPLIER, np.uint64)))
INVERSES = np.cumprod(np.append(np.uint64(1), np.full(PIECE, pow(MULTIPLIER, -1, 2**64), np.uint64)))


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link when 100 * shared >= percent * union."""

    words: int = 5
    percent: int = 80


def word_hashes(text: np.ndarray) -> np.ndarray:
    """One number per word of lower-cased text, whatever its length."""
    out, p = [], 0
    while p < len(text):
        end = min(len(text), p + PIECE)
        space = SPACE[text[p:end]]
        if end < len(text) and not space[-1]:
            if space.any():
                end -= int(space[::-1].argmax())
                space = space[:end - p]
            elif not SPACE[text[end]]:  # a word longer than a piece
                rest = SPACE[text[end:]]
                stop = end + (int(rest.argmax()) if rest.any() else len(rest))
                digest = hashlib.blake2b(text[p:stop].tobytes(), digest_size=8).digest()
                out.append(np.frombuffer(digest, np.uint64))
                p = stop
                continue
        edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
        first, last = edges[::2], edges[1::2]
        sums = np.append(np.uint64(0), np.cumsum(WEIGHTS[text[p:end]] * POWERS[:end - p]))
        out.append(mixed((sums[last] - sums[first]) * INVERSES[first] + (last - first).astype(np.uint64)))
        p = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; the whole sequence if it is shorter."""
    hashes = word_hashes(LOWER[text])
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    total = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        total += hashes[k:k + len(total)] * SALTS[k]
    return np.unique(mixed(total))


@lru_cache
def bands(size: int, percent: int) -> tuple[tuple[int, int, int, bool], ...]:
    """(band, first-level parts, how many of them sign, whether empty ranges do) for a set of this size."""
    out, band, low, high = [], 0, 1, 9
    while percent * low <= 100 * size:
        differ = 2 * high * (100 - percent) // (100 + percent)
        if size <= high and differ:
            parts = -(-(differ + 1) // (MISSED + 1))
            signing = min(parts, MANY_PARTS)
            parts = parts if parts <= MANY_PARTS else max(MANY_PARTS, -(-differ // SPARE))
            out.append((band, parts, signing, (1 - full_match(low, differ, parts, percent)) ** signing > CHANCE))
        band, low, high = band + 1, high + 1, max(high + 1, int(high * BAND_GROWTH))
    return tuple(out)


def full_match(low: int, differ: int, parts: int, percent: int) -> float:
    """Least chance that a part of two linked sets has at most one difference and equal ranges that hold an element."""
    mean, shared = differ / parts, low * percent / (100 * parts * SECOND)
    return exp(-mean) * (1 + mean) * (1 - exp(-2 * shared))


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a sorted set in its bands."""
    sums = np.append(np.uint64(0), np.cumsum(mixed(elements)))
    out = []
    for band, parts, signing, empties in bands(len(elements), percent):
        borders = (np.arange(1, parts * SECOND, dtype=np.float64) * (2.0**64 / (parts * SECOND))).astype(np.uint64)
        edges = np.concatenate([[0], np.searchsorted(elements, borders), [len(elements)]])[:signing * SECOND + 1]
        content = mixed(np.diff(sums[edges])).reshape(signing, SECOND)
        filled = np.diff(edges).reshape(signing, SECOND) > 0
        salt = mixed(np.arange(signing, dtype=np.uint64) + np.uint64(band << 40))
        for k, picked in enumerate(combinations(range(SECOND), SECOND - MISSED)):
            sign = salt + np.uint64(k)
            for j, c in enumerate(picked):
                sign = sign + content[:, c] * SALTS[j]
            out.append(mixed(sign if empties else sign[filled[:, picked].any(axis=1)]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """Parity of the elements by hash, in the power of two of bits next above two for each."""
    bits = max(64 * FOLD_WORDS[0], 1 << int(2 * len(elements) - 1).bit_length())
    parity = np.bincount(((elements >> np.uint64(7)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(bool)).view(np.uint64)


def fold_words(sizes: np.ndarray) -> np.ndarray:
    """Words of the folded sketch of sets of these sizes: enough that strangers differ in more bits than linked sets may."""
    return np.array(FOLD_WORDS)[np.searchsorted(np.array(FOLD_WORDS[:-1]) * FOLD_ELEMENTS, sizes)]


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch with fewer bits."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def five_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five_bytes(parts: list[bytes]) -> np.ndarray:
    raw = joined(parts, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view(np.uint64).ravel()


def described(batches, rule: Rule):
    """Phase 1: one row per document."""
    for row, elements in document_sets(batches, rule.words, "row"):
        n, doc, t = len(elements), row["doc"], row["t"]
        digest = np.array([mixed(elements).sum(), (mixed(elements ^ SALTS[0]) * SALTS[1]).sum()], np.uint64).view(np.int64).tolist() if n else [0, 0]
        yield doc, t, n, *digest, parity_sketch(elements).tobytes() if n else b""


def signed(batches, rule: Rule, chunks: int):
    """Phase 2: signatures of one document per row."""
    low = np.uint64((1 << 40) - 1)
    for doc, elements in document_sets(batches, rule.words):
        if len(elements):
            a = int(mixed(elements).sum().view(np.int64))
            fold = folded(parity_sketch(elements), int(fold_words(len(elements)))).tobytes()
            chunk = int(chunk_of(np.array([doc]), np.array([a]), chunks)[0])
            yield chunk, doc, a, len(elements), fold, five_bytes(np.unique(signatures(elements, rule.percent) & low))


def chunk_of(doc: np.ndarray, a: np.ndarray, chunks: int) -> np.ndarray:
    return (mixed(mixed(doc.view(np.uint64)) ^ a.view(np.uint64)) % np.uint64(chunks)).astype(np.int32)


def document_sets(batches, words: int, key: str = "doc"):
    """(key, set) of every document."""
    import pyarrow as pa

    for batch in batches:
        group = pa.Table.from_batches([batch])
        data, offsets = binary_parts(group, "text")
        for r, doc in enumerate(group.column(key).to_pylist()):
            yield doc, shingle_set(data[offsets[r]:offsets[r + 1]], words)


def batched(rows, schema: str, at_once: int = 2000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield from packed(held, schema).to_batches()
            held = []
    if held:
        yield from packed(held, schema).to_batches()


def chunk_signs(group):
    """Of the classes' least documents in a chunk: nodes, sizes, folds, all signatures and the document each is of.

    Marks give rows another node; ``COPY`` marks rows of a class that another row stands for.
    """
    marks = {(d, a): m for d, a, m in zip(*(group.column(c).to_pylist() for c in ("doc", "a", "mark"))) if m is not None}
    own = (r for r in zip(*(group.column(c).to_pylist() for c in ("doc", "a", "n", "fold", "signs", "mark"))) if r[5] is None)
    rows = [(marks.get(r[:2], r[0]), *r[1:]) for r in own if marks.get(r[:2]) != COPY]
    signs = from_five_bytes([r[4] for r in rows])
    place = np.repeat(np.arange(len(rows)), [len(r[4]) // 5 for r in rows])
    return np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), [r[3] for r in rows], signs, place


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(x) % np.uint64(buckets)).astype(np.int64)


def sent_signs(group, buckets: int):
    """Phase 2, chunk side: the chunk's distinct signatures by bucket, with counts of those it has more often than once."""
    *_, signs, _ = chunk_signs(group)
    signs, counts = np.unique(signs, return_counts=True)
    order, cuts = by_bucket(bucket_of(signs, buckets), buckets)
    signs, counts = signs[order], counts[order].astype(np.int32)
    chunk = group.column("chunk")[0].as_py()
    out = []
    for b, i, j in cuts:
        many = counts[i:j] > 1
        out.append((b, chunk, five_bytes(signs[i:j][~many]), five_bytes(signs[i:j][many]), counts[i:j][many].tobytes()))
    return packed(out, SENT)


def shared_signs(group):
    """Phase 2, bucket side: to each chunk its signatures that occur twice, and the totals of frequent ones."""
    once, many, counts = (group.column(c).to_pylist() for c in ("once", "many", "counts"))
    lists = [from_five_bytes([a, b]) for a, b in zip(once, many)]
    weight = np.concatenate([np.append(np.ones(len(a) // 5, np.int64), np.frombuffer(c, np.int32)) for a, c in zip(once, counts)])
    kinds, place = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(place, weight, len(kinds)).astype(np.int64)[place]
    out, end = [], 0
    for chunk, names in zip(group.column("chunk").to_pylist(), lists):
        mine = total[end:end + len(names)]
        end += len(names)
        frequent = mine > BLOCK
        if (mine > 1).any():
            out.append((chunk, five_bytes(names[mine > 1]), five_bytes(names[frequent]), mine[frequent].tobytes()))
    return packed(out, ANSWERS)


def meetings(group, answers, buckets: int):
    """Phase 3, chunk side: (key, document) of shared signatures by bucket; a frequent signature has a key for each two of its blocks."""
    if not answers.num_rows:
        return packed([], MEETING)
    docs, sizes, folds, signs, place = chunk_signs(group)
    shared = np.sort(from_five_bytes(answers.column("names").to_pylist()))
    keep = shared[np.minimum(np.searchsorted(shared, signs), len(shared) - 1)] == signs
    signs, place = signs[keep], place[keep]
    hot = from_five_bytes(answers.column("frequent").to_pylist())
    if len(hot):
        totals, order = joined(answers.column("totals").to_pylist(), np.int64), np.argsort(hot)
        hot, totals = hot[order], totals[order]
        at = np.minimum(np.searchsorted(hot, signs), len(hot) - 1)
        is_hot = hot[at] == signs
        more_signs, more_place = [signs[~is_hot]], [place[~is_hot]]
        for sign, p, width in zip(signs[is_hot], place[is_hot], -(-totals[at[is_hot]] // BLOCK)):
            block = int(mixed(docs[p:p + 1].view(np.uint64))[0] % np.uint64(width))
            other = np.arange(width)
            tile = (np.minimum(other, block) * width + np.maximum(other, block)).astype(np.uint64)
            more_signs.append(mixed(sign + (tile + np.uint64(1)) * SALTS[3]))
            more_place.append(np.full(width, p))
        signs, place = np.concatenate(more_signs), np.concatenate(more_place)
    out = []
    order, cuts = by_bucket(bucket_of(signs, buckets), buckets)
    for b, i, j in cuts:
        mine, at = np.unique(place[order[i:j]], return_inverse=True)
        out.append((b, signs[order[i:j]].tobytes(), at.astype(np.int32).tobytes(), docs[mine].tobytes(), sizes[mine].tobytes(), b"".join(folds[k] for k in mine.tolist())))
    return packed(out, MEETING)


def may_link(differing, na, nb, percent: int):
    """Whether sizes and differing bits allow the similarity (arrays)."""
    return (differing * (100 + percent) <= (na + nb) * (100 - percent)) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent)


def candidate_forest(group, percent: int):
    """Phase 3, bucket side: a forest of the pairs that share a key and may link."""
    import pyarrow as pa

    counts = [len(x) // 8 for x in group.column("docs").to_pylist()]
    base = np.cumsum(counts) - counts
    keys = joined(group.column("keys").to_pylist(), np.uint64)
    lists = [np.frombuffer(x, np.int32) + b for x, b in zip(group.column("places").to_pylist(), base)]
    place = np.concatenate(lists)
    docs, sizes = (joined(group.column(c).to_pylist(), np.int64) for c in ("docs", "sizes"))
    folds = fold_levels(joined(group.column("folds").to_pylist(), np.uint64), sizes)
    order = np.lexsort((docs[place], keys))
    keys, place = keys[order], place[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(first, len(keys)))
    label = np.arange(len(docs))

    def join(left, right):
        nonlocal label
        apart = label[left] != label[right]
        left, right = tested(left[apart], right[apart], folds, sizes, percent)
        if len(left):
            nodes, roots = forest(label[left], label[right])
            moved = np.arange(len(docs))
            moved[nodes] = roots
            label = moved[label]

    two = first[size == 2]
    for k in range(0, len(two), PAIRS):
        join(place[two[k:k + PAIRS]], place[two[k:k + PAIRS] + 1])
    seen, held, waiting = set(), [], 0
    for k, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        mine = place[k:k + n]
        own = label[mine]
        if (own == own[0]).all() or (name := mine.tobytes()) in seen:
            continue
        seen.add(name)
        step = max(1, PAIRS // n)
        for i in range(0, n - 1, step):
            x, y = np.nonzero(np.triu(own[i:i + step, None] != own[None, i:], 1))
            held.append((mine[i + x], mine[i + y]))
            waiting += len(x)
            if waiting > PAIRS:
                join(*map(np.concatenate, zip(*held)))
                own, held, waiting = label[mine], [], 0
    if held:
        join(*map(np.concatenate, zip(*held)))
    nodes = np.flatnonzero(label != np.arange(len(docs)))
    return pa.table({"a": docs[label[nodes]], "b": docs[nodes]})


def fold_levels(words: np.ndarray, sizes: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width of folded sketches: the place of a set among those that have it or a larger one, and their sketches."""
    widths = fold_words(sizes)
    start = np.cumsum(widths) - widths
    out = {}
    for w in FOLD_WORDS:
        at, sketches = np.cumsum(widths >= w) - 1, np.zeros(((widths >= w).sum(), w), np.uint64)
        for v in (v for v in FOLD_WORDS if v >= w):
            own = np.flatnonzero(widths == v)
            if len(own):
                sketches[at[own]] = np.bitwise_xor.reduce(words[start[own, None] + np.arange(v)].reshape(len(own), v // w, w), axis=1)
        out[w] = at, sketches
    return out


def tested(left, right, folds, sizes, percent):
    """The pairs that folded sketches, of the width of the smaller set's, and sizes allow."""
    keep = []
    for k in range(0, len(left), 1 << 16):
        i, j = left[k:k + (1 << 16)], right[k:k + (1 << 16)]
        least = np.minimum(sizes[i], sizes[j])
        ok = least * 100 >= np.maximum(sizes[i], sizes[j]) * percent
        widths = np.where(ok, fold_words(least), 0)
        for w in FOLD_WORDS:
            mine = np.flatnonzero(widths == w)
            if len(mine):
                at, sketches = folds[w]
                differing = np.bitwise_count(sketches[at[i[mine]]] ^ sketches[at[j[mine]]]).sum(axis=1, dtype=np.int64)
                ok[mine] = may_link(differing, sizes[i[mine]], sizes[j[mine]], percent)
        keep.append(ok)
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return left[ok], right[ok]


def tile_distances(sketches: list[np.ndarray], sizes: np.ndarray, percent: int):
    """Yields (rows, columns, differing bits) blocks of all pairs whose sizes allow a link; every pair in one block at least."""
    words = np.array([len(s) for s in sketches])
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        others = np.flatnonzero((words == w) | (words == 2 * w))
        x = np.array([sketches[k] for k in own])
        y = np.array([folded(sketches[k], w) for k in others])
        step = max(1, AT_ONCE // (len(others) * w))
        for k in range(0, len(own), step):
            yield own[k:k + step], others, np.bitwise_count(x[k:k + step, None] ^ y[None]).sum(axis=2, dtype=np.int64)


def tile_pairs(group, percent: int, every: bool):
    """Phase 4: of each tile the spanning forest of closest pairs that may link, or every such pair across components."""
    import pyarrow as pa

    tiles = list(zip(*(group.column(c).to_pylist() for c in ("group", "low", "high"))))
    docs, sizes, parts = (group.column(c).to_numpy() for c in ("doc", "n", "component"))
    sketches = [np.frombuffer(x, np.uint64) for x in group.column("sketch").to_pylist()]
    members: dict[tuple, list[int]] = {}
    for k, tile in enumerate(tiles):
        members.setdefault(tile, []).append(k)
    found = []
    for mine in map(np.array, members.values()):
        rows, columns, weights = [], [], []
        widths = np.array([len(sketches[k]) for k in mine])
        for i, j, differing in tile_distances([sketches[k] for k in mine], sizes[mine], percent):
            a, b = mine[i], mine[j]
            ok = may_link(differing, sizes[a][:, None], sizes[b][None], percent) & (docs[a][:, None] != docs[b][None])
            ok &= (widths[i][:, None] != widths[j][None]) | (i[:, None] < j[None])  # each pair once
            if every:
                ok &= parts[a][:, None] != parts[b][None]
            p, q = np.nonzero(ok)
            rows.append(a[p].astype(np.int32))
            columns.append(b[q].astype(np.int32))
            weights.append(differing[p, q].astype(np.int32))
        a, b = np.concatenate(rows), np.concatenate(columns)
        if not every:
            keep = spanning(a, b, np.concatenate(weights))
            a, b = a[keep], b[keep]
        found.append(np.column_stack([np.minimum(docs[a], docs[b]), np.maximum(docs[a], docs[b])]))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Edges of a least spanning forest: each component takes its lightest way out, until none is left."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    label, taken = np.arange(len(nodes)), []
    order = np.lexsort((j, i, weight))  # one order of all edges, so equal weights make no cycles
    i, j = i[order], j[order]
    alive = np.arange(len(i))
    while True:
        alive = alive[label[i[alive]] != label[j[alive]]]
        if not len(alive):
            return order[np.unique(taken).astype(np.int64)] if taken else np.zeros(0, np.int64)
        out = np.full(len(nodes), len(i))
        np.minimum.at(out, label[i[alive]], alive)
        np.minimum.at(out, label[j[alive]], alive)
        best = np.unique(out[out < len(i)])
        taken = [*taken, *best.tolist()]
        while True:  # joins the labels over the edges just taken
            low = np.minimum(label[i[best]], label[j[best]])
            new = label.copy()
            np.minimum.at(new, label[i[best]], low)
            np.minimum.at(new, label[j[best]], low)
            new = new[label]
            if (new == label).all():
                break
            label = new


def sets_of(batches, words: int):
    for doc, elements in document_sets(batches, words):
        yield doc, np.ascontiguousarray((elements >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def linked(batches, percent: int):
    """Exact check of pairs that carry both sets."""
    import pyarrow as pa

    for batch in batches:
        t = pa.Table.from_batches([batch])
        ok = []
        for x, y in zip(t.column("elements").to_pylist(), t.column("elements_b").to_pylist()):
            x, y = from_six_bytes(x), from_six_bytes(y)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield from t.select(["a", "b"]).filter(pa.array(ok, pa.bool_())).to_batches()


def checked(pairs: DataFrame, texts: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """The stored pairs (a, b) of nodes whose sets are similar enough, stored."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = durable(ends.join(reps, "node").select("node", "doc", "t"))
    found = fetch(texts, needed, ["doc", "t"]).select(F.col("node").alias("doc"), "text")
    sets = found.mapInArrow(lambda it: batched(sets_of(it, rule.words), "doc long, elements binary", 200), "doc long, elements binary")
    both = pairs.join(sets.select(F.col("doc").alias("a"), "elements"), "a").join(sets.select(F.col("doc").alias("b"), F.col("elements").alias("elements_b")), "b")
    return durable(both.mapInArrow(lambda it: linked(it, rule.percent), "a long, b long").distinct())


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc (NULL_ID for null), a digest of the text, and the text of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))


def components_of_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc, t, n, node, component and component_id for every row of ``docs``; node and component are null for empty sets."""
    texts = keyed_texts(docs)
    known = durable(texts.select(F.struct("doc", "t").alias("row"), "text").mapInArrow(lambda it: batched(described(it, rule), DESCRIBED), DESCRIBED))
    alike = known.where("n > 0").groupBy("n", "a", "b").agg(F.min(F.struct("doc", "t")).alias("rep"))
    shared = durable(alike.groupBy("rep.doc").agg(F.count(F.lit(1)).alias("named")).where(F.col("named") > 1))
    by_digest = F.lit(2**61) + F.shiftrightunsigned(F.xxhash64("n", "a", "b"), 3)
    named = alike.select("n", "a", "b", "rep.doc", "rep.t").join(shared, "doc", "left")
    classes = durable(named.withColumn("node", F.when(F.col("named").isNull() & (F.col("doc") != NULL_ID), F.col("doc")).otherwise(by_digest)).drop("named"))
    reps = classes.select("node", "doc", "t")
    chunks = max(LEAST_CHUNKS, -(-known.count() // CHUNK_ROWS))
    own = texts.mapInArrow(lambda it: batched(signed(it, rule, chunks), SIGNED), SIGNED)
    members = known.select("doc", "n", "a", "b").join(classes.select("n", "a", "b", "node", F.col("doc").alias("least")), ["n", "a", "b"])
    mark = F.when(F.col("doc") != F.col("least"), F.lit(COPY)).otherwise(F.col("node"))
    marks = members.where("doc <> node").select("doc", "a", mark.alias("mark")).distinct()
    marks = marks.mapInArrow(lambda it: placed_marks(it, chunks), "chunk int, doc long, a long, mark long")
    dealt = own.unionByName(marks, allowMissingColumns=True)
    sent = dealt.groupBy("chunk").applyInArrow(lambda g: sent_signs(g, chunks), SENT)
    answers = sent.groupBy("bucket").applyInArrow(shared_signs, ANSWERS)
    met = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda g, a: meetings(g, a, chunks), MEETING)
    near = met.groupBy("bucket").applyInArrow(lambda g: candidate_forest(g, rule.percent), "a long, b long")
    groups = components(near)

    sketched = known.select("doc", "t", "n", "sketch").join(reps, ["doc", "t"]).select(F.col("node").alias("doc"), "n", "sketch").distinct()
    grouped = durable(sketched.join(groups.select(F.col("node").alias("doc"), F.col("component").alias("group")), "doc"))
    width = F.ceil(F.col("many") / BLOCK).cast("int")
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("many"))
    block = F.pmod(F.xxhash64("doc"), width).cast("int")
    cut = grouped.join(sizes, "group").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), width - 1)))
    tiles = cut.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    bucket = F.pmod(F.xxhash64("group", "low", "high"), F.lit(chunks)).cast("int")

    def pairs(parts: DataFrame | None, every: bool) -> DataFrame:
        rows = tiles.withColumn("component", F.col("doc"))
        if parts is not None:
            rows = tiles.join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        rows = rows.select(bucket.alias("bucket"), "group", "low", "high", "doc", "component", "n", "sketch")
        return rows.groupBy("bucket").applyInArrow(lambda g: tile_pairs(g, rule.percent, every), "a long, b long").distinct()

    closest = durable(pairs(None, False))
    links = checked(closest, texts, reps, rule)
    rest = durable(pairs(components(links), True).join(closest, ["a", "b"], "left_anti"))
    found = components(links.unionByName(checked(rest, texts, reps, rule)))
    least = found.join(reps, "node").groupBy("component").agg(F.min("doc").alias("component_id"))
    placed = classes.select("n", "a", "b", "node", F.col("doc").alias("least")).join(found.join(least, "component"), "node", "left")
    own_class = placed.select("n", "a", "b", "node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    return known.select("doc", "t", "n", "a", "b").join(own_class, ["n", "a", "b"], "left").select(
        "doc", "t", "n", "node", "component", F.coalesce("component_id", "doc").alias("component_id"))


def similar_documents(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    real = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return components_of_rows(docs, rule).select(real("doc").alias("doc_id"), F.col("n").alias("n_shingles"), real("component_id").alias("component_id"))


def placed_marks(batches, chunks: int):
    import pyarrow as pa

    for batch in batches:
        docs = batch.column("doc").to_numpy(zero_copy_only=False)
        chunk = chunk_of(docs, batch.column("a").to_numpy(zero_copy_only=False), chunks)
        yield from pa.table({"chunk": chunk, "doc": batch.column("doc"), "a": batch.column("a"), "mark": batch.column("mark")}).to_batches()


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` without rows that are linked to another, over any number of links, but for one of each component.

    The row with the smallest doc_id stays (null last; of rows that share it, one digest of the text, once).
    """
    rows = durable(components_of_rows(docs, rule).where("component IS NOT NULL").groupBy("component", "doc", "t").agg(F.count(F.lit(1)).alias("times")))
    first = rows.groupBy("component").agg(F.min(F.struct("doc", "t")).alias("first"))
    judged = durable(rows.join(first, "component").select("doc", "t", "times", (F.struct("doc", "t") == F.col("first")).alias("stays")).where("times > 1 OR NOT stays"))
    keys = {"doc_": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "t_": F.xxhash64(F.coalesce("text", F.lit("")))}
    carried = veiled(docs, "doc_id", "text").withColumns(keys)
    gone, repeated = (judged.where(c).select(F.col("doc").alias("doc_"), F.col("t").alias("t_")) for c in ("NOT stays", "stays"))
    kept = fetch(carried, durable(gone), ["doc_", "t_"], "left_anti")
    again = durable(repeated)
    once = fetch(kept, again, ["doc_", "t_"], "left_semi").dropDuplicates(["doc_", "t_"])
    return fetch(kept, again, ["doc_", "t_"], "left_anti").unionByName(once).drop("doc_", "t_").toDF(*docs.columns)


@query("op9_partenum_join")
def op9_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), Rule(words=3, percent=90))

"""Repeated byte strings removed but for their first copy, by grouping equal windows.

A byte goes when a string of ``least`` bytes over it also starts in a document with a
smaller doc_id. The suffix order is sharded so that nothing is ever sorted as a whole:

0. A text that a smaller document holds whole goes whole, found by digest; such copies take no
   further part.
1. Every window of ``least`` bytes is named by the least hash of the ``GRAM``-byte strings
   inside it. Equal windows have equal names, and neighbours mostly share one, so a run of
   windows with one name is handled as one string.
2. Chunks of documents send their distinct names to name buckets; a bucket answers which
   names occur in more than one document. Each chunk sends a name once, so the most
   frequent passage costs a bucket one entry per chunk.
3. Chunks send the strings of shared names, equal strings once with the least document.
   A bucket sorts the windows of ``least`` bytes of its distinct strings; the least document of
   each run of equal windows tells which have an earlier match. No longest-previous-factor array
   is built: matches beyond ``least`` bytes do not change which bytes go.
4. The spans go back to the chunks and are united.

Documents are shuffled once and the shuffle serves all three passes over them. Texts are
whole and cut into overlapping pieces inside a task, so memory does not follow the longest.
Null text is empty, a null doc_id is smaller than any; rows with one doc_id do not count as
earlier than each other; an empty table gives no rows; extra columns are kept by
``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.bytesets import binary_parts, by_bucket, gram_hashes, joined, mixed, packed, sliding_min
from treeledger.llm.columns import veiled
from treeledger.llm.registry import query
from treeledger.operators.durable import durable
from treeledger.sources.adapters import table

LEAST = 50
GRAM = 20
CHUNK_BYTES = 5 << 20
LEAST_CHUNKS = 64
PIECE_BYTES = 256 << 10
NULL_ID = -(2**63)

SENT = "bucket int, chunk int, once binary, many binary"
ANSWER = "chunk int, names binary"
STRINGS = "bucket int, chunk int, names binary, ids binary, sizes binary, strings binary, counts binary, rows binary, starts binary, spans binary"
SPANS = "chunk int, spans binary"
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def chunk_rows(group):
    """The documents of a chunk in their fixed order, their ids, bytes and offsets, and which are copies of smaller ones."""
    import pyarrow.compute as pc

    marked = group.filter(group.column("mark__"))
    rows = group.filter(pc.invert(group.column("mark__"))).sort_by([("order__", "ascending"), ("text", "ascending")])
    marks = set(zip(marked.column("order__").to_pylist(), marked.column("same__").to_pylist()))
    ids = rows.column("order__").to_numpy()
    copies = np.zeros(len(ids), bool)
    if marks:
        copies[:] = [key in marks for key in zip(ids.tolist(), rows.column("same__").to_pylist())]
    return rows, ids, *binary_parts(rows, "text"), copies


def pieces(data: np.ndarray, offsets: np.ndarray, least: int, skipped: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, starts in them, rows and starts in the rows of documents cut into pieces.

    Pieces of a long document overlap by ``least`` - 1 bytes: every window is in one piece.
    """
    parts, rows, at, held = [], [], [], 0

    def flush():
        sizes = np.array([len(p) for p in parts])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]), np.array(rows), np.array(at)

    wanted = np.diff(offsets) >= least
    if skipped is not None:
        wanted &= ~skipped
    for row in np.flatnonzero(wanted).tolist():
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        for start in range(lo, hi - least + 1, PIECE_BYTES):
            parts.append(data[start:min(hi, start + PIECE_BYTES + least - 1)])
            rows.append(row)
            at.append(start - lo)
            held += len(parts[-1])
            if held >= PIECE_BYTES:
                yield flush()
                parts, rows, at, held = [], [], [], 0
    if parts:
        yield flush()


def runs(data: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end window, name, piece) of the runs of windows that share a name."""
    names = sliding_min(gram_hashes(data, GRAM), least - GRAM + 1)
    cut = np.empty(len(names), bool)
    cut[0] = True
    np.not_equal(names[1:], names[:-1], out=cut[1:])
    ends = starts[1:]
    cut[starts[:-1]] = True
    over = ends - least + 1
    cut[over[over < len(names)]] = True
    first = np.flatnonzero(cut)
    end = np.append(first[1:], len(names))
    piece = np.searchsorted(starts, first, "right") - 1
    inside = first <= ends[piece] - least
    return first[inside], end[inside], names[first[inside]], piece[inside]


def sent_names(group, buckets: int, least: int):
    """Phase 2, chunk side: the distinct names of a chunk by bucket, apart for those of one and of more documents."""
    chunk = group.column("chunk__")[0].as_py()
    _, _, data, offsets, copies = chunk_rows(group)
    found = []
    for text, starts, rows, _ in pieces(data, offsets, least, copies):
        _, _, names, piece = runs(text, starts, least)
        row = rows[piece]
        order = np.lexsort((names, row))
        names, row = names[order], row[order]
        fresh = np.append(True, (names[1:] != names[:-1]) | (row[1:] != row[:-1]))
        found.append(names[fresh])
    names, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    order, cuts = by_bucket((mixed(names) % np.uint64(buckets)).astype(np.int64), buckets)
    names, many = names[order], counts[order] > 1
    out = [(b, chunk, names[i:j][~many[i:j]].tobytes(), names[i:j][many[i:j]].tobytes()) for b, i, j in cuts]
    return packed(out, SENT)


def shared_names(group):
    """Phase 2, bucket side: to each chunk its names that occur in more than one document."""
    chunks, once, many = (group.column(c).to_pylist() for c in ("chunk", "once", "many"))
    lists = [np.frombuffer(a + b, np.uint64) for a, b in zip(once, many)]
    names = np.concatenate(lists)
    weight = np.concatenate([np.repeat([1, 2], [len(a) // 8, len(b) // 8]) for a, b in zip(once, many)])
    kinds, place = np.unique(names, return_inverse=True)
    shared = np.bincount(place, weight, len(kinds))[place] > 1
    ends = np.cumsum([len(x) for x in lists])
    out = [(c, x[shared[e - len(x):e]].tobytes()) for c, x, e in zip(chunks, lists, ends) if shared[e - len(x):e].any()]
    return packed(out, ANSWER)


def sent_strings(group, answers, buckets: int, least: int):
    """Phase 3, chunk side: strings of shared names by bucket; what a smaller document of the chunk holds is a span already."""
    if not answers.num_rows:
        return packed([], STRINGS)
    chunk = group.column("chunk__")[0].as_py()
    _, ids, data, offsets, copies = chunk_rows(group)
    shared = np.sort(joined(answers.column("names").to_pylist(), np.uint64))
    seen: dict[bytes, int] = {}
    names, owners, texts, places, spans = [], [], [], [], []
    for text, starts, rows, at in pieces(data, offsets, least, copies):
        first, end, name, piece = runs(text, starts, least)
        hit = np.minimum(np.searchsorted(shared, name), len(shared) - 1)
        keep = shared[hit] == name
        first, end, name, piece = first[keep], end[keep], name[keep], piece[keep]
        row, start = rows[piece], first - starts[piece] + at[piece]
        flat = text.tobytes()
        for lo, hi, n, r, s in zip(first.tolist(), (end + least - 1).tolist(), name.tolist(), row.tolist(), start.tolist()):
            string, mine = flat[lo:hi], ids[r]
            k = seen.get(string)
            if k is None:
                seen[string] = len(texts)
                names.append(n)
                owners.append(mine)
                texts.append(string)
                places.append([(r, s)])
            elif owners[k] < mine:
                spans.append((r, s, s + hi - lo))
            else:
                places[k].append((r, s))
    seen.clear()
    name = np.array(names, np.uint64)
    out = []
    order, cuts = by_bucket((mixed(name) % np.uint64(buckets)).astype(np.int64), buckets)
    for b, i, j in cuts:
        picked = order[i:j].tolist()
        spots = [p for k in picked for p in places[k]]
        out.append((
            b, chunk, name[order[i:j]].tobytes(), np.array([owners[k] for k in picked], np.int64).tobytes(),
            np.array([len(texts[k]) for k in picked], np.int32).tobytes(), b"".join(texts[k] for k in picked),
            np.array([len(places[k]) for k in picked], np.int32).tobytes(), np.array([r for r, _ in spots], np.int32).tobytes(),
            np.array([s for _, s in spots], np.int32).tobytes(), b""))
    if spans:
        out.append((chunk % buckets, chunk, *[b""] * 7, np.array(spans, np.int32).tobytes()))
    return packed(out, STRINGS)


def earlier_windows(strings: list[bytes], ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows that also start in a string of a smaller document.

    The suffixes are sorted by their first ``least`` bytes, which is as far as the
    longest previous factor is asked for, and within equal ones by document. The previous smaller
    document in suffix order is then within reach exactly when the suffix is not
    of the least document among those it shares ``least`` bytes with.
    """
    data = np.frombuffer(b"".join(strings) + bytes(least + 8), np.uint8)
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(sizes) - sizes
    windows = sizes - least + 1
    string = np.repeat(np.arange(len(strings)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[string] + offset
    words = data.astype(np.uint64)
    for size in (1, 2, 4):  # eight bytes from each position, the first the highest
        words = (words[:-size] << np.uint64(8 * size)) | words[size:]
    keys = [words[at + k] for k in range(0, least - 7, 8)]
    if least % 8:
        keys.append(words[at + least - 8])
    owner = ids[string]
    order = np.lexsort((owner, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    owner = owner[order]
    least_owner = owner[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    matched = np.sort(order[owner > least_owner])
    return string[matched], offset[matched]


def united(spans: np.ndarray) -> np.ndarray:
    """Rows (row, from, to) sorted, with those of a row that overlap or touch made one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    row, lo, hi = spans.T.astype(np.int64)
    far = np.int64(2**32)
    reach = np.maximum.accumulate(row * far + hi)  # rows ascend, so a reach of an earlier row is below any start
    fresh = np.append(True, row[1:] * far + lo[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(row)) - 1
    return np.column_stack([row[first], lo[first], reach[last] - row[first] * far])


def found_spans(group, least: int):
    """Phase 3, bucket side: spans with an earlier match, for each chunk."""
    rows = group.to_pylist()
    least_owner: dict[bytes, int] = {}
    name_of: dict[bytes, int] = {}
    for r in rows:
        flat, p = r["strings"], 0
        r["ids"], r["sizes"] = np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["sizes"], np.int32).tolist()
        r["texts"] = []
        for name, owner, size in zip(np.frombuffer(r["names"], np.uint64).tolist(), r["ids"], r["sizes"]):
            text = flat[p:p + size]
            p += size
            r["texts"].append(text)
            if least_owner.get(text, owner) >= owner:
                least_owner[text] = owner
            name_of[text] = name
        r["strings"] = None
    texts = list(least_owner)
    names = np.array([name_of[t] for t in texts], np.uint64)
    _, place, counts = np.unique(names, return_inverse=True, return_counts=True)
    several = np.flatnonzero(counts[place] > 1) if len(texts) else np.zeros(0, np.int64)
    partly: dict[bytes, list[tuple[int, int]]] = {}
    if len(several):
        picked = [texts[k] for k in several.tolist()]
        string, offset = earlier_windows(picked, np.array([least_owner[t] for t in picked], np.int64), least)
        if len(string):
            spans = united(np.column_stack([string, offset, offset + least]))
            for k, lo, hi in spans.tolist():
                partly.setdefault(picked[k], []).append((lo, hi))
    out: dict[int, list] = {}
    for r in rows:
        mine = out.setdefault(r["chunk"], [])
        if r["spans"]:
            mine.append(np.frombuffer(r["spans"], np.int32).reshape(-1, 3))
        spots = zip(np.frombuffer(r["rows"], np.int32).tolist(), np.frombuffer(r["starts"], np.int32).tolist())
        new = []
        for text, owner, size, count in zip(r["texts"], r["ids"], r["sizes"], np.frombuffer(r["counts"], np.int32).tolist()):
            parts = [(0, size)] if owner > least_owner[text] else partly.get(text, ())
            for _ in range(count):
                row, start = next(spots)
                new += [(row, start + lo, start + hi) for lo, hi in parts]
        if new:
            mine.append(united(np.array(new, np.int64)).astype(np.int32))
    done = [(c, np.concatenate(x).tobytes()) for c, x in out.items() if x]
    return packed(done, SPANS)


def removed_spans(group, answers):
    """The chunk's rows, bytes and offsets, the spans (row, from, to) to take out, and where each row's spans begin."""
    rows, _, data, offsets, copies = chunk_rows(group)
    spans = joined(answers.column("spans").to_pylist(), np.int32).reshape(-1, 3)
    whole = np.flatnonzero(copies)
    spans = united(np.concatenate([spans, np.column_stack([whole, np.zeros_like(whole), np.diff(offsets)[whole]])]).astype(np.int64))
    return rows, data, offsets, spans, np.searchsorted(spans[:, 0], np.arange(rows.num_rows + 1))


def digests(group, answers):
    group, data, offsets, spans, edges = removed_spans(group, answers)
    out = []
    for r, doc in enumerate(group.column("doc_id").to_pylist()):
        body, mine = data[offsets[r]:offsets[r + 1]], spans[edges[r]:edges[r + 1]]
        digest, p = hashlib.sha256(), 0
        for _, lo, hi in mine.tolist():
            digest.update(body[p:lo])
            p = hi
        digest.update(body[p:])
        out.append((doc, len(body), int((mine[:, 2] - mine[:, 1]).sum()) if len(mine) else 0, len(mine), digest.hexdigest()))
    return packed(out, DIGESTS)


def kept_rows(group, answers, columns: list[str]):
    """The rows with their text shortened; only whole characters are taken out."""
    import pyarrow as pa

    group, data, offsets, spans, edges = removed_spans(group, answers)
    texts = group.column("text").to_pylist()
    for r in np.flatnonzero(np.diff(edges)).tolist():
        body = data[offsets[r]:offsets[r + 1]]
        inner = np.append((body & 0xC0) == 0x80, False)  # bytes inside a character
        kept, p = [], 0
        for _, lo, hi in spans[edges[r]:edges[r + 1]].tolist():
            while inner[lo]:
                lo += 1
            while inner[hi]:
                hi -= 1
            if lo < hi:
                kept.append(body[p:lo].tobytes())
                p = hi
        texts[r] = b"".join([*kept, body[p:].tobytes()]).decode()
    out = group.set_column(group.column_names.index("text"), "text", pa.array(texts, group.schema.field("text").type))
    return out.select(columns)


def removal_plan(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Documents by chunk, with a marked row beside each that copies a smaller one whole, and the spans to remove by chunk."""
    if least < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes are needed")
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    chunks = max(LEAST_CHUNKS, -(-total // CHUNK_BYTES))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    chunk = F.pmod(F.xxhash64(order), F.lit(chunks)).cast("int")
    dealt = docs.withColumns({"order__": order, "chunk__": chunk, "same__": F.unhex(F.md5(F.coalesce("text", F.lit("")))), "mark__": F.lit(False)})
    brief = dealt.where(F.octet_length("text") >= least).select("same__", "order__", "chunk__")
    repeated = brief.groupBy("same__").agg(F.min("order__").alias("least__"), F.max("order__").alias("most__")).where("least__ < most__")
    marks = durable(brief.join(repeated, "same__").where("order__ > least__").select("same__", "order__", "chunk__", F.lit(True).alias("mark__")).distinct())
    dealt = dealt.unionByName(marks, allowMissingColumns=True)
    names = dealt.groupBy("chunk__").applyInArrow(lambda g: sent_names(g, chunks, least), SENT)
    shared = names.groupBy("bucket").applyInArrow(shared_names, ANSWER)
    strings = dealt.groupBy("chunk__").cogroup(shared.groupBy("chunk")).applyInArrow(lambda g, a: sent_strings(g, a, chunks, least), STRINGS)
    spans = strings.groupBy("bucket").applyInArrow(lambda g: found_spans(g, least), SPANS)
    return dealt, spans


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with repeated strings taken out of ``text``; all columns kept."""
    rows = veiled(docs, "doc_id", "text")
    dealt, spans = removal_plan(rows, least)
    columns = rows.columns
    return dealt.groupBy("chunk__").cogroup(spans.groupBy("chunk")).applyInArrow(lambda g, a: kept_rows(g, a, columns), rows.schema).toDF(*docs.columns)


@query("op10_previous_factors")
def op10_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt, spans = removal_plan(docs, LEAST)
    return dealt.groupBy("chunk__").cogroup(spans.groupBy("chunk")).applyInArrow(digests, DIGESTS)

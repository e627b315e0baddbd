"""Plain versions of the corpus operators, for small inputs."""

import collections
import hashlib
import math
import re

LOWEST = -(2**63)


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(k) for k in range(n)]


def shingles(text, words):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(w) < words:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k:k + words]) for k in range(len(w) - words + 1))


def similar(rows, words, percent):
    """Sorted (doc_id, set size, component) of rows with distinct doc_ids."""
    sets = [shingles(t, words) for _, t in rows]
    having = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for e in s:
            having[e].append(k)
    links = []
    for k, s in enumerate(sets):
        for j, shared in collections.Counter(j for e in s for j in having[e] if j < k).items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                links.append((j, k))
    root = components(len(rows), links)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], d), d)
    return sorted((d, len(sets[k]), least[root[k]]) for k, (d, _) in enumerate(rows))


def removed(rows, least=50):
    """Per row the text's bytes and a flag for each that goes."""
    first = {}
    key = lambda d: LOWEST if d is None else d
    for d, t in sorted(rows, key=lambda r: key(r[0])):
        body = (t or "").encode()
        for k in range(len(body) - least + 1):
            first.setdefault(body[k:k + least], key(d))
    out = []
    for d, t in rows:
        body = (t or "").encode()
        gone = bytearray(len(body))
        for k in range(len(body) - least + 1):
            if first[body[k:k + least]] < key(d):
                gone[k:k + least] = b"\1" * least
        out.append((body, gone))
    return out


def removal_digests(rows, least=50):
    out = []
    for (d, _), (body, gone) in zip(rows, removed(rows, least)):
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out.append((d, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def kept_text(body, gone):
    """Only whole characters go."""
    out, k = [], 0
    for c in body.decode():
        size = len(c.encode())
        if not all(gone[k:k + size]):
            out.append(c)
        k += size
    return "".join(out)


def digest(*parts):
    return hashlib.md5(":".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()


def poisson(u, mean):
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u:
        k += 1
        p *= mean / k
        total += p
    return k


def mixture(rows, seed, temper=0.5):
    """(row, copy) in shuffled order of rows with doc_id and source as their first two values."""
    sizes = collections.Counter(r[1] for r in rows)
    weights = {s: n**temper for s, n in sizes.items()}
    out = []
    for r in rows:
        mean = len(rows) * weights[r[1]] / sum(weights.values()) / sizes[r[1]]
        u = int(digest(seed, r[0], 0)[:13], 16) / 2**52
        out += [(r, c) for c in range(poisson(u, mean))]
    return sorted(out, key=lambda x: digest(seed + 1, x[0][0], x[1]))


def packed(sizes, options):
    """(sequence, final length, position) by looking at every open sequence for every item."""
    bins, out = [], []
    for k, size in enumerate(sizes):
        rest = sizes[k + 1:]
        fitting = [b for b in bins if b["length"] - b["used"] >= size]
        if fitting:
            room = min(b["length"] - b["used"] for b in fitting)
            chosen = max((b for b in fitting if b["length"] - b["used"] == room), key=lambda b: b["last"])
        else:
            def price(c):
                more = min(c - size, sum(rest)) if rest and min(sizes) <= c - size else 0
                return options.cost(c) / (size + more), c
            chosen = {"length": min((c for c in options.lengths if c >= size), key=price), "used": 0, "id": len(bins)}
            bins.append(chosen)
        out.append((chosen["id"], chosen["used"]))
        chosen["used"] += size
        chosen["last"] = k
    return [(k, min(c for c in options.lengths if c >= bins[k]["used"]), at) for k, at in out]

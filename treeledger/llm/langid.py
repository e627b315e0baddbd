"""Language identification: a bidirectional gated recurrent network over bytes.

Both directions read windows of ``window`` bytes; every byte is labelled from the two
states at it, and a document's probabilities are the mean over its letter positions. The
network is trained with numpy by backpropagation through time on a bounded sample of labelled
rows (``per_language`` distinct texts of each language, of the ``languages`` commonest where that is set; one excerpt of
``excerpt`` characters at a place drawn from the text), then applied to every byte of every
text where the text lies: no shuffle.

A text that is null or holds no letter is ``und`` with score 0, as is everything when there is
nothing to learn from. Rows without language are predicted but not learned from; repeated
texts count once in the sample; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.bytesets import binary_parts, packed
from treeledger.llm.registry import query
from treeledger.sources.adapters import table

UNKNOWN = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, agreement double"
LETTER_BYTES = np.zeros(256, bool)
LETTER_BYTES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Training:
    hidden: int = 8
    window: int = 64
    per_language: int = 200
    languages: int | None = None
    excerpt: int = 400
    epochs: int = 5
    batch: int = 128
    rate: float = 0.02
    seed: int = 5


@dataclass
class Network:
    """``ways``: for each direction (input table, gate weights, candidate weights); ``out``: weights and bias of the labels."""

    labels: list[str]
    ways: list[list[np.ndarray]]
    out: list[np.ndarray]
    window: int


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def read(text: np.ndarray, way: list[np.ndarray], times, trace: list | None = None) -> np.ndarray:
    """States (time, window, hidden) of one direction over ``text`` (time, window)."""
    table_, gates, candidate = way
    h = candidate.shape[0]
    states = np.zeros((len(text), text.shape[1], h), np.float32)
    state = np.zeros((text.shape[1], h), np.float32)
    for t in times:
        x = table_[text[t]]
        g = x[:, :2 * h] + state @ gates
        sigmoid(g)
        update, reset = g[:, :h], g[:, h:]
        held = reset * state
        new = x[:, 2 * h:] + held @ candidate
        np.tanh(new, out=new)
        if trace is not None:
            trace.append((t, state, update, reset, held, new))
        step = new - state
        step *= update
        state = np.add(state, step, out=states[t])
    return states


def probabilities(states: list[np.ndarray], out: list[np.ndarray]) -> np.ndarray:
    weights, bias = out
    h = states[0].shape[-1]
    p = states[0] @ weights[:h]
    p += states[1] @ weights[h:]
    p += bias
    p -= p.max(axis=-1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=-1, keepdims=True)
    return p


def back(way: list[np.ndarray], trace: list, text: np.ndarray, grad: np.ndarray) -> list[np.ndarray]:
    """Gradients of one direction through time from those of its states."""
    table_, gates, candidate = way
    h = candidate.shape[0]
    d_gates, d_candidate, d_inputs = np.zeros_like(gates), np.zeros_like(candidate), np.zeros((*text.shape, 3 * h), np.float32)
    later = np.zeros_like(grad[0])
    for t, state, update, reset, held, new in reversed(trace):
        total = grad[t] + later
        d_new = total * update * (1 - new * new)
        d_held = d_new @ candidate.T
        d_g = np.concatenate([total * (new - state) * update * (1 - update), d_held * state * reset * (1 - reset)], axis=1)
        d_candidate += held.T @ d_new
        d_gates += state.T @ d_g
        later = total * (1 - update) + d_held * reset + d_g @ gates.T
        d_inputs[t, :, :2 * h], d_inputs[t, :, 2 * h:] = d_g, d_new
    flat, codes = d_inputs.reshape(-1, 3 * h), text.ravel()
    d_table = np.column_stack([np.bincount(codes, flat[:, k], 256) for k in range(3 * h)]).astype(np.float32)
    return [d_table, d_gates, d_candidate]


def cut_windows(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte and document of the windows that cover all documents."""
    sizes = np.diff(offsets)
    counts = -(-sizes // window)
    doc = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[:-1][doc] + nth * window, doc


def window_text(data: np.ndarray, first: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (time, window), 0 beyond the document, and where letters are."""
    at = first + np.arange(window)[:, None]
    text = np.where(at < end, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    return text, LETTER_BYTES[text]


def train(samples: list[tuple[str, str]], options: Training = Training()) -> Network | None:
    """A network from (language, text) rows."""
    labels = sorted({lang for lang, _ in samples})
    if not labels:
        return None
    rng, h, n = np.random.default_rng(options.seed), options.hidden, len(labels)

    def drawn(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0] if shape[0] != 256 else 4)).astype(np.float32)

    net = Network(labels, [[drawn(256, 3 * h), drawn(h, 2 * h), drawn(h, h)] for _ in range(2)], [drawn(2 * h, n), np.zeros(n, np.float32)], options.window)
    bodies = [text.encode() for _, text in samples]
    data = np.frombuffer(b"".join(bodies) or b"\0", np.uint8)
    offsets = np.cumsum([0, *map(len, bodies)])
    first, doc = cut_windows(data, offsets, options.window)
    truth, end = np.array([labels.index(lang) for lang, _ in samples])[doc] if len(doc) else np.zeros(0, int), offsets[1:][doc]
    params = [*net.ways[0], *net.ways[1], *net.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    forward, step = range(options.window), 0
    for epoch in range(options.epochs):
        order = rng.permutation(len(first))
        for k in range(0, len(order), options.batch):
            pick = order[k:k + options.batch]
            text, letters = window_text(data, first[pick], end[pick], options.window)
            traces = [[], []]
            states = [read(text, net.ways[0], forward, traces[0]), read(text, net.ways[1], forward[::-1], traces[1])]
            error = probabilities(states, net.out)
            error[:, np.arange(len(pick)), truth[pick]] -= 1
            error *= (letters / max(1, letters.sum()))[:, :, None]
            error = error.astype(np.float32)
            flat = error.reshape(-1, n)
            grads = []
            for way, trace, weights in zip(net.ways, traces, (net.out[0][:h], net.out[0][h:])):
                grads += back(way, trace, text, error @ weights.T)
            grads += [np.concatenate([s.reshape(-1, h).T @ flat for s in states]), flat.sum(axis=0)]
            step += 1
            rate = options.rate * (1 - epoch / options.epochs)
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def label_documents(net: Network, data: np.ndarray, offsets: np.ndarray, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Mean label probabilities and share of letter positions with each label, per document."""
    n, docs = len(net.labels), len(offsets) - 1
    first, doc = cut_windows(data, offsets, net.window)
    pooled, votes, letters_of = np.zeros((docs, n)), np.zeros((docs, n)), np.zeros(docs)
    forward = range(net.window)
    for k in range(0, len(first), at_once):
        mine = doc[k:k + at_once]
        text, letters = window_text(data, first[k:k + at_once], offsets[1:][mine], net.window)
        p = probabilities([read(text, net.ways[0], forward), read(text, net.ways[1], forward[::-1])], net.out)
        best = p.argmax(axis=-1)
        p *= letters[:, :, None]
        sums = p.sum(axis=0)
        letters_of += np.bincount(mine, letters.sum(axis=0), docs)
        for c in range(n):
            pooled[:, c] += np.bincount(mine, sums[:, c], docs)
            votes[:, c] += np.bincount(mine, ((best == c) & letters).sum(axis=0), docs)
    return pooled / np.maximum(letters_of, 1)[:, None], votes / np.maximum(letters_of, 1)[:, None]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(labelled: DataFrame, options: Training = Training()) -> list[tuple[str, str]]:
    """(language, excerpt) of distinct texts, chosen and cut by a digest of the text alone."""
    known = labelled.where("lang is not null and text is not null")
    digest, unit = F.xxhash64("text"), float(2**63)
    texts = known.groupBy("lang").agg(F.approx_count_distinct(digest).alias("n")).orderBy(F.desc("n"), "lang")
    sizes = {r.lang: max(1, r.n) for r in (texts if options.languages is None else texts.limit(options.languages)).collect()}
    if not sizes:
        return []
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 3.0 * options.per_language / n)))))
    place = F.pmod(digest, F.greatest(F.lit(1), F.length("text") - options.excerpt)).cast("int") + 1
    thin = known.where(F.abs(digest / unit) < share[F.col("lang")]).select("lang", digest.alias("digest"), F.substring(F.col("text"), place, F.lit(options.excerpt)).alias("piece"))
    rows = thin.groupBy("lang", "digest").agg(F.min("piece").alias("piece")).orderBy("digest").limit(4 * options.per_language * len(sizes)).collect()
    taken: dict[str, list[str]] = {}
    for r in rows:
        taken.setdefault(r.lang, []).append(r.piece)
    return [(lang, piece) for lang in sorted(taken) for piece in taken[lang][:options.per_language]]


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, agreement (share of letter positions labelled so)."""
    def batches(it):
        import pyarrow as pa

        for batch in it:
            group = pa.Table.from_batches([batch])
            ids, held, worded = (group.column(c).to_pylist() for c in ("doc_id", "held_out", "worded"))
            data, offsets = binary_parts(group, "text")
            if net is not None:
                pooled, votes = label_documents(net, data, offsets.astype(np.int64))
                best = pooled.argmax(axis=1)
            rows = []
            for r, known in enumerate(worded):
                if known and net is not None:
                    c = int(best[r])
                    rows.append((ids[r], held[r], net.labels[c], min(1.0, float(pooled[r, c])), min(1.0, float(votes[r, c]))))
                else:
                    rows.append((ids[r], held[r], UNKNOWN, 0.0, 0.0))
            if rows:
                yield from packed(rows, PREDICTED).to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("worded"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(batches, PREDICTED)


def learned(docs: DataFrame, options: Training = Training()) -> Network | None:
    """The network from the rows that are not held out."""
    return train(training_sample(docs.where(~held_out()), options), options)


def accepted(docs: DataFrame, net: Network | None, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a language of at least this score; the others are rejected."""
    def batches(it):
        import pyarrow as pa

        for batch in it:
            group = pa.Table.from_batches([batch])
            data, offsets = binary_parts(group, "text")
            pooled, _ = label_documents(net, data, offsets.astype(np.int64))
            yield from group.filter(pa.array(pooled.max(axis=1) >= least)).to_batches()

    return docs.limit(0) if net is None else docs.where(F.col("text").rlike(r"\p{L}")).mapInArrow(batches, docs.schema)


@query("op2_byte_bigru")
def op2_byte_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, learned(docs))

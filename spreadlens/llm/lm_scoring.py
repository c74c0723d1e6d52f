"""Masked pseudo-likelihood of documents from a bidirectional window network (operator 1).

Every word of every text is predicted from the ``SIDE`` words before and after it.  The network predicts a symbol:
position-weighted embeddings of the words around, a soft step x / (1 + |x|), and a softmax in two steps (class of 64 symbols, then
symbol), so that its probabilities sum to one.  The ``KNOWN`` most frequent words of the corpus (counted over all documents)
are symbols of their own.  Any other word is the symbol of its first byte's group, which the network predicts from both sides,
times its spelling: first byte and then each byte given the one before it, up to the end, from counts over all
such words of the corpus.  So every word has a probability of its own, and no two share one by a bucket.  A document's
score is the sum of the log probabilities of all its words.

Training takes every word of every document as a target once.  Texts become streams of symbols, which are dealt
over ``ROUNDS`` rounds; in a round all partitions train from the same weights on their own streams in numpy, and the results
are averaged, weighted by their targets.  A step takes ``STEP`` neighbouring words: the sums over the words around
each target are shifted sums over the stream, and the gradient of a word's embedding is summed once for all its places.

Defined results: a text without words, null included, has no tokens, sum 0 and a null mean; an empty table gives no
rows; null ids stay; repeated rows count in the corpus each time and get equal scores; texts of any length are read whole;
extra columns are left out whatever their names; of equally frequent words at the edge of the known ones that with the
lesser hash is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, flat

CLASSES = WITHIN = 64
#: Known words; the last class holds the symbols of the first bytes of all others.
KNOWN = (CLASSES - 1) * WITHIN
SYMBOLS = CLASSES * WITHIN
#: Words on each side, embedding size.
SIDE, DIM = 2, 32
ROUNDS, STEP, RATE = 4, 4096, 0.3
#: Bytes of text made into one stream.
PIECE = 1 << 17
#: Words whose counts a task sums before it hands them on.
COUNTED = 1 << 21
#: Words scored together; their class scores fit into a core's cache.
CHUNK = 1 << 13
BLOCKS = 8
#: The end of a word in its spelling.
STOP = 256

RESULT = "doc_id bigint, n_tokens bigint, log_likelihood double, mean_log_likelihood double"
COUNTS = "word bigint, n bigint"
#: phase -1: counts of spellings, else a stream of symbols.
STREAMS = "phase int, n bigint, symbols binary"
WEIGHTS = "block int, n double, vals binary"

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
LOWER = flat.lower_table()
OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]


class Words:
    """The words of some texts: bytes, ends, hashes, and the text of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[raw]
        self.starts, self.stops, self.doc = flat.spans(self.low, offsets, WORD)
        self.hashes = flat.span_hashes(self.low, self.starts, self.stops)

    def __len__(self) -> int:
        return len(self.starts)


def words_of(col: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first text, last text + 1, their words) for pieces of the texts."""
    raw, offsets = common.text_buffer(col)
    for i, j in common.pieces(offsets, PIECE):
        yield i, j, Words(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])


# ------------------------------------------------------------------ vocabulary

def _counts(batches):
    def emit(parts):
        words, n = np.unique(np.concatenate(parts), return_counts=True)
        return common.batch(COUNTS, pa.array(words.view(np.int64)), pa.array(n))

    held, size = [], 0
    for b in batches:
        for _, _, w in words_of(b.column(1)):
            held.append(w.hashes)
            size += len(w)
            if size >= COUNTED:
                yield emit(held)
                held, size = [], 0
    if held:
        yield emit(held)


class Vocabulary:
    """Symbols of words, and how often the known ones occur in the corpus."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int):
        self.order = np.argsort(words)
        self.sorted = words[self.order]
        rest = max(0, total - int(counts.sum())) / WITHIN
        self.counts = np.concatenate([counts, np.zeros(KNOWN - len(counts)), np.full(WITHIN, rest)])

    def symbols(self, w: Words) -> np.ndarray:
        """A known word's number, else that of the group of its first byte."""
        other = KNOWN + (w.low[w.starts] % WITHIN).astype(np.int64)
        if not len(self.sorted):
            return other
        at = np.minimum(np.searchsorted(self.sorted, w.hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == w.hashes, self.order[at], other)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The most frequent words of all documents (at most ``KNOWN`` rows come to the driver)."""
    counts = common.checkpointed(common.documents(docs).mapInArrow(_counts, COUNTS).groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    return Vocabulary(np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], float), total)


# ------------------------------------------------------------------ spelling

def steps(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the spelling table that the words ``which`` take, and where each word's begin.

    A cell is (byte before, next byte); the first byte is led up to by its group, the last by the end.
    """
    size = w.stops[which] - w.starts[which]
    begin = np.cumsum(size + 1) - (size + 1)
    nxt = np.full(int((size + 1).sum()), STOP, np.int64)
    inside = np.ones(len(nxt), bool)
    inside[begin + size] = False
    at = np.arange(int(size.sum())) + np.repeat(w.starts[which] - (np.cumsum(size) - size), size)
    nxt[inside] = w.low[at]
    before = np.empty_like(nxt)
    before[1:] = nxt[:-1]
    before[begin] = STOP + 1 + nxt[begin] % WITHIN
    return before * (STOP + 1) + nxt, begin


CELLS = (STOP + 1 + WITHIN) * (STOP + 1)


def spelling(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the cells; bytes no word has had keep a small share."""
    n = counts.reshape(-1, STOP + 1).astype(np.float64)
    fits = np.concatenate([WORD, [True]])[None].repeat(len(n), 0)
    lead = np.arange(STOP + 1)[None] % WITHIN == np.arange(WITHIN)[:, None]
    fits[STOP + 1:] = lead & WORD[np.minimum(np.arange(STOP + 1), 255)] & (np.arange(STOP + 1) < STOP)
    n = np.where(fits, n + 0.5, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log(n / n.sum(1, keepdims=True)).ravel()


# ------------------------------------------------------------------ network

def init(v: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    """Random weights whose biases give the corpus frequencies of the symbols."""
    rng = np.random.default_rng(seed)
    g = lambda *s, a: (rng.standard_normal(s) * a).astype(np.float32)
    c = v.counts.reshape(CLASSES, WITHIN) + 0.5
    return {"emb": np.concatenate([g(SYMBOLS, DIM, a=0.3), np.zeros((1, DIM), np.float32)]), "pos": np.ones((2 * SIDE, DIM), np.float32),
            "b": np.zeros(DIM, np.float32), "cls": g(DIM, CLASSES, a=0.05), "cb": np.log(c.sum(1) / c.sum()).astype(np.float32),
            "sym": g(CLASSES, DIM, WITHIN, a=0.05), "sb": np.log(c / c.sum(1, keepdims=True)).astype(np.float32)}


def hidden(p: dict, seen: np.ndarray) -> np.ndarray:
    """Hidden values of the places of a stream, from the embeddings ``seen`` there and ``SIDE`` places further both ways."""
    n = len(seen) - 2 * SIDE
    x = seen[:n] * p["pos"][0]
    for k, o in enumerate(OFFSETS[1:], 1):
        x += seen[SIDE + o:SIDE + o + n] * p["pos"][k]
    x += p["b"]
    return x / (1 + np.abs(x))


def by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that brings targets of a class together, and (class, begin, end) of those that occur."""
    cls = (target // WITHIN).astype(np.uint8)
    order = np.argsort(cls, kind="stable")
    ends = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, ends[c], ends[c + 1]) for c in range(CLASSES) if ends[c + 1] > ends[c]]


def needs_shift(p: dict) -> bool:
    """Whether a score may be too large for ``exp`` as it is; hidden values lie in [-1, 1], so the weights bound it."""
    return max((np.abs(p["cls"]).sum(0) + np.abs(p["cb"])).max(), (np.abs(p["sym"]).sum(1) + np.abs(p["sb"])).max()) > 80


def exponentials(scores: np.ndarray, shift: bool) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the scores, if need be shifted by the greatest of a row, and their sums; overwrites ``scores``."""
    if shift:
        scores -= scores.max(1, keepdims=True)
    np.exp(scores, out=scores)
    return scores, scores @ np.ones(scores.shape[1], scores.dtype)


def log_probability(p: dict, h: np.ndarray, target: np.ndarray, shift: bool = True) -> np.ndarray:
    """Log probability of each target symbol given the hidden values of its place."""
    scores, total = exponentials(h @ p["cls"] + p["cb"], shift)
    likely = scores[np.arange(len(target)), target // WITHIN] / total
    order, classes = by_class(target)
    hs, ts = h.take(order, axis=0), target[order] % WITHIN
    own = np.empty(len(target), likely.dtype)
    for c, i, j in classes:
        scores, total = exponentials(hs[i:j] @ p["sym"][c] + p["sb"][c], shift)
        own[i:j] = scores[np.arange(j - i), ts[i:j]] / total
    likely[order] *= own
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(likely), -80.0)


def gradients(p: dict, stream: np.ndarray) -> tuple[int, dict]:
    """Number of targets of a stream, and gradients of their mean negative log probability; ``emb`` as (rows, values).

    The first and last ``SIDE`` places are only seen, as are gaps between texts.
    """
    seen = p["emb"].take(stream, axis=0)
    inner = stream[SIDE:len(stream) - SIDE]
    at = np.flatnonzero(inner < SYMBOLS)
    n = len(at)
    every = hidden(p, seen)
    order, classes = by_class(inner[at])
    at = at[order]  # everything in the order of the classes
    target, h = inner[at], every.take(at, axis=0)
    kind = h.dtype.type
    shift = needs_shift(p)
    d, total = exponentials(h @ p["cls"] + p["cb"], shift)
    d /= total[:, None]
    for c, i, j in classes:
        d[i:j, c] -= 1
    d *= kind(1 / n)
    g = {"cls": h.T @ d, "cb": d.sum(0), "sym": np.zeros_like(p["sym"]), "sb": np.zeros_like(p["sb"])}
    dh = d @ p["cls"].T
    own = target % WITHIN
    for c, i, j in classes:
        e, total = exponentials(h[i:j] @ p["sym"][c] + p["sb"][c], shift)
        e /= total[:, None]
        e[np.arange(j - i), own[i:j]] -= 1
        e *= kind(1 / n)
        g["sym"][c], g["sb"][c] = h[i:j].T @ e, e.sum(0)
        dh[i:j] += e @ p["sym"][c].T
    dx = np.zeros_like(every)
    dx[at] = dh * np.square(1 - np.abs(h))
    g["b"] = dx.sum(0)
    m = len(inner)
    g["pos"] = np.stack([np.einsum("ij,ij->j", dx, seen[SIDE + o:SIDE + o + m]) for o in OFFSETS])
    back = np.zeros_like(seen)
    for k, o in enumerate(OFFSETS):
        back[SIDE + o:SIDE + o + m] += dx * p["pos"][k]
    order = np.argsort(stream.astype(np.uint16), kind="stable")
    rows, starts = np.unique(stream[order], return_index=True)
    g["emb"] = (rows, np.add.reduceat(back.take(order, axis=0), starts, axis=0))
    return n, g


def padded(streams: np.ndarray) -> np.ndarray:
    return np.concatenate([np.full(SIDE, SYMBOLS, streams.dtype), streams, np.full(SIDE, SYMBOLS, streams.dtype)])


def train(p: dict, stream: np.ndarray, rate: float, seed: int, square: dict | None = None) -> int:
    """One pass of Adagrad steps over a stream; changes ``p`` and returns the number of targets."""
    square = {k: np.full_like(v, 1e-6) for k, v in p.items()} if square is None else square
    whole, count = padded(stream), 0
    starts = np.arange(0, len(stream), STEP)
    for i in np.random.default_rng(seed).permutation(starts).tolist():
        part = whole[i:min(i + STEP, len(stream)) + 2 * SIDE]
        if (part[SIDE:len(part) - SIDE] == SYMBOLS).all():
            continue
        n, g = gradients(p, part)
        count += n
        for name, d in g.items():
            rows, d = d if isinstance(d, tuple) else (slice(None), d)
            s = square[name][rows] + d * d
            square[name][rows] = s
            p[name][rows] -= d.dtype.type(rate) * d / np.sqrt(s)
    p["emb"][SYMBOLS] = 0  # the place beyond a text's ends
    return count


def stream_of(symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Symbols of several texts in a row, with ``SIDE`` gaps between texts."""
    out = np.full(len(symbols) + SIDE * (int(doc[-1] - doc[0]) if len(doc) else 0), SYMBOLS, np.int64)
    out[np.arange(len(symbols)) + SIDE * (doc - doc[0]) if len(doc) else []] = symbols
    return out


# ------------------------------------------------------------------ on Spark

def _streams(batches, vocabulary, rounds):
    """Streams of symbols, dealt over the rounds, and at last the spelling counts of unknown words."""
    v, cells = vocabulary.value, np.zeros(CELLS, np.int64)
    for b in batches:
        for _, _, w in words_of(b.column(1)):
            if not len(w):
                continue
            s = v.symbols(w)
            taken, _ = steps(w, np.flatnonzero(s >= KNOWN))
            cells += np.bincount(taken, minlength=CELLS)
            if rounds:
                _, doc = np.unique(w.doc, return_inverse=True)
                phase = int(np.bitwise_xor.reduce(w.hashes) % np.uint64(rounds))
                yield common.batch(STREAMS, [phase], [len(s)], [stream_of(s, doc).astype("<u2").tobytes()])
    yield common.batch(STREAMS, [-1], [int(cells.sum())], [cells.astype(np.float64).tobytes()])


def pack(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpack(values: np.ndarray, like: dict) -> dict:
    out, i = {}, 0
    for k in sorted(like):
        out[k] = values[i:i + like[k].size].reshape(like[k].shape).astype(np.float32)
        i += like[k].size
    return out


def _local_training(batches, start, rate, seed):
    """Train on streams as they come, then hand on the weights, multiplied by the number of targets, in blocks."""
    p, square, seen = None, None, 0
    for b in batches:
        for raw in b.column(2).to_pylist():
            if p is None:
                p = {k: v.copy() for k, v in start.value.items()}
                square = {k: np.full_like(v, 1e-6) for k, v in p.items()}
            seen += train(p, np.frombuffer(raw, "<u2").astype(np.int64), rate, seed + seen, square)
    if seen:
        for i, part in enumerate(np.array_split(pack(p).astype(np.float64) * seen, BLOCKS)):
            yield common.batch(WEIGHTS, [i], [float(seen)], [part.tobytes()])


def _sums(batches):
    """Sum the values of each block, one row at a time."""
    total: dict[int, list] = {}
    for b in batches:
        for block, n, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
            v = np.frombuffer(raw)
            if block in total:
                total[block][0] += n
                total[block][1] += v
            else:
                total[block] = [n, v.copy()]
    for block, (n, v) in total.items():
        yield common.batch(WEIGHTS, [block], [n], [v.tobytes()])


def summed(rows: DataFrame) -> list[tuple[int, float, np.ndarray]]:
    """(block, n, values) summed over ``rows``, in two steps, so that no task reads what all partitions made."""
    some = rows.repartition(BLOCKS * 8, "block", F.pmod(F.xxhash64("vals"), F.lit(8))).mapInArrow(_sums, WEIGHTS)
    return sorted(((x["block"], x["n"], np.frombuffer(x["vals"])) for x in some.repartition(BLOCKS, "block").mapInArrow(_sums, WEIGHTS).collect()),
                  key=lambda x: x[0])


def fit(docs: DataFrame, rounds: int = ROUNDS):
    """The vocabulary, spelling and weights learnt from all documents, broadcast."""
    common.bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    v = vocabulary(docs)
    streams = common.checkpointed(common.documents(docs).mapInArrow(partial(_streams, vocabulary=sc.broadcast(v), rounds=rounds), STREAMS))
    cells = summed(streams.filter("phase = -1").select(F.lit(0).alias("block"), F.col("n").cast("double").alias("n"), F.col("symbols").alias("vals")))
    spell = spelling(cells[0][2] if cells else np.zeros(CELLS))
    p = init(v)
    for r in range(rounds):
        trained = streams.filter(F.col("phase") == r).mapInArrow(partial(_local_training, start=sc.broadcast(p), rate=RATE / (1 + r), seed=r), WEIGHTS)
        sums = summed(trained)
        if sums:
            p = unpack(np.concatenate([x / n for _, n, x in sums]), p)
    return sc.broadcast((v, spell, p))


def score_words(w: Words, v: Vocabulary, spell: np.ndarray, p: dict) -> np.ndarray:
    """Log probability of every word."""
    s = v.symbols(w)
    _, doc = np.unique(w.doc, return_inverse=True)
    stream = padded(stream_of(s, doc))
    place = np.arange(len(s)) + SIDE * doc
    out, shift = np.empty(len(s)), needs_shift(p)
    for a in range(0, len(s), CHUNK):
        b = min(a + CHUNK, len(s))
        first, last = place[a], place[b - 1] + 1
        h = hidden(p, p["emb"].take(stream[first:last + 2 * SIDE], axis=0))
        out[a:b] = log_probability(p, h.take(place[a:b] - first, axis=0), s[a:b], shift)
    other = np.flatnonzero(s >= KNOWN)
    if len(other):
        taken, begin = steps(w, other)
        out[other] += np.add.reduceat(spell[taken], begin)
    return out


def score_batch(col: pa.Array, v: Vocabulary, spell: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and sum of log probabilities of each text."""
    count, total = np.zeros(len(col), np.int64), np.zeros(len(col))
    for i, j, w in words_of(col):
        if len(w):
            total[i:j] = np.bincount(w.doc, score_words(w, v, spell, p), j - i)
            count[i:j] = np.bincount(w.doc, minlength=j - i)
    return count, total


def _score(batches, model):
    v, spell, p = model.value
    for b in batches:
        n, total = score_batch(b.column(1), v, spell, p)
        mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
        yield common.batch(RESULT, b.column(0), pa.array(n), pa.array(total), mean)


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: words, summed and mean log probability of its words given those around them."""
    return common.documents(docs).mapInArrow(partial(_score, model=fit(docs, rounds)), RESULT)

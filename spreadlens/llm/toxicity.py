"""Toxicity scores from a bidirectional GRU with attention pooling, trained in numpy (operator 3).

Every word becomes a vector of its hashed word embedding, the mean of its
hashed character-gram embeddings, and that of the grams at its two ends.  A GRU reads windows of ``WINDOW`` words in
both directions, attention pools its states, and a logistic unit scores the
window.  All overlapping windows of a whole text are scored; the text's score
is the calibrated score of its highest window.

Training: at most ``SAMPLE_ROWS`` labelled rows a class and ``SAMPLE_BYTES``
of text (whole texts, in the order of a hash of the id; half the bytes a
class, texts over a sixteenth of that last, texts over it never) are taken to
the driver; this bound on the labelled sample is all that doesn't cover all data.
Only a text's label is known, so training starts from random windows and goes
on with the highest windows under the current weights.  A fifth of the sample
is kept out of it to fit the calibration.

Defined results: a text without words, null included, scores 0; null ids (held_out null)
never are training rows; an id with several labels counts as toxic if any row
says so; a sample without both classes gives the constant share of toxic rows
among all labelled ones;
repeated rows get equal scores; longer texts have more windows, none cut off.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, flat

#: Bounds of the labelled sample.
SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 24 << 20
THRESHOLD = 0.3
WINDOW, STRIDE = 32, 16
WORD_BUCKETS, GRAM_BUCKETS = 1 << 13, 1 << 16
DIM, HIDDEN = 8, 8
GRAMS = (3, 4, 5)
EDGE_GRAMS = (4, 5, 6)
INPUT = 3 * DIM
PIECE = 2 << 20
ROUNDS, EPOCHS, BATCH = 4, 3, 256
#: Distinct words whose grams are held at once.
CHUNK_WORDS = 1 << 14

RESULT = "doc_id bigint, held_out boolean, score double, predicted int"

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


# ------------------------------------------------------------------ words and windows

@dataclass
class Words:
    """Texts as word numbers: text t has words ``at[first[t]:first[t + 1]]``.

    Each distinct word has a bucket, and in ``grams`` a list of gram buckets of
    its inside and of its ends: (all buckets, where each word's begin).
    """

    first: np.ndarray
    at: np.ndarray
    bucket: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]


def gram_buckets(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the byte grams of each word between a begin and an end mark: all, and those that hold a mark."""
    size = stops - starts + 2
    edge = np.concatenate([[0], np.cumsum(size)])
    text = np.ones(edge[-1], np.uint64)
    mark = np.zeros(edge[-1], bool)
    mark[edge[:-1]] = mark[edge[1:] - 1] = True
    src = np.repeat(starts - edge[:-1] - 1, size) + np.arange(edge[-1])
    text[~mark] = buf[src[~mark]]
    word = np.repeat(np.arange(len(starts)), size)
    out = []
    for lengths, at_ends in ((GRAMS, False), (EDGE_GRAMS, True)):
        found, owner = [], []
        for n in lengths:
            h = flat.window_hashes(text, n)
            k = np.arange(len(h))
            ok = word[:len(h)] == word[n - 1:n - 1 + len(h)]
            if at_ends:
                ok &= mark[:len(h)] | mark[n - 1:n - 1 + len(h)]
            k = k[ok]
            found.append(((h[k] + np.uint64(n + 100 * at_ends)) % np.uint64(GRAM_BUCKETS)).astype(np.int32))
            owner.append(word[k])
        # every word owns at least the bucket of its length, so that no mean is empty
        found.append((size % GRAM_BUCKETS).astype(np.int32))
        owner.append(np.arange(len(starts)))
        owner, found = np.concatenate(owner), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        out.append((found[order], np.searchsorted(owner[order], np.arange(len(starts) + 1))))
    return out


def words_of(texts: list[str]) -> Words:
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    starts, stops, doc = flat.spans(buf, offsets, WORD)
    hashes, one, at = np.unique(flat.span_hashes(buf, starts, stops), return_index=True, return_inverse=True)
    parts = [gram_buckets(buf, starts[k], stops[k]) for k in np.array_split(one, max(1, -(-len(one) // CHUNK_WORDS)))]
    grams = []
    for lists in zip(*parts, strict=True):
        before = np.cumsum([0] + [len(g) for g, _ in lists])
        grams.append((np.concatenate([g for g, _ in lists]), np.concatenate([*[f[:-1] + b for (_, f), b in zip(lists, before)], before[-1:]])))
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    return Words(first, at.astype(np.int32), (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), grams)


def windows_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (windows x WINDOW, -1 beyond a text's end) of all overlapping windows, and the text of each."""
    n = np.diff(w.first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    place = (w.first[text] + k * STRIDE).astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
    inside = place < w.first[text + 1][:, None]
    place[~inside] = 0
    index = w.at[place] if len(w.at) else np.full(place.shape, -1, np.int32)
    index[~inside] = -1
    return index, text


# ------------------------------------------------------------------ network

def init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    g = lambda *s, a=1.0: (rng.standard_normal(s) * a).astype(np.float32)
    d = INPUT
    return {"word": g(WORD_BUCKETS, DIM, a=0.1), "gram": g(GRAM_BUCKETS, DIM, a=0.3), "x": g(2, d, 3 * HIDDEN, a=d ** -0.5),
            "xb": np.zeros((2, 1, 3 * HIDDEN), np.float32), "u": g(2, HIDDEN, 3 * HIDDEN, a=HIDDEN ** -0.5),
            "nb": np.zeros((2, 1, HIDDEN), np.float32), "att": g(2 * HIDDEN, a=0.3), "out": g(2 * HIDDEN, a=0.3),
            "ob": np.zeros(1, np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def word_vectors(p: dict, w: Words, which: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Vectors of the distinct words ``which``; the buckets and counts of their grams."""
    parts, lists = [p["word"][w.bucket[which]]], []
    for grams, first in w.grams:
        n = first[which + 1] - first[which]
        begin = np.cumsum(n) - n
        own = grams[np.repeat(first[which] - begin, n) + np.arange(int(n.sum()))]
        parts.append(np.add.reduceat(p["gram"][own], begin, axis=0) / n[:, None].astype(np.float32))
        lists.append((own, n))
    return np.concatenate(parts, 1).astype(np.float32), lists


def forward(p: dict, gates: np.ndarray, index: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logits of windows; ``gates`` (2, words + 1, 3 HIDDEN) holds the words' gate inputs, its last row the padding."""
    b, t_n, h_n = len(index), index.shape[1], HIDDEN
    index = np.ascontiguousarray(index.T)
    mask = (index >= 0)
    states = np.empty((t_n, b, 2 * h_n), np.float32)
    h = np.zeros((2, b, h_n), np.float32)
    for t in range(t_n):
        tb = t_n - 1 - t
        x = np.stack([gates[0][index[t]], gates[1][index[tb]]])
        m = np.stack([mask[t], mask[tb]])[:, :, None]
        hu = h @ p["u"]
        rz = sigmoid(x[..., :2 * h_n] + hu[..., :2 * h_n])
        r, z = rz[..., :h_n], rz[..., h_n:]
        un = hu[..., 2 * h_n:] + p["nb"]
        n = np.tanh(x[..., 2 * h_n:] + r * un)
        new = np.where(m, n + z * (h - n), h)
        if keep is not None:
            keep.append((h, r, z, un, n, m))
        h = new
        states[t, :, :h_n], states[tb, :, h_n:] = h[0], h[1]
    e = np.where(mask, states @ p["att"], np.float32(-1e9))
    e -= e.max(0)
    a = np.exp(e)
    a /= a.sum(0)
    pooled = np.einsum("tb,tbh->bh", a, states)
    if keep is not None:
        keep.append((states, a, pooled))
    return pooled @ p["out"] + p["ob"][0]


def backward(p: dict, keep: list, dlogit: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients; ``x`` holds those of the gate inputs, (2, T, B, 3 HIDDEN) in the order of reading."""
    states, a, pooled = keep.pop()
    t_n, b, h_n = states.shape[0], states.shape[1], HIDDEN
    dp = dlogit[:, None] * p["out"]
    de = a * (np.einsum("tbh,bh->tb", states, dp) - (pooled * dp).sum(1))
    ds = a[:, :, None] * dp + de[:, :, None] * p["att"]
    g = {"out": dlogit @ pooled, "ob": np.array([dlogit.sum()]), "att": np.einsum("tb,tbh->h", de, states),
         "u": np.zeros_like(p["u"]), "nb": np.zeros_like(p["nb"])}
    dx = np.empty((2, t_n, b, 3 * h_n), np.float32)
    carry = np.zeros((2, b, h_n), np.float32)
    ut = p["u"].transpose(0, 2, 1)
    for t in range(t_n - 1, -1, -1):
        h, r, z, un, n, m = keep[t]
        dh = carry + np.stack([ds[t, :, :h_n], ds[t_n - 1 - t, :, h_n:]])
        on = dh * m
        dn = on * (1 - z) * (1 - n * n)
        dz = on * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        dx[:, t] = np.concatenate([dr, dz, dn], 2)
        dhu = np.concatenate([dr, dz, dn * r], 2)
        g["u"] += h.transpose(0, 2, 1) @ dhu
        g["nb"] += (dn * r).sum(1, keepdims=True)
        carry = dh * ~m + on * z + dhu @ ut
    g["x"] = dx
    return g


def step(p: dict, w: Words, index: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator | None) -> tuple[float, dict]:
    """Loss and gradients of one batch; with ``rng`` some words lose their word embedding, so that characters count."""
    which, at = np.unique(index, return_inverse=True)
    at = at.reshape(index.shape)
    pad = int(which[0] == -1)
    which = which[pad:]
    index = at - pad
    vec, lists = word_vectors(p, w, which)
    drop = np.ones((len(which), 1), np.float32) if rng is None else (rng.random((len(which), 1)) > 0.4).astype(np.float32)
    vec[:, :DIM] *= drop
    gates = np.concatenate([vec @ p["x"] + p["xb"], np.zeros((2, 1, 3 * HIDDEN), np.float32)], 1)
    keep: list = []
    logit = forward(p, gates, index, keep)
    prob = sigmoid(logit)
    loss = float(-(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum() / weight.sum())
    g = backward(p, keep, ((prob - y) * weight / weight.sum()).astype(np.float32))
    dx = g["x"]
    total = np.zeros((2, len(which) + 1, 3 * HIDDEN), np.float32)
    np.add.at(total[0], index.T, dx[0])
    np.add.at(total[1], index.T[::-1], dx[1])
    dg = total[:, :-1]
    g["x"], g["xb"] = vec.T @ dg, dg.sum(1, keepdims=True)
    dvec = np.einsum("kwg,kdg->wd", dg, p["x"])
    g["word"] = (w.bucket[which], dvec[:, :DIM] * drop)
    spread = [np.repeat(dvec[:, (i + 1) * DIM:(i + 2) * DIM] / n[:, None].astype(np.float32), n, axis=0) for i, (_, n) in enumerate(lists)]
    g["gram"] = (np.concatenate([own for own, _ in lists]), np.concatenate(spread))
    return loss, g


class Optimiser:
    """Adam for the dense weights, Adagrad for the embedding rows that a batch touches."""

    def __init__(self, p: dict, rate: float = 0.01, rows_rate: float = 0.05):
        self.p, self.rate, self.rows_rate, self.t = p, rate, rows_rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def apply(self, g: dict) -> None:
        self.t += 1
        for k, d in g.items():
            if isinstance(d, tuple):
                rows, at = np.unique(d[0], return_inverse=True)
                s = np.zeros((len(rows), d[1].shape[1]), np.float32)
                np.add.at(s, at, d[1])
                self.v[k][rows] += s * s
                self.p[k][rows] -= self.rows_rate * s / (np.sqrt(self.v[k][rows]) + 1e-8)
            else:
                d = d.astype(np.float32)
                self.m[k] += 0.1 * (d - self.m[k])
                self.v[k] += 0.01 * (d * d - self.v[k])
                lift = np.sqrt(1 - 0.99 ** self.t) / (1 - 0.9 ** self.t)
                self.p[k] -= np.float32(self.rate * lift) * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)


def logits(p: dict, w: Words, index: np.ndarray, size: int = 2048) -> np.ndarray:
    """Logits of all windows."""
    if not len(index):
        return np.empty(0, np.float32)
    gates = np.zeros((2, len(w.bucket) + 1, 3 * HIDDEN), np.float32)
    for k in range(0, len(w.bucket), CHUNK_WORDS):
        which = np.arange(k, min(len(w.bucket), k + CHUNK_WORDS))
        gates[:, which] = word_vectors(p, w, which)[0] @ p["x"] + p["xb"]
    return np.concatenate([forward(p, gates, index[i:i + size]) for i in range(0, len(index), size)])


def logits_by_slice(p: dict, w: Words, index: np.ndarray, size: int = 4096) -> np.ndarray:
    """``logits`` that holds the gate inputs of one slice's words at a time, for texts with many distinct words."""
    out = np.empty(len(index), np.float32)
    for i in range(0, len(index), size):
        which, at = np.unique(index[i:i + size], return_inverse=True)
        pad = int(which[0] == -1)
        gates = np.zeros((2, len(which) - pad + 1, 3 * HIDDEN), np.float32)
        gates[:, :-1] = word_vectors(p, w, which[pad:])[0] @ p["x"] + p["xb"]
        out[i:i + size] = forward(p, gates, at.reshape(-1, index.shape[1]) - pad)
    return out


def highest(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The highest window logit of each of ``n`` texts; -inf without windows (windows are in the order of texts)."""
    out = np.full(n, -np.inf)
    np.maximum.at(out, text, values)
    return out


# ------------------------------------------------------------------ training

def calibration(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels on logits, with softened labels (Newton steps)."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, s = q - t, np.maximum(q * (1 - q), 1e-9)
        grad = np.array([(r * x).sum() + 1e-3 * a, r.sum()])
        hess = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        a, b = a - move[0], b - move[1]
    return (a, b) if a > 0 else (0.0, float(np.log((n1 + 1) / (n0 + 1))))


def train(texts: list[str], labels: np.ndarray, toxic_share: float | None = None, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights from whole texts and their 0/1 labels; ``scale`` turns the highest window's logit into the score.

    ``toxic_share`` is that of all labelled rows, where the sample holds another share (its classes have separate bounds).
    """
    rng = np.random.default_rng(seed)
    p = init(rng)
    y = labels.astype(np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        share = share if toxic_share is None else toxic_share
        return p | {"scale": np.array([0.0, np.log((share + 1e-6) / (1 - share + 1e-6))])}
    w = words_of(texts)
    index, text = windows_of(w)
    begin = np.searchsorted(text, np.arange(len(texts) + 1))
    some = np.flatnonzero(np.diff(begin) > 0)
    kept_out = rng.random(len(texts)) < 0.2
    learn = some[~kept_out[some]]
    opt = Optimiser(p)
    for rnd in range(ROUNDS):
        if rnd:
            score = logits_by_slice(p, w, index)
            order = np.lexsort((-score, text))
        picks, label = [], []
        for d in learn.tolist():
            a, b = int(begin[d]), int(begin[d + 1])
            if rnd == 0:
                own = rng.integers(a, b, 3)
            else:
                own = order[a:min(b, a + 2)]
                if not y[d]:
                    own = np.concatenate([own, rng.integers(a, b, 1)])
            picks.append(own)
            label.append(np.full(len(own), y[d]))
        pick, lab = np.concatenate(picks), np.concatenate(label)
        weight = np.where(lab == 1, max(1.0, 0.5 * (lab == 0).sum() / max(1, (lab == 1).sum())), 1.0).astype(np.float32)
        epochs = max(EPOCHS, -(-400 * BATCH // (ROUNDS * max(1, len(pick)))))  # small samples: 100 steps a round at least
        opt.rate = 0.01 / (1 + rnd)
        for _ in range(epochs):
            turn = rng.permutation(len(pick))
            for i in range(0, len(turn), BATCH):
                k = turn[i:i + BATCH]
                opt.apply(step(p, w, index[pick[k]], lab[k], weight[k], rng)[1])
    top = highest(logits_by_slice(p, w, index), text, len(texts))
    fit = kept_out & np.isfinite(top)
    if len(set(y[fit].tolist())) < 2:
        fit = np.isfinite(top)
    slope, offset = calibration(top[fit], y[fit])
    if toxic_share is not None and 0 < toxic_share < 1 and 0 < (own := float(y[fit].mean())) < 1:
        offset += np.log(toxic_share / (1 - toxic_share)) - np.log(own / (1 - own))
    p["scale"] = np.array([slope, offset])
    return p


def score_texts(p: dict, texts: list[str]) -> np.ndarray:
    """The score of each whole text."""
    sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    out = np.zeros(len(texts))
    for i, j in common.pieces(sizes, PIECE):
        w = words_of(texts[i:j])
        index, text = windows_of(w)
        top = highest(logits(p, w, index), text, j - i)
        a, b = p["scale"]
        with np.errstate(invalid="ignore"):
            out[i:j] = np.where(np.isfinite(top), 1 / (1 + np.exp(-np.clip(a * np.where(np.isfinite(top), top, 0) + b, -500, 500))), 0.0)
    return out


# ------------------------------------------------------------------ on Spark

def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray, float | None]:
    """Whole texts and labels of at most ``rows`` labelled rows a class and ``size`` bytes, in the order of a hash of the id.

    Third comes the share of toxic rows among all labelled rows that aren't held out.
    """
    docs = common.documents(docs)
    marks = (common.take(labels, doc_id="bigint", toxic="int").filter("doc_id is not null and toxic is not null").filter(~held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sized = marks.join(docs.select("doc_id", (F.octet_length("text") + 64).alias("size")).filter("size is not null")
                       .groupBy("doc_id").agg(F.max("size").alias("size")), "doc_id")
    chosen = {i: toxic for toxic in (1, 0) for i in common.bounded_ids(sized.filter(F.col("toxic") == toxic), rows, size // 2)}
    got = common.texts_of(docs, list(chosen))
    share = marks.agg(F.avg(F.col("toxic").cast("double")).alias("share")).first()["share"]
    return [t for _, t in got], np.array([chosen[i] for i, _ in got], int), share


def model(docs: DataFrame, labels: DataFrame):
    """The broadcast weights (about 1.4 MB), trained on the labelled rows of ``docs`` that aren't held out."""
    common.bounded_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(train(*training_sample(docs, labels)))


def _score(batches, weights, threshold):
    for b in batches:
        s = score_texts(weights.value, common.to_strings(b.column(1)))
        yield common.batch(RESULT, b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32)))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: whether it was held out of training, its score, and whether that reaches the threshold."""
    weights = model(docs, labels)
    rows = common.documents(docs).withColumn("held_out", held_out())
    return rows.mapInArrow(partial(_score, weights=weights, threshold=threshold), RESULT)


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is under the threshold, whole and with all their columns."""
    weights = model(docs, labels)

    def kernel(b: pa.RecordBatch, at: int) -> pa.RecordBatch:
        return b.filter(pa.array(score_texts(weights.value, common.to_strings(b.column(at))) < threshold))

    return common.map_text_rows(docs, kernel)

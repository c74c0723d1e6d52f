"""Many tree ensembles at once, grown level by level from histograms.

Features are binned once.  A *unit* is one tree that grows: of a forest, of a boosting round, of one of many bootstrap
replicates.  For a level, every block of rows adds up the weights and targets of its rows by (unit, open node, feature, bin) in
numpy; the sums of all blocks are added by chunk of units on Spark, where each open node's best split is chosen from its small
table, and only splits and leaves come to the driver, to be broadcast for the next level.  A level is one Spark job for all units
of a wave, so forests of all folds and feature sets, or of hundreds of replicates, cost as many jobs as one tree.

Where one record holds all rows, no sums need be waited for: a task then grows its own units through all levels by
the same steps, in one job.

A forest without a depth limit has about as many nodes as rows, each with a table of all features and bins: far more than the rows
themselves.  Up to ``DEEP_BYTES`` of binned rows its trees are grown by tasks that hold all of them (``deep_tree``): a node
looks only at the bins of its own rows, and at the features it has drawn.  The same splits follow, and the task scores
its trees at once, so that neither tables nor trees leave it, but a sum of votes a row.

* Forests: Gini splits on Poisson(1) bootstrap weights, a random part of the features at each node, mean of the trees'
  shares.  A replicate's own bootstrap multiplies in as the rate of that Poisson draw.
* Boosting: log loss; leaves take a Newton step; split gain of squared residuals (``gradient``) or of the regularised second-order
  objective (``second_order``).
* AdaBoost: reweighted stumps (discrete, two classes).

Draws come from md5 numbers of the row id mixed with the unit's number: retried tasks draw the same.  Running scores of boosted models are
kept beside their rows and written to the checkpoint folder every ``KEEP`` rounds; between them a pass adds the few newest trees.

A split's threshold is one of ``BINS`` quantiles of the feature over all rows (fewer distinct values: each of them).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from copy import copy
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch_linear import SCORES, named
from .partials import EVERY, Rows, Split
from .tiled_graph import few_rows

BINS = 64
#: Bytes of a chunk's histogram and units in it, units in flight at once, rounds between two written scores.
CHUNK_BYTES, CHUNK_UNITS, WAVE, KEEP = 4 << 20, 256, 16384, 10
#: Rows that a record may hold for a task to grow trees alone.
ALONE_ROWS = 32768
#: Bytes of binned rows that a task may hold to grow trees without a depth limit, and cells of its rows that it sorts at once.
DEEP_BYTES, DEEP_CELLS = 64 << 20, 1 << 21
BLOCKS = "part int, n int, ids array<string>, y binary, bins binary, draws binary, trains binary, scores binary"
HISTS = "chunk int, hist binary"
SPLITS = "chunk int, feature binary, bin binary, sums binary"
VOTES = "model int, number bigint, part int, ids array<string>, y binary, trained binary, votes binary"
EPS = 1e-12
BOOSTED = ("gradient", "second_order", "adaboost")


@dataclass(frozen=True)
class Ensemble:
    """One model: names, features by place, training rows, kind, and its settings (the reference's defaults)."""

    names: tuple[str, ...]
    features: tuple[int, ...]
    split: Split = EVERY
    kind: str = "forest"
    trees: int = 200
    depth: int | None = 6
    min_leaf: int = 1
    rate: float = 0.1
    #: Number of a bootstrap replicate: rows count Poisson(1) times, and rows that count zero times are held out.
    replicate: int | None = None
    #: Added to the curvature of a boosted leaf.
    ridge: float = 0.0


#: The two boosted models: squared residual gain, and second-order gain with a ridge on the leaves.
def gradient(names, features, split=EVERY, trees=100, depth=3, rate=0.1) -> Ensemble:
    return Ensemble(names, features, split, "gradient", trees, depth, 1, rate)


def second_order(names, features, split=EVERY, trees=200, depth=4, rate=0.1) -> Ensemble:
    return Ensemble(names, features, split, "second_order", trees, depth, 1, rate, ridge=1.0)


def adaboost(names, features, split=EVERY, trees=300, rate=0.05) -> Ensemble:
    return Ensemble(names, features, split, "adaboost", trees, 1, 1, rate)


# ------------------------------------------------------------------ draws

def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(rows: np.ndarray, units: np.ndarray, salt: int) -> np.ndarray:
    """Rows x units numbers in [0, 1), each fixed by the row's and the unit's number."""
    with np.errstate(over="ignore"):
        own = mix(units.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    return (mix(rows[:, None] ^ own[None]) >> np.uint64(11)) / float(1 << 53)


MOST = 12
#: Row r: the distribution of a Poisson draw of rate r.
POISSON = np.array([np.cumsum([math.exp(-r) * r**k / math.factorial(k) for k in range(MOST + 1)]) for r in range(MOST + 1)])


def poisson(u: np.ndarray, rate: np.ndarray | int = 1) -> np.ndarray:
    """Poisson draws from uniform ones, for whole rates up to ``MOST``."""
    rate = np.broadcast_to(rate, u.shape)
    out = np.zeros(u.shape, np.uint8)
    for r in np.unique(rate):
        at = rate == r
        out[at] = np.searchsorted(POISSON[r], u[at], side="right")
    return out


def replicate_counts(draws: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """How often each row is in each replicate (rows x replicates)."""
    return poisson(uniform(draws, replicates, 1))


# ------------------------------------------------------------------ binned blocks of rows

def bin_edges(rows: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Ascending thresholds of each feature: at most ``bins`` - 1 of its quantiles."""
    marks = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    finite = [F.when(~F.isnan(F.get("x", F.lit(f))), F.get("x", F.lit(f))) for f in range(width)]
    got = rows.agg(*[F.percentile_approx(c, marks, 10000).alias(f"q{f}") for f, c in enumerate(finite)]).first()
    return [np.unique(np.array(got[f"q{f}"] or [], float)) for f in range(width)]


def blocks(rows: DataFrame, edges: list[np.ndarray], splits: list[Split], columns: list[str], boosted: int, parts: int) -> DataFrame:
    """One record a batch of rows, in ``parts`` copies that each serve their own chunks of units."""
    width = len(edges)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            r = Rows(b.select([0, 1, 2, 3]), width, columns)
            binned = np.stack([np.searchsorted(e, r.x[:, f], side="left") for f, e in enumerate(edges)], 1).astype(np.uint8)
            trains = np.packbits(np.stack([f(s) for f in (r.trains, r.scoped) for s in splits], 1), axis=0)
            ids = pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), b.column(0))
            y = r.y.astype(np.uint8)
            for part in range(parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([len(b)], pa.int32()), ids.cast(pa.list_(pa.string())), *[pa.array([v.tobytes()], pa.binary()) for v in (
                        y, binned, b.column(4).to_numpy(), trains, np.zeros(len(b) * boosted, np.float32))]],
                    names=[f.split()[0] for f in BLOCKS.split(", ")])

    drawn = rows.select("id", "y", "x", "splits", F.conv(F.substring(F.md5("id"), 1, 15), 16, 10).cast("bigint").alias("draw"))
    return drawn.mapInArrow(run, BLOCKS).repartition(max(parts, rows.rdd.getNumPartitions()), "part", F.xxhash64("y", "draws")).checkpoint()


class Block:
    """A record of ``blocks`` in numpy."""

    def __init__(self, r: dict, width: int, splits: int):
        n = r["n"]
        self.part, self.n, self.ids = r["part"], n, r["ids"]
        self.y = np.frombuffer(r["y"], np.uint8).astype(np.float64)
        self.bins = np.frombuffer(r["bins"], np.uint8).reshape(n, width)
        self.draws = np.frombuffer(r["draws"], np.int64).view(np.uint64)
        both = np.unpackbits(np.frombuffer(r["trains"], np.uint8).reshape(-1, 2 * splits), axis=0, count=n).astype(bool)
        self.trains, self.scoped = both[:, :splits], both[:, splits:]
        scores = np.frombuffer(r["scores"], np.float32)
        self.scores = scores.reshape(n, len(scores) // n)


# ------------------------------------------------------------------ trees

class Trees:
    """Trees in flat arrays: feature (-1: leaf), bin, left child (right is the next) and value of each node."""

    def __init__(self, units: int):
        self.feature, self.bin = np.full(units, -1, np.int16), np.zeros(units, np.uint8)
        self.left, self.value = np.zeros(units, np.int32), np.zeros(units, np.float64)
        self.root = np.arange(units)
        self.open = np.arange(units)

    def grow(self, feature: np.ndarray, bins: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Split the open nodes that got a feature, with the values of the nodes and their sides; returns which were split."""
        self.value[self.open] = own
        split = feature >= 0
        at = self.open[split]
        self.feature[at], self.bin[at] = feature[split], bins[split]
        self.left[at] = len(self.value) + 2 * np.arange(len(at))
        new = 2 * len(at)
        self.open = len(self.value) + np.arange(new)
        self.feature = np.append(self.feature, np.full(new, -1, np.int16))
        self.bin, self.left = np.append(self.bin, np.zeros(new, np.uint8)), np.append(self.left, np.zeros(new, np.int32))
        self.value = np.append(self.value, np.stack([left[split], right[split]], 1).ravel())
        return split

    def places(self, bins: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The node each row reaches in each of the trees ``units`` (rows x units)."""
        at = np.broadcast_to(self.root[units], (len(bins), len(units))).copy()
        rows = np.arange(len(bins))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            at = np.where(inner, self.left[at] + (bins[rows, np.maximum(f, 0)] > self.bin[at]), at)


@dataclass
class Wave:
    """The units that grow together, and what a task needs to know of them."""

    models: list[Ensemble]
    splits: list[Split]
    parts: int
    #: Column of the scores of each boosted model.
    column: dict[int, int]
    #: Trees of earlier rounds that the blocks' scores don't hold yet, with their models.
    newer: list[tuple[Trees, np.ndarray]]
    model: np.ndarray
    number: np.ndarray
    trees: Trees
    #: The unit of each open node.
    owner: np.ndarray

    def chunks(self, cells: int) -> list[np.ndarray]:
        """Units by chunk, so that a chunk's histogram is bounded (one unit at least); chunk c serves part c % parts."""
        nodes = np.bincount(self.owner, minlength=len(self.model))
        place = np.arange(len(nodes))
        at = np.maximum(np.cumsum(nodes * cells * 24) // CHUNK_BYTES, place // CHUNK_UNITS)
        at = np.maximum(at, place * self.parts // max(len(nodes), 1))
        return [u for u in np.split(place, np.flatnonzero(np.diff(at)) + 1) if len(u) and nodes[u].any()]

    def trained(self, k: Block, units: np.ndarray) -> np.ndarray:
        """Which rows train each of the units (rows x units)."""
        return k.trains[:, [self.splits.index(self.models[m].split) for m in self.model[units]]]

    def nodes(self, units: np.ndarray) -> np.ndarray:
        """Places of the chunk's open nodes among all open ones."""
        return np.flatnonzero((self.owner >= units[0]) & (self.owner <= units[-1]))


def current_scores(w: Wave, k: Block) -> np.ndarray:
    """Running scores (rows x boosted models) with the newest trees added."""
    out = k.scores.astype(np.float64)
    for trees, model in w.newer:
        out[:, [w.column[m] for m in model]] += trees.value[trees.places(k.bins, np.arange(len(model)))]
    return out


def weights_and_targets(w: Wave, k: Block, units: np.ndarray, running: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows x units: what each row adds to the two sums of its cell.

    Forests and AdaBoost: weight, and weight of class 1.  Boosting: curvature, and residual.
    """
    own, kind = w.trained(k, units), w.models[w.model[units[0]]].kind
    if kind == "forest":
        count = np.ones((k.n, len(units)), np.uint8)
        reps = np.array([-1 if w.models[m].replicate is None else w.models[m].replicate for m in w.model[units]])
        if (reps >= 0).any():
            found, place = np.unique(reps, return_inverse=True)
            count = np.where(reps >= 0, np.minimum(replicate_counts(k.draws, np.maximum(found, 0))[:, place], MOST), 1)
        weight = np.where(own, poisson(uniform(k.draws, w.number[units], 2), count), 0).astype(np.float64)
        return weight, weight * k.y[:, None]
    score = running[:, [w.column[m] for m in w.model[units]]]
    if kind == "adaboost":
        weight = np.where(own, np.exp(score * (1 - 2 * k.y[:, None])), 0.0)
        return weight, weight * k.y[:, None]
    p = 0.5 * (1 + np.tanh(0.5 * score))
    return np.where(own, p * (1 - p), 0.0), np.where(own, k.y[:, None] - p, 0.0)


def histogram(w: Wave, k: Block, units: np.ndarray, features: list[int], bins: int, running: np.ndarray | None) -> np.ndarray:
    """Rows, first and second sum by (open node of the chunk, feature, bin)."""
    a, b = weights_and_targets(w, k, units, running)
    nodes = w.nodes(units)
    number = np.full(len(w.trees.value), -1)
    number[w.trees.open[nodes]] = np.arange(len(nodes))
    place = number[w.trees.places(k.bins, units)]
    inside = (place >= 0) & (a > 0)
    row, _ = np.nonzero(inside)
    place, a, b = place[inside], a[inside], b[inside]
    out = np.empty((3, len(nodes), len(features), bins))
    for i, f in enumerate(features):
        cell = place * bins + k.bins[row, f]
        for j, v in enumerate((None, a, b)):
            out[j, :, i] = np.bincount(cell, v, len(nodes) * bins).reshape(len(nodes), bins)
    return out


def drawn_features(w: Wave, units: np.ndarray, able: np.ndarray, own: np.ndarray, level: int) -> np.ndarray:
    """The features a forest looks at in each node: a random square root of the model's, and on until one can split."""
    nodes = w.nodes(units)
    of = w.owner[nodes]
    first = np.searchsorted(of, of)  # a node's place within its unit doesn't hang on the chunk
    with np.errstate(over="ignore"):
        key = w.number[of].astype(np.uint64) * np.uint64(1 << 20) + (np.arange(len(of)) - first).astype(np.uint64) * np.uint64(64) + np.uint64(level)
    u = uniform(np.arange(own.shape[1]).astype(np.uint64) + np.uint64(1), key, 3).T
    rank = np.argsort(np.argsort(np.where(own, u, 2.0), 1, kind="stable"), 1, kind="stable")
    part = np.array([max(1, math.isqrt(len(w.models[m].features))) for m in w.model[of]])
    soonest = np.where(able & own, rank, own.shape[1]).min(1, initial=own.shape[1])
    return own & (rank < np.maximum(part, soonest + 1)[:, None])


def best_splits(w: Wave, hist: np.ndarray, units: np.ndarray, features: list[int], level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none) and bin of each open node of the chunk, and its sums: whole node's two, left side's two."""
    nodes = w.nodes(units)
    models = [w.models[m] for m in w.model[w.owner[nodes]]]
    kind, wide = models[0].kind, hist.shape[-1] - 1
    total = hist[:, :, 0].sum(-1)
    sums = np.concatenate([total[1:].T, np.zeros((len(nodes), 2))], 1)
    if not wide:
        return np.full(len(nodes), -1), np.zeros(len(nodes), int), sums
    lc, la, lb = np.cumsum(hist, -1)[..., :-1]
    rc, ra, rb = (t[:, None, None] - v for t, v in zip(total, (lc, la, lb), strict=True))
    if kind in ("forest", "adaboost"):
        # weighted Gini: larger sums of (n1^2 + n0^2) / n mean purer sides
        def score(n, n1):
            return np.where(n > EPS, (n1 * n1 + (n - n1) ** 2) / np.maximum(n, EPS), 0.0)
    elif kind == "gradient":
        def score(n, g):
            return g * g / np.maximum(n, 1)
    else:
        ridge = np.array([m.ridge for m in models])[:, None, None]

        def score(h, g):
            return g * g / (h + ridge)
    left, right, whole = ((lc, rc, total[0]) if kind == "gradient" else (la, ra, total[1]))
    gain = score(left, lb) + score(right, rb) - score(whole[:, None, None], total[2][:, None, None])
    least = np.array([m.min_leaf for m in models])[:, None, None]
    ok = (lc >= least) & (rc >= least) & (gain > EPS)
    if kind == "second_order":
        ok &= (la >= 1) & (ra >= 1)
    own = np.array([[f in m.features for f in features] for m in models])
    if kind == "forest":
        own = drawn_features(w, units, ok.any(2), own, level)
    deep = np.array([m.depth is not None and level >= m.depth for m in models])
    gain = np.where(ok & own[:, :, None] & ~deep[:, None, None], gain, -np.inf).reshape(len(nodes), -1)
    best, row = gain.argmax(1), np.arange(len(nodes))
    sums[:, 2], sums[:, 3] = la.reshape(len(nodes), -1)[row, best], lb.reshape(len(nodes), -1)[row, best]
    return np.where(np.isfinite(gain[row, best]), np.array(features)[best // wide], -1), best % wide, sums


def node_value(models: list[Ensemble], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A forest's share of class 1, a boosted leaf's step, or AdaBoost's class (-1 or 1)."""
    kind = models[0].kind
    if kind == "forest":
        return np.where(a > EPS, b / np.maximum(a, EPS), 0.5)
    if kind == "adaboost":
        return np.where(b > a - b, 1.0, -1.0)
    rate, ridge = np.array([m.rate for m in models]), np.array([m.ridge for m in models])
    return rate * b / np.maximum(a + ridge, EPS)


# ------------------------------------------------------------------ trees without a depth limit

def purity(n: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Weighted Gini: larger sums of (n1^2 + n0^2) / n mean purer sides."""
    return np.where(n > EPS, (n1 * n1 + (n - n1) ** 2) / np.maximum(n, EPS), 0.0)


def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a > EPS, b / np.maximum(a, EPS), 0.5)


@dataclass
class Bag:
    """The rows of a tree that are in open nodes: node, bins, whole weight and class of each, and each node's rows and sums."""

    place: np.ndarray
    bins: np.ndarray
    a: np.ndarray
    y: np.ndarray
    nodes: int

    def __post_init__(self):
        self.c = np.bincount(self.place, minlength=self.nodes)
        self.ta, self.tb = (np.bincount(self.place, v, self.nodes) for v in (self.a, self.a * self.y))

    def of(self, nodes: np.ndarray) -> Bag:
        """The rows of some nodes, numbered in that order."""
        if len(nodes) == self.nodes:
            return self
        number = np.full(self.nodes, -1)
        number[nodes] = np.arange(len(nodes))
        place = number[self.place]
        own = place >= 0
        return Bag(place[own], self.bins[own], self.a[own], self.y[own], len(nodes))


def best_cuts(bag: Bag, chosen: np.ndarray, bins: int, least: int) -> tuple[np.ndarray, ...]:
    """Feature (-1: none), bin, and left side's two sums of each node's best split by its ``chosen`` features (ascending).

    Equal gains go to the first feature and bin, as in ``best_splits``.
    """
    n, each = chosen.shape
    if len(bag.place) * each > DEEP_CELLS and n > 1 and len(bag.place) < n * bins:
        middle = int(np.clip(np.searchsorted(np.cumsum(bag.c), len(bag.place) / 2), 1, n - 1))
        halves = [best_cuts(bag.of(at), chosen[at], bins, least) for at in (np.arange(middle), np.arange(middle, n))]
        return tuple(np.concatenate(c) for c in zip(*halves, strict=True))
    if len(bag.place) >= n * bins:
        # tables of all bins: nodes have many rows
        lc, la, lb = np.empty((3, n, each, bins))
        for j in range(each):
            cell = bag.place * bins + bag.bins[np.arange(len(bag.place)), chosen[bag.place, j]]
            for out, v in ((lc, None), (la, bag.a), (lb, bag.a * bag.y)):
                out[:, j] = np.cumsum(np.bincount(cell, v, n * bins).reshape(n, bins), 1)
        lc, la, lb = (v.ravel() for v in (lc, la, lb))
        cut = np.tile(np.arange(bins), n * each)
        group = np.repeat(np.arange(n * each), bins)
    else:
        # the rows' own bins in order, weight and class beside them
        cell = (bag.place[:, None] * each + np.arange(each)) * bins + bag.bins[np.arange(len(bag.place))[:, None], chosen[bag.place]]
        code = ((cell << 5) | (bag.a.astype(np.int64) << 1 | bag.y.astype(np.int64))[:, None]).ravel()
        code.sort()
        weight, cell = (code >> 1) & 15, code >> 5
        last = np.append(np.flatnonzero(cell[1:] != cell[:-1]), len(cell) - 1)[:len(cell)]
        group, cut = np.divmod(cell[last], bins)
        rows = np.repeat(bag.c, each)
        start = (np.cumsum(rows) - rows)[group]
        lc = last + 1 - start
        la, lb = (np.append(0, np.cumsum(v)) for v in (weight, weight * (code & 1)))
        la, lb = ((v[last + 1] - v[start]).astype(np.float64) for v in (la, lb))
    node = group // each
    ta, tb = bag.ta[node], bag.tb[node]
    gain = purity(la, lb) + purity(ta - la, tb - lb) - purity(ta, tb)
    ok = np.flatnonzero((lc >= least) & (bag.c[node] - lc >= least) & (gain > EPS))
    most = np.full(n, -np.inf)
    np.maximum.at(most, node[ok], gain[ok])
    top = ok[gain[ok] == most[node[ok]]]
    found, first = np.unique(node[top], return_index=True)
    top = top[first]
    out = np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n)
    for to, v in zip(out, (chosen[found, group[top] % each], cut[top], la[top], lb[top]), strict=True):
        to[found] = v
    return out


def deep_splits(bag: Bag, number: int, level: int, bins: int, least: int) -> tuple[np.ndarray, ...]:
    """``best_cuts`` of all nodes by the features that ``drawn_features`` gives them, without tables of the others."""
    wide = bag.bins.shape[1]
    part = max(1, math.isqrt(wide))
    out = np.full(bag.nodes, -1), np.zeros(bag.nodes, int), np.zeros(bag.nodes), np.zeros(bag.nodes)
    # one class, or too few rows: no feature can split
    at = np.flatnonzero((bag.c >= 2 * max(least, 1)) & (bag.tb > 0) & (bag.tb < bag.ta))
    if not len(at):
        return out
    with np.errstate(over="ignore"):
        key = np.uint64(number) * np.uint64(1 << 20) + at.astype(np.uint64) * np.uint64(64) + np.uint64(level)
    order = np.argsort(uniform(np.arange(wide).astype(np.uint64) + np.uint64(1), key, 3).T, 1, kind="stable")
    chosen, after, bag = np.sort(order[:, :part], 1), part, bag.of(at)
    while True:
        found = best_cuts(bag, chosen, bins, least)
        done = found[0] >= 0
        for to, v in zip(out, found, strict=True):
            to[at[done]] = v[done]
        if done.all() or after >= wide:
            return out
        rest = np.flatnonzero(~done)  # on until one can split
        at, order, bag = at[rest], order[rest], bag.of(rest)
        chosen, after = order[:, after:after + 1], after + 1


def deep_tree(k: Block, e: Ensemble, number: int, weight: np.ndarray, bins: int) -> Trees:
    """A forest's tree on the rows with a ``weight``, node for node as ``grow_levels`` grows it."""
    trees, features, rows, level = Trees(1), np.array(sorted(e.features)), np.flatnonzero(weight), 0
    bag = Bag(np.zeros(len(rows), int), k.bins[rows][:, features], weight[rows].astype(np.float64), k.y[rows], 1)
    while len(trees.open) and (e.depth is None or level < e.depth):
        f, cut, la, lb = deep_splits(bag, number, level, bins, e.min_leaf)
        split = trees.grow(np.where(f >= 0, features[f], -1), cut, share(bag.ta, bag.tb), share(la, lb), share(bag.ta - la, bag.tb - lb))
        own = np.flatnonzero(split[bag.place])
        place = bag.place[own]
        side = bag.bins[own, f[place]] > cut[place]
        bag = Bag(2 * (np.cumsum(split) - 1)[place] + side, bag.bins[own], bag.a[own], bag.y[own], len(trees.open))
        level += 1
    return trees


def reached(t: Trees, bins: np.ndarray) -> np.ndarray:
    """The leaf of one tree that each row reaches."""
    at, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(live):
        now = at[live]
        f = t.feature[now]
        inner = f >= 0
        live, now, f = live[inner], now[inner], f[inner]
        at[live] = t.left[now] + (bins[live, f] > t.bin[now])
    return at


def joined(blocks: list[Block]) -> Block:
    """The rows of several records, as one."""
    out = copy(blocks[0])
    out.n, out.ids = sum(k.n for k in blocks), None
    for name in ("y", "bins", "draws", "trains", "scoped"):
        setattr(out, name, np.concatenate([getattr(k, name) for k in blocks]))
    return out


# ------------------------------------------------------------------ on Spark

class Grower:
    """Binned blocks of rows, and the jobs over them."""

    def __init__(self, rows: DataFrame, models: list[Ensemble], width: int, columns: list[str], bins: int = BINS, alone_rows: int | None = None):
        alone_rows = ALONE_ROWS if alone_rows is None else alone_rows
        self.spark, self.models, self.width = rows.sparkSession, models, width
        edges = bin_edges(rows, width, bins)
        self.bins = max((len(e) for e in edges), default=0) + 1
        self.splits = sorted({m.split for m in models}, key=str)
        self.column = {m: i for i, m in enumerate(i for i, e in enumerate(models) if e.kind != "forest")}
        few = rows.limit(alone_rows + 1).count() <= alone_rows
        rows = rows.coalesce(1) if few else rows
        self.parts = max(1, self.spark.sparkContext.defaultParallelism // max(1, rows.rdd.getNumPartitions()))
        with few_rows(self.spark, alone_rows) if few else nullcontext():
            self.blocks = blocks(rows, edges, self.splits, columns, len(self.column), self.parts)
        self.partitions = self.blocks.rdd.getNumPartitions()
        #: Every part has all its rows in one record: trees grow within a task then.
        self.alone = self.blocks.count() <= self.parts
        #: Forests without a depth limit whose rows a task may hold.
        self.deep = [m for m, e in enumerate(models) if e.kind == "forest" and e.depth is None]
        if self.deep and (self.blocks.where("part = 0").agg(F.sum("n")).first()[0] or 0) * (width + 9) > DEEP_BYTES:
            self.deep = []
        self.jobs = 0

    def wave(self, newer: list, model: np.ndarray | None = None, number: np.ndarray | None = None) -> Wave:
        model = np.zeros(0, int) if model is None else model
        return Wave(self.models, self.splits, self.parts, self.column, newer, model, model if number is None else number, Trees(len(model)), np.arange(len(model)))

    def level(self, w: Wave, features: list[int], level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``best_splits`` of all open nodes of a wave: one Spark job."""
        chunks = w.chunks(len(features) * self.bins)
        sent = self.spark.sparkContext.broadcast((w, chunks))
        width, splits, bins = self.width, len(self.splits), self.bins

        def chosen(c, total):
            wave, groups = sent.value
            found = best_splits(wave, total.reshape(3, -1, len(features), bins), groups[c], features, level)
            cols = [v.astype(k).tobytes() for v, k in zip(found, (np.int16, np.uint8, np.float64), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *[pa.array([v], pa.binary()) for v in cols]], names=["chunk", "feature", "bin", "sums"])

        def handed(c, total):
            return pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "hist"])

        def histograms(batches):
            wave, groups = sent.value
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for r in b.to_pylist():
                    k = Block(r, width, splits)
                    running = None if wave.models[wave.model[0]].kind == "forest" else current_scores(wave, k)
                    for c in range(k.part, len(groups), wave.parts):
                        h = histogram(wave, k, groups[c], features, bins, running)
                        held[c] = held[c] + h if c in held else h
                        if len(held) > 16:
                            yield from [handed(*x) for x in held.items()]
                            held = {}
            yield from [handed(*x) for x in held.items()]

        def added(batches):
            now, total = None, None
            for b in batches:
                for c, raw in zip(*[x.to_pylist() for x in b.columns], strict=True):
                    if c == now:
                        total += np.frombuffer(raw)
                        continue
                    if now is not None:
                        yield chosen(now, total)
                    now, total = c, np.frombuffer(raw).copy()
            if now is not None:
                yield chosen(now, total)

        wide = max(1, min(len(chunks), self.partitions))
        found = self.blocks.mapInArrow(histograms, HISTS).repartition(wide, "chunk").sortWithinPartitions("chunk").mapInArrow(added, SPLITS)
        self.jobs += 1
        got = sorted((r["chunk"], r["feature"], r["bin"], r["sums"]) for r in found.collect())  # splits and sums of a wave's nodes
        sent.unpersist()
        f, n, sums = (np.concatenate([np.frombuffer(g[i], k) for g in got]) if got else np.zeros(0, k) for i, k in ((1, np.int16), (2, np.uint8), (3, np.float64)))
        return f, n, sums.reshape(-1, 4)

    def grow(self, model: np.ndarray, number: np.ndarray, newer: list) -> tuple[Trees, np.ndarray]:
        """Grow one tree a unit, a Spark job a level; also the first level's sums."""
        w = self.wave(newer, model, number)
        return w.trees, grow_levels(w, self.level)

    def grow_alone(self, unit: np.ndarray, number: np.ndarray) -> tuple[list, list]:
        """All trees in one job, where a record holds all rows: the same steps, without sums to wait for."""
        groups = self.wave([], unit, number).chunks(self.width * self.bins)
        sent = self.spark.sparkContext.broadcast((self.wave([]), unit, number, groups))
        width, splits, bins = self.width, len(self.splits), self.bins

        def run(batches):
            base, units, numbers, chunks = sent.value
            for b in batches:
                for r in b.to_pylist():
                    k = Block(r, width, splits)

                    def level(w, features, depth):
                        running = None if w.models[w.model[0]].kind == "forest" else current_scores(w, k)
                        # a few units at a time: a deep tree has many open nodes
                        best = [best_splits(w, histogram(w, k, u, features, bins, running).reshape(3, -1, len(features), bins), u, features, depth)
                                for u in w.chunks(len(features) * bins)]
                        return tuple(np.concatenate(c) for c in zip(*best, strict=True))

                    for c in range(k.part, len(chunks), base.parts):
                        u = chunks[c]
                        w = fresh(base, units[u], numbers[u], [])
                        grow_levels(w, level)
                        yield found("forest", c, [(w.trees, units[u])])
                    own = [m for m in base.column if m % base.parts == k.part]
                    for kind in BOOSTED:
                        models = np.array([m for m in own if base.models[m].kind == kind], int)
                        if len(models):
                            rounds: list = []
                            newer: list = []
                            start = k.scores
                            for one in boost(base, models, lambda m, newer: grown(fresh(base, m, m, newer), level), newer):
                                rounds.append(one)
                                newer.append(one)
                                if len(newer) >= KEEP:  # kept beside the rows, as ``keep_scores`` does
                                    k.scores = current_scores(fresh(base, models, models, newer), k).astype(np.float32)
                                    newer.clear()
                            k.scores = start
                            yield found("boosted", k.part, rounds)

        def grown(w, level):
            return w.trees, grow_levels(w, level)

        def found(kind, place, trees):
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([place], pa.int32()), pa.array([pickle.dumps(trees)], pa.binary())], names=["kind", "place", "trees"])

        self.jobs += 1
        got = self.blocks.mapInArrow(run, "kind string, place int, trees binary").collect()  # the trees themselves, as in ``level``
        parts = {kind: [t for r in sorted(got, key=lambda r: r["place"]) if r["kind"] == kind for t in pickle.loads(r["trees"])] for kind in ("forest", "boosted")}
        return parts["forest"], parts["boosted"]

    def deep_votes(self, seed: int, held_out: bool) -> DataFrame:
        """(model, id, y, p, trained) of the ``deep`` forests: each task grows and scores its own trees."""
        models, width, splits, bins, deep, order = self.models, self.width, len(self.splits), self.bins, self.deep, self.splits
        units = [(m, i) for m in deep for i in range(models[m].trees)]
        copies = max(1, min(len(units), 2 * self.spark.sparkContext.defaultParallelism))

        def votes(part, blocks, numbers, ids):
            if not blocks:
                return
            k = joined(blocks)
            ends = np.cumsum([b.n for b in blocks])
            for m in deep:
                e = models[m]
                place = order.index(e.split)
                own, scope, count = k.trains[:, place], k.scoped[:, place], 1
                seen = own
                if e.replicate is not None:
                    count = np.minimum(replicate_counts(k.draws, np.array([e.replicate])), MOST)
                    seen = own & (count[:, 0] > 0)
                at = np.flatnonzero(scope & ~seen if held_out else scope)
                total, scored = np.zeros(len(at)), k.bins[at]
                mine = [i for u, (of, i) in enumerate(units) if of == m and u % copies == part]
                if part and not mine:
                    continue
                for i in mine:
                    number = unit_number(e, i, seed)
                    weight = np.where(own, poisson(uniform(k.draws, np.array([number]), 2), count)[:, 0], 0)
                    t = deep_tree(k, e, number, weight, bins)
                    total += t.value[reached(t, scored)]
                for r, (end, b) in enumerate(zip(ends, blocks, strict=True)):
                    lo, hi = np.searchsorted(at, [end - b.n, end])
                    here = at[lo:hi] - (end - b.n)
                    if len(here):
                        first = [[ids[r][i] for i in here], b.y[here].astype(np.uint8).tobytes(), seen[at[lo:hi]].astype(np.uint8).tobytes()] if not part else [None] * 3
                        cols = [m, numbers[r], part, *first, total[lo:hi].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([v], c) for v, c in zip(cols, kinds, strict=True)], names=names)

        names = [f.split()[0] for f in VOTES.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]

        def run(batches):
            now, blocks, numbers, ids = None, [], [], []
            for b in batches:
                for r in b.to_pylist():
                    if r["part"] != now:
                        yield from votes(now, blocks, numbers, ids)
                        now, blocks, numbers, ids = r["part"], [], [], []
                    blocks.append(Block(r, width, splits))
                    numbers.append(r["number"])
                    ids.append(r["ids"])
            yield from votes(now, blocks, numbers, ids)

        def shares(m, first, total):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(total), m, np.int32)), pa.array(first["ids"], pa.string()),
                                               pa.array(np.frombuffer(first["y"], np.uint8).astype(np.int32)), pa.array(total / models[m].trees),
                                               pa.array(np.frombuffer(first["trained"], np.uint8).astype(bool))], names=["model", "id", "y", "p", "trained"])

        def added(batches):
            first, total = None, None
            for b in batches:
                for r in b.to_pylist():
                    if not r["part"]:
                        if first is not None:
                            yield shares(first["model"], first, total)
                        first, total = r, np.frombuffer(r["votes"]).copy()
                    else:
                        total += np.frombuffer(r["votes"])
            if first is not None:
                yield shares(first["model"], first, total)

        one = self.blocks.where("part = 0").withColumn("number", F.monotonically_increasing_id()).drop("part")
        dealt = one.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        # a row's id is needed once
        dealt = dealt.withColumns({"ids": F.when(F.col("part") == 0, F.col("ids")), "scores": F.lit(b"")})
        grown = dealt.repartitionByRange(copies, "part").sortWithinPartitions("part", "number").mapInArrow(run, VOTES)
        self.jobs += 1
        return grown.repartition("model", "number").sortWithinPartitions("model", "number", "part").mapInArrow(added, SCORES).checkpoint()

    def keep_scores(self, newer: list) -> None:
        """Add the newest trees to the scores beside the rows, and write those to the checkpoint folder."""
        sent = self.spark.sparkContext.broadcast(self.wave(newer))
        width, splits = self.width, len(self.splits)

        def run(batches):
            for b in batches:
                for i, r in enumerate(b.to_pylist()):
                    new = current_scores(sent.value, Block(r, width, splits)).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns[:-1], pa.array([new.tobytes()], pa.binary())], names=b.schema.names)

        self.blocks = self.blocks.mapInArrow(run, BLOCKS).checkpoint()
        self.jobs += 1


class Fitted:
    """Fitted ensembles over the blocks they were grown on."""

    def __init__(self, grower: Grower, forests: list[tuple[Trees, np.ndarray]], newer: list, seed: int):
        self.grower, self.forests, self.newer, self.seed = grower, forests, newer, seed
        self.models, self.jobs = grower.models, grower.jobs
        self.deep: dict[bool, DataFrame] = {}

    def deep_scores(self, held_out: bool) -> DataFrame:
        """The scores of the forests without a depth limit, grown and scored at the first call."""
        if held_out not in self.deep:
            self.deep[held_out] = self.grower.deep_votes(self.seed, held_out)
        return self.deep[held_out]

    def scores(self, names: list[str], held_out: bool = True) -> DataFrame:
        """(names, id, y, p, trained) of the rows a model hasn't seen (for a replicate: drawn zero times), or of all rows."""
        g = self.grower
        sent = g.spark.sparkContext.broadcast((g.wave(self.newer), self.forests))
        width, splits, deep = g.width, len(g.splits), set(g.deep)

        def run(batches):
            wave, forests = sent.value
            for b in batches:
                for r in b.to_pylist():
                    k = Block(r, width, splits)
                    boosted = current_scores(wave, k) if wave.column else None
                    for m in range(k.part, len(wave.models), wave.parts):
                        e = wave.models[m]
                        if m in deep:
                            continue
                        place = wave.splits.index(e.split)
                        seen, scope = k.trains[:, place], k.scoped[:, place]
                        if e.replicate is not None:
                            seen = seen & (replicate_counts(k.draws, np.array([e.replicate]))[:, 0] > 0)
                        at = np.flatnonzero(scope & ~seen if held_out else scope)
                        if not len(at):
                            continue
                        if e.kind == "forest":
                            p = sum(t.value[t.places(k.bins[at], np.flatnonzero(own == m))].sum(1) for t, own in forests if (own == m).any()) / e.trees
                        else:
                            # the weights of AdaBoost's votes are held halved
                            p = 0.5 * (1 + np.tanh(boosted[at, wave.column[m]] * (2 if e.kind == "adaboost" else 0.5)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m, np.int32)), pa.array([k.ids[i] for i in at], pa.string()),
                                                          pa.array(k.y[at].astype(np.int32)), pa.array(p), pa.array(seen[at])],
                                                         names=["model", "id", "y", "p", "trained"])

        found = None if len(deep) == len(g.models) else g.blocks.mapInArrow(run, SCORES)
        if deep:
            found = self.deep_scores(held_out) if found is None else found.unionByName(self.deep_scores(held_out))
        return named(found, [m.names for m in g.models], names)


def unit_number(e: Ensemble, tree: int, seed: int) -> int:
    """The number that a forest's tree draws by."""
    return tree + seed + 100_003 * (e.replicate or 0)


def fit(rows: DataFrame, models: list[Ensemble], width: int, columns: list[str] = (), bins: int = BINS, seed: int = 42) -> Fitted:
    """Grow all ``models`` on a row matrix of ``width`` features whose splits are of ``columns``."""
    g = Grower(rows, list(models), width, list(columns), bins)
    forest = [m for m, e in enumerate(models) if e.kind == "forest" and m not in g.deep]
    unit = np.repeat(np.array(forest, int), [models[m].trees for m in forest])
    number = np.array([unit_number(models[m], i, seed) for m in forest for i in range(models[m].trees)], np.int64)
    if len(g.deep) == len(models):
        return Fitted(g, [], [], seed)
    if g.alone:
        return Fitted(g, *g.grow_alone(unit, number), seed)
    forests = [(g.grow(unit[a:a + WAVE], number[a:a + WAVE], [])[0], unit[a:a + WAVE]) for a in range(0, len(unit), WAVE)]
    newer: list[tuple[Trees, np.ndarray]] = []
    for kind in BOOSTED:
        boosted = np.array([m for m, e in enumerate(models) if e.kind == kind], int)
        if not len(boosted):
            continue
        for trees, now in boost(g.wave([]), boosted, lambda m, _: g.grow(m, m, newer), newer):
            newer.append((trees, now))
            if len(newer) >= KEEP:
                g.keep_scores(newer)
                newer.clear()
    return Fitted(g, forests, newer, seed)


def fresh(w: Wave, model: np.ndarray, number: np.ndarray, newer: list) -> Wave:
    """A wave of new trees, one for each of ``model``."""
    return replace(w, newer=newer, model=model, number=number, trees=Trees(len(model)), owner=np.arange(len(model)))


def grow_levels(w: Wave, level: Callable) -> np.ndarray:
    """Grow the wave's trees until no node can split, by ``level``'s splits; returns the first level's sums."""
    features = sorted({f for m in set(w.model.tolist()) for f in w.models[m].features})
    deepest = max((math.inf if w.models[m].depth is None else w.models[m].depth for m in set(w.model.tolist())), default=0)
    depth, roots = 0, np.zeros((len(w.model), 4))
    while len(w.trees.open) and depth < deepest:
        f, n, sums = level(w, features, depth)
        if not len(f):  # no rows at all
            break
        if not depth:
            roots = sums
        models = [w.models[m] for m in w.model[w.owner]]
        a, b, la, lb = sums.T
        split = w.trees.grow(f, n, node_value(models, a, b), node_value(models, la, lb), node_value(models, a - la, b - lb))
        w.owner = np.repeat(w.owner[split], 2)
        depth += 1
    return roots


def boost(w: Wave, model: np.ndarray, grow: Callable, newer: list) -> Iterator[tuple[Trees, np.ndarray]]:
    """The rounds of boosted models of one kind: trees and the models they belong to.

    ``grow(models, newer)`` grows a tree for each of them; the caller adds what is yielded to ``newer``.
    """
    kind = w.models[model[0]].kind
    if kind == "gradient":
        yield prior(w, model, grow), model
    for r in range(max(w.models[m].trees for m in model)):
        now = np.array([m for m in model if r < w.models[m].trees])
        trees, roots = grow(now, newer)
        if kind == "adaboost":
            vote(trees, roots, np.array([w.models[m].rate for m in now]))
        yield trees, now


def prior(w: Wave, model: np.ndarray, grow: Callable) -> Trees:
    """The log odds of each model's training rows, as trees of one leaf."""
    _, sums = grow(model, [])
    out = Trees(len(model))
    n = 4 * sums[:, 0]  # at score 0 every row has curvature 1/4 and residual y - 1/2
    share = np.clip((sums[:, 1] + n / 2) / np.maximum(n, EPS), 1e-6, 1 - 1e-6)
    out.value[:] = np.log(share / (1 - share))
    return out


def vote(trees: Trees, sums: np.ndarray, rate: np.ndarray) -> None:
    """Turn the classes (-1, 1) of stumps into half the weight of their votes, by their weighted error."""
    a, b, la, lb = sums.T
    split = trees.feature[trees.root] >= 0
    wrong = np.where(split, np.minimum(lb, la - lb) + np.minimum(b - lb, a - la - b + lb), np.minimum(b, a - b))
    err = np.clip(wrong / np.maximum(a, EPS), 1e-10, 1 - 1e-10)
    half = rate * np.log((1 - err) / err) / 2
    trees.value[trees.root] *= half
    inner = trees.root[split]
    for side in (0, 1):
        trees.value[trees.left[inner] + side] *= half[split]


def settings(names: tuple[str, ...], features: tuple[int, ...], split: Split, kind: str) -> Ensemble:
    """The tree ensembles of the classifier list by name."""
    if kind == "random_forest":
        return Ensemble(names, features, split)
    if kind == "random_forest_leaf":
        return Ensemble(names, features, split, trees=600, depth=None, min_leaf=2)
    return {"gradient_boosting": gradient, "boosted_trees": second_order, "adaboost": adaboost}[kind](names, features, split)

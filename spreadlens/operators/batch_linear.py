"""Many logistic models in one job: folds, feature sets, penalties, class weights and held-out groups at once.

All models share one pass over the rows an iteration.  Standardising, picking features, and turning them by principal components
are linear maps, so every model is a vector of coefficients on the raw features; a pass computes the losses, gradients and
Hessians of all of them from the same batch of rows (Arrow partial sums, ``partials.summed``), and the driver
holds only models x features numbers.  A proximal Newton step for each model follows there: exact for the quadratic penalty, coordinate
descent for elastic net, halved where it didn't lower the objective.  The number of Spark jobs is the number of Newton passes
of the slowest model (about ten), whatever the number of models; ``GROUP_BYTES`` bounds what a pass returns, and models
beyond it take a pass of their own group.

Objective: mean weighted loss + 1/(C n) (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2), on features standardised by the training
rows' mean and population deviation, with a free intercept; ``balanced`` weighs a class by n / (2 n_class).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .partials import EVERY, Rows, Split, summed
from .tiled_graph import few_rows

#: Bytes of sums that one pass returns.
GROUP_BYTES = 64 << 20
PASSES = 60
TOLERANCE = 1e-8
SCORES = "model int, id string, y int, p double, trained boolean"


@dataclass(frozen=True)
class Linear:
    """One model: its names, features by place, training rows and penalty; ``components`` of principal axes or none."""

    names: tuple[str, ...]
    features: tuple[int, ...]
    split: Split = EVERY
    c: float = 1.0
    l1_ratio: float = 0.0
    balanced: bool = False
    components: int | None = None
    whiten: bool = False
    #: ``logistic``, or ``margin`` for a linear support vector machine with squared hinge loss.
    loss: str = "logistic"


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * v))


# ------------------------------------------------------------------ what the training rows look like

class Spread:
    """Rows by class, mean and covariance of the rows that train under one split (around ``pivot``)."""

    def __init__(self, sums: np.ndarray, width: int):
        self.n0, self.n1 = sums[:2]
        self.n = self.n0 + self.n1
        n = max(self.n, 1.0)
        self.mean = sums[2:2 + width] / n
        self.cov = sums[2 + width:].reshape(width, width) / n - np.outer(self.mean, self.mean)
        self.cov[np.abs(self.cov) < 1e-12 * np.abs(np.diag(self.cov)).max(initial=0)] = 0.0
        self.sd = np.sqrt(np.maximum(np.diag(self.cov), 0))


class Packed:
    """A row matrix without ids, for the passes of a fit: one record a batch of rows, with the bits of which rows train under ``splits``.

    A pass then reads a few long binaries and no strings.
    """

    def __init__(self, rows: DataFrame, splits: list[Split], width: int, columns: list[str]):
        def run(batches):
            for b in batches:
                if len(b):
                    r = Rows(b, width, columns)
                    trains = np.packbits(np.stack([r.trains(s) for s in splits], 1) if splits else np.zeros((len(r), 0), bool), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (r.y, r.x, trains)], names=["y", "x", "trains"])

        self.splits, self.width = splits, width
        self.rows = rows.mapInArrow(run, "y binary, x binary, trains binary").checkpoint()

    def summed(self, kernel: Callable[[np.ndarray, np.ndarray, dict], np.ndarray]) -> np.ndarray | None:
        """The sum of ``kernel(x, y, which rows train by split)`` over all records; None without rows."""
        splits, width = self.splits, self.width

        def added(b):
            total = None
            for raw_y, raw_x, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                y = np.frombuffer(raw_y)
                bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, len(splits)), axis=0, count=len(y)).astype(bool) if splits else None
                v = kernel(np.frombuffer(raw_x).reshape(len(y), width), y, {s: bits[:, i] for i, s in enumerate(splits)})
                total = v if total is None else total + v
            return total

        with few_rows(self.rows.sparkSession):
            return summed(self.rows, added)


def pivot_of(rows: Packed) -> np.ndarray:
    """The mean of all rows: sums are taken around it, so that they lose no digits."""
    def kernel(x, y, trains):
        if not np.isfinite(x).all():
            raise ValueError("linear models need finite features; impute them first")
        return np.append(x.sum(0), len(x))

    total = rows.summed(kernel)
    return np.zeros(rows.width) if total is None else total[:-1] / max(total[-1], 1)


def spreads(rows: Packed, pivot: np.ndarray) -> list[Spread]:
    splits, width = rows.splits, rows.width

    def kernel(x, y, trains):
        x = x - pivot
        out = []
        for s in splits:
            m = trains[s]
            own = x[m]
            n1 = y[m].sum()
            out.append(np.concatenate([[m.sum() - n1, n1], own.sum(0), (own.T @ own).ravel()]))
        return np.concatenate(out)

    total = rows.summed(kernel)
    size = 2 + width + width * width
    total = np.zeros(size * len(splits)) if total is None else total
    return [Spread(total[i * size:(i + 1) * size], width) for i in range(len(splits))]


def linear_map(model: Linear, s: Spread, width: int) -> np.ndarray:
    """(width + 1) x (inputs + 1): from features around the pivot and a one to the model's inputs and a one."""
    f = list(model.features)
    scale = np.where(s.sd[f] > 0, 1 / np.where(s.sd[f] > 0, s.sd[f], 1), 0.0)
    if model.components is None:
        turn = np.diag(scale)
    else:
        e, v = np.linalg.eigh(s.cov[np.ix_(f, f)] * np.outer(scale, scale))
        keep = np.argsort(-e, kind="stable")[:min(model.components, len(f), max(int(s.n), 1))]
        turn = scale[:, None] * v[:, keep]
        if model.whiten:
            var = np.maximum(e[keep], 0) * s.n / max(s.n - 1, 1)
            turn = turn * np.where(var > 1e-12, 1 / np.sqrt(np.where(var > 1e-12, var, 1)), 0.0)
    out = np.zeros((width + 1, turn.shape[1] + 1))
    out[f, :-1] = turn
    out[width, :-1] = -s.mean[f] @ turn
    out[width, -1] = 1
    return out


# ------------------------------------------------------------------ Newton steps on the driver

def newton_target(h: np.ndarray, g: np.ndarray, w: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The minimum of the quadratic model around ``w`` plus penalties; the last place is the intercept, without any."""
    free = np.ones(len(w))
    free[-1] = 0
    if l1 == 0:
        return w - np.linalg.lstsq(h + np.diag(l2 * free), g + l2 * free * w, rcond=1e-14)[0]
    u, diagonal = w.copy(), np.diag(h)
    slope = g.copy()  # of the smooth part at u
    for _ in range(1000):
        most = 0.0
        for k in range(len(w)):
            a = diagonal[k] + l2 * free[k]
            if diagonal[k] <= 0:
                continue
            z = diagonal[k] * u[k] - slope[k]
            new = np.sign(z) * max(abs(z) - l1 * free[k], 0) / a
            if new != u[k]:
                step = new - u[k]
                slope += h[:, k] * step
                most = max(most, abs(step))
                u[k] = new
        if most < TOLERANCE / 10:
            break
    return u


class State:
    """One model on the driver: where it stands, its step and its best objective."""

    def __init__(self, model: Linear, s: Spread, width: int):
        self.model = model
        self.usable = s.n0 > 0 and s.n1 > 0
        self.map = linear_map(model, s, width)
        self.n = s.n
        self.weights = (s.n / (2 * s.n0), s.n / (2 * s.n1)) if model.balanced and self.usable else (1.0, 1.0)
        strength = 1 / (model.c * max(s.n, 1))
        self.l1, self.l2 = strength * model.l1_ratio, strength * (1 - model.l1_ratio)
        self.at = np.zeros(self.map.shape[1])
        if self.usable and not model.balanced and model.loss == "logistic":
            self.at[-1] = np.log(s.n1 / s.n0)
        self.base, self.best, self.step = self.at, np.inf, None
        self.done = not self.usable

    def penalty(self, w: np.ndarray) -> float:
        return self.l1 * np.abs(w[:-1]).sum() + self.l2 / 2 * (w[:-1] ** 2).sum()

    def advance(self, loss: float, g: np.ndarray, h: np.ndarray) -> None:
        """Take the sums at ``at``: accept the step or halve it, and go on."""
        value = loss / self.n + self.penalty(self.at)
        if value > self.best + 1e-13 * max(abs(self.best), 1):
            self.step = self.step / 2
            self.done = np.abs(self.step).max() < TOLERANCE
            self.at = self.base if self.done else self.base + self.step
            return
        self.base, self.best = self.at, value
        g, h = self.map.T @ g / self.n, self.map.T @ h @ self.map / self.n
        self.step = newton_target(h, g, self.at, self.l1, self.l2) - self.at
        self.done = np.abs(self.step).max() < TOLERANCE
        self.at = self.at + self.step

    def effective(self) -> np.ndarray:
        """Coefficients on the features around the pivot, and the intercept."""
        return self.map @ self.at


class Fitted:
    """All fitted models: coefficients on the raw features, small enough to broadcast."""

    def __init__(self, states: list[State], pivot: np.ndarray, columns: list[str], passes: int):
        self.models = [s.model for s in states]
        self.pivot, self.columns, self.passes = pivot, columns, passes
        self.inputs = [s.at for s in states]
        self.usable = np.array([s.usable for s in states])
        self.coef = np.stack([s.effective() for s in states], 1)

    def scores(self, rows: DataFrame, names: list[str], held_out: bool = True) -> DataFrame:
        """(names, id, y, p, trained): probabilities of the rows a model hasn't seen, or with ``held_out=False`` of all rows.

        A margin model gives its margin as p.  Models whose training rows hold one class give no scores.
        """
        coef, pivot, models, columns, usable = self.coef, self.pivot, self.models, self.columns, self.usable
        splits = sorted({m.split for m in models}, key=str)
        chances = np.array([m.loss == "logistic" for m in models], bool)

        def run(batches):
            for b in batches:
                r = Rows(b, len(pivot), columns)
                p = (r.x - pivot) @ coef[:-1] + coef[-1]
                p[:, chances] = _sigmoid(p[:, chances])
                trains, scope = ({s: f(s) for s in splits} for f in (r.trains, r.scoped))
                for m, model in enumerate(models):
                    seen = trains[model.split]
                    at = np.flatnonzero(scope[model.split] & ~seen if held_out else scope[model.split])
                    if usable[m] and len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m, np.int32)), r.ids.take(pa.array(at)), pa.array(r.y[at].astype(np.int32)),
                                                          pa.array(p[at, m]), pa.array(seen[at])], names=["model", "id", "y", "p", "trained"])

        return named(rows.mapInArrow(run, SCORES), [m.names for m in models], names)

    def coefficients(self, rows: DataFrame, names: list[str], features: list[str]) -> DataFrame:
        """(names, feature, coefficient): on the standardised features, for the models without components."""
        out = [(*m.names, features[f], float(w)) for m, at, ok in zip(self.models, self.inputs, self.usable, strict=True) if ok and m.components is None
               for f, w in zip(m.features, at[:-1], strict=True)]
        return rows.sparkSession.createDataFrame(out, ", ".join(f"{n} string" for n in names) + ", feature string, coefficient double")


def named(df: DataFrame, rows: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """Put the names of its model in place of each row's model number (one short row a model is broadcast)."""
    table = df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "model int, " + ", ".join(f"{n} string" for n in names))
    return df.join(F.broadcast(table), "model").select(*names, *[c for c in df.columns if c != "model"])


def components(rows: DataFrame, split: Split, k: int, width: int, columns: list[str] = (), scaled: bool = True) -> DataFrame:
    """The row matrix turned onto the first ``k`` principal axes of the rows that train under ``split``."""
    columns = list(columns)
    packed = Packed(rows, [split], width, columns)
    pivot = pivot_of(packed)
    spread = spreads(packed, pivot)[0]
    if not scaled:
        spread.sd = np.ones(width)
    turn = linear_map(Linear((), tuple(range(width)), split, components=k), spread, width)[:, :-1]

    def run(batches):
        for b in batches:
            x = (Rows(b, width, columns).x - pivot) @ turn[:-1] + turn[-1]
            offsets = pa.array(np.arange(len(b) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(x.ravel())), b.column(3)], names=["id", "y", "x", "splits"])

    return rows.mapInArrow(run, rows.schema).checkpoint()


def calibrated_margins(rows: DataFrame, names: tuple[str, ...], keys: list[str], features: tuple[int, ...], width: int, cell: str, test: str, folds: list[str],
                       columns: list[str], c: float = 1.0, components: int | None = None) -> DataFrame:
    """A linear support vector machine with sigmoid calibration: the mean of the calibrated models of all ``folds``.

    ``cell`` names each training row's fold, or ``test``.  Each fold's machine trains on the other folds, its sigmoid on the
    margins of the fold itself; the scores are those of the test rows.
    """
    machines = [Linear((f,), features, Split(cell, tuple(g for g in folds if g != f), True), c, components=components, loss="margin") for f in folds]
    margins = fit(rows, machines, width, columns).scores(rows, ["fold"])
    place = rows.select("id", F.get("splits", F.lit(columns.index(cell))).alias("cell"))
    wide = margins.groupBy("id", "y").pivot("fold", folds).agg(F.first("p")).join(place, "id")
    # a machine has no margin of the rows it trained on: their place is never read
    x = F.array(*[F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) for f in folds])
    second = wide.select("id", F.col("y").cast("double").alias("y"), x.alias("x"), F.array("cell").alias("splits")).checkpoint()
    curves = fit(second, [Linear((f,), (i,), Split("cell", f, True), 1e10) for i, f in enumerate(folds)], len(folds), ["cell"])
    mean = (curves.scores(second, ["fold"]).join(second.where(F.get("splits", F.lit(0)) == test).select("id"), "id", "left_semi")
            .groupBy("id", "y").agg(F.avg("p").alias("p")))
    return mean.select(*[F.lit(v).alias(k) for k, v in zip(keys, names, strict=True)], "id", "y", "p")


def fit(rows: DataFrame, models: list[Linear], width: int, columns: list[str] = ()) -> Fitted:
    """Fit all ``models`` on a row matrix of ``width`` features whose splits are of ``columns``."""
    columns = list(columns)
    splits = sorted({m.split for m in models}, key=str)
    packed = Packed(rows, splits, width, columns)
    pivot = pivot_of(packed)
    own = dict(zip(splits, spreads(packed, pivot), strict=True))
    states = [State(m, own[m.split], width) for m in models]
    passes = 0
    while passes < PASSES and not all(s.done for s in states):
        for group in groups([s for s in states if not s.done]):
            for s, sums in zip(group, newton_sums(packed, group, pivot), strict=True):
                s.advance(*sums)
        passes += 1
    for s in states:
        if not s.done:
            s.at = s.base
    return Fitted(states, pivot, columns, passes)


def groups(states: list[State]) -> list[list[State]]:
    out, size = [[]], 0
    for s in states:
        own = 8 * (len(s.model.features) + 1) ** 2
        if out[-1] and size + own > GROUP_BYTES:
            out.append([])
            size = 0
        out[-1].append(s)
        size += own
    return out


def newton_sums(rows: Packed, states: list[State], pivot: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and Hessian of each model where it stands, on its features and a one; one Spark job."""
    width, coef = rows.width, np.stack([s.effective() for s in states], 1)
    jobs = [(s.model.split, np.array([*s.model.features, width]), s.weights, s.model.loss) for s in states]

    def kernel(x, y, trains):
        x = np.append(x - pivot, np.ones((len(x), 1)), axis=1)
        logits, out = x @ coef, []
        for m, (split, f, (w0, w1), loss) in enumerate(jobs):
            own = trains[split]
            z, t, part = logits[own, m], y[own], x[np.ix_(own, f)]
            w = np.where(t > 0, w1, w0)
            if loss == "logistic":
                p = _sigmoid(z)
                value, slope, bend = np.logaddexp(0, z) - t * z, p - t, p * (1 - p)
            else:
                side = 2 * t - 1
                short = np.maximum(1 - side * z, 0)
                value, slope, bend = short**2, -2 * side * short, 2.0 * (short > 0)
            out.append([(w * value).sum()])
            out.append(part.T @ (w * slope))
            out.append((part.T @ (part * (w * bend)[:, None])).ravel())
        return np.concatenate(out)

    total, at, out = rows.summed(kernel), 0, []
    for _, f, _, _ in jobs:
        k = len(f)
        loss, g, h = total[at], np.zeros(width + 1), np.zeros((width + 1, width + 1))
        g[f] = total[at + 1:at + 1 + k]
        h[np.ix_(f, f)] = total[at + 1 + k:at + 1 + k + k * k].reshape(k, k)
        at += 1 + k + k * k
        out.append((loss, g, h))
    return out

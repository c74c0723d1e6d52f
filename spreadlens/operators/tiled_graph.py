"""Clusters and similarity graph of questions with more distinct vectors than one task should hold.

Input: the distinct unit vectors of a question (``q``, ``name``, ``m`` rows each, ``vec`` as doubles), cut into tiles of about
``TILE`` vectors.  A tile meets all tiles of its question in one sorted stream, two tiles in memory at a time; no task holds a
question, and no N x N matrix exists.

* ``linkage_sizes``: average linkage in rounds.  Each round finds every cluster's nearest one (a tie goes to the lesser name) and
  merges pairs that are nearest to each other; average linkage is reducible, so these are merges of the dendrogram.  A cluster
  with nothing nearer than the threshold is final.  A question with few enough clusters left is finished in one task.
* ``spectrum_sums``: block Lanczos on the graph's Laplacian with full reorthogonalisation.  m copies of a vector are one node of
  weight m: eigenvectors that differ within the copies have the known eigenvalue g (the copies' weighted degree and their own
  weight) m - 1 times, all others are those of the symmetric quotient diag(g) - sqrt(m) W sqrt(m), whose product with a block of
  vectors is one stream over tiles.  The basis stays in the tiles; sums of small Gram matrices go round by question.  Steps end
  once the two lowest pairs have residuals under ``STILL`` of the largest value.

The entropy of the spectrum needs every eigenvalue.  Here the sum of x log2 x comes from the same steps by Gauss quadrature over
``BLOCK`` random start vectors, after a parabola through the nodes whose sum is known exactly (count, trace and trace of the
square); the probes' standard error is returned with it.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

TILE, BLOCK, STILL, SLAB = 2048, 8, 1e-9, 512
#: Rows of a piece of the graph that fits into a core's cache.
SIDE = 256
#: Tiles of a question that one task still holds: its vectors and the basis of the steps, never the graph.
ALONE = 8
#: Bytes of distinct vectors without entries below zero that one task still holds (131,072 of 64 entries).
ALONE_BYTES = 1 << 26
#: Directions of a block under this share of its largest (squared) are left out.
FLAT = 1e-13

TILES = "q string, tile int, tiles int, sent binary, state binary"
SUMS = "q string, tiles int, total binary"
NEAR = "q string, name string, n bigint, sums array<double>, dist double, other string"
FINAL = "q string, ritz array<double>, sums array<double>, low array<double>"


@contextmanager
def few_rows(spark: SparkSession, rows: int = 4):
    """Arrow batches of ``rows`` rows while plans over tiles run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    After ``checkpoint()`` a plan still carries the sizes guessed for its joins, whose digits double with every step of a loop.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tiles-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _records(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        yield from b.to_pylist()


def _batch(schema: str, *rows: tuple) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(),
             "array<double>": pa.list_(pa.float64())}
    s = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), s, strict=True)], schema=s)


def met(tiles: DataFrame, shared: list[str], private: list[str] = ()) -> DataFrame:
    """Each tile sent to every tile (``target``) of its question; sorted, a target's own tile first, with its ``private`` columns."""
    out = tiles.select("q", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("target"), "tile", "tiles", *shared, *private)
    own = F.col("tile") == F.col("target")
    out = out.select("q", "target", "tile", "tiles", *shared, *[F.when(own, F.col(c)).alias(c) for c in private])
    return out.repartition("q", "target").sortWithinPartitions("q", "target", ~own, "tile")


def _in_tiles(rows: DataFrame, counts: DataFrame, tile: int) -> DataFrame:
    """``rows`` with the number of tiles of their question and their own tile."""
    return (rows.join(counts.select("q", F.ceil(F.col("k") / tile).cast("int").alias("tiles")), "q")
            .withColumn("tile", F.pmod(F.xxhash64("name"), F.col("tiles")).cast("int")))


# ------------------------------------------------------------------ linkage

def _nearest(batches):
    """The nearest other cluster of every cluster of a target tile."""
    now, have = None, None

    def out():
        return _batch(NEAR, *[(now[0], a, n, s, d if np.isfinite(d) else None, o) for a, n, s, d, o in
                              zip(have["names"], have["n"].tolist(), have["sums"].tolist(), have["dist"].tolist(), have["other"], strict=True)])

    for r in _records(batches):
        rows = sorted(r["rows"], key=lambda x: x["name"])
        names, n, sums = np.array([x["name"] for x in rows], object), np.array([x["n"] for x in rows]), np.array([x["sums"] for x in rows])
        own = r["tile"] == r["target"]
        if own:
            if now is not None:
                yield out()
            now = (r["q"], r["target"])
            have = {"names": names, "n": n, "sums": sums, "dist": np.full(len(n), np.inf), "other": np.full(len(n), None, object)}
        elif now != (r["q"], r["target"]):  # the hash left the target tile empty
            continue
        # a pair's product is taken in one order whichever side asks, so both sides read the same number
        dots = have["sums"] @ sums.T if r["target"] <= r["tile"] else (sums @ have["sums"].T).T
        dist = 1.0 - dots / np.multiply.outer(have["n"], n)
        if own:
            np.fill_diagonal(dist, np.inf)
        at = dist.argmin(1)  # names are sorted: a tie goes to the lesser
        best, who = dist[np.arange(len(at)), at], names[at]
        better = (best < have["dist"]) | ((best == have["dist"]) & np.isfinite(best) & np.array([o is not None and w < o for w, o in zip(who, have["other"], strict=True)], bool))
        have["dist"], have["other"] = np.where(better, best, have["dist"]), np.where(better, who, have["other"])
    if now is not None:
        yield out()


def _merged(near: DataFrame) -> DataFrame:
    """(q, name, n, sums, merged): clusters after the merges of one round."""
    other = near.select("q", F.col("name").alias("other"), F.col("other").alias("back"), F.col("n").alias("n2"), F.col("sums").alias("sums2"))
    both = near.join(other, ["q", "other"], "left").withColumn("merged", F.col("back").eqNullSafe(F.col("name")))
    return (both.filter(~F.col("merged") | (F.col("name") < F.col("other")))
            .select("q", "name", F.when(F.col("merged"), F.col("n") + F.col("n2")).otherwise(F.col("n")).alias("n"),
                    F.when(F.col("merged"), F.zip_with("sums", "sums2", lambda x, y: x + y)).otherwise(F.col("sums")).alias("sums"), "merged"))


def linkage_sizes(classes: DataFrame, threshold: float, finish, tile: int = TILE) -> DataFrame:
    """(q, size, n): how many clusters of each size questions have.

    ``classes``: (q, name, m, sums as array) of vectors that aren't zero; ``finish`` gives the cluster sizes of vector sums and their
    row counts in one task, for questions with at most ``tile`` clusters left.
    """
    spark = classes.sparkSession
    ended: list[DataFrame] = []
    left = written(classes.select("q", "name", F.col("m").alias("n"), "sums"))

    def last(pdf):
        pdf = pdf.sort_values("name")
        sizes = finish(np.stack(pdf["sums"].to_numpy()), pdf["n"].to_numpy().astype(float))
        values, n = np.unique(sizes, return_counts=True)
        return type(pdf)({"q": pdf["q"].iloc[0], "size": values, "n": n})

    while True:
        counts = written(left.groupBy("q").agg(F.count("*").alias("k")))
        small = left.join(counts.filter(F.col("k") <= tile).select("q"), "q", "left_semi")
        ended.append(written(small.groupBy("q").applyInPandas(last, "q string, size bigint, n bigint")))
        large = counts.filter(F.col("k") > tile)
        if large.isEmpty():
            break
        with few_rows(spark):
            tiles = (_in_tiles(left, large, tile).groupBy("q", "tile", "tiles")
                     .agg(F.collect_list(F.struct("name", "n", "sums")).alias("rows")))
            near = written(met(tiles, ["rows"]).mapInArrow(_nearest, NEAR))
        near_enough = F.col("dist") < threshold
        final = near.filter(~F.coalesce(near_enough, F.lit(False)))
        ended.append(written(final.groupBy("q", F.col("n").alias("size")).agg(F.count("*").alias("n"))))
        after = written(_merged(near.filter(near_enough)))
        if final.isEmpty() and after.filter("merged").isEmpty() and not after.isEmpty():
            raise RuntimeError("a round of average linkage merged nothing")
        left = after.drop("merged")
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out.groupBy("q", "size").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ spectrum

def _cut(pdf):
    """A tile from its classes."""
    pdf = pdf.sort_values("name")
    q, tile, n = pdf["q"].iloc[0], int(pdf["tile"].iloc[0]), float(pdf["n"].iloc[0])
    m = pdf["m"].to_numpy().astype(float)
    vecs = np.stack([np.frombuffer(v) for v in pdf["vec"]])
    return type(pdf)({"q": [q], "tile": [tile], "tiles": [int(pdf["tiles"].iloc[0])],
                      "sent": [pickle.dumps((vecs, m[:, None]))], "state": [pickle.dumps({"m": m, "n": n})]})


def _times(batches, first: bool):
    """The graph's weights times the block that all tiles sent, for each target tile."""
    now, have = None, None

    def out():
        s, acc = have["state"], have["acc"]
        m = s["m"]
        if first:
            own = np.maximum(np.einsum("nd,nd->n", have["vecs"], have["vecs"]), 0)
            g = acc[:, 0]
            degree = g - own
            rng = np.random.default_rng(zlib.crc32(f"{now[0]}|{now[1]}".encode()))
            s |= {"g": g, "trace": m @ degree, "square": m @ (degree * degree) + m @ (have["acc2"][:, 0] - own * own),
                  "basis": np.sqrt(m / s["n"])[:, None], "T": np.zeros((1, 1)), "width": 0, "start": np.zeros((0, 0)),
                  "y": rng.integers(0, 2, (len(m), BLOCK)) * 2.0 - 1.0}
        else:
            v = s["basis"][:, -s["width"]:]
            s["y"] = s["g"][:, None] * v - np.sqrt(m)[:, None] * acc
        return _batch(TILES, (now[0], now[1], have["tiles"], pickle.dumps((have["vecs"], None)), pickle.dumps(s)))

    for r in _records(batches):
        vecs, u = pickle.loads(r["sent"])
        if r["tile"] == r["target"]:
            if now is not None:
                yield out()
            now = (r["q"], r["target"])
            have = {"vecs": vecs, "state": pickle.loads(r["state"]), "tiles": r["tiles"], "acc": np.zeros((len(vecs), u.shape[1])),
                    "acc2": np.zeros((len(vecs), u.shape[1]))}
        for i in range(0, len(have["vecs"]), SLAB):
            w = np.maximum(have["vecs"][i:i + SLAB] @ vecs.T, 0.0)
            have["acc"][i:i + SLAB] += w @ u
            if first:
                have["acc2"][i:i + SLAB] += (w * w) @ u
    if now is not None:
        yield out()


def _parts(batches, kind: int):
    """What a tile adds to its question's small matrices; those that all tiles hold alike come from tile 0."""
    for r in _records(batches):
        s = pickle.loads(r["state"])
        q, y = s["basis"], s["y"]
        alike = [] if kind == 0 else [s["T"]] if kind == 1 else [s["T"], s["C"], s["R"], s["start"], np.array([float(s["width"])])]
        part = [q.T @ y] + ([] if kind == 0 else [y.T @ y]) + [a if r["tile"] == 0 else np.zeros_like(a) for a in alike]
        yield r["q"], r["tiles"], part


def _added(rows):
    """Sums of consecutive rows of a question."""
    now, total, tiles = None, None, None
    for q, n, part in rows:
        if q != now:
            if now is not None:
                yield now, tiles, total
            now, total, tiles = q, part, n
        else:
            total = [a + b for a, b in zip(total, part, strict=True)]
    if now is not None:
        yield now, tiles, total


def _send_parts(batches, kind: int):
    for q, tiles, total in _added(_parts(batches, kind)):
        yield _batch(SUMS, (q, tiles, pickle.dumps(total)))


def _solve(batches, kind: int):
    """Sums of the parts of each question, and what its tiles are to do with them."""
    rows = ((r["q"], r["tiles"], pickle.loads(r["total"])) for r in _records(batches))
    for q, tiles, total in _added(rows):
        yield _batch(SUMS, (q, tiles, pickle.dumps(SMALL[kind](total))))


def _basis_of(gram: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(S, R): Y S is orthonormal and spans Y = (Y S) R where ``gram`` = Y'Y; flat directions are left out."""
    value, turn = np.linalg.eigh(gram)
    keep = value > max(floor, FLAT * value.max(initial=0.0))
    value, turn = value[keep], turn[:, keep]
    return turn / np.sqrt(value), np.sqrt(value)[:, None] * turn.T


def _first_turn(total):
    return {"C": total[0]}


def _second_turn(total):
    c, gram, t = total
    scale = max(1.0, np.abs(t).max()) if len(t) > 1 else 0.0
    turn, r = _basis_of(gram - c.T @ c, (1e-12 * scale) ** 2)
    return {"C": c, "S": turn, "R": r}


def _third_turn(total):
    c3, gram, t, c, r, start, width = total
    turn, more = _basis_of(gram - c3.T @ c3, 0.0) if len(gram) else (np.zeros((0, 0)), np.zeros((0, 0)))
    r = more @ r if len(gram) else r
    w = int(width[0])
    out = {"C": c3, "S": turn, "done": False, "ritz": None}
    if w:  # the products of the last block of the basis are known now
        t = t.copy()
        t[:, -w:] = c
        t[-w:, :] = c.T
        value, vector = np.linalg.eigh(t[1:, 1:])
        rest = np.linalg.norm(r @ vector[-w:, :2], axis=0)
        if len(r) == 0 or (len(value) > 1 and rest.max() <= STILL * max(abs(value[-1]), 1e-300)):
            out |= {"done": True, "lowest": vector[:, 0], "ritz": [value[0], value[1] if len(value) > 1 else np.nan, *_quadrature(value, vector, start)]}
    else:
        start = r
    size = len(t) + turn.shape[1]
    grown = np.zeros((size, size))
    grown[:len(t), :len(t)] = t
    return out | {"T": grown, "start": start}


def _quadrature(value, vector, start) -> list[float]:
    """Parabola through x log2 x at the nodes, and the mean and standard error over probes of what it leaves."""
    mass = (start.T @ vector[:len(start)]) ** 2  # probes x nodes
    x = np.maximum(value, 0.0)
    y = x_log_x(x)
    scale = max(x.max(), 1e-300)
    weight = np.sqrt(mass.mean(0))
    powers = np.stack([np.ones_like(x), x / scale, (x / scale) ** 2], 1)
    c = np.linalg.lstsq(powers * weight[:, None], y * weight, rcond=None)[0]
    left = mass @ (y - powers @ c)
    return [c[0], c[1] / scale, c[2] / scale ** 2, left.mean(), left.std(ddof=1) / np.sqrt(len(left))]


def x_log_x(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1.0)), 0.0)


def rounded_off(value: float, trace: float) -> float:
    """An eigenvalue of a Laplacian; one that differs from zero by rounding only is zero."""
    return float(value) if value > 1e-14 * trace else 0.0


SMALL = [_first_turn, _second_turn, _third_turn]


def _apply(batches, kind: int):
    for r in _records(batches):
        s, got = pickle.loads(r["state"]), pickle.loads(r["total"])
        y = s["y"] - s["basis"] @ got["C"]
        sent = r["sent"]
        if kind == 0:
            s |= {"y": y, "C": got["C"]}
        elif kind == 1:
            s |= {"y": y @ got["S"], "C": s["C"] + got["C"], "R": got["R"]}
        else:
            v = y @ got["S"] if got["S"].size else np.zeros((len(y), 0))
            s |= {"T": got["T"], "start": got["start"], "done": got["done"], "ritz": got["ritz"]}
            if got["done"]:
                s["lowest"] = s["basis"][:, 1:] @ got["lowest"]
            s |= {"basis": np.concatenate([s["basis"], v], 1), "width": v.shape[1], "y": None}
            sent = pickle.dumps((pickle.loads(sent)[0], np.sqrt(s["m"])[:, None] * v))
        yield pa.RecordBatch.from_arrays([*_batch(TILES, (r["q"], r["tile"], r["tiles"], sent, pickle.dumps(s))).columns,
                                          pa.array([bool(s.get("done"))])], names=[*TILE_COLUMNS, "done"])


TILE_COLUMNS = [f.split()[0] for f in TILES.split(", ")]


def _turned(tiles: DataFrame, kind: int) -> DataFrame:
    """One round of sums over each question's tiles."""
    sums = (tiles.mapInArrow(partial(_send_parts, kind=kind), SUMS).repartition("q").sortWithinPartitions("q")
            .mapInArrow(partial(_solve, kind=kind), SUMS))
    spread = sums.select("q", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "total")
    return written(tiles.join(spread, ["q", "tile"]).select(*TILE_COLUMNS, "total").mapInArrow(partial(_apply, kind=kind), TILES + ", done boolean"))


def _final(batches):
    """A finished tile's part of its question's features."""
    for r in _records(batches):
        s = pickle.loads(r["state"])
        yield _batch(FINAL, (r["q"], s["ritz"], *_node_sums(s["m"], s["g"], np.abs(s["lowest"]), s["trace"], s["square"])))


def _node_sums(m, g, u, trace, square) -> tuple[list[float], list[float]]:
    """What nodes add to their question's sums, and the lowest eigenvalues within copies; ``u``: sizes of the Fiedler vector's entries."""
    own = u / np.sqrt(m)  # a row's entry in the vector
    again = m - 1
    low = np.sort(np.concatenate([g[again > 0], g[again > 1]]))[:2]
    return [trace, square, again @ g, again @ (g * g), again @ x_log_x(g), m @ own, m @ x_log_x(own), m @ own ** 4, float(len(m))], low.tolist()


def spectrum_sums(classes: DataFrame, counts: DataFrame, tile: int = TILE) -> DataFrame:
    """(q, ritz, sums, low) of each question in ``counts`` (q, k classes, n rows); ``spectral_features`` turns them into features."""
    spark = classes.sparkSession
    with few_rows(spark):
        cut = _in_tiles(classes, counts, tile).join(counts.select("q", "n"), "q")
        tiles = written(cut.groupBy("q", "tile").applyInPandas(_cut, TILES))
        # a hash may leave a tile empty: number those that are there
        there = tiles.groupBy("q").agg(F.sort_array(F.collect_list("tile")).alias("there"))
        tiles = written(tiles.drop("tiles").join(there, "q").withColumn("tile", (F.array_position("there", F.col("tile")) - 1).cast("int"))
                        .withColumn("tiles", F.size("there")).select(*TILE_COLUMNS))
        ended = []
        first = True
        while not tiles.isEmpty():
            tiles = written(met(tiles, ["sent"], ["state"]).mapInArrow(partial(_times, first=first), TILES))
            for kind in range(3):
                tiles = _turned(tiles.select(*TILE_COLUMNS), kind)
            first = False
            ended.append(written(tiles.filter("done").mapInArrow(_final, FINAL)))
            tiles = written(tiles.filter("not done").select(*TILE_COLUMNS))
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    total = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(9)])
    return out.groupBy("q").agg(F.first("ritz").alias("ritz"), total.alias("sums"), F.slice(F.sort_array(F.flatten(F.collect_list("low"))), 1, 2).alias("low"))


def spectrum_alone(vecs: np.ndarray, m: np.ndarray, name: str = "") -> tuple[list[float], list[float], list[float]]:
    """``spectrum_sums`` of one question in one task: the same steps over pieces of the graph, of which only one is held at a time."""
    positive = not (vecs < 0).any()  # then no similarity is below zero, and the graph is vecs vecs'

    def times(u, squared=False):
        if positive:
            return np.einsum("nd,nd->n", vecs @ (vecs.T @ (u * vecs)), vecs)[:, None] if squared else vecs @ (vecs.T @ u)
        out = np.zeros((len(vecs), u.shape[1]))
        for i in range(0, len(vecs), SIDE):
            for j in range(i, len(vecs), SIDE):  # a piece of the graph serves both of its sides
                w = vecs[i:i + SIDE] @ vecs[j:j + SIDE].T
                np.maximum(w, 0.0, out=w)
                if squared:
                    w *= w
                out[i:i + SIDE] += w @ u[j:j + SIDE]
                if j > i:
                    out[j:j + SIDE] += w.T @ u[i:i + SIDE]
        return out

    root, own = np.sqrt(m), np.maximum(np.einsum("nd,nd->n", vecs, vecs), 0)
    g = times(m[:, None])[:, 0]
    degree = g - own
    trace, square = m @ degree, m @ (degree * degree) + m @ (times(m[:, None], True)[:, 0] - own * own)
    # columns of the basis, doubled when they are full
    held, used, width = np.empty((len(m), 1 + 8 * BLOCK), order="F"), 1, 0
    held[:, 0] = root / np.sqrt(m.sum())
    t, start = np.zeros((1, 1)), np.zeros((0, 0))
    y = np.random.default_rng(zlib.crc32(name.encode())).integers(0, 2, (len(m), BLOCK)) * 2.0 - 1.0
    while True:
        q = held[:, :used]
        c = q.T @ y
        y -= q @ c
        turned = _second_turn([q.T @ y, y.T @ y, t])
        y = (y - q @ turned["C"]) @ turned["S"]
        got = _third_turn([q.T @ y, y.T @ y, t, c + turned["C"], turned["R"], start, np.array([float(width)])])
        if got["done"]:
            break
        v = (y - q @ got["C"]) @ got["S"] if got["S"].size else np.zeros((len(y), 0))
        t, start, width = got["T"], got["start"], v.shape[1]
        if used + width > held.shape[1]:
            grown = np.empty((len(m), 2 * held.shape[1]), order="F")
            grown[:, :used] = q
            held = grown
        held[:, used:used + width] = v
        used += width
        y = g[:, None] * v - root[:, None] * times(root[:, None] * v)
    u = np.abs(held[:, 1:used] @ got["lowest"])
    sums, low = _node_sums(m, g, u, trace, square)
    return [float(x) for x in got["ritz"]], sums, low


def spectral_features(ritz, sums, low, eps: float) -> dict:
    """G8-G11 and Σλ, Σλ² of one question, with the standard error of the entropy."""
    trace, square, rep, rep2, rep_log, z, z_log, fourth, k = sums
    values = sorted([(rounded_off(x, trace), 0) for x in ritz[:2]] + [(rounded_off(x, trace), 1) for x in low])
    (second, copies), third = values[0], values[1][0]
    c0, c1, c2, left, error = ritz[2:]
    logs = rep_log + c0 * (k - 1) + c1 * (trace - rep) + c2 * (square - rep2) + left
    entropy = np.log2(trace) - logs / trace if trace > 0 else 0.0
    # a vector that differs within copies only: two of them against each other
    spread, fourth = (1.0, 0.5) if copies else (np.log2(z) - z_log / z, fourth)
    return {"lam2": second, "lam3": third, "SGR": second / (third + 1e-8), "spectral_entropy": entropy, "ipr_fiedler": fourth,
            "HFER": second * spread, "lam_sum": trace, "lam_sq_sum": square, "spectral_entropy_se": error / trace if trace > 0 else 0.0}

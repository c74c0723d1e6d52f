"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 6).

Equal vectors of one label collapse to a class.  Classes are range-partitioned
by label and by their angle to the first principal axis and cut into tiles;
two unit vectors at cosine c or more differ by at most arccos(c) in that angle,
so farther tile pairs are left out.  A tile pair is compared in rotated
coordinates, leading axes first: once the partial product plus the product of
the suffix norms (Cauchy-Schwarz) can't reach the threshold a pair is dropped, and
what is left is checked in double precision on the given vectors.  Each
comparison returns counts and a spanning forest of its links.

Any orthonormal rotation gives the same links; it is fitted on at most
``SAMPLE_VECTORS`` vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those without a label, link with nothing; vectors of different
lengths don't link; rows that repeat a vec_id count as vectors of their own;
a null vec_id takes part but is no component's id (null if no member has one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components, local_components

THRESHOLD = 0.93
SAMPLE_VECTORS = 2048
TILE = 1024
SLAB = 256
#: Axes after which pairs are dropped.
STAGES = (8, 16, 32)
#: Share of a slab's pairs under which they are followed one by one.
SPARSE = 0.05
EPS = 1e-9

KEYED = "vec_id bigint, label int, dim int, key string, vec binary"
TILES = "base bigint, label int, dim int, lo double, hi double, keys array<string>, weights array<bigint>, vecs binary"
FOUND = "a bigint, b bigint, n bigint"
common.ARROW.setdefault("array<string>", pa.list_(pa.string()))


def vectors_of(col: pa.Array) -> list[np.ndarray | None]:
    """Each row as a double vector, or None if it links with nothing."""
    flat = np.asarray(pc.fill_null(col.flatten(), float("nan")).cast(pa.float64()))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(col), 0))
    ends = np.cumsum(sizes)
    out: list[np.ndarray | None] = []
    for s, e in zip(ends - sizes, ends, strict=True):
        v = flat[s:e]
        ok = len(v) and np.isfinite(v).all() and v.any()
        with np.errstate(over="ignore"):
            out.append(v if ok and np.isfinite(n := np.sqrt(v @ v)) and n > 0 else None)
    return out


def _keyed(batches):
    for b in batches:
        labels = b.column(1).to_pylist()
        dims, keys, raw = [], [], []
        for label, v in zip(labels, vectors_of(b.column(2)), strict=True):
            good = v is not None and label is not None
            raw.append(v.tobytes() if good else None)
            dims.append(len(v) if good else None)
            keys.append(hashlib.blake2b(raw[-1], digest_size=16, salt=f"{label}".encode()[:16]).hexdigest() if good else None)
        yield common.batch(KEYED, b.column(0), b.column(1), dims, keys, raw)


def rotation(rows: list[bytes], dim: int) -> np.ndarray:
    """Orthonormal axes (columns) by falling second moment of the unit vectors."""
    x = np.stack([np.frombuffer(r) for r in rows]) if rows else np.eye(dim)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def axes(turn: np.ndarray, dim: int) -> np.ndarray:
    return turn if len(turn) == dim else np.eye(dim)


def _angles(batches, turn):
    for b in batches:
        out = []
        for raw in b.column("vec").to_pylist():
            v = np.frombuffer(raw)
            out.append(float(np.arccos(np.clip(v @ axes(turn.value, len(v))[:, 0] / np.linalg.norm(v), -1, 1))))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "angle"])


def _tiles(batches: Iterator[pa.RecordBatch], size) -> Iterator[pa.RecordBatch]:
    """Cut a sorted partition into tiles of one label and length."""
    base = TaskContext.get().partitionId() << 40
    held: list[tuple] = []
    kind = None

    def tile():
        nonlocal base
        keys, weights, vecs, angles = zip(*held, strict=True)
        row = common.batch(TILES, [base], [kind[0]], [kind[1]], [angles[0]], [angles[-1]], [list(keys)], [list(weights)], [b"".join(vecs)])
        base += len(held)
        held.clear()
        return row

    for b in batches:
        for label, dim, key, weight, vec, angle in zip(*[b.column(c).to_pylist() for c in ("label", "dim", "key", "weight", "vec", "angle")], strict=True):
            if held and ((label, dim) != kind or len(held) >= size):
                yield tile()
            kind = (label, dim)
            held.append((key, weight, vec, angle))
    if held:
        yield tile()


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows of rotated unit vectors, dropped as soon as the bound is under the threshold."""
    d = a.shape[1]
    cuts = [0, *[c for c in STAGES if c < d], d]
    rest_a, rest_b = (np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], 1)[:, ::-1], 0)) for x in (a, b))
    rest_a, rest_b = (np.concatenate([r, np.zeros((len(r), 1))], 1) for r in (rest_a, rest_b))
    out_i, out_j = [], []
    for s in range(0, len(a), SLAB):
        x, xr = a[s:s + SLAB], rest_a[s:s + SLAB]
        total = np.zeros((len(x), len(b)))
        i = j = value = None
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if i is None:
                total += x[:, lo:hi] @ b[:, lo:hi].T
                alive = total + np.outer(xr[:, hi], rest_b[:, hi]) >= threshold - EPS
                if same:
                    alive &= np.arange(s, s + len(x))[:, None] < np.arange(len(b))
                if hi == d or np.count_nonzero(alive) < SPARSE * alive.size:
                    i, j = np.nonzero(alive)
                    value = total[i, j]
            else:
                value = value + np.einsum("nd,nd->n", x[i, lo:hi], b[j, lo:hi])
                alive = value + xr[i, hi] * rest_b[j, hi] >= threshold - EPS
                i, j, value = i[alive], j[alive], value[alive]
            if i is not None and not len(i):
                break
        out_i.append(i + s)
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def _compare(batches, turn, threshold):
    for batch in batches:
        for r in batch.to_pylist():
            same, dim = r["base_a"] == r["base_b"], r["dim"]
            a, b = (np.frombuffer(r[k]).reshape(-1, dim) for k in ("a", "b"))
            na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
            q = axes(turn.value, dim)
            i, j = near_pairs((a / na[:, None]) @ q, (b / nb[:, None]) @ q, threshold, same)
            real = np.einsum("nd,nd->n", a[i], b[j]) / (na[i] * nb[j]) >= threshold
            i, j = i[real], j[real]
            if not len(i):
                continue
            wa, wb = np.array(r["wa"], np.int64), np.array(r["wb"], np.int64)
            number = np.concatenate([np.arange(len(a)) + r["base_a"], [] if same else np.arange(len(b)) + r["base_b"]]).astype(np.int64)
            j2 = j if same else j + len(a)
            count = np.zeros(len(number), np.int64)
            np.add.at(count, i, wb[j])
            np.add.at(count, j2, wa[i])
            root = local_components(len(number), i, j2)
            tied = np.flatnonzero(root != np.arange(len(number)))
            hit = np.flatnonzero(count)
            yield common.batch(FOUND, pa.array(np.concatenate([number[tied], number[hit]])),
                               pa.array([*number[root[tied]].tolist(), *[None] * len(hit)], pa.int64()),
                               pa.array([*[None] * len(tied), *count[hit].tolist()], pa.int64()))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = embeddings.sparkSession
    common.bounded_batches(spark)
    rows = common.take(embeddings, vec_id="bigint", label="int", embedding="array<double>").mapInArrow(_keyed, KEYED)
    classes = (rows.filter("key is not null").groupBy("key")
               .agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.count("*").alias("weight"), F.first("vec").alias("vec")))
    sample = classes.select("dim", "vec").orderBy(F.xxhash64("key")).limit(SAMPLE_VECTORS).collect()  # at most SAMPLE_VECTORS rows
    dims = [r["dim"] for r in sample]
    dim = max(set(dims), key=lambda x: (dims.count(x), x)) if dims else 1
    turn = spark.sparkContext.broadcast(rotation([bytes(r["vec"]) for r in sample if r["dim"] == dim], dim))
    angled = classes.mapInArrow(partial(_angles, turn=turn), "key string, label int, dim int, weight bigint, vec binary, angle double")
    order = ["label", "dim", "angle", "key"]
    tiles = common.checkpointed(angled.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_tiles, size=tile), TILES))

    ends = tiles.select("base", "label", "dim", "lo", "hi")
    reach = float(np.arccos(threshold)) + 1e-6
    one, two = (ends.select("label", "dim", *[F.col(c).alias(f"{c}_{s}") for c in ("base", "lo", "hi")]) for s in "ab")
    pairs = (one.join(two, ["label", "dim"])
             .filter("base_a <= base_b").filter((F.col("lo_b") - F.col("hi_a") <= reach) & (F.col("lo_a") - F.col("hi_b") <= reach))
             .select("dim", "base_a", "base_b"))
    left = tiles.select(F.col("base").alias("base_a"), F.col("vecs").alias("a"), F.col("weights").alias("wa"))
    right = tiles.select(F.col("base").alias("base_b"), F.col("vecs").alias("b"), F.col("weights").alias("wb"))
    work = pairs.join(left, "base_a").join(right, "base_b").select("dim", "base_a", "base_b", "a", "b", "wa", "wb")
    found = common.checkpointed(work.mapInArrow(partial(_compare, turn=turn, threshold=threshold), FOUND))

    numbers = tiles.select("base", F.posexplode(F.arrays_zip("keys", "weights")).alias("at", "x")).select(
        (F.col("base") + F.col("at")).alias("number"), F.col("x.keys").alias("key"), F.col("x.weights").alias("weight"))
    counts = found.filter("n is not null").groupBy(F.col("a").alias("number")).agg(F.sum("n").alias("n"))
    root = connected_components(found.filter("b is not null").select("a", "b")).select(F.col("node").alias("number"), "root")
    member = (numbers.join(counts, "number", "left").join(root, "number", "left")
              .select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "number").alias("root")))
    ids = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"))
    least = member.join(ids, "key").groupBy("root").agg(F.min("first").alias("least"))
    info = member.join(least, "root").select("key", "links", "least")
    own = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return (rows.select("vec_id", "key").join(info, "key", "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"),
                    F.col("vec_id").eqNullSafe(own).alias("kept")))

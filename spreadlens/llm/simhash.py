"""SimHash near-duplicates by tiled exact comparison (operator 2).

Distinct fingerprints are put into tiles by the population counts of their
four 16-bit parts; large tiles are cut into blocks.  Two fingerprints within
the radius have counts that differ by no more than it in sum, so only
such tile pairs are compared, each by exclusive-or and bit counts in numpy.
A comparison returns a spanning forest of its links, never all of them, and
components come from grouped joins.  Copies collapse before any comparison.

Defined results: a null text counts as empty; texts without words have
fingerprint zero and link like any other; repeated rows are rows of their
own with the same fingerprint; a null doc_id stays, takes part in linking, and
never is a component's id (an id is null if no member has one).  Empty
tables give no rows, texts of any length are read whole, extra columns go
through ``keep_one`` whatever their names and are left out by ``groups``.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components, local_components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints in one block of a tile.
BLOCK = 2048
#: Rows of a block that are compared at once with the other block.
SLAB = 256
PARTS = 4
DIGIT = 64

PRINTS = "doc_id bigint, fp bigint, fingerprint string"
MARKED = "doc_id bigint, fp bigint, mark bigint"
LINKS = "a bigint, b bigint"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The 8 bytes (most significant first) of a text's fingerprint."""
    words = text.translate(LOWER).split()  # bytes.split() parts at 0x20 and 0x09-0x0D
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = [xxhash.xxh64_digest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size) - 1
        start = end - size + 1
        h = xxhash.xxh64_digest
        digests = [h(joined[s:e], SEED) for s, e in zip(start[:len(words) - shingle + 1].tolist(), end[shingle - 1:].tolist(), strict=True)]
    n = len(digests)
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(raw[i:i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n).tobytes()


def _prints(batches, shingle):
    for b in batches:
        col = b.column(1).cast(pa.binary())
        found = [fingerprint(t.as_py() or b"", shingle) for t in col]
        fp = np.frombuffer(b"".join(found), ">u8").astype(np.uint64).view(np.int64)
        yield common.batch(PRINTS, b.column(0), pa.array(fp), [f.hex() for f in found])


def _marked_prints(batches, shingle):
    for b in batches:
        printed = next(_prints(iter([b]), shingle))
        yield common.batch(MARKED, b.column(0), printed.column(1), b.column(2))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64 bits) and fingerprint (hex) of every whole text."""
    common.bounded_batches(docs.sparkSession)
    return common.documents(docs).mapInArrow(partial(_prints, shingle=shingle), PRINTS)


def tile_steps(radius: int) -> list[int]:
    """Differences of tile numbers to compare: counts differ by at most the radius in sum; one of each mirrored two."""
    span = range(-radius, radius + 1)
    steps = [d for d in itertools.product(span, repeat=PARTS) if sum(map(abs, d)) <= radius and d >= (0,) * PARTS]
    return [sum(x * DIGIT ** (PARTS - 1 - i) for i, x in enumerate(d)) for d in steps]


def _compare(batches, radius):
    for batch in batches:
        a_list, b_list, same = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        av, bv = (np.asarray(x.flatten()).view(np.uint64) for x in (a_list, b_list))
        ao, bo = (np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(x)))]) for x in (a_list, b_list))
        for k, one in enumerate(same):
            a, b = av[ao[k]:ao[k + 1]], bv[bo[k]:bo[k + 1]]
            at, to = [], []
            for s in range(0, len(a), SLAB):
                near = np.bitwise_count(a[s:s + SLAB, None] ^ b[None, :]) <= radius
                i, j = np.nonzero(near)
                if len(i):
                    at.append(i + s)
                    to.append(j)
            if not at:
                continue
            i, j = np.concatenate(at), np.concatenate(to)
            both = a if one else np.concatenate([a, b])
            root = local_components(len(both), i, j if one else j + len(a))
            tied = np.flatnonzero(root != np.arange(len(both)))
            if len(tied):
                yield common.batch(LINKS, pa.array(both[tied].view(np.int64)), pa.array(both[root[tied]].view(np.int64)))


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """A spanning forest (a, b) of the distinct fingerprints ``fp`` at ``radius`` or fewer bits."""
    part = [F.bit_count(F.shiftrightunsigned("fp", 16 * (PARTS - 1 - i)).bitwiseAND(F.lit(0xFFFF).cast("bigint"))) for i in range(PARTS)]
    tile = sum((p.cast("bigint") + radius) * DIGIT ** (PARTS - 1 - i) for i, p in enumerate(part))
    distinct = common.checkpointed(prints.select("fp").distinct().select("fp", tile.alias("tile")))
    sizes = distinct.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
    cut = (distinct.join(sizes, "tile").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
           .groupBy("tile", "part").agg(F.collect_list("fp").alias("fps")))
    blocks = common.checkpointed(cut)
    parts = blocks.select("tile", "part")
    near = parts.select(F.col("tile").alias("ta"), F.col("part").alias("pa"),
                        F.explode(F.array(*[F.lit(s).cast("bigint") for s in tile_steps(radius)])).alias("step"))
    pairs = (near.withColumn("tb", F.col("ta") + F.col("step")).drop("step")
             .join(parts.select(F.col("tile").alias("tb"), F.col("part").alias("pb")), "tb")
             .filter("ta <> tb or pa <= pb"))
    left = blocks.select(F.col("tile").alias("ta"), F.col("part").alias("pa"), F.col("fps").alias("a"))
    right = blocks.select(F.col("tile").alias("tb"), F.col("part").alias("pb"), F.col("fps").alias("b"))
    work = (pairs.join(left, ["ta", "pa"]).join(right, ["tb", "pb"])
            .select("a", "b", ((F.col("ta") == F.col("tb")) & (F.col("pa") == F.col("pb"))).alias("same")))
    return work.mapInArrow(partial(_compare, radius=radius), LINKS)


def roots(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """fp, its least doc_id, and the root of its component."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    root = connected_components(links(prints, radius, block))
    return first.join(root, first["fp"] == root["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``."""
    prints = common.checkpointed(fingerprints(docs, shingle))
    member = roots(prints, radius, block)
    ids = member.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = member.join(ids, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, whole and with all its columns.

    It is the row with the least id (nulls last), then the least hash of all its columns, so the result doesn't hang on
    how rows are dealt; rows that share an id but not a component all count by themselves.
    """
    flat = common.positional(docs)
    key, text = (F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text"))
    marked = flat.withColumn("mark", F.xxhash64(*flat.columns))
    common.bounded_batches(docs.sparkSession)
    prints = common.checkpointed(marked.select(key.cast("bigint"), text.cast("string"), "mark").mapInArrow(partial(_marked_prints, shingle=shingle), MARKED))
    root = roots(prints, radius).select("fp", "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    best = prints.join(root, "fp").groupBy("root").agg(F.min(order).alias("row"))
    kept = best.select(F.col("row.doc_id").alias("k_id"), F.col("row.mark").alias("k_mark")).distinct()
    # rows equal in every column share a mark; one of them stays
    left = marked.join(kept, key.cast("bigint").eqNullSafe(F.col("k_id")) & (F.col("mark") == F.col("k_mark")), "left_semi")
    return left.dropDuplicates([f"c{docs.columns.index('doc_id')}", "mark"]).drop("mark").toDF(*docs.columns)

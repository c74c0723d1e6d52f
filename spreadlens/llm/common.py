"""Helpers shared by the operators: column picking, Arrow text buffers, batch bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; with whole texts of up to 100 kB a batch stays under about 50 MB.
BATCH_ROWS = 512
#: Bytes of text that a kernel looks at together (a longer text forms a piece of its own).
PIECE_BYTES = 1 << 20
#: A text over this part of a sample's bytes is taken only if others leave room.
BOUND_SHARE = 16


def bounded_batches(spark: SparkSession) -> None:
    """Limit the rows of an Arrow batch for this session, so that a batch of whole texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: names that clash (also by case) can't get in the way."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def take(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns ``wanted`` (name=Spark type) of ``df``, found by exact name, the first if repeated.

    All other columns are left out, whatever their names.
    """
    at = {n: df.columns.index(n) for n in wanted}
    return positional(df).select(*[F.col(f"c{at[n]}").cast(kind).alias(n) for n, kind in wanted.items()])


def documents(df: DataFrame) -> DataFrame:
    return take(df, doc_id="bigint", text="string")


def map_text_rows(df: DataFrame, kernel: Callable[[pa.RecordBatch, int], pa.RecordBatch], column: str = "text") -> DataFrame:
    """Run ``kernel(batch, index of the text column)`` over ``df``; it returns a batch of the same columns.

    Columns go through by position, so any extra columns and names survive.
    """
    at = df.columns.index(column)
    flat = positional(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield kernel(b, at)

    return flat.mapInArrow(run, flat.schema).toDF(*df.columns)


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(),
         "float": pa.float32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a flat Spark schema string (``name type, name type``)."""
    return pa.schema([(n, ARROW[t]) for n, t in (f.split() for f in schema.split(","))])


def batch(schema: str, *columns) -> pa.RecordBatch:
    """A record batch of ``schema`` from Arrow arrays or Python values."""
    s = arrow_schema(schema)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type)
                                       for c, f in zip(columns, s, strict=True)], schema=s)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the offsets of each; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if offs is None or not len(col):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts of at most ``limit`` bytes together; a longer text comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def to_strings(col: pa.Array) -> list[str]:
    """The texts of a column; null is empty, bytes that are no UTF-8 become U+FFFD."""
    try:
        return ["" if s is None else s for s in col.to_pylist()]
    except UnicodeDecodeError:
        return [(s or b"").decode("utf-8", "replace") for s in col.cast(pa.binary()).to_pylist()]


def text_sample(docs: DataFrame, rows: int, size: int) -> list[str]:
    """At most ``rows`` whole texts of together at most ``size`` bytes, in the order of a hash of the id (``bounded_ids``)."""
    chosen = bounded_ids(documents(docs).select("doc_id", (F.octet_length("text") + 64).alias("size")).filter("doc_id is not null and size is not null")
                         .groupBy("doc_id").agg(F.max("size").alias("size")), rows, size)
    return [t for _, t in texts_of(docs, chosen)]


def bounded_ids(sized: DataFrame, rows: int, size: int) -> list[int]:
    """At most ``rows`` ids of ``sized`` (doc_id, size) in the order of a hash, whose sizes sum to at most ``size``.

    A row that doesn't fit into what is left is passed over.  Rows over a ``BOUND_SHARE``-th of ``size`` come after all
    others, so that no long text takes the room of many; those over ``size`` can't be taken.
    """
    out, total = [], 0
    long = F.col("size") > size // BOUND_SHARE
    for r in sized.filter(F.col("size") <= size).orderBy(long, F.xxhash64("doc_id"), "doc_id").limit(rows).collect():  # at most ``rows`` rows
        if total + r["size"] <= size:
            total += r["size"]
            out.append(r["doc_id"])
    return out


def texts_of(docs: DataFrame, ids: list[int]) -> list[tuple[int, str]]:
    """(doc_id, text) of the few documents ``ids``, in the order of their ids; the largest text of a repeated id."""
    if not ids:
        return []
    few = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id bigint")
    got = documents(docs).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")).orderBy("doc_id")
    return [(r["doc_id"], r["text"] or "") for r in got.collect()]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder (``spark.checkpoint.dir``)."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

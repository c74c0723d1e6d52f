"""Weighted rendezvous sharding with gapless slots (operator 7, DataFrame functions only).

Shard s scores a record key by ``-ln(u) / weight``, u drawn from the md5 of key
and shard; the lowest score wins.  A new shard takes only the rows it wins, all
others stay.  Slots come in two steps, so that no task ever holds a shard:
rows are numbered within (shard, bucket) and the counts of the buckets before
are added; the count table has ``shards x BUCKETS`` rows.

Defined results: a null key is a key like any other (all such rows share a
shard); null text has no bytes and the checksum of the empty text; repeated
rows get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 16
#: Buckets of a shard; rows of a bucket are numbered in one task (at 10**10 rows and 16 shards: 600,000 each).
BUCKETS = 1024
BITS = 48


def draw(*parts: Column) -> Column:
    """48 bits from the md5 of the parts joined by ':'."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (place among ``weights``) of a key; the lower one on a tie."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = [F.struct((-F.log((draw(key, F.lit(s)) + F.lit(0.5)) / F.lit(float(1 << BITS))) / F.lit(float(w))).alias("score"),
                       F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_min(F.array(*scores))["shard"]


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, new_weight: float = 1.0, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, and the shard after one more shard of ``new_weight``.

    Only ids, sizes and checksums are shuffled, not the texts.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = (common.documents(docs)
              .select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
              .withColumn("shard", rendezvous(F.col("doc_id"), weights))
              .withColumn("grown_shard", rendezvous(F.col("doc_id"), [*weights, new_weight]))
              .withColumn("bucket", F.pmod(draw(F.col("doc_id"), F.col("size"), F.col("text_crc32")), F.lit(buckets))))
    numbered = placed.withColumn("place", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("before"))
    return (numbered.join(offsets, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("before") + F.col("place") - 1).cast("bigint").alias("slot"), "grown_shard", "bucket"))

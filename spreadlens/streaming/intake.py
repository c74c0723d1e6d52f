"""Structured Streaming jobs over incoming responses / events.

* ``dedup_stream`` (W1): incremental intake; a replayed id is dropped while
  it is within the watermark (``dropDuplicatesWithinWatermark``), so state
  stays bounded.
* ``rolling_rates`` (W2): tumbling or sliding event-time windows per
  dataset with a watermark; append mode emits a window once it closes.
* ``upsert_batches`` (W3): ``foreachBatch`` upsert of late judgements into
  a versioned state table (never overwriting the version being read) and
  re-scoring of the questions a batch touched.

Checkpoints go under the session's ``spark.checkpoint.dir`` (a shared
folder on a cluster), so a restarted query resumes exactly once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rollup import question_counts
from ..session import ensure_checkpoint_dir
from ..sources.tables import read_buckets, write_version

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def read_stream(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def dedup_stream(events: DataFrame, id_col: str = "event_id", ts_col: str = "ts",
                 delay: str = "1 hour") -> DataFrame:
    """Drop ids seen again within the watermark delay."""
    return events.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([id_col])


def rolling_rates(events: DataFrame, key: str, flag: F.Column, ts_col: str = "ts", size: str = "1 day",
                  slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Per window and key: rows, flagged rows and their rate."""
    w = F.window(ts_col, size, slide) if slide else F.window(ts_col, size)
    return (events.withWatermark(ts_col, delay)
            .groupBy(w.alias("window"), key)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(flag.cast("int")).alias("n_flagged"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key,
                    "n", "n_flagged", (F.col("n_flagged") / F.col("n")).alias("rate")))


def window_rates_batch(events: DataFrame, key: str, flag: F.Column, ts_col: str = "ts",
                       size: str = "1 day") -> DataFrame:
    """W2 on a static table (the same plan without watermark), for reports and checks."""
    return (events.groupBy(F.window(ts_col, size).alias("window"), key)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(flag.cast("int")).alias("n_flagged"))
            .select(F.col("window.start").alias("window_start"), key, "n", "n_flagged",
                    (F.col("n_flagged") / F.col("n")).alias("rate")))


STATE_BUCKETS = 64


def upsert_batches(state_root: str, key: str = "id", buckets: int = STATE_BUCKETS):
    """A ``foreachBatch`` function upserting judgements into ``state_root``.

    The state lies in hash buckets of the key.  Each micro-batch: the latest
    judgement per id wins (a tie goes to the greater row, a null time is the
    oldest); the buckets it touches are merged with their last committed version by
    a full outer join and written as a new version, others stay where they are.  The
    state keeps ``judged_at``, so an older judgement that arrives in a later batch changes
    nothing.  The touched
    questions are re-scored into ``state_root/scores/epoch=…``.  A retried epoch
    starts from the versions before it and replaces what it wrote, so nothing
    is counted twice; a state that can't be read is an error, never an empty one.
    """
    root = state_root.rstrip("/")

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        others = [c for c in batch.columns if c not in (key, "judged_at")]
        latest = batch.groupBy(key).agg(F.max(F.struct("judged_at", *others)).alias("w")).select(key, "w.*")
        latest = latest.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")).checkpoint()
        touched = [r["bucket"] for r in latest.select("bucket").distinct().collect()]  # at most ``buckets`` rows
        current = read_buckets(spark, f"{root}/data", upto=epoch, only=touched)
        if current is None:
            merged = latest
        else:
            # whichever was judged later wins, whenever it arrives; what it leaves null stays as it was
            late = F.col("n.judged_at") < F.col("o.judged_at")
            late = F.coalesce(late, F.col("n.judged_at").isNull() & F.col("o.judged_at").isNotNull())
            merged = (current.alias("o").join(latest.alias("n"), key, "full_outer")
                      .select(key, F.greatest("n.judged_at", "o.judged_at").alias("judged_at"),
                              *[F.when(late, F.coalesce(f"o.{c}", f"n.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}")).alias(c) for c in others])
                      .withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")))
        write_version(merged, f"{root}/data", epoch + 1, "bucket")
        fresh = read_buckets(spark, f"{root}/data", upto=epoch + 1)
        if fresh is not None:
            scored = question_counts(fresh.join(latest.select("prompt_id").distinct(), "prompt_id", "left_semi"))
            scored.write.mode("overwrite").parquet(f"{root}/scores/epoch={epoch}")

    return run


def read_state(spark: SparkSession, state_root: str) -> DataFrame | None:
    """The whole current state that ``upsert_batches`` keeps."""
    return read_buckets(spark, f"{state_root.rstrip('/')}/data")

"""Exact running sums, row numbers and average ranks without a global window.

A window ``partitionBy(keys).orderBy(v)`` puts every row of a key into one
task; with one dataset or feature holding a third of all rows that task
does not finish.  ``prefix_sums`` computes the same inclusive running sums
in two levels:

1. boundaries from a bounded sample of the *whole* ordering tuple cut the
   rows into ordered *slices* of about ``rows_per_slice`` rows, so the number
   of slices grows with the data, strings are compared as strings, and rows
   that tie in the leading column are split by the columns after it;
2. a window partitioned by ``(keys, slice)`` computes the local running sum,
   a ``groupBy(keys, slice)`` the slice totals;
3. a window over the small totals table gives each slice its offset, which is
   joined back.

Rows that are equal in the whole tuple share a slice, so the result is exact.
Finding the boundaries takes two small jobs while the plan is built; they are
then literals of the plan, the same for every branch and retried task.  A
derived input is first written to the checkpoint folder, so that it is computed
once and nothing stays cached.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SLICE = 100_000
#: Bounds of the plan's boundary literals and of the sample behind them.
MAX_SLICES = 4096
SAMPLE_PER_SLICE = 20


def slice_bounds(df: DataFrame, order: list[str], rows_per_slice: int) -> list[tuple]:
    """Ordering tuples that cut ``df`` into slices of about ``rows_per_slice`` rows (at most ``MAX_SLICES``)."""
    n = df.count()
    slices = min(MAX_SLICES, math.ceil(n / rows_per_slice))
    if slices <= 1:
        return []
    # at most about SAMPLE_PER_SLICE x MAX_SLICES tuples come to the driver
    share = min(1.0, SAMPLE_PER_SLICE * slices / n)
    sample = [tuple(r) for r in df.select(*order).sample(share, 7).orderBy(*order).collect()]
    picked = [sample[len(sample) * i // slices] for i in range(1, slices)] if sample else []
    return list(dict.fromkeys(picked))


def slice_number(df: DataFrame, order: list[str], bounds: list[tuple]) -> Column:
    """How many of the sorted ``bounds`` lie below the row's ordering tuple, by a tree of comparisons."""
    kinds = [df.schema[c].dataType for c in order]
    row = F.struct(*[F.col(c) for c in order])

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        bound = F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(bounds[mid], kinds, order, strict=True)])
        return F.when(row > bound, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def prefix_sums(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column], descending: bool = False,
                rows_per_slice: int = ROWS_PER_SLICE, scan: bool = False) -> DataFrame:
    """Add inclusive running sums ``{name: expr}`` ordered by ``order`` within ``keys``.

    With ``descending`` the running sum accumulates from the largest tuple
    down.  ``scan`` says that ``df`` is a plain scan, cheaper to read again
    than to write to the checkpoint folder.  Null keys form a group.
    """
    keys = list(keys)
    x = df.withColumns({"_v_" + name: expr for name, expr in sums.items()})
    if not scan:
        x = x.checkpoint()
    at = slice_number(x, order, slice_bounds(x, order, rows_per_slice))
    x = x.withColumn("_slice", (-at if descending else at).cast("int"))

    ordering = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    w_local = (Window.partitionBy(*keys, "_slice").orderBy(*ordering)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = x.withColumns({"_run_" + name: F.sum("_v_" + name).over(w_local) for name in sums})

    totals = x.groupBy(*keys, "_slice").agg(*[F.sum("_v_" + n).alias("_tot_" + n) for n in sums])
    w_off = (Window.partitionBy(*keys).orderBy("_slice")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col("_slice").alias("_k_slice"), *[
        F.coalesce(F.sum("_tot_" + n).over(w_off), F.lit(0)).alias("_off_" + n) for n in sums])
    same = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col("_k_" + k))
    out = local.join(offsets, same, "left")
    out = out.withColumns({name: F.col("_run_" + name) + F.coalesce(F.col("_off_" + name), F.lit(0)) for name in sums})
    return out.drop("_slice", "_k_slice", *["_k_" + k for k in keys], *[p + n for n in sums for p in ("_v_", "_run_", "_off_")])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str = "rn",
                rows_per_slice: int = ROWS_PER_SLICE, scan: bool = False) -> DataFrame:
    """Exact ``row_number()`` over ``partitionBy(keys).orderBy(order)`` (order must be unique)."""
    return prefix_sums(df, keys, order, {name: F.lit(1).cast("long")}, rows_per_slice=rows_per_slice, scan=scan)


def dense_ranks(df: DataFrame, keys: list[str], value: str, name: str = "drank",
                rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Exact ``dense_rank()`` of ``value`` within ``keys``: rank of the distinct values."""
    distinct = df.select(*keys, value).distinct()
    ranked = prefix_sums(distinct, keys, [value], {name: F.lit(1).cast("long")}, rows_per_slice=rows_per_slice)
    return df.join(ranked, keys + [value], "left")


def average_ranks(counts: DataFrame, keys: list[str], value: str, count_col: str,
                  rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """average rank (ties share the mean of their positions) per distinct value.

    ``counts`` has one row per ``(keys, value)`` with the multiplicity in
    ``count_col``; adds ``avg_rank = cum_before + (cnt + 1) / 2``.
    """
    out = prefix_sums(counts, keys, [value], {"_cum": F.col(count_col).cast("long")}, rows_per_slice=rows_per_slice)
    return (out.withColumn("avg_rank", (F.col("_cum") - F.col(count_col)).cast("double")
                           + (F.col(count_col) + 1) / 2.0)
            .drop("_cum"))

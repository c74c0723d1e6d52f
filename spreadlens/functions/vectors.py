"""Array-vector expressions (B14, B15, B17) built from higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col_


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col_(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def l2_normalize(a, eps: float = 1e-12) -> Column:
    """A / max(‖a‖, eps), as doubles."""
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(col_(a), lambda v: v.cast("double") / n)


def cosine(a, b, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def signed_log1p(a) -> Column:
    """sign(x)·log1p(|x|) per element."""
    return F.transform(col_(a), lambda v: F.signum(v) * F.log1p(F.abs(v)))


def flat_index_parts(pos, heads: int, ranks: int) -> dict[str, Column]:
    """Flat position → (layer, head, rank) with rank 1-based."""
    p = col_(pos)
    return {"layer": (p / (heads * ranks)).cast("int"),
            "head": ((p % (heads * ranks)) / ranks).cast("int"),
            "rank": (p % ranks + 1).cast("int")}

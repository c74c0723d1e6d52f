"""Scalar column expressions shared by all operators.

Everything here returns a ``Column`` built from built-in Spark functions, so
it stays inside whole-stage code generation.  The pseudo-random helpers use
``md5`` because the same digest exists in DuckDB, which makes seeded splits,
permutations and bootstraps reproducible across engines and across task
retries (unlike ``rand``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MD5_SPAN = 16 ** 7  # 7 hex digits → [0, 2^28)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_int(*parts) -> Column:
    """Integer in [0, 16^7) from the first 7 hex digits of md5(concat(parts, '|'))."""
    s = F.concat_ws("|", *[col_(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 7), 16, 10).cast("bigint")


def md5_uniform(*parts) -> Column:
    """Deterministic uniform draw in [0, 1)."""
    return md5_int(*parts) / F.lit(float(MD5_SPAN))


def stars(p) -> Column:
    """Significance stars."""
    p = col_(p)
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .otherwise("ns"))


def normal_sf(z) -> Column:
    """Upper normal tail Q(z) via the Abramowitz–Stegun 7.1.26 erfc polynomial."""
    z = col_(z)
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741
                + t * (-1.453152027 + t * 1.061405429))))
    erfc = poly * F.exp(-x * x)
    upper = 0.5 * erfc
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def ks_pvalue(d, n1, n0, terms: int = 100) -> Column:
    """Asymptotic two-sided KS p-value 2·Σ(-1)^(m-1)·exp(-2m²z²), clipped to [0,1]."""
    n1, n0, d = col_(n1).cast("double"), col_(n0).cast("double"), col_(d)
    z = d * F.sqrt(n1 * n0 / (n1 + n0))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, m: acc + F.when(m % 2 == 1, 1.0).otherwise(-1.0)
        * F.exp(-2.0 * m * m * z * z))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series))
    return F.when(z < 0.05, F.lit(1.0)).otherwise(p)


def safe_div(a, b, default=0.0) -> Column:
    a, b = col_(a), col_(b)
    return F.when(b == 0, F.lit(default)).otherwise(a / b)


def correlation(a, b) -> Column:
    """Pearson correlation as an aggregate; null where a column doesn't vary, in ANSI mode too (there ``corr`` divides by zero)."""
    a, b = col_(a).cast("double"), col_(b).cast("double")
    spread = F.var_pop(F.when(b.isNotNull(), a)) * F.var_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(spread))


def r6(c) -> Column:
    """Round to 6 decimals for report columns (stable value hashes across engines)."""
    return F.round(col_(c), 6)

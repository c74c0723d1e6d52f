"""Connected components of a link table, by alternating large-star and small-star joins.

Each round is two grouped minima with joins on the node, all on Spark; the
links never leave the executors, and a hub's links are split by AQE's skewed
joins.  A round's links are cut off with ``checkpoint()`` into the shared
folder; rounds grow with the logarithm of a component's diameter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b bigint) to (node, root): every node that isn't its component's smallest, and the smallest.

    Rows with a null or with a = b link nothing; repeated links count once.
    """
    e = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] == 0 or now == before:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
                 .union(low.select("hi", "m")))
        e = checkpointed(small.distinct())


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of the component of each of ``n`` nodes, for links held in arrays."""
    label = np.arange(n)
    while True:
        m = label.copy()
        np.minimum.at(m, a, label[b])
        np.minimum.at(m, b, m[a])
        m = m[m]
        if (m == label).all():
            return label
        label = m

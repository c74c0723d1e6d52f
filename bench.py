"""Benchmark the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8).  Each query is executed in full through the no-op sink (every
row is produced, nothing is collected to the driver), from an empty cache.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spreadlens.plans.catalog import QUERIES  # noqa: E402
from spreadlens.session import get_spark  # noqa: E402

HEADLINE = [
    "question_features",        # G12/G13 end to end: responses → text vectors → features
    "join_question_geometry",   # E1+E4+G1–G4
    "text_dispersion",          # moment kernel
    "dense_structure",          # clustering + spectrum kernel
    "ks_lineitem",              # H1 over 600k rows × 4 features
    "mann_whitney_heads",       # H6
    "auc_by_dataset",           # J1/J2
    "classification_metrics",   # J4
    "describe_lineitem",        # E16 exact quartiles
    "laplacian_topk",           # I1/I2
    "correlation_matrix",       # E17
    "paraphrase_classes",       # F2/F3
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(cpus * 2, 8),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    # warm the JVM and the Python workers once (not timed)
    QUERIES["non_correct_rate"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        spark.catalog.clearCache()
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()

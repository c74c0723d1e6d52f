"""Composite per-question plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import rollup as R


def question_features(resp: DataFrame, cloud: DataFrame, tau: float = 0.85,
                      bucket_rows: int = 4096) -> DataFrame:
    """G12 + G13: metadata, counts, label, dispersion, clusters and graph spectrum.

    Each part is one grouped plan keyed by ``prompt_id``; the parts are
    joined once on the key.  All-refused questions are dropped (E6).  The
    vectors are written once to the checkpoint folder, so each text is read
    and embedded a single time; so are the responses, without their texts.
    """
    cloud = cloud.checkpoint()
    resp = resp.drop("model_answer").checkpoint()
    meta = R.question_metadata(resp).select(
        "prompt_id", "question", F.col("domain_mode").alias("domain"), "domain_inconsistent",
        "adversarial", "dataset")
    counts = R.question_counts(resp)
    geo = G.cloud_dispersion(cloud, ["prompt_id"], bucket_rows=bucket_rows).drop("n")
    struct = G.cloud_structure(cloud, ["prompt_id"], tau=tau)
    out = meta.join(counts, "prompt_id").join(geo, "prompt_id", "left").join(struct, "prompt_id", "left")
    return out.withColumnRenamed("n_clusters", "K")


def block_features(cloud: DataFrame, block_col: str, tau: float = 0.85) -> DataFrame:
    """Baseline features for fixed blocks of responses (renormalised vectors)."""
    geo = G.cloud_dispersion(cloud, [block_col]).withColumnRenamed("sig2_S", "sigma2_S")
    struct = G.cloud_structure(cloud, [block_col], tau=tau).select(
        block_col, F.col("n_clusters"), "H_sem")
    return geo.join(struct, block_col, "left")

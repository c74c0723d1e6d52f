"""Clusters and spectra of questions cut into tiles, against the same question in one task."""

import numpy as np

from spreadlens.operators import geometry as G
from spreadlens.operators import tiled_graph as TG


def _frame(spark, clouds):
    rows = [(q, f"{q}_{i:04d}", v.tolist()) for q, vecs in clouds.items() for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "prompt_id string, id string, e array<double>")


def _clouds():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(5, 6))
    near = np.concatenate([c + 0.25 * rng.normal(size=(18, 6)) for c in centres])
    copies = np.concatenate([rng.normal(size=(50, 6)), np.repeat(near[:3], 12, axis=0), np.zeros((4, 6))])
    # equal distances: pairs of axes at one angle
    ties = np.concatenate([np.eye(24), np.roll(np.eye(24), 1, axis=1) + np.eye(24)])
    return {"near": near, "copies": copies[:-4], "zeros": copies, "ties": ties, "small": near[:5]}


def _dense(vecs):
    """Spectrum of the whole graph, a row a node."""
    norm = np.linalg.norm(vecs, axis=1, keepdims=True)
    E = np.divide(vecs, norm, out=np.zeros_like(vecs), where=norm > 0)
    W = np.maximum(E @ E.T, 0)
    np.fill_diagonal(W, 0)
    return np.linalg.eigh(np.diag(W.sum(1)) - W)


def test_tiles_give_the_features_of_one_task(spark):
    tau = 0.3
    cloud = _frame(spark, _clouds())
    one = {r.prompt_id: r for r in G.cloud_structure(cloud, ["prompt_id"], tau=tau, moments=True).collect()}
    cut = {r.prompt_id: r for r in G.cloud_structure(cloud, ["prompt_id"], tau=tau, moments=True, tile=12).collect()}
    assert one.keys() == cut.keys()
    for q in one:
        for c in G.CLUSTER_COLS:
            assert np.isclose(one[q][c], cut[q][c], rtol=1e-9, atol=1e-9), (q, c)
        for c in G.SPECTRAL_COLS + G.MOMENT_COLS:
            if c in ("ipr_fiedler", "HFER") and (q in ("ties", "zeros")):  # more than one vector of the eigenvalue
                continue
            tolerance = 1e-3 if c == "spectral_entropy" else 1e-8
            assert np.isclose(one[q][c], cut[q][c], rtol=tolerance, atol=1e-8), (q, c, one[q][c], cut[q][c])


def test_classes_give_the_spectrum_of_all_rows():
    for q, vecs in _clouds().items():
        value, mode = _dense(vecs)
        unit, m = np.unique(np.round(vecs, 12), axis=0, return_counts=True)
        norm = np.linalg.norm(unit, axis=1, keepdims=True)
        got = G.graph_features(np.divide(unit, norm, out=np.zeros_like(unit), where=norm > 0), m)
        p = value / value.sum()
        p = p[p > 0]
        want = {"lam2": value[1], "lam3": value[2], "lam_sum": value.sum(), "lam_sq_sum": (value ** 2).sum(),
                "spectral_entropy": -(p * np.log2(p)).sum()}
        if q not in ("ties", "zeros"):
            share = np.abs(mode[:, 1]) / np.abs(mode[:, 1]).sum()
            want |= {"ipr_fiedler": (mode[:, 1] ** 4).sum(), "HFER": -value[1] * (share * np.log2(share)).sum()}
        for c, x in want.items():
            assert np.isclose(got[c], x, rtol=1e-8, atol=1e-8), (q, c, got[c], x)


def test_few_rows_restores_the_setting(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with TG.few_rows(spark, 3):
        assert spark.conf.get(name) == "3"
    assert spark.conf.get(name) == before

"""Words of a batch of texts are held a piece at a time."""

import tracemalloc

import numpy as np
import pandas as pd

from spreadlens.sources import fixtures as FX


def test_many_texts_of_a_batch_do_not_add_up(monkeypatch):
    texts = pd.Series([None, "", "Ab ab c"] + [" ".join(f"w{i}x{j}" for j in range(4000)) for i in range(60)])
    embed = FX._hashed_bow(16).func
    monkeypatch.setattr(FX, "PIECE_CHARS", 1 << 40)
    whole = embed(texts)
    monkeypatch.setattr(FX, "PIECE_CHARS", 50_000)
    tracemalloc.start()
    cut = embed(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(cut) == len(texts) and all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
    assert not np.any(cut[0]) and np.isclose(np.linalg.norm(cut[2]), 1)
    assert peak < 8 << 20  # all words at once take over 15 MB
    assert len(embed(texts[:0])) == 0

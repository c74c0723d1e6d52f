import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spreadlens.llm import lm_scoring, toxicity

# ---------------------------------------------------------------- toxicity


def test_network_gradients():
    rng = np.random.default_rng(0)
    p = toxicity.init(rng)
    w = toxicity.words_of(["ab cde fgh ab x", "hello world foo bar " * 9, "z"])
    index, _ = toxicity.windows_of(w)
    y, weight = rng.integers(0, 2, len(index)).astype(float), rng.random(len(index)) + 0.5
    g = toxicity.step(p, w, index, y, weight, None)[1]
    for name in ("x", "u", "nb", "att", "out", "ob", "xb"):
        at = np.unravel_index(np.abs(g[name]).argmax(), p[name].shape)
        loss = []
        for e in (0.01, -0.01):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += e
            loss.append(toxicity.step(q, w, index, y, weight, None)[0])
        assert (loss[0] - loss[1]) / 0.02 == pytest.approx(float(np.asarray(g[name])[at]), rel=0.05, abs=1e-5)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 100):
        w = toxicity.words_of([" ".join(f"w{i}" for i in range(n)), "tail"])
        index, text = toxicity.windows_of(w)
        own = index[text == 0]
        assert set(own[own >= 0].tolist()) == set(w.at[:n].tolist())
        assert (index[text == 1] >= 0).sum() == 1
        assert len(own) == (0 if n == 0 else 1 + max(0, -(-(n - toxicity.WINDOW) // toxicity.STRIDE)))


def test_batches_score_alike(monkeypatch):
    p = toxicity.init(np.random.default_rng(1)) | {"scale": np.array([1.0, 0.0])}
    texts = ["one two three " * 40, "", "Quatre CINQ", "--- !!", "one " * 500]
    whole = toxicity.score_texts(p, texts)
    assert whole[1] == whole[3] == 0 and ((whole >= 0) & (whole <= 1)).all()
    assert np.allclose([toxicity.score_texts(p, [t])[0] for t in texts], whole, atol=1e-5)


def plain_score(p, text):
    """The score of one text, word by word and window by window, from the definition of the network."""
    w = toxicity.words_of([text])
    words = w.at.tolist()
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(k):
        parts = [p["word"][w.bucket[k]]]
        parts += [np.mean([p["gram"][g] for g in grams[first[k]:first[k + 1]]], 0) for grams, first in w.grams]
        return np.concatenate(parts)

    def read(vectors, side):
        h, out = np.zeros(toxicity.HIDDEN), []
        for v in vectors:
            x, u = v @ p["x"][side] + p["xb"][side][0], h @ p["u"][side]
            r, z, n = np.split(x, 3)
            ur, uz, un = np.split(u, 3)
            r, z = sig(r + ur), sig(z + uz)
            n = np.tanh(n + r * (un + p["nb"][side][0]))
            h = n + z * (h - n)
            out.append(h)
        return out

    if not words:
        return 0.0
    best = -np.inf
    for a in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        v = [vector(k) for k in words[a:a + toxicity.WINDOW]]
        states = [np.concatenate(s) for s in zip(read(v, 0), read(v[::-1], 1)[::-1], strict=True)]
        e = np.exp([s @ p["att"] for s in states])
        best = max(best, float(sum(k * s for k, s in zip(e / e.sum(), states, strict=True)) @ p["out"] + p["ob"][0]))
    return sig(p["scale"][0] * best + p["scale"][1])


def test_scores_equal_a_plain_recurrent_loop():
    p = {k: v.astype(float) for k, v in toxicity.init(np.random.default_rng(5)).items()} | {"scale": np.array([1.3, -0.2])}
    rng = np.random.default_rng(6)
    p["nb"], p["xb"] = rng.standard_normal(p["nb"].shape) * 0.3, rng.standard_normal(p["xb"].shape) * 0.3
    texts = ["Ab cde fgh", "", "x", " ".join(f"w{i * i % 37}" for i in range(32)), " ".join(f"é{i * i % 41}" for i in range(90)), "--"]
    got = toxicity.score_texts({k: v.astype(np.float32) if k != "scale" else v for k, v in p.items()}, texts)
    assert np.allclose(got, [plain_score(p, t) for t in texts], atol=1e-4)


def test_held_out_accuracy_and_odd_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.select("doc_id", "text").filter("doc_id < 4000")
    odd = spark.createDataFrame([(None, None), (-1, None), (-2, ""), (-3, "!!"), (-4, "you idiot scum, worthless loser"), (-4, "you idiot scum, worthless loser")], rows.schema)
    got = toxicity.score(rows.union(odd), labels).collect()
    mark = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (None, -1, -2, -3))
    test = [(r["score"], mark[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in mark]
    toxic, clean = (np.array([s for s, t in test if t == k]) for k in (1, 0))
    auc = (toxic[:, None] > clean).mean() + 0.5 * (toxic[:, None] == clean).mean()
    assert auc > 0.9 and (clean >= 0.3).mean() < 0.05 and (toxic >= 0.3).mean() > 0.6


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(8)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    clean = spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    for labels in (none, clean):
        assert {r["predicted"] for r in toxicity.score(docs, labels).collect()} == {0}
    assert toxicity.score(docs.limit(0), clean).count() == 0
    assert toxicity.remove_toxic(docs, clean).columns == docs.columns


def test_a_text_over_the_bound_is_passed_over(spark):
    from spreadlens.llm import common

    some = spark.range(400).filter(~toxicity.held_out("id")).withColumn("toxic", (F.col("id") % 2).cast("int")).orderBy(F.xxhash64("id"))
    rows = [(r["id"], r["toxic"]) for r in some.collect()]
    first = {next(i for i, t in rows if t == k) for k in (0, 1)}  # the first of each class in the order of the hash
    for n in (20_000, 9_000):  # over the bound of a class, and nearly all of it
        docs = spark.createDataFrame([(i, "word " * (n // 5) if i in first else f"word{i}") for i, _ in rows], "doc_id bigint, text string")
        labels = spark.createDataFrame(rows, "doc_id bigint, toxic int")
        texts, marks, share = toxicity.training_sample(docs, labels, size=20_000)
        assert 0 < share < 1 and (marks == 0).sum() > 50 and (marks == 1).sum() > 50 and max(map(len, texts)) < 1_000
        assert sum(len(t) + 64 for t in texts) <= 20_000
        assert len(common.text_sample(docs, 300, 10_000)) > 50
    assert toxicity.train(["a"], np.array([1]), toxic_share=0.1)["scale"][1] < 0


# ---------------------------------------------------------------- language model


def small():
    counts = np.arange(10, 0, -1).astype(float)
    v = lm_scoring.Vocabulary(np.arange(10, dtype=np.uint64), counts, 100)
    return v, {k: x.astype(np.float64) for k, x in lm_scoring.init(v).items()}


def words(*texts):
    (_, _, w), = lm_scoring.words_of(pa.array(texts, pa.string()))
    return w


def plain(p, symbols, at):
    """Log probability of one symbol of a text, by the definition."""
    x = np.array(p["b"], float)
    for k, o in enumerate(lm_scoring.OFFSETS):
        if 0 <= at + o < len(symbols):
            x += p["emb"][symbols[at + o]] * p["pos"][k]
    h = x / (1 + abs(x))
    c, w = divmod(int(symbols[at]), lm_scoring.WITHIN)
    out = 0
    for scores, own in ((h @ p["cls"] + p["cb"], c), (h @ p["sym"][c] + p["sb"][c], w)):
        out += scores[own] - np.log(np.exp(scores).sum())
    return out


def test_language_model_gradients_and_sum():
    v, p = small()
    rng = np.random.default_rng(0)
    stream = rng.integers(0, lm_scoring.SYMBOLS, 40)
    stream[[9, 10, 20, 21]] = lm_scoring.SYMBOLS
    inner = np.arange(2, 38)
    inner = inner[stream[inner] < lm_scoring.SYMBOLS]

    def loss(q):
        h = lm_scoring.hidden(q, q["emb"][stream])
        return -lm_scoring.log_probability(q, h[inner - 2], stream[inner]).mean()

    n, g = lm_scoring.gradients(p, stream)
    assert n == len(inner)
    rows, values = g["emb"]
    g["emb"] = np.zeros_like(p["emb"])
    g["emb"][rows] = values
    for name in g:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        got = []
        for e in (1e-4, -1e-4):
            q = {k: x.copy() for k, x in p.items()}
            q[name][at] += e
            got.append(loss(q))
        assert (got[0] - got[1]) / 2e-4 == pytest.approx(g[name][at], rel=1e-3)
    h = lm_scoring.hidden(p, p["emb"][stream])[:1]
    every = lm_scoring.log_probability(p, np.repeat(h, lm_scoring.SYMBOLS, 0), np.arange(lm_scoring.SYMBOLS))
    assert np.exp(every).sum() == pytest.approx(1)
    assert np.allclose(lm_scoring.log_probability(p, h, stream[2:3], False), lm_scoring.log_probability(p, h, stream[2:3], True))
    p["cls"] *= 1e4
    assert lm_scoring.needs_shift(p) and np.isfinite(lm_scoring.log_probability(p, h, stream[2:3])).all()


def test_spellings_share_out_each_group():
    w = words("abc abd b1 \u00e9t\u00e9 \u8a9e", "zz")
    cells, begin = lm_scoring.steps(w, np.arange(len(w)))
    assert len(begin) == len(w) and len(cells) == sum(len(x.encode()) + 1 for x in ("abc", "abd", "b1", "\u00e9t\u00e9", "\u8a9e", "zz"))
    counts = np.bincount(np.append(cells, cells[:4]), minlength=lm_scoring.CELLS)
    spell = lm_scoring.spelling(counts).reshape(-1, 257)
    assert np.allclose(np.exp(spell[lm_scoring.STOP + 1:]).sum(1), 1)  # first bytes of a group
    assert np.allclose(np.exp(spell[:256]).sum(1), 1)  # what follows a byte, the end included
    own = np.add.reduceat(spell.ravel()[cells], begin)
    assert len(set(own.round(9).tolist())) == len(w)


def test_streams_keep_texts_apart():
    end = lm_scoring.SYMBOLS
    assert lm_scoring.stream_of(np.array([5, 6, 7]), np.array([0, 0, 1])).tolist() == [5, 6, end, end, 7]
    assert lm_scoring.stream_of(np.array([], int), np.array([], int)).tolist() == []


def test_scores_equal_a_word_by_word_sum_and_training_helps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(1).alias("DOC_ID"), F.lit("x").alias("n"))
    odd = docs.union(spark.createDataFrame([(None, None, 1, "x"), (-1, "", 1, "x"), (-2, "one", 1, "x"), (-2, "one", 1, "x"), (-3, "long\u00e9 text " * 100_000, 1, "x")], docs.schema))
    v, spell, p = lm_scoring.fit(odd, rounds=2).value
    texts = [r[1] for r in docs.limit(20).collect()] + ["qqxzzy qqxzzq", "qqxzzq qqxzzy"]
    n, total = lm_scoring.score_batch(pa.array(texts, pa.string()), v, spell, p)
    q = {k: x.astype(float) for k, x in p.items()}
    for text, k, s in zip(texts, n.tolist(), total.tolist(), strict=True):
        w = words(text)
        sym = v.symbols(w)
        one = sum(plain(q, sym, i) for i in range(len(sym)))
        for i in np.flatnonzero(sym >= lm_scoring.KNOWN):
            word = w.low[w.starts[i]:w.stops[i]].tolist()
            lead = [lm_scoring.STOP + 1 + word[0] % lm_scoring.WITHIN, *word]
            one += sum(spell[a * 257 + b] for a, b in zip(lead, [*word, lm_scoring.STOP], strict=True))
        assert k == len(sym) and s == pytest.approx(one, rel=1e-4)
    base = lm_scoring.score(odd, rounds=0).toPandas()
    learnt = lm_scoring.score(odd).toPandas()
    assert learnt.log_likelihood.sum() / learnt.n_tokens.sum() > base.log_likelihood.sum() / base.n_tokens.sum() + 0.1
    empty = learnt[learnt.n_tokens == 0]
    assert len(empty) == 2 and (empty.log_likelihood == 0).all() and empty.mean_log_likelihood.isna().all()
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_every_word_is_a_target_once_at_the_registered_settings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")

    class Held:
        value = lm_scoring.vocabulary(docs)

    texts = pa.array([r["text"] for r in docs.limit(30).collect()], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["doc_id", "text"])
    got = [x for b in lm_scoring._streams(iter([batch]), Held, lm_scoring.ROUNDS) for x in b.to_pylist()]
    streams = [np.frombuffer(x["symbols"], "<u2").astype(int) for x in got if x["phase"] >= 0]
    assert all(0 <= x["phase"] < lm_scoring.ROUNDS for x in got[:-1]) and got[-1]["phase"] == -1
    targets = np.concatenate(streams)
    symbols = np.concatenate([Held.value.symbols(w) for _, _, w in lm_scoring.words_of(texts)])
    assert sorted(targets[targets < lm_scoring.SYMBOLS].tolist()) == sorted(symbols.tolist())
    p = lm_scoring.init(Held.value)
    assert sum(lm_scoring.train(p, s, 0.1, 0) for s in streams) == len(symbols)


def test_counts_cover_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    v = lm_scoring.vocabulary(docs)
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    total = sum(len(re.findall(rb"[0-9a-z\x80-\xff]+", r["text"].encode().translate(lower))) for r in docs.collect())
    assert v.counts.sum() == pytest.approx(total)

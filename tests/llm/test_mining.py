"""Phrase collocations, URL filters and whitening against plain versions."""
import collections
import random
import re

import numpy as np
import pytest

from spreadlens.llm import collocations, url_filter, whitening

# ---------------------------------------------------------------- collocations


def plain_collocations(rows, least, top, longest=4):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = {p[i:i + m] for p, b in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * b >= 80 * c[p[i:i + m]]}
        rows = []
        for p, a in found.items():
            if p not in covered:
                score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def prose(seed, docs):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "x\x01", "x", "\x00", "naïve", "語", "a" * 300, *(f"w{i}" for i in range(40))]
    fixed = [rng.choices(words, k=4) for _ in range(30)]
    out = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randint(0, 40)):
            parts += ["the"] if rng.random() < 0.33 else rng.choice(fixed) if rng.random() < 0.5 else rng.choices(words, k=2)
            parts.append(rng.choice(["", "", "", ".", "\n", " , ", "\t", "!?"]))
        out.append((rng.choice(["en", "en", "en", "de", None, ""]), " ".join(parts)))
    return out


def test_collocations_equal_plain_counts(spark):
    rows = prose(1, 400) + [("fr", None), (None, ""), ("fr", "one two one two " * 3000), ("fr", "only,"), ("de", " \t")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, LANG int, words string").repartition(7)
    for least, top in ((3, 50), (2, 10**6)):
        got = collocations.collocations(df, least=least, top=top).collect()
        assert sorted(map(tuple, got)) == plain_collocations(rows, least, top)
    assert len(got) > 1500  # more than a batch, so that runs cross batches and ranges
    assert collocations.collocations(df.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(df.limit(0)).count() == 0


def test_covering_and_cut_rules(spark):
    rows = [("en", "a b c.")] * 80 + [("en", "a b.")] * 20 + [("en", "x a b d.")] * 5
    df = spark.createDataFrame(rows, "lang string, text string")
    got = {r["phrase"]: r for r in collocations.collocations(df, least=5).collect()}
    assert "a b" in got and "b c" not in got and "a b c" in got  # 80 of 105 cover no "a b"; 80 of 80 cover "b c"
    assert (got["a b c"]["l"], got["a b c"]["r"], got["a b c"]["score"]) == (105, 80, 2_000_000 * 80 // 185)


def test_maps_only_leave_out_rare_phrases(spark):
    """Maps that let every pair pass give the same phrases as those of the corpus."""
    rows = [(a or "und", b) for a, b in prose(2, 80)]
    df = spark.createDataFrame(rows, "lang string, text string")
    full = [spark.sparkContext.broadcast(np.full(1 << (collocations.MAP_BITS - 3), 255, np.uint8))] * 4
    maps = []
    for _ in range(4):
        maps.append(collocations.frequent_map(df, 4, maps))
    got = [{tuple(r["words"]): r["n"] for r in collocations.phrase_counts(collocations.counted_windows(df, m).filter("words is not null"), 4).collect()} for m in (full, maps)]
    assert got[0] == got[1] and len(got[0]) > 100
    assert collocations.counted_windows(df, maps).count() < collocations.counted_windows(df, full).count()


# ---------------------------------------------------------------- URLs

URLS = ["http://a.net/", "http://a.net", "http://net/x", "https://EXAMPLE.net/en/1?q#f", "http://example.net/en", "http://m.example.net/en/#x", "http://notexample.net/en/1",
        "http://www.example.com/de/1", "http://example.com/fr/", "http://xexample.com/de/", "http://a.org/fr/login", "http://a.org/en/login", "http://a.org/x?sessionid=1",
        "http://a.org/foo.net/", "http://a.org:80/fr/x", "http://u@a.net:8/x", "net/", "", None, "://net/x", "http:///net/", "http://a.org\x00.net/", "http://.net/", "http://é.NET/é?é",
        "http://a.org/http://b.net/", "http://a.net?x/", "http://a.net#x/", "http://ads.x.ads.y.org/", "http://a.org/" + "y" * 70000 + ".exe", "x://a.org/\nlogin/login", "http://a.org/tag"]


def plain_verdict(url, rules, globs):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    query = m[1] if (m := re.match("[^?#]*[?]([^#]*)", rest)) else ""
    fits = [r for r in rules if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.name), len(r.host)))
        return host, path, best.name, best.verdict
    whole = "\x00".join(p.replace("\x00", "\xff") for p in ("." + host, path, query))
    blocked = any(re.fullmatch(re.escape(g).replace(r"\*", "[^\x00]*").replace(r"\?", "[^\x00]"), whole) for g in globs)
    return host, path, None, "block" if blocked else "allow"


def test_urls_equal_plain_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://a.net/"), (0, "http://a.net/")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, HOST string")
    many = tuple(url_filter.Rule("block" if i % 2 else "allow", f"h{i}.net", f"/p{i}/") for i in range(60))
    for rules in (url_filter.RULES, url_filter.RULES + many, ()):
        got = sorted((tuple(r) for r in url_filter.judge(df, rules).collect()), key=str)
        assert got == sorted(((i, *plain_verdict(u, rules, url_filter.GLOBS)) for i, u in rows), key=str)
    left = url_filter.allowed(df)
    assert left.columns == df.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in df.collect() if plain_verdict(r["url"], url_filter.RULES, url_filter.GLOBS)[3] == "allow")
    assert url_filter.judge(df.limit(0)).count() == 0 and url_filter.allowed(df.limit(0)).count() == 0


def test_automaton_equals_regular_expressions():
    rng = random.Random(4)
    globs = ["".join(rng.choices("ab*?\x00", weights=(4, 4, 3, 1, 1), k=rng.randint(0, 40))) for _ in range(80)]
    texts = ["".join(rng.choices("ab\x00", weights=(5, 5, 1), k=rng.randint(0, 30))) for _ in range(400)]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = url_filter.Automaton([g.encode() for g in globs]).run(buf, offsets)
    for j, g in enumerate(globs):
        rule = re.compile(re.escape(g).replace(r"\*", "[^\x00]*").replace(r"\?", "[^\x00]"))
        assert [bool(rule.fullmatch(t)) for t in texts] == found[:, j].tolist(), g


# ---------------------------------------------------------------- whitening


def plain_whitening(vectors, components=32):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    d = x - sums / n
    e, v = np.linalg.eigh(d.T @ d / n)
    order = np.argsort(-e)[:components]
    return x, [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x], d @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_whitening_equals_plain_eigenvectors(spark):
    rng = np.random.default_rng(0)
    vectors = (rng.standard_normal((700, 40)) * np.linspace(0.2, 3, 40) @ rng.standard_normal((40, 40))).astype(np.float32)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(vectors)]
    odd = [(-1, None, "n"), (-2, [float("nan")] * 40, "n"), (-3, [float("inf")] * 40, "n"), (-4, [None] + [0.0] * 39, "n"), (-5, [1.0], "n"), (-6, [], "n")]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, VEC_ID string").repartition(9)
    got = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    _, deviation, white, explained = plain_whitening(vectors)
    assert len(got) == 700 * 32 and got.vec_id.min() == 0 and (got.n == 700).all()
    assert got.component.tolist() == list(range(1, 33)) * 700
    assert got.deviation.to_numpy().reshape(700, 32)[:, 0].tolist() == deviation
    w = got.whitened.to_numpy().reshape(700, 32)
    assert np.abs(w * np.sign((w * white).sum(0)) - white).max() < 1e-8
    assert np.abs(got.explained.to_numpy()[:32] / explained - 1).max() < 1e-10
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_whitening_of_little(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [float("nan")])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (None, [0.5, 2.0])], schema)).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(0, None, 0.0, None)] * 4
    # one direction only, repeated rows, an entry so large that its deviation leaves 64 bits
    line = whitening.whiten(spark.createDataFrame([(i, [float(i % 3), float(i % 3), 1.0]) for i in range(30)], schema)).toPandas()
    assert line[line.component == 1].explained.iloc[0] == pytest.approx(1) and line[line.component > 1].whitened.isna().all()
    far = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [1e300])], schema)).collect()}
    assert far[2] is None and far[0] is None
    near = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [1e7])], schema)).collect()}
    assert near[2] == (2 * 640_000_000) ** 2 and near[0] == 640_000_000**2


@pytest.mark.parametrize("values", [np.linspace(1, 2, 60), np.repeat([3.0, 2.0, 1.0], 20), 1 + np.arange(60) * 1e-9,
                                    np.concatenate([np.full(30, 5.0), 5 + np.arange(1, 21) * 1e-6, [1e-3] * 5, [0.0] * 5]), np.geomspace(1, 1e-9, 60)])
def test_refinement_reaches_double_precision(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((60, 60)))
    a = q * values @ q.T
    a = (a + a.T) / 2
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    e, x = whitening.refine(a)
    size = np.abs(values).max()
    assert np.abs(x.T @ x - np.eye(60)).max() < 1e-13
    assert np.abs(a @ x - x * e).max() < 1e-13 * size * 60
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-13 * size * 60
    assert np.abs(a @ start - start * np.einsum("ij,ij->j", start, a @ start)).max() > 1e-9 * size  # single precision alone doesn't


def test_moments_merge_like_one():
    x = np.random.default_rng(2).integers(10**6 - 64, 10**6 + 64, (1000, 8))
    whole = whitening.Moments.of(x)
    some = whitening.Moments.of(x[:1]).merge(whitening.Moments.of(x[1:333])).merge(whitening.Moments.of(x[333:]))
    assert some.n == whole.n and (some.sums == whole.sums).all() and np.allclose(some.products, whole.products, rtol=1e-12)
    assert np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-12)

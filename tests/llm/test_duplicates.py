import re

import numpy as np
import pytest
import xxhash

from spreadlens.llm import components, embed_dedup, simhash


def component_ids(ids, links):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words)] if 0 < len(words) <= k else [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles if s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, radius):
    fps = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    ids = component_ids([r[0] for r in rows], links)
    return sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, ids, strict=True)), key=str)


@pytest.mark.parametrize(("radius", "block"), [(2, 2048), (11, 5)])
def test_simhash_equals_brute_force(spark, radius, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((tuple(r) for r in simhash.groups(docs, radius=radius, block=block).collect()), key=str)
    assert got == plain_groups(rows, radius)


ODD = [(1, "a b c d", 5), (1, "a b c d", 5), (None, "a b c d", 1), (None, None, 1), (3, "", 1), (None, "q w e r t y", 1),
       (None, "q w e r t y", 2), (4, "A  b\tc\nd", 2), (5, "É x É", 2), (6, "word " * 30_000, 1), (7, "x", 1), (8, "x y", 1)]


def test_simhash_odd_rows(spark):
    df = spark.createDataFrame([(*r, "f", "F") for r in ODD], "doc_id bigint, text string, fp int, fingerprint string, component_id string")
    got = sorted((tuple(r) for r in simhash.groups(df).collect()), key=str)
    assert got == plain_groups([r[:2] for r in ODD], 2)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    # one row a component: that of the six words without an id is one of two
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 5, 6, 7, 8]
    assert simhash.groups(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_one_row_of_each_component_whatever_its_id(spark):
    a, b, c = "this is the first text here", "quite another one it is now", "and a third of its own words"
    rows = [(3, a), (5, a), (5, b), (None, b), (None, c), (None, c), (None, a), (7, a + " "), (7, a + " ")]
    seen = set()
    for n in (1, 3, 7):
        df = spark.createDataFrame([(*r, "m") for r in rows], "doc_id bigint, text string, mark string").repartition(n)
        kept = sorted(map(tuple, simhash.keep_one(df).collect()), key=str)
        assert kept == sorted([(3, a, "m"), (5, b, "m"), (None, c, "m")], key=str)
        seen.add(str(kept))
    assert len(seen) == 1


def test_tile_pairs_reach_every_neighbour():
    rng = np.random.default_rng(0)
    steps = set(simhash.tile_steps(2))

    def tile(x):
        return sum(((x >> (16 * (3 - i)) & 0xFFFF).bit_count() + 2) * simhash.DIGIT ** (3 - i) for i in range(4))

    for _ in range(2000):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.integers(0, 64, 2).tolist():
            b ^= 1 << bit
        assert tile(b) - tile(a) in steps or tile(a) - tile(b) in steps


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 40)] + [(200, 201), (201, 202), (202, 200), (7, 7), (None, 3)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 1 for i in range(2, 40)}, 201: 200, 202: 200}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_local_components():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    assert components.local_components(300, a, b).tolist() == component_ids(list(range(300)), list(zip(a.tolist(), b.tolist(), strict=True)))


def plain_embeddings(rows, threshold):
    def vector(v):
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        return np.array(v, float) if ok else None

    vs = [vector(r[1]) if r[2] is not None else None for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if vs[i] is not None and vs[j] is not None and rows[i][2] == rows[j][2]
             and len(vs[i]) == len(vs[j]) and vs[i] @ vs[j] / (np.linalg.norm(vs[i]) * np.linalg.norm(vs[j])) >= threshold]
    ids = component_ids([r[0] for r in rows], links)
    n = [sum(i in x for x in links) for i in range(len(rows))]
    return sorted(((r[0], k, c, r[0] == c) for r, k, c in zip(rows, n, ids, strict=True)), key=str)


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 20))
    rows = [(i, (centres[i % 12] + rng.standard_normal(20) * rng.choice([0.05, 0.2, 0.5])).astype(np.float32).tolist(), i % 3 if i % 17 else None)
            for i in range(240)]
    rows += [(500 + i, rows[1][1], rows[1][2]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    for threshold, tile in ((0.93, 1024), (0.8, 7)):
        got = sorted((tuple(r) for r in embed_dedup.near_duplicates(df, threshold, tile).collect()), key=str)
        assert got == plain_embeddings(rows, threshold)


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [1.0, 0.0], None),
            (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [inf, 1.0], 1), (None, [0.0, 1.0], 2)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id bigint, embedding array<float>, label int, n int, key string")
    got = sorted((tuple(r) for r in embed_dedup.near_duplicates(df).collect()), key=str)
    assert got == plain_embeddings(rows, 0.93)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_bound_never_drops_a_pair():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 48))
    x[:150] = x[150:] + rng.standard_normal((150, 48)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for threshold in (0.2, 0.7, 0.95):
        i, j = embed_dedup.near_pairs(x, x, threshold, True)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True) if a < b}

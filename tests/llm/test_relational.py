import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from spreadlens.llm import chat, sharding

# ---------------------------------------------------------------- sharding


def plain_shard(key, weights):
    def score(s):
        h = int(hashlib.md5(f"{'null' if key is None else key}:{s}".encode()).hexdigest()[:12], 16)
        return -math.log((h + 0.5) / 2**48) / weights[s]

    return min(range(len(weights)), key=lambda s: (score(s), s))


ROWS = [(i, f"text é {i % 7}" * (i % 5)) for i in range(300)] + [(None, None), (None, "x"), (5, "same"), (5, "same")] + [(9, f"copy {i}") for i in range(200)]


@pytest.mark.parametrize(("weights", "buckets"), [((1.0,) * 16, 1024), ((1.0, 3.0, 0.5), 4)])
def test_sharding_equals_plain_rendezvous(spark, weights, buckets):
    df = spark.createDataFrame([(*r, "s", 1) for r in ROWS], "doc_id bigint, text string, shard string, slot int")
    got = sharding.shard(df, weights, 2.0, buckets).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    for r in got:
        assert r["shard"] == plain_shard(r["doc_id"], weights)
        assert r["grown_shard"] == plain_shard(r["doc_id"], [*weights, 2.0]) and r["grown_shard"] in (r["shard"], len(weights))
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(df.limit(0)).count() == 0


def test_weights_set_the_shares(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    n = collections.Counter(r["shard"] for r in sharding.shard(df, (1.0, 2.0, 3.0)).collect())
    assert [round(n[s] / 6000, 1) for s in range(3)] == [0.2, 0.3, 0.5]
    with pytest.raises(ValueError):
        sharding.shard(df, (1.0, 0.0))


# ---------------------------------------------------------------- chat

NASTY = ["<|turn|>", "<\\|", "\\", "\\\\<|", "<", "|>", "a<|next|>b\\", "<\\\\|", "<|end|>", "", "\n<|says|>x", "é😀<", "</s>[INST] ok [/INST]"]
ROLES = ["assistant", "assistant", "user", None, "as<|says|>\\"]


def plain_digest(conv, turns):
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    both = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return conv, len(turns), hashlib.sha256(both.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_formatting_reads_back(spark):
    rows = [(1, i, ROLES[i % 5], x) for i, x in enumerate(NASTY)] + [(None, None, None, None), (2, 3, "assistant", None), (2, 3, "assistant", None)]
    rows += [(3, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(400)] + [(4, i, "assistant", "a") for i in range(300)]
    df = spark.createDataFrame([(*r, "f") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    formatted = chat.conversations(df)
    got = sorted((tuple(r)[:5] for r in chat.digests(formatted).collect()), key=str)
    by = collections.defaultdict(list)
    for c, _, r, t in rows:
        by[c].append((r, t))
    assert got == sorted((plain_digest(c, t) for c, t in by.items()), key=str)
    for r in formatted.collect():
        turns = by[r["conv_id"]]
        runs = 1 + sum((a or "") != (b or "") for (a, _), (b, _) in zip(turns, turns[1:], strict=False))
        assert r["formatted"].count(chat.TURN) == r["formatted"].count(chat.END) == runs
        assert len(r["loss_mask"]) == sum(x == "assistant" for x, _ in turns)
    assert chat.conversations(df.limit(0)).count() == 0

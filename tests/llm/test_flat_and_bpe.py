import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spreadlens.llm import bpe, flat
from spreadlens.llm.decontaminate import WORD

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB, VOCABULARY = Tokenizer.from_file(PATH), bpe.Vocabulary(PATH)
TEXTS = ["", " ", "a", "aaaaaaaa aaaaa", "I'll don't 'S we've", "  \n\n \t x", "a<|endoftext|> b<|endoftext|><|endoftext|>",
         "\x1c\x1d\x85\xa0 x　z", "1234567890 ½ Ⅷ ٣", "日本語 한국어 😀👩‍👩‍👧", "é" * 300, "abc" * 3000]


@pytest.fixture(scope="module")
def tools():
    return Tokenizer.from_file(PATH), bpe.Encoder(bpe.Vocabulary(PATH))


def test_bpe_equals_the_library(tools):
    lib, own = tools
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("etaoin shrdlu'\n0é") for _ in range(rng.randrange(4000))) for _ in range(20)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_bpe_on_any_text(texts):
    lib, own = LIB, bpe.Encoder(VOCABULARY)
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids and own.decode(ids) == t





def test_partial_characters_decode_like_the_library(tools):
    lib, own = tools
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert own.decode(np.array(ids)) == lib.decode(ids, skip_special_tokens=False)


def test_cache_starts_anew(tools, monkeypatch):
    lib, _ = tools
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    own = bpe.Encoder(bpe.Vocabulary(PATH))
    for t in ("one two three four five six", "seven eight one", "two nine"):
        assert own.encode([t])[0].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_digests_on_spark(spark, tools):
    lib, _ = tools
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, None), (3, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, ids string, n_tokens int")
    got = sorted((tuple(r) for r in bpe.digests(df, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_token_ids_come_back_in_small_batches(spark, tools, monkeypatch):
    import pyarrow as pa

    import corpus_pipeline

    lib, own = tools
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in dict(corpus_pipeline.STAGES)["bpe_tokens"](spark, df, "").collect():
        want = lib.encode(dict(rows)[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3, 4]), pa.array(["ab " * 20, None, "c " * 200, ""])], ["doc_id", "text"])
    monkeypatch.setattr(bpe.common.pieces, "__defaults__", (64,))
    got = list(bpe._encoded(iter([batch]), own))
    assert [d.to_pylist() for d, _ in got] == [[1, None], [3], [4]]
    assert [own.decode(x) for _, p in got for x in p] == ["ab " * 20, "", "c " * 200, ""]


def test_spans_end_with_texts():
    texts = [b"ab c", b"", b"d  ef", b"gh"]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s, e, d = flat.spans(buf, offs, WORD)
    assert [(buf[a:b].tobytes(), k) for a, b, k in zip(s, e, d.tolist(), strict=True)] == [(b"ab", 0), (b"c", 0), (b"d", 2), (b"ef", 2), (b"gh", 3)]


def test_equal_words_hash_alike_anywhere(monkeypatch):
    words = [b"alpha", b"beta", b"alpha", b"gamma" * 50, b"alpha"] * 20
    buf = np.frombuffer(b" ".join(words), np.uint8)
    s, e, _ = flat.spans(buf, np.array([0, len(buf)]), WORD)
    whole = flat.span_hashes(buf, s, e)
    monkeypatch.setattr(flat, "STEP", 16)
    assert (flat.span_hashes(buf, s, e) == whole).all()
    assert len(set(whole.tolist())) == 3

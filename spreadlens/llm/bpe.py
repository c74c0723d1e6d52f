"""Byte-level BPE encoding and decoding in batched numpy merge rounds (operator 5).

A text is split into words by the fixed pattern; the distinct words of a batch
lie as symbols in one flat array.  Each round looks the adjacent pairs that
changed up by binary search over the sorted pair keys, finds every word's
lowest rank, merges all its occurrences (leftmost first where they overlap),
and sets words aside that have no pair left.  Merging all occurrences at once
equals merging one by one, since a pair that holds a new symbol ranks behind it.

The vocabulary file is a parameter; the driver reads it and broadcasts its
tables, whose size is that of the vocabulary.

Defined results: null text counts as empty and has no tokens; the strings of
added tokens inside a text become those tokens; bytes that are no UTF-8 are
read as U+FFFD; any id, repeated or null, goes through as it is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Fixed value: the pattern that splits text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The classes of that pattern for characters below U+0250, and the pattern with them; the plain ``re`` module is faster.
LETTERS, DIGITS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
BEYOND_LATIN = "[^\x00-ɏ]"
#: Distinct words that a task remembers; beyond that it starts anew.
CACHE_WORDS = 200_000
#: Symbols merged together.
CHUNK_SYMBOLS = 1 << 18
NO_RANK = np.int32(2**31 - 1)

#: Bytes of a Parquet row group, which its writer holds in memory, in tables with token ids.
ROW_GROUP_BYTES = 16 << 20

DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Token ids are little-endian unsigned integers of 32 bits, one after the other.
TOKENS = f"{DIGESTS}, ids binary"
IDS = "doc_id bigint, ids binary"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """The tables of a byte-level BPE file: symbols of bytes, sorted pair keys with ranks, bytes of tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec.get("normalizer") or model.get("dropout") or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE":
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        chars = byte_characters()
        self.byte_symbol = np.array([vocab[c] for c in chars], np.int64)
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, new = (np.array([vocab[x] for x in side], np.int64) for side in
                            ([p[0] for p in pairs], [p[1] for p in pairs], [p[0] + p[1] for p in pairs]))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.new = keys[order], order.astype(np.int32), new[order]
        back = {c: b for b, c in enumerate(chars)}
        spelled = [b""] * self.size
        for token, i in vocab.items():
            spelled[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.token_len = np.array([len(s) for s in spelled], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the sorted keys, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


def runs_even(at: np.ndarray) -> np.ndarray:
    """Of sorted positions, those at an even place in their run of consecutive ones."""
    begin = np.concatenate([[True], np.diff(at) != 1])
    first = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - first) % 2 == 0]


def merge_words(v: Vocabulary, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, flat, and their number a word; ``sym`` holds the byte symbols of non-empty words."""
    done_ids, done_word, done_len = [], [], []
    word = np.arange(len(lens))
    sym = sym.astype(np.int64)
    last = np.zeros(len(sym), bool)
    last[np.cumsum(lens) - 1] = True
    place = np.full(len(sym), -1, np.int64)
    inner = np.flatnonzero(~last)
    place[inner] = v.pairs(sym[inner], sym[inner + 1])
    while len(sym):
        rank = np.where(place >= 0, v.rank[place], NO_RANK)
        starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
        lens = np.diff(np.concatenate([starts, [len(sym)]]))
        low = np.minimum.reduceat(rank, starts)
        ended = low == NO_RANK
        if ended.any():
            gone = np.repeat(ended, lens)
            done_ids.append(sym[gone])
            done_word.append(word[ended])
            done_len.append(lens[ended])
            stay = ~gone
            sym, last, place, rank = sym[stay], last[stay], place[stay], rank[stay]
            word, lens, low = word[~ended], lens[~ended], low[~ended]
            if not len(sym):
                break
        at = runs_even(np.flatnonzero(rank == np.repeat(low, lens)))
        sym[at] = v.new[place[at]]
        last[at] = last[at + 1]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        moved = np.cumsum(stay)[at] - 1
        sym, last, place = sym[stay], last[stay], place[stay]
        place[moved] = -1
        before = moved[moved > 0] - 1
        changed = np.concatenate([moved, before[~last[before]]])
        changed = changed[~last[changed]]
        place[changed] = v.pairs(sym[changed], sym[changed + 1])
    if not done_ids:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids, word, n = (np.concatenate(x) for x in (done_ids, done_word, done_len))
    order = np.argsort(word, kind="stable")
    return ids[ranges((np.cumsum(n) - n)[order], n[order])], n[order]


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start .. start + len of all ranges, one after the other."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


class Encoder:
    """Encodes and decodes batches; remembers up to ``CACHE_WORDS`` words between them."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.split_any, self.split_latin = regex.compile(PATTERN).findall, re.compile(LATIN).findall
        self.beyond = re.compile(BEYOND_LATIN).search
        self.added = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True)) + ")") if v.special else None
        self.clear()

    def clear(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()  # a new word gets the next number
        self.known.default_factory = self.known.__len__
        self.known.update((s, i) for i, s in enumerate(self.v.special))
        self.ids = np.array(list(self.v.special.values()), np.int64)
        self.len = np.ones(len(self.known), np.int64)
        self.at = np.arange(len(self.known))

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if self.beyond(text) else self.split_latin(text)

    def words(self, text: str) -> list[str]:
        if self.added is None or not any(s in text for s in self.v.special):
            return self.split(text)
        out: list[str] = []
        for part in self.added.split(text):
            out += [part] if part in self.v.special else self.split(part)
        return out

    def learn(self, new: list[str]) -> None:
        """Encode words not seen before."""
        raw = [w.encode("utf-8", "replace") for w in new]
        lens = np.array([len(r) for r in raw], np.int64)
        cuts = np.cumsum(lens)
        ids, counts, i = [self.ids], [self.len], 0
        while i < len(raw):
            j = max(i + 1, int(np.searchsorted(cuts, (cuts[i - 1] if i else 0) + CHUNK_SYMBOLS)))
            sym = self.v.byte_symbol[np.frombuffer(b"".join(raw[i:j]), np.uint8)]
            got, n = merge_words(self.v, sym, lens[i:j])
            ids.append(got)
            counts.append(n)
            i = j
        self.ids, self.len = np.concatenate(ids), np.concatenate(counts)
        self.at = np.cumsum(self.len) - self.len

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.clear()
        known, n0 = self.known, len(self.known)
        numbers = []
        for t in texts:
            ws = self.words(t)
            numbers.append(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)))
        if len(known) > n0:
            self.learn(list(known)[n0:] if n0 else list(known))
        return [self.ids[ranges(self.at[w], self.len[w])] for w in numbers]

    def decode(self, ids: np.ndarray) -> str:
        v = self.v
        return v.token_bytes[ranges(v.token_at[ids], v.token_len[ids])].tobytes().decode("utf-8", "replace")


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """doc_id and token ids of ``common.PIECE_BYTES`` of texts at a time, so that no more ids are held at once."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        for i, j in common.pieces(np.concatenate([[0], np.cumsum(size, dtype=np.int64)])):
            yield b.column(0).slice(i, j - i), encoder.encode(common.to_strings(b.column(1).slice(i, j - i)))


def _packed(ids: np.ndarray) -> bytes:
    """Token ids as little-endian unsigned integers of 32 bits."""
    return ids.astype("<u4").tobytes()


def _digest(batches, vocabulary, with_ids):
    encoder = Encoder(vocabulary.value)
    for doc_id, parts in _encoded(batches, encoder):
        raw = [_packed(ids) for ids in parts]
        columns = [doc_id, [len(ids) for ids in parts], [hashlib.sha256(r).hexdigest() for r in raw],
                   [hashlib.sha256(encoder.decode(ids).encode()).hexdigest() for ids in parts]]
        yield common.batch(TOKENS, *columns, raw) if with_ids else common.batch(DIGESTS, *columns)


def _ids(batches, vocabulary):
    encoder = Encoder(vocabulary.value)
    for doc_id, parts in _encoded(batches, encoder):
        yield common.batch(IDS, doc_id, [_packed(ids) for ids in parts])


def _texts(batches, vocabulary):
    encoder = Encoder(vocabulary.value)
    for b in batches:
        raw, offsets = common.text_buffer(b.column(1))
        for i, j in common.pieces(offsets):
            yield common.batch("doc_id bigint, text string", b.column(0).slice(i, j - i),
                               [encoder.decode(raw[offsets[k]:offsets[k + 1]].view("<u4")) for k in range(i, j)])


def small_row_groups(spark: SparkSession) -> None:
    """Limit Parquet row groups for this session's writes."""
    spark.conf.set("parquet.block.size", str(ROW_GROUP_BYTES))


def _broadcast(df: DataFrame, path: str):
    common.bounded_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(Vocabulary(path))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each whole text; number of tokens and digests of both results (``DIGESTS``)."""
    return common.documents(docs).mapInArrow(partial(_digest, vocabulary=_broadcast(docs, path), with_ids=False), DIGESTS)


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """``digests`` and the token ids themselves (``TOKENS``); Parquet files that the session writes get row groups of ``ROW_GROUP_BYTES``."""
    small_row_groups(docs.sparkSession)
    return common.documents(docs).mapInArrow(partial(_digest, vocabulary=_broadcast(docs, path), with_ids=True), TOKENS)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids of each whole text (``IDS``); Parquet files that the session writes get row groups of ``ROW_GROUP_BYTES``."""
    small_row_groups(docs.sparkSession)
    return common.documents(docs).mapInArrow(partial(_ids, vocabulary=_broadcast(docs, path)), IDS)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of each row of token ids as ``encode`` gives them (null: empty)."""
    rows = common.take(tokens, doc_id="bigint", ids="binary")
    return rows.mapInArrow(partial(_texts, vocabulary=_broadcast(tokens, path)), "doc_id bigint, text string")

"""Benchmark decontamination: find benchmark word windows inside documents (operator 4).

A window is ``ngram`` consecutive words of a benchmark item (an item of fewer
words is one window).  The hashes of all windows form one sorted set, sent to
the tasks if the benchmark is under ``MAX_BENCHMARK_BYTES``; each task scans its
documents' words in numpy, verifies every hash hit against the words
themselves, and marks the words inside.  No shuffle, no Python code per word.
A larger benchmark goes another way: tasks emit only the windows whose hash
is set in a fixed-size bitmap, and an equi-join on the window's words finds
the items (``scan_joined``).

Defined results: a null or wordless text has no words and no hits; null ids
stay null; repeated rows give repeated rows; items without words occur
nowhere; items that share a window all count; null item ids are written as
an empty string; an empty benchmark hits nothing; empty documents give no
rows; texts of any length are read whole; extra columns are left out by the
scans and go through the removals, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, flat

NGRAM = 10
#: Benchmark text up to this size is held by every task (about 10 times as much memory).
MAX_BENCHMARK_BYTES = 16 << 20
#: Bits of the bitmap in front of the hash set.
FILTER_BITS = 20
#: Bits of the bitmap for a benchmark that is not sent whole (16 MB).
WIDE_FILTER_BITS = 27

RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"

#: Word bytes after lower-casing A-Z: 0-9, a-z and all bytes of characters above U+007F.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
LOWER = flat.lower_table()


def words_of(raw: np.ndarray, offsets: np.ndarray):
    low = LOWER[raw]
    starts, stops, doc = flat.spans(low, offsets, WORD)
    return low, starts, stops, doc, flat.span_hashes(low, starts, stops)


def same_text(doc: np.ndarray, n: int) -> np.ndarray:
    """Word positions at which ``n`` words of one text begin."""
    m = len(doc) - n + 1
    return np.flatnonzero(doc[:m] == doc[n - 1:n - 1 + m]) if m > 0 else np.empty(0, np.int64)


def window_key(low: np.ndarray, starts: np.ndarray, stops: np.ndarray, at: int, n: int) -> bytes:
    """The words of a window, lower-cased and joined by one space."""
    return b" ".join(low[s:e].tobytes() for s, e in zip(starts[at:at + n].tolist(), stops[at:at + n].tolist(), strict=True))


def item_windows(texts: pa.Array, ngram: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(item's position, words in the window, its hash, its words) of all windows of all items."""
    raw, offsets = common.text_buffer(texts)
    low, starts, stops, doc, words = words_of(raw, offsets)
    count = np.bincount(doc, minlength=len(offsets) - 1) if len(doc) else np.zeros(len(offsets) - 1, int)
    first = np.concatenate([[0], np.cumsum(count)])
    for item, k in enumerate(count.tolist()):
        n = min(k, ngram)
        if not n:
            continue
        a = int(first[item])
        for i, h in enumerate(flat.window_hashes(words[a:a + k], n).tolist()):
            yield item, n, h, window_key(low, starts, stops, a + i, n)


class WindowSet:
    """The benchmark's windows by length: sorted hashes behind a bitmap, and the items of each window."""

    def __init__(self, ids: list, texts: pa.Array, ngram: int):
        by: dict[int, dict[int, dict[bytes, set]]] = {}
        for item, n, h, key in item_windows(texts, ngram):
            by.setdefault(n, {}).setdefault(h, {}).setdefault(key, set()).add("" if ids[item] is None else str(ids[item]))
        self.sizes = []
        for n, hashes in sorted(by.items()):
            order = np.sort(np.fromiter(hashes, np.uint64, len(hashes)))
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[order & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.sizes.append((n, order, seen, hashes))

    def hits(self, low, starts, stops, doc, words) -> Iterator[tuple[int, int, set]]:
        """(first word, words, items) of each verified window occurrence."""
        for n, order, seen, hashes in self.sizes:
            at = same_text(doc, n)
            if not len(at):
                continue
            h = flat.window_hashes(words, n)[at]
            some = np.flatnonzero(seen[h & np.uint64((1 << FILTER_BITS) - 1)])
            place = np.minimum(np.searchsorted(order, h[some]), len(order) - 1)
            some = some[order[place] == h[some]]
            for i in some.tolist():
                items = hashes[int(h[i])].get(window_key(low, starts, stops, int(at[i]), n))
                if items is not None:
                    yield int(at[i]), n, items


def digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def scan_texts(texts: pa.Array, windows: WindowSet) -> Iterator[tuple[int, int, list[int], list[int], list[set], list[np.ndarray]]]:
    """For each piece of texts: first, last, words, hit words, items, and merged byte spans of the hits per text."""
    raw_all, offs_all = common.text_buffer(texts)
    for i, j in common.pieces(offs_all):
        raw, offsets = raw_all[offs_all[i]:offs_all[j]], offs_all[i:j + 1] - offs_all[i]
        low, starts, stops, doc, words = words_of(raw, offsets)
        edge = np.zeros(len(starts) + 1, np.int32)
        items: list[set] = [set() for _ in range(j - i)]
        for at, n, found in windows.hits(low, starts, stops, doc, words):
            edge[at] += 1
            edge[at + n] -= 1
            items[doc[at]] |= found
        hit = np.cumsum(edge[:-1]) > 0
        n_words = np.bincount(doc, minlength=j - i) if len(doc) else np.zeros(j - i, int)
        n_hit = np.bincount(doc[hit], minlength=j - i) if hit.any() else np.zeros(j - i, int)
        cuts = [np.empty((0, 2), np.int64)] * (j - i)
        for d in np.flatnonzero(n_hit).tolist():
            own = np.flatnonzero(doc == d) if j - i > 1 else np.arange(len(doc))
            h = hit[own]
            begin = np.flatnonzero(h & ~np.concatenate([[False], h[:-1]]))
            end = np.flatnonzero(h & ~np.concatenate([h[1:], [False]]))
            cuts[d] = np.stack([starts[own[begin]], stops[own[end]]], 1) - offsets[d]
        yield i, j, n_words.tolist(), n_hit.tolist(), items, cuts


def _scan(batches: Iterator[pa.RecordBatch], windows) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_hit, n_items, sha = [], [], [], []
        for _, _, words, hits, items, _ in scan_texts(b.column(1), windows.value):
            n_words += words
            n_hit += hits
            n_items += [len(x) for x in items]
            sha += [digest(x) for x in items]
        yield common.batch(RESULT, b.column(0), n_words, n_hit, n_items, sha, [h > 0 for h in n_hit])


def small_enough(benchmark: DataFrame, limit: int) -> bool:
    total = benchmark.agg(F.sum(F.octet_length("text") + F.lit(16)).alias("b")).first()["b"]
    return (total or 0) <= limit


def window_set(benchmark: DataFrame, ngram: int):
    """The broadcast window set of a benchmark whose size has been checked."""
    rows = benchmark.toArrow()
    texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    return benchmark.sparkSession.sparkContext.broadcast(WindowSet(rows.column("item_id").to_pylist(), texts, ngram))


def scan(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, max_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """One row per document: its words, hit words, and the benchmark items that occur in it (``RESULT``)."""
    common.bounded_batches(docs.sparkSession)
    docs, benchmark = common.documents(docs), common.take(benchmark, item_id="string", text="string")
    if not small_enough(benchmark, max_bytes):
        return scan_joined(docs, benchmark, ngram)
    return docs.mapInArrow(partial(_scan, windows=window_set(benchmark, ngram)), RESULT)


def remove_documents(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM,
                     max_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """The documents without any hit, whole and with all their columns."""
    common.bounded_batches(docs.sparkSession)
    benchmark = common.take(benchmark, item_id="string", text="string")
    if not small_enough(benchmark, max_bytes):
        flat_docs = common.positional(docs)
        d, t = (F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text"))
        bad = (scan_joined(flat_docs.select(d.alias("doc_id"), t.alias("text")), benchmark, ngram, keep_text_key=True)
               .filter("contaminated").select(F.col("doc_id").alias("k_id"), "k_text").distinct())
        kept = flat_docs.join(bad, d.eqNullSafe(bad["k_id"]) & (F.sha2(F.coalesce(t, F.lit("")), 256) == bad["k_text"]), "left_anti")
        return kept.toDF(*docs.columns)
    windows = window_set(benchmark, ngram)

    def kernel(b: pa.RecordBatch, at: int) -> pa.RecordBatch:
        clean = [not h for _, _, _, hits, _, _ in scan_texts(b.column(at), windows.value) for h in hits]
        return b.filter(pa.array(clean, pa.bool_()))

    return common.map_text_rows(docs, kernel)


def without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    keep = np.ones(len(raw), bool)
    for s, e in spans:
        keep[s:e] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes().decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, max_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """All documents, their texts without the hit words and what stands between them."""
    common.bounded_batches(docs.sparkSession)
    benchmark = common.take(benchmark, item_id="string", text="string")
    if not small_enough(benchmark, max_bytes):
        return remove_joined_spans(docs, benchmark, ngram)
    windows = window_set(benchmark, ngram)

    def kernel(b: pa.RecordBatch, at: int) -> pa.RecordBatch:
        texts = b.column(at).to_pylist()
        for i, _, _, _, _, cuts in scan_texts(b.column(at), windows.value):
            for d, own in enumerate(cuts):
                if len(own):
                    texts[i + d] = without(texts[i + d].encode(), own.tolist())
        cols = list(b.columns)
        cols[at] = pa.array(texts, b.schema.field(at).type)
        return pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return common.map_text_rows(docs, kernel)


# ------------------------------------------------------------------ a benchmark beyond the bound

ITEM_WINDOWS = "item_id string, n int, key binary, bit bigint"
WORD_COUNTS = "doc_id bigint, k_text string, n_words bigint"
DOC_WINDOWS = "doc_id bigint, k_text string, at bigint, n int, key binary"


def _windows_of_items(batches, ngram):
    for b in batches:
        ids = b.column(0).to_pylist()
        # Spark numbers bits from 1
        rows = [(ids[i] or "", n, k, (h & ((1 << WIDE_FILTER_BITS) - 1)) + 1) for i, n, h, k in item_windows(b.column(1), ngram)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield common.batch(ITEM_WINDOWS, *cols)


def _candidates(batches, bitmap):
    sizes, bits = bitmap.value
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1)
        raw_all, offs = common.text_buffer(texts)
        for i, j in common.pieces(offs):
            low, starts, stops, doc, words = words_of(raw_all[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            key_of: dict[int, str] = {}
            rows = []
            for n in sizes:
                at = same_text(doc, n)
                h = flat.window_hashes(words, n)[at] & np.uint64((1 << WIDE_FILTER_BITS) - 1)
                first = np.searchsorted(doc, doc[at]) if len(at) else at
                for k in np.flatnonzero(bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1).tolist():
                    d = int(doc[at[k]])
                    if d not in key_of:
                        key_of[d] = hashlib.sha256((texts[i + d].as_py() or "").encode()).hexdigest()
                    rows.append((ids[i + d], key_of[d], int(at[k] - first[k]), n, window_key(low, starts, stops, int(at[k]), n)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield common.batch(DOC_WINDOWS, *cols)


def _word_counts(batches):
    for b in batches:
        raw, offs = common.text_buffer(b.column(1))
        counts, keys = [], []
        for i, j in common.pieces(offs):
            _, _, doc = flat.spans(LOWER[raw[offs[i]:offs[j]]], offs[i:j + 1] - offs[i], WORD)
            counts += (np.bincount(doc, minlength=j - i) if len(doc) else np.zeros(j - i, int)).tolist()
        for i in range(len(offs) - 1):
            keys.append(hashlib.sha256(raw[offs[i]:offs[i + 1]].tobytes()).hexdigest())
        yield common.batch(WORD_COUNTS, b.column(0), keys, counts)


def joined_hits(docs: DataFrame, benchmark: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, k_text, at, n, item_id) of all occurrences: bitmap first, then an equi-join on the windows' words."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").mapInArrow(partial(_windows_of_items, ngram=ngram), ITEM_WINDOWS)
    items = common.checkpointed(items.distinct())
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most ``ngram`` rows
    # put together on the executors, 4 kB a row; 16 MB at most reach the driver
    blocks = items.groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = np.zeros(1 << (WIDE_FILTER_BITS - 3), np.uint8)
    for r in blocks.toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        bits[(r["block"] - 1) * len(part):r["block"] * len(part)] = part
    found = docs.mapInArrow(partial(_candidates, bitmap=spark.sparkContext.broadcast((sizes, bits))), DOC_WINDOWS)
    return found.distinct().join(items.select("n", "key", "item_id"), ["n", "key"])


def _cut(batches, at):
    """Documents, whose column ``at`` is the text and whose last is the places of hits, without the words of their hits."""
    for b in batches:
        texts, places = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
        for k, own in enumerate(places):
            if own:
                raw = texts[k].encode()
                _, starts, stops, _, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, [p["at"] for p in own], 1)
                np.add.at(edge, [p["at"] + p["n"] for p in own], -1)
                hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
                texts[k] = without(raw, [(int(starts[r[0]]), int(stops[r[-1]])) for r in runs])
        cols = list(b.columns[:-1])
        cols[at] = pa.array(texts, cols[at].type)
        yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])


def remove_joined_spans(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """``remove_spans`` for a benchmark of any size: the places of a document's hits are gathered and joined to it."""
    flat_docs = common.positional(docs)
    at = docs.columns.index("text")
    key, text = (F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text"))
    hits = joined_hits(flat_docs.select(key.cast("bigint").alias("doc_id"), text.cast("string").alias("text")), benchmark, ngram)
    places = (hits.select(F.col("doc_id").alias("k_id"), "k_text", "at", "n").distinct().groupBy("k_id", "k_text")
              .agg(F.collect_list(F.struct("at", "n")).alias("places")))
    found = flat_docs.join(places, key.cast("bigint").eqNullSafe(F.col("k_id")) & (F.sha2(F.coalesce(text, F.lit("")), 256) == F.col("k_text")), "left")
    return found.select(*flat_docs.columns, "places").mapInArrow(partial(_cut, at=at), flat_docs.schema).toDF(*docs.columns)


def scan_joined(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, keep_text_key: bool = False) -> DataFrame:
    """``scan`` for a benchmark of any size."""
    hits = joined_hits(docs, benchmark, ngram)
    words = (hits.select("doc_id", "k_text", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("w")).distinct()
             .groupBy("doc_id", "k_text").agg(F.count("*").alias("n_hit")))
    names = (hits.select("doc_id", "k_text", "item_id").distinct().groupBy("doc_id", "k_text")
             .agg(F.sort_array(F.collect_set("item_id")).alias("ids")))
    per_doc = words.join(names, words["doc_id"].eqNullSafe(names["doc_id"]) & (words["k_text"] == names["k_text"])).select(
        words["doc_id"].alias("h_id"), words["k_text"].alias("h_text"), "n_hit", "ids")
    base = docs.mapInArrow(_word_counts, WORD_COUNTS)
    out = base.join(per_doc, base["doc_id"].eqNullSafe(per_doc["h_id"]) & (base["k_text"] == per_doc["h_text"]), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                      F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *(["k_text"] if keep_text_key else []))

"""Mining of phrase collocations from sorted count streams (operator 11).

A pass over the texts for each length finds, in a bitmap of a fixed size, the phrases that may be frequent (a clear bit is
proof of the contrary), among those whose two parts one word shorter may be.  The last pass counts one window for each word, the longest phrase
there that may be frequent.  From then on counts are exact streams in sorted order, as in external language-model estimation:

* in prefix order, the windows that begin with a phrase follow each other, so one pass over the sorted stream sums the
  counts of all phrases (``fold``);
* in prefix order, a phrase comes right before its extensions to the right and right after its own prefixes, so one
  lockstep pass (``lockstep``) gives each phrase the counts of its prefixes and its most frequent right extension;
* the same pass in suffix order (words reversed) gives the counts of its suffixes and its most frequent left extension;
* a sort-merge join lays both beside each other.

No table of counts is held in memory.  A sorted stream is cut into ranges by the whole phrase, so a frequent first word
spreads over many tasks: runs that touch the edge of a batch are handed on as parts and summed in a small
grouped table, and each range gets the counts of the few prefixes that are open where it begins.

Only extensions by one word need be looked at: a longer candidate that holds a phrase holds one of them, and that
is at least as frequent.

Rules: A-Z are lower-cased; ``[.,;:!?\\x0A-\\x0D]`` ends a piece, blanks and tabs end a word; counts are for each lang.

Defined results: a null text is empty, a null lang is ``und``; texts are read whole, however long; repeated rows and ids
count each time (ids aren't used); extra columns are left out whatever their names; an empty table gives no rows; ties are
broken by the higher count, then by the lesser phrase in UTF-8 byte order; a cut's tie by the shorter first part.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, flat

LONGEST, LEAST, TOP = 4, 30, 2000
#: A phrase goes if a longer one that holds it has at least this percentage of its count.
COVERED = 80
SCORE = 2_000_000
#: Phrases are counted in 2 ** 32 buckets first, cut into ranges; buckets share the bits of a map.  Where more phrases fill
#: the map, rare ones pass too and are left out after counting.
MAP_BITS, RANGE_BITS = 27, 8
RANGES = 1 << RANGE_BITS
#: Buckets of a range that are kept as lists.
FEW = 1 << 20
#: Phrases whose buckets a task counts together.
COUNTED = 1 << 22
#: Rows of windows that a task sums before it hands them on, and in a batch of those.
HELD, HANDED = 1 << 20, 1 << 16
#: Bytes of text whose windows a task counts together.
TOGETHER = 8 << 20
#: A language's best phrases are found in so many parts first.
PARTS = 64

BLOBS = "range int, places binary, n binary"
BITS = "range int, bits binary"
WINDOWS = "lang string, words string, n bigint"
FOLDED = "words array<string>, n bigint, edge boolean"
RUNS = "words array<string>, n bigint, parts array<bigint>, extension bigint, open boolean"

LOWER = flat.lower_table()
CUT = np.zeros(256, bool)
CUT[[ord(c) for c in ".,;:!?"]] = CUT[10:14] = True
IS_WORD = ~CUT
IS_WORD[[9, 32]] = False
#: Joins the words of a window; no word holds a tab.
TAB = "\t"


# ------------------------------------------------------------------ words of texts

def _by_lang(batches):
    """(lang, texts) of all rows, up to about ``TOGETHER`` bytes of a language at once."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for b in batches:
        langs, texts = b.column(0), b.column(1)
        for lang in pc.unique(langs).to_pylist():
            part = texts.filter(pc.equal(langs, lang))
            held.setdefault(lang, []).append(part)
            size[lang] = size.get(lang, 0) + part.nbytes
            if size[lang] >= TOGETHER:
                yield lang, held.pop(lang)
                del size[lang]
        if sum(size.values()) >= 4 * TOGETHER:  # many languages, little of each
            yield from held.items()
            held, size = {}, {}
    yield from held.items()


def word_stream(batches):
    """(lang, words as a dictionary array, whether each word goes on in the piece of the word before it)."""
    for lang, arrays in _by_lang(batches):
        raw, offsets = common.text_buffer(pa.chunked_array(arrays).combine_chunks())
        for i, j in common.pieces(offsets, TOGETHER):
            low = LOWER[raw[offsets[i]:offsets[j]]]
            starts, stops, doc = flat.spans(low, offsets[i:j + 1] - offsets[i], IS_WORD)
            if not len(starts):
                continue
            bounds = np.concatenate([[0], np.cumsum(stops - starts)])
            inside = low[IS_WORD[low]]
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(inside)])
            cuts = np.searchsorted(np.flatnonzero(CUT[low]), starts)
            goes_on = np.zeros(len(starts), bool)
            goes_on[1:] = (cuts[1:] == cuts[:-1]) & (doc[1:] == doc[:-1])
            yield lang, words.dictionary_encode(), goes_on


def text(a: pa.Array) -> pa.Array:
    """Binary words as strings; bytes that are no UTF-8 never come from Spark's strings."""
    return a.cast(pa.binary()).cast(pa.string())


# ------------------------------------------------------------------ what may be frequent

def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, other ones in each language."""
    raw, offsets = common.text_buffer(words)
    own = np.frombuffer(b"." + lang.encode(), np.uint8)
    with np.errstate(over="ignore"):
        salt = flat.span_hashes(own, np.array([0]), np.array([len(own)]))[0] * flat.BASE
        return flat.mix(flat.span_hashes(raw, offsets[:-1], offsets[1:]) + salt)


def may_be(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set (most significant bit of a byte first)."""
    at = hashes >> np.uint64(64 - MAP_BITS)
    return (bits[at >> np.uint64(3)] << (at & np.uint64(7)).astype(np.uint8)) & 128 > 0


def _blobs(hashes: list[np.ndarray], least: int):
    """Counts of 32-bit buckets, cut by range: sorted places within the range, and counts up to ``least``."""
    keys, n = np.unique((np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32), return_counts=True)
    n = np.minimum(n, least).astype(np.min_scalar_type(2 * least))
    cuts = np.searchsorted(keys, np.arange(RANGES + 1, dtype=np.uint64) << np.uint64(32 - RANGE_BITS))
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        i, j = cuts[r], cuts[r + 1]
        yield common.batch(BLOBS, [r], [keys[i:j].tobytes()], [n[i:j].tobytes()])


def growing(h: np.ndarray, goes_on: np.ndarray, maps: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Where phrases of 1, 2, ... words (one length a map) may be frequent, and where phrases of one word more may be, with their hashes."""
    places, lengths, hashes = np.arange(len(h)), [], h
    for k, bits in enumerate(maps, 1):
        ok = may_be(bits, hashes)
        places, hashes = places[ok], hashes[ok]
        lengths.append(places)
        # a phrase of one word more begins here and holds another such phrase one word later
        here = np.zeros(len(h) + 1, bool)
        here[places] = True
        ok = here[places + 1] & goes_on[np.minimum(places + k, len(h) - 1)] & (places + k < len(h))
        places, hashes = places[ok], hashes[ok]
        with np.errstate(over="ignore"):
            hashes = flat.mix(hashes * flat.BASE + h[places + k])
    return lengths, places, hashes


def _bucket_counts(batches, maps, least):
    """Counts of the buckets of phrases one word longer than those of the last of ``maps``, whose parts may be frequent."""
    held, size = [], 0
    for lang, words, goes_on in word_stream(batches):
        h = word_hashes(lang, words.dictionary)[words.indices.to_numpy()]
        got = growing(h, goes_on, [m.value for m in maps])[2]
        held.append(got)
        size += len(got)
        if size >= COUNTED:
            yield from _blobs(held, least)
            held, size = [], 0
    if size:
        yield from _blobs(held, least)


class Buckets:
    """Counts, up to ``least``, of the buckets of one range: as lists while there are few, then as one array."""

    def __init__(self, least: int):
        self.least, self.kind = least, np.min_scalar_type(2 * least)
        self.places: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size, self.dense = 0, None

    def add(self, places: np.ndarray, n: np.ndarray) -> None:
        """``places`` differ from each other."""
        if self.dense is None:
            self.places.append(places)
            self.counts.append(n)
            self.size += len(places)
            if self.size <= FEW:
                return
            self.dense = np.zeros(1 << (32 - RANGE_BITS), self.kind)
            for p, n in zip(self.places, self.counts, strict=True):
                self.add(p, n)
            self.places, self.counts = [], []
            return
        at = places & np.uint32(len(self.dense) - 1)
        self.dense[at] = np.minimum(self.dense[at] + n, self.least)

    def bits(self) -> bytes:
        share = 32 - MAP_BITS
        if self.dense is not None:
            near = (self.dense.reshape(-1, 1 << share) >= self.least).any(1)
        else:
            keys, at = np.unique(np.concatenate(self.places), return_inverse=True)
            often = keys[np.bincount(at, np.concatenate(self.counts)) >= self.least]
            near = np.zeros(1 << (MAP_BITS - RANGE_BITS), bool)
            near[(often & np.uint32((1 << (32 - RANGE_BITS)) - 1)) >> np.uint32(share)] = True
        return np.packbits(near).tobytes()


def _frequent_bits(batches, least):
    """The bitmap of each range's buckets with a count of ``least``, from blobs sorted by range; memory doesn't grow with them."""
    now, have = None, None
    for b in batches:
        for r, keys, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if r != now:
                if have is not None:
                    yield common.batch(BITS, [now], [have.bits()])
                now, have = r, Buckets(least)
            have.add(np.frombuffer(keys, np.uint32), np.frombuffer(n, have.kind))
    if have is not None:
        yield common.batch(BITS, [now], [have.bits()])


def frequent_map(texts: DataFrame, least: int, maps: list = ()):
    """A broadcast bitmap of 2 ** MAP_BITS bits: clear for words rarer than ``least``, or with the maps of shorter phrases for those one word longer."""
    blobs = texts.mapInArrow(partial(_bucket_counts, maps=list(maps), least=least), BLOBS)
    bits = blobs.repartition("range").sortWithinPartitions("range").mapInArrow(partial(_frequent_bits, least=least), BITS)
    out = np.zeros((RANGES, 1 << (MAP_BITS - RANGE_BITS - 3)), np.uint8)
    for r in bits.collect():  # RANGES rows, 2 ** (MAP_BITS - 3) bytes in all
        out[r["range"]] = np.frombuffer(r["bits"], np.uint8)
    return texts.sparkSession.sparkContext.broadcast(out.ravel())


# ------------------------------------------------------------------ windows

def _windows(batches, maps):
    """``_flush_windows`` summed over a task's texts, up to about ``HELD`` rows at once."""
    def emit(parts):
        t = pa.Table.from_batches(parts).group_by(["lang", "words"], use_threads=False).aggregate([("n", "sum")])
        for b in t.select(["lang", "words", "n_sum"]).combine_chunks().to_batches(max_chunksize=HANDED):
            yield pa.RecordBatch.from_arrays(b.columns, schema=common.arrow_schema(WINDOWS))

    held, size = [], 0
    for b in _flush_windows(batches, maps):
        held.append(b)
        size += len(b)
        if size >= HELD:
            yield from emit(held)
            held, size = [], 0
    if held:
        yield from emit(held)


def _flush_windows(batches, maps):
    """Counts of the longest phrase that may be frequent at each word, as texts joined by tabs; a null window counts all words."""
    for lang, found, goes_on in word_stream(batches):
        own = pa.array([lang], pa.string())
        yield common.batch(WINDOWS, own, pa.nulls(1, pa.string()), [len(found)])
        at = found.indices.to_numpy()
        lengths, _, _ = growing(word_hashes(lang, found.dictionary)[at], goes_on, [m.value for m in maps])
        names = text(found.dictionary)
        for k, places in enumerate(lengths, 1):
            # those that go no further
            if k < len(lengths):
                places = np.setdiff1d(places, lengths[k], assume_unique=True)
            if not len(places):
                continue
            # equal windows get equal codes, one word more at a time
            table = [at[places + i] for i in range(k)]
            code = table[0].astype(np.int64)
            for c in table[1:]:
                code = pa.array(code * len(names) + c).dictionary_encode().indices.to_numpy().astype(np.int64)
            count = np.bincount(code)
            some = np.flatnonzero(count)
            first = np.empty(len(count), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            cells = [names.take(pa.array(c[first[some]])) for c in table]
            joined = pc.binary_join_element_wise(*cells, TAB) if k > 1 else cells[0]
            yield common.batch(WINDOWS, own.take(pa.array(np.zeros(len(some), np.int64))), joined, pa.array(count[some]))


def counted_windows(texts: DataFrame, maps: list) -> DataFrame:
    """(lang, words, n) of all windows, given the broadcast maps; null words count every word of a lang."""
    return common.checkpointed(texts.mapInArrow(partial(_windows, maps=maps), WINDOWS).groupBy("lang", "words").agg(F.sum("n").alias("n")))


# ------------------------------------------------------------------ sorted streams

class Rows:
    """A batch of sorted word lists as a matrix of ids (-1: beyond the end)."""

    def __init__(self, col: pa.Array, width: int):
        self.length = np.diff(col.offsets.to_numpy())
        encoded = col.flatten().dictionary_encode()
        self.names = encoded.dictionary
        self.ids = np.full((len(col), width), -1)
        self.ids[np.repeat(np.arange(len(col)), self.length), np.arange(len(encoded)) - np.repeat(np.cumsum(self.length) - self.length, self.length)] = encoded.indices

    def runs(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of at least ``depth`` words, and where among them the first ``depth`` words change."""
        rows = np.flatnonzero(self.length >= depth)
        if not len(rows):
            return rows, rows
        keys = self.ids[rows, :depth]
        return rows, np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1])

    def lists(self, rows: np.ndarray, depth: int | np.ndarray) -> pa.Array:
        """The first ``depth`` words of ``rows`` as lists."""
        depth = np.broadcast_to(depth, len(rows))
        keep = np.arange(self.ids.shape[1])[None] < depth[:, None]
        offsets = np.concatenate([[0], np.cumsum(depth)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), self.names.take(pa.array(self.ids[rows][keep])))


def list_batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {**common.ARROW, "array<string>": pa.list_(pa.string())}
    s = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))])
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                                       for c, f in zip(columns, s, strict=True)], schema=s)


def _fold(batches, width):
    """Counts of all prefixes (from two places on, the first being the lang) of sorted windows; runs at a batch's edge as parts."""
    for b in batches:
        if not len(b):
            continue
        r, n = Rows(b.column(0), width), b.column(1).to_numpy()
        for depth in range(2, width + 1):
            rows, starts = r.runs(depth)
            if not len(rows):
                continue
            sums = np.add.reduceat(n[rows], starts)
            edge = np.zeros(len(starts), bool)
            edge[[0, -1]] = True
            yield list_batch(FOLDED, r.lists(rows[starts], depth), pa.array(sums), pa.array(edge))


def sorted_stream(df: DataFrame, column: str = "words") -> DataFrame:
    """``df`` cut into ranges of ``column`` and sorted; the ranges hold in the checkpoint that follows."""
    return df.repartitionByRange(column).sortWithinPartitions(column)


def phrase_counts(windows: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(words, n) of all phrases of up to ``longest`` words with a count of at least ``least``; words begin with the lang."""
    rows = windows.select(F.concat(F.array("lang"), F.split("words", TAB, -1)).alias("words"), "n")
    folded = common.checkpointed(sorted_stream(rows).mapInArrow(partial(_fold, width=longest + 1), FOLDED).filter(F.col("edge") | (F.col("n") >= least)))
    edges = folded.filter("edge").groupBy("words").agg(F.sum("n").alias("n"))
    return folded.filter("not edge").select("words", "n").union(edges).filter(F.col("n") >= least)


class Open:
    """The prefixes of the last row of a stream so far, with their counts."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts

    def count(self, words: list[str]) -> int:
        if self.words[:len(words)] != words or len(self.counts) < len(words) - 1:
            raise ValueError(f"no count of {words} in its sorted stream")
        return self.counts[len(words) - 2]


def _lockstep(batches, width, carried):
    """Counts of the prefixes of each phrase, and its most frequent extension, from a stream in sorted order.

    ``carried`` gives for each range the first row's proper prefixes, whose rows lie in earlier ranges.
    """
    before = Open(*carried.value.get(TaskContext.get().partitionId(), ([], [])))
    for b in batches:
        if not len(b):
            continue
        r, n = Rows(b.column(0), width), b.column(1).to_numpy()
        size = len(n)
        prefix = np.zeros((size, width - 1), np.int64)  # column k: count of the first k + 2 places
        extension, is_open = np.zeros(size, np.int64), np.zeros(size, bool)
        strays = []
        for depth in range(2, width + 1):
            rows, starts = r.runs(depth)
            if not len(rows):
                continue
            heads = rows[starts]
            own = r.length[heads] == depth
            counts = np.where(own, n[heads], 0)
            if not own[0]:  # began in an earlier batch: only the first run can
                counts[0] = before.count(b.column(0)[int(heads[0])].as_py()[:depth])
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
            prefix[rows, depth - 2] = counts[run]
            best = np.maximum.reduceat(np.where(r.length[rows] == depth + 1, n[rows], 0), starts)
            extension[heads[own]] = best[own]
            is_open[heads[-1]] |= own[-1]
            if not own[0] and best[0]:
                strays.append((r.lists(heads[:1], depth), int(best[0])))
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(r.length - 1)]).astype(np.int32)),
                                          pa.array(prefix[np.arange(width - 1)[None] < (r.length - 1)[:, None]]))
        yield list_batch(RUNS, b.column(0), pa.array(n), listed, pa.array(extension), pa.array(is_open))
        for words, best in strays:
            yield list_batch(RUNS, words, [None], [None], [best], [True])
        last = b.column(0)[size - 1].as_py()
        before = Open(last, prefix[-1, :len(last) - 1].tolist())


def _first_rows(batches):
    for b in batches:
        if len(b):
            yield list_batch("range int, words array<string>", [TaskContext.get().partitionId()], b.column(0).slice(0, 1))
            return


def lockstep(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(words, n, parts, extension): counts of the prefixes of up to all words, and of the most frequent extension, 0 if none."""
    stream = common.checkpointed(sorted_stream(counts))
    # one row a range: the prefixes open at its start
    firsts = stream.select("words").mapInArrow(_first_rows, "range int, words array<string>")
    asked = firsts.select("range", F.col("words").alias("row"), F.posexplode(F.transform(F.sequence(F.lit(2), F.size("words")), lambda k: F.slice("words", F.lit(1), k))).alias("k", "words"))
    carried: dict[int, tuple[list, list]] = {}
    for x in stream.join(F.broadcast(asked), "words").orderBy("range", "k").collect():  # at most LONGEST rows a range
        carried.setdefault(x["range"], (list(x["row"]), []))[1].append(x["n"])
    found = common.checkpointed(stream.mapInArrow(partial(_lockstep, width=longest + 1, carried=counts.sparkSession.sparkContext.broadcast(carried)), RUNS))
    whole = (found.filter("open").groupBy("words")
             .agg(F.max("n").alias("n"), F.max("parts").alias("parts"), F.max("extension").alias("extension")))
    return found.filter("not open").select("words", "n", "parts", "extension").union(whole)


# ------------------------------------------------------------------ scores

def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(candidates with the counts of their parts and extensions, word totals by lang)."""
    common.bounded_batches(docs.sparkSession)
    texts = common.take(docs, lang="string", text="string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    maps: list = []
    for _ in range(longest):
        maps.append(frequent_map(texts, least, maps))
    windows = counted_windows(texts, maps)
    totals = windows.filter("words is null").select("lang", F.col("n").alias("total"))
    windows = windows.filter("words is not null")
    counts = common.checkpointed(phrase_counts(windows, least, longest))
    ahead = lockstep(counts, longest).filter(F.size("words") > 2)
    # suffix order: the lang stays in front, the words turn round
    def turned(c):
        return F.concat(F.slice(c, 1, 1), F.reverse(F.slice(c, 2, longest)))
    back = lockstep(counts.select(turned("words").alias("words"), "n"), longest).filter(F.size("words") > 2)
    back = back.select(turned("words").alias("words"), F.col("parts").alias("ends"), F.col("extension").alias("to_left"))
    return ahead.join(back.hint("merge"), "words").withColumn("covering", F.greatest("extension", "to_left")), totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """The first ``top`` phrases of each lang by score: lang, rank, phrase, a, l, r, n, score."""
    both, totals = mined(docs, least, longest)
    wide = "decimal(38,0)"
    free = both.filter(F.col("covering").cast(wide) * 100 < F.col("n").cast(wide) * COVERED)
    # a cut after k words: the prefix of k words and the suffix of the others
    cuts = free.select("words", F.col("n").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda k: F.struct(
        k.alias("k"), F.get("parts", k - 1).alias("l"), F.get("ends", F.size("words") - 2 - k).alias("r")))).alias("cut"))
    scored = cuts.select("words", "a", "cut", F.expr(f"cast({SCORE}BD * a as decimal(38,0)) div (cast(cut.l as decimal(20,0)) + cut.r)").alias("score"))
    worst = scored.groupBy("words", "a").agg(F.min(F.struct("score", "cut.k", "cut.l", "cut.r")).alias("w"))
    rows = worst.select(F.get("words", F.lit(0)).alias("lang"), F.array_join(F.slice("words", 2, longest), " ").alias("phrase"), "a", "w.l", "w.r", "w.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = rows.withColumn("i", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).filter(F.col("i") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")

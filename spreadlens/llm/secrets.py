"""Secret scans: fixed patterns plus character Markov models (operator 10).

Two first-order character models, one of random strings and one of ordinary
identifiers, are trained from labelled samples: generated random strings and
rulers, identifiers joined from common words, and the letter-only words of at
most ``SAMPLE_ROWS`` documents (``SAMPLE_BYTES`` of whole texts).  A run of
``MIN_CHARS`` or more key characters outside the base spans, which are cut out of longer runs, is a secret if its
mean log-likelihood ratio reaches ``MARGIN``.

Defined results: null text counts as empty and has no spans; spans are code
points, end exclusive; a base span always stays, kinds may overlap each other;
null ids stay; repeated rows give equal rows; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: The base patterns; a match stays if its group has at least so many characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")  # the same spans as HEX with 24 or more characters, since runs don't touch
KINDS = ("assign", "access", "hex", "markov")

KEY_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIN_CHARS = 16
#: Nats a character by which a run must look more like a random string than like an identifier.
MARGIN = 0.35
SAMPLE_ROWS = 300
SAMPLE_BYTES = 2 << 20

CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(256, -1, np.int64)
CODE[[ord(c) for c in CHARS]] = np.arange(len(CHARS))
#: Parts of ordinary identifiers.
PARTS = """get set make read write open close user name value index count list item node file path data table column row
key type size length start end first last next prev parent child left right old new max min sum total mean test case
config option param result error message status state event handler manager service client server request response
session context buffer stream input output source target model train batch layer weight image text word line page
document section paragraph version license number order price customer account address street city country date time
hour minute second internal external temporary international application information implementation""".split()

RESULT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


# ------------------------------------------------------------------ models

def labelled(seed: int = 11, rows: int = 4000) -> tuple[list[str], list[str]]:
    """Random strings, and ordinary identifiers and rulers."""
    rng = np.random.default_rng(seed)
    kinds = ["0123456789abcdef", CHARS[26:62], CHARS[:62], CHARS[:26] + CHARS[52:62], CHARS[:62] + "+/", CHARS[:62] + "_-"]
    random = ["".join(rng.choice(list(kinds[i % len(kinds)]), rng.integers(16, 65))) for i in range(rows)]
    plain = []
    for i in range(rows):
        ws = [PARTS[k] for k in rng.integers(0, len(PARTS), rng.integers(2, 6))]
        plain.append(["_".join(ws), "-".join(ws), ws[0] + "".join(w.title() for w in ws[1:]), "_".join(ws).upper(), "/".join(ws)][i % 5]
                     + (str(rng.integers(0, 3000)) if i % 3 == 0 else ""))
    rulers = [c * 40 for c in CHARS for _ in range(rows // 400)]
    return random, plain + rulers


def counts(strings: list[str]) -> np.ndarray:
    """How often each character follows each other one."""
    n = len(CHARS)
    codes = CODE[np.frombuffer(" ".join(strings).encode("ascii", "replace"), np.uint8)]
    a, b = codes[:-1], codes[1:]
    ok = (a >= 0) & (b >= 0)
    return np.bincount(a[ok] * n + b[ok], minlength=n * n).reshape(n, n).astype(float)


def ratio_table(random: list[str], plain: list[str], smooth: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each character given the one before."""
    logs = []
    for strings in (random, plain):
        c = counts(strings) + smooth
        logs.append(np.log(c / c.sum(1, keepdims=True)))
    return logs[0] - logs[1]


def ordinary_words(texts: list[str]) -> list[str]:
    return [w for t in texts for w in re.findall(r"(?<![A-Za-z0-9])[A-Za-z]{4,15}(?![A-Za-z0-9])", t)]


def train(texts: list[str]) -> np.ndarray:
    random, plain = labelled()
    return ratio_table(random, plain + ordinary_words(texts))


def ratio(table: np.ndarray, runs: list[str]) -> np.ndarray:
    """Mean log-likelihood ratio a character of each run."""
    if not runs:
        return np.empty(0)
    lens = np.array([len(r) for r in runs])
    codes = CODE[np.frombuffer("".join(runs).encode(), np.uint8)]
    value = np.zeros(len(codes))
    value[1:] = table[codes[:-1], codes[1:]]
    first = np.cumsum(lens) - lens
    value[first] = 0
    return np.add.reduceat(value, first) / (lens - 1)


# ------------------------------------------------------------------ spans

def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches of a text, sorted."""
    found = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), 2) for m in HEX_LONG.finditer(text)]
    return sorted((s, k, e) for s, e, k in found)


def outside(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of key runs outside the sorted base spans, of ``MIN_CHARS`` or more characters."""
    k = reach = 0
    for m in KEY_RUN.finditer(text):
        at, stop = m.span()
        at = max(at, reach)
        while k < len(base) and base[k][0] < stop:
            if base[k][0] - at >= MIN_CHARS:
                yield at, base[k][0]
            reach = max(reach, base[k][2])
            at = max(at, reach)
            k += 1
        if stop - at >= MIN_CHARS:
            yield at, stop


def all_spans(texts: list[str], table: np.ndarray, margin: float = MARGIN) -> Iterator[tuple[list, list]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    runs = [(i, s, e) for i, t in enumerate(texts) for s, e in outside(t, base[i])]
    strings = [texts[i][s:e] for i, s, e in runs]
    more: dict[int, list] = {}
    for (i, s, e), r in zip(runs, ratio(table, strings), strict=True):
        if r >= margin:
            more.setdefault(i, []).append((s, 3, e))
    for i, own in enumerate(base):
        yield own, sorted(own + more.get(i, []))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[REDACTED]") -> str:
    """The text with each stretch of overlapping or touching spans replaced by the mark."""
    out, at, end = [], 0, -1
    for s, _, e in spans:
        if s > end:
            out += [text[at:s], mark]
        end = max(end, e)
        at = end
    return "".join(out) + text[at:]


# ------------------------------------------------------------------ on Spark

def model(docs: DataFrame):
    """The broadcast ratio table (35 kB)."""
    common.bounded_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(train(common.text_sample(docs, SAMPLE_ROWS, SAMPLE_BYTES)))


def _scan(batches, table):
    for b in batches:
        n, sha, spans = [[], [], []], [], []
        for base, every in all_spans(common.to_strings(b.column(1)), table.value):
            for k in range(3):
                n[k].append(sum(x[1] == k for x in base))
            sha.append(hashlib.sha256(written(base).encode()).hexdigest())
            spans.append(written(every))
        yield common.batch(RESULT, b.column(0), *n, sha, spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans."""
    return common.documents(docs).mapInArrow(partial(_scan, table=model(docs)), RESULT)


def redact_documents(docs: DataFrame) -> DataFrame:
    """All documents with every span replaced by ``[REDACTED]`` in ``text``; ``n_chars`` follows where it is a column.

    A null text stays null.  Rows and all other columns stay as they are.
    """
    table = model(docs)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def kernel(b: pa.RecordBatch, at: int) -> pa.RecordBatch:
        texts = common.to_strings(b.column(at))
        cols = list(b.columns)
        changed = [redact(t, spans) if spans else t for t, (_, spans) in zip(texts, all_spans(texts, table.value), strict=True)]
        null = b.column(at).is_null().to_pylist()
        cols[at] = pa.array([None if z else t for z, t in zip(null, changed, strict=True)], b.schema.field(at).type)
        if chars is not None and pa.types.is_integer(cols[chars].type):
            was = cols[chars].to_pylist()
            cols[chars] = pa.array([len(t) if t != o and w is not None else w for t, o, w in zip(changed, texts, was, strict=True)], cols[chars].type)
        return pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return common.map_text_rows(docs, kernel)

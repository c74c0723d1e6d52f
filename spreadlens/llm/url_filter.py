"""URL filtering by a bit-parallel wildcard automaton (operator 12).

Rules are globs over canonical URLs.  All rules are packed side by side into the bits of several 64-bit words, one bit
a character, and run at once as a Shift-And automaton: for each character of the URL the state shifts by one bit, is
masked by the positions where that character may stand, and keeps the positions that a ``*`` lets stay.  The state
of all URLs of a batch is one numpy array (URLs x words), stepped together through their characters.

Canonical form of a URL: ``.host`` + NUL + path + NUL + query.  ``*`` stands for any characters but NUL, so a rule's
host part can't match in a path; ``?`` for one such byte.  The rule host ``net`` becomes ``*.net`` and so fits
the host and all its subdomains; the rule path ``/en/`` becomes ``/en/*``.

Order: a listed rule wins over all globs of the method; of several listed rules the one with the longest host and path
wins (equal lengths: the longer host, then the lesser text).  Without a listed rule the verdict is block where one of
``GLOBS`` fits and else allow.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; it is allowed unless a glob
fits an empty host.  Null and repeated page ids and rows stay; URLs of any length are read whole; extra columns are
left out whatever their names; an empty table gives no rows.  A NUL in a URL is an ordinary character no rule has, and
never the end of a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

END = 0
#: A NUL of the URL itself, which no rule may match as an end.
ODD = 255
RESULT = "page_id bigint, host string, path string, rule string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host (with its subdomains) and the start of a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def glob(self) -> bytes:
        return b"*." + self.host.encode() + b"\x00" + self.path.encode() + b"*\x00*"


#: The rules of the contract.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: The method's own globs over host, path and query, where no listed rule fits; each blocks.
GLOBS = tuple(h + "\x00" + p + "\x00" + q for h, p, q in (
    ("*", "*/login*", "*"), ("*", "*/wp-admin/*", "*"), ("*", "*/cart/*", "*"), ("*", "*/tag/*", "*"), ("*", "*.exe", "*"), ("*", "*.zip", "*"),
    ("*.ads.*", "*", "*"), ("*.tracker.*", "*", "*"), ("*", "*", "*sessionid=*"), ("*", "*", "*add-to-cart=*")))


class Automaton:
    """Globs packed into masks: one bit before the first character and one a character of each glob."""

    def __init__(self, globs: list[bytes]):
        starts, finals, stars, chars = [], [], [], []
        at = 0
        for g in globs:
            starts.append(at)
            for c in g:
                if c == ord("*"):
                    stars.append(at)
                else:
                    at += 1
                    chars.append((at, c))
            finals.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.step, self.stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        self.finals = [(i // 64, np.uint64(i % 64)) for i in finals]
        inside = np.arange(256) != END
        for i in starts:
            self.first[i // 64] |= np.uint64(1 << i % 64)
        for i in stars:
            self.stay[inside, i // 64] |= np.uint64(1 << i % 64)
        for i, c in chars:
            self.step[inside if c == ord("?") else c, i // 64] |= np.uint64(1 << i % 64)

    def run(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which globs fit which strings (strings x globs); the longest strings come first in the running state."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        begin, size = offsets[:-1][order], size[order]
        state = np.repeat(self.first[None], len(order), 0)
        # how many strings, longest first, still have a character at each place
        alive = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
        one, top = np.uint64(1), np.uint64(63)
        for t, k in enumerate(alive.tolist()):
            c = buf[begin[:k] + t]
            d = state[:k]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved &= self.step[c]
            moved |= d & self.stay[c]
            state[:k] = moved
        found = np.empty((len(order), len(self.finals)), bool)
        for r, (w, bit) in enumerate(self.finals):
            found[order, r] = (state[:, w] >> bit) & one
        return found


def canonical(host: pa.Array, path: pa.Array, query: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``.host`` NUL path NUL query of each row as one byte array with offsets."""
    parts = [common.text_buffer(c) for c in (host, path, query)]
    sizes = [np.diff(o) for _, o in parts]
    offsets = np.concatenate([[0], np.cumsum(3 + sum(sizes))])
    out = np.zeros(int(offsets[-1]), np.uint8)
    at = offsets[:-1].copy()
    out[at] = ord(".")
    at += 1
    for (raw, o), n in zip(parts, sizes, strict=True):
        raw = np.where(raw == END, ODD, raw).astype(np.uint8)
        out[np.arange(len(raw)) + np.repeat(at - o[:-1], n)] = raw
        at += n + 1
    return out, offsets


def by_strength(rules: tuple[Rule, ...]) -> list[int]:
    """Rule numbers from the weakest to the strongest."""
    return sorted(range(len(rules)), key=lambda r: (len(rules[r].name), len(rules[r].host), [-c for c in rules[r].name.encode()]))


def _judge(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], globs: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    machine = Automaton([r.glob() for r in rules] + [g.encode() for g in globs])
    names = pa.array([r.name for r in rules], pa.string())
    verdicts = pa.array([*(r.verdict for r in rules), "block", "allow"], pa.string())
    for b in batches:
        found = machine.run(*canonical(*b.columns[1:4]))
        rule = np.full(len(found), -1)
        for r in by_strength(rules):
            rule[found[:, r]] = r
        none = rule < 0
        verdict = np.where(none, np.where(found[:, len(rules):].any(1), len(rules), len(rules) + 1), rule)
        yield common.batch(RESULT, b.column(0), b.column(1), b.column(2), names.take(pa.array(rule, mask=none)), verdicts.take(pa.array(verdict)))


def split(url: Column) -> list[Column]:
    """Host (A-Z lower-cased), path and query of a URL; empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return [F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER).alias("host"),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract(rest, "^[^?#]*[?]([^#]*)", 1).alias("query")]


def parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path and query of every row."""
    return common.take(pages, page_id="bigint", url="string").select("page_id", *split(F.col("url")))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, globs: tuple[str, ...] = GLOBS) -> DataFrame:
    """One row a page: host, path, the rule that decides (null: none) and the verdict."""
    return parts(pages).mapInArrow(partial(_judge, rules=tuple(rules), globs=tuple(globs)), RESULT)


def _keep(batches, width: int, rules: tuple[Rule, ...], globs: tuple[str, ...]):
    """The first ``width`` columns of the rows that aren't blocked; host, path and query are the last three."""
    for b in batches:
        null = pa.nulls(len(b), pa.int64())
        asked = pa.RecordBatch.from_arrays([null, *b.columns[width:]], names=["page_id", "host", "path", "query"])
        verdict = next(_judge(iter([asked]), rules, globs)).column(4)
        kept = pa.RecordBatch.from_arrays(b.columns[:width], names=b.schema.names[:width])
        yield kept.filter(pc.equal(verdict, "allow"))


def allowed(pages: DataFrame, rules: tuple[Rule, ...] = RULES, globs: tuple[str, ...] = GLOBS) -> DataFrame:
    """The rows of ``pages`` whose URL isn't blocked, with all their columns."""
    flat = common.positional(pages)
    url = flat[f"c{pages.columns.index('url')}"].cast("string")
    asked = flat.select("*", *split(url))
    return asked.mapInArrow(partial(_keep, width=len(flat.columns), rules=tuple(rules), globs=tuple(globs)), flat.schema).toDF(*pages.columns)

"""Substring deduplication by recompression.

A text is a sequence of words, named by hash.  A round names pairs: the
symbols are split in two halves by a hash of their name, and each pair (left
half, right half) becomes one symbol named by its two parts; later rounds first
name runs of one symbol.  Names depend on content alone, so they are the same
in every task without a dictionary, and the inside of equal substrings gets
equal symbols wherever they stand.

1. *Long repeats.*  After more rounds symbols span dozens of words, in the end
   the whole text.  Equal names reveal and verify equal stretches: every window
   inside a symbol that an earlier document has too is repeated.
2. *Anchors.*  Whether a word boundary lies inside a pair after three rounds
   depends on the four words on either side.  Of the 8-word stretches of a
   window, the one around the boundary that lasted longest (the smallest hash
   among equals) is the window's anchor; equal windows have equal anchors.  Only
   windows whose anchor occurs in several documents can be repeated.
3. *Windows.*  Those that are neither inside a long repeat nor without a shared
   anchor are compared by the hash of all their words: a window is repeated if
   the smallest document that has it is smaller than its own.

Each task sends a symbol, anchor or window once, with its smallest document;
what it finds repeated itself it need not ask for.  So one that a third of all
documents have is a few rows, and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import size_checked, store
from tillpoint.llm.textscan import Words, blocks, mix, powers

WINDOW, STRETCH = 13, 8
#: Rounds without runs, which anchors use; rounds after which symbols are compared, the whole text besides.
LOCAL_ROUNDS, SYMBOL_ROUNDS = 3, (14, 20)
#: Words of a symbol that is compared: shorter ones hold too few windows.
LEAST_SYMBOL = 2 * WINDOW
#: Anchors or windows that a task holds before it sends them.
CHUNK = 1_000_000
_STEP = 0x9E3779B97F4A7C15
_C, _BACK = np.uint64(_STEP), pow(_STEP, -1, 1 << 64)


class Parse:
    """Symbols of many texts: ``name``, ``start`` and ``end`` (words), ``doc``; ``lasted``: the rounds that each word boundary outlived."""

    def __init__(self, words: Words):
        self.words, self.n = words, len(words.hash)
        self.name, self.start, self.doc = words.hash.copy(), np.arange(self.n), words.doc
        self.end = self.start + 1
        self.lasted = np.full(self.n, LOCAL_ROUNDS)
        self.round = 0

    def pairs(self) -> np.ndarray:
        """Name the pairs; the words at which a boundary went."""
        level = np.uint64((self.round + 1) * _STEP % (1 << 64))
        left = mix(self.name ^ level) >> np.uint64(63) != 0
        at = np.flatnonzero(left[:-1] & ~left[1:] & (self.doc[:-1] == self.doc[1:]))
        self.name[at] = mix((self.name[at] * _C + self.name[at + 1]) ^ level)
        self.end[at] = self.end[at + 1]
        gone = self.start[at + 1]
        self._keep(np.delete(np.arange(len(self.name)), at + 1))
        self.round += 1
        return gone

    def runs(self) -> None:
        same = (self.name[1:] == self.name[:-1]) & (self.doc[1:] == self.doc[:-1])
        if same.any():
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(np.append(begin, len(self.name)))
            name = self.name[begin]
            self.name[begin] = np.where(size > 1, mix(name + size.astype(np.uint64) * _C), name)
            self.end[begin] = self.end[begin + size - 1]
            self._keep(begin)

    def _keep(self, at: np.ndarray) -> None:
        self.name, self.start, self.end, self.doc = self.name[at], self.start[at], self.end[at], self.doc[at]

    def local(self) -> Parse:
        for k in range(LOCAL_ROUNDS):
            self.lasted[self.pairs()] = k
        return self

    def symbols(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``(doc, name, start, size)`` of the symbols that are compared, round by round up to whole texts."""
        while len(self.name):
            one = np.bincount(self.doc, minlength=self.words.n)[self.doc] == 1
            size = self.end - self.start
            take = (size >= LEAST_SYMBOL) & (one | (self.round in SYMBOL_ROUNDS))
            if take.any():
                yield self.doc[take], mix(self.name[take] + _C), self.start[take], size[take]
            if one.any():  # whole texts are done
                self._keep(np.flatnonzero(~one))
            self.runs()
            self.pairs()


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h)
    run = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(_STEP, n))])
    return mix((run[size:] - run[:-size]) * powers(_BACK, n)[:n - size + 1])


def anchors(words: Words, lasted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(start, key)`` of every window: the key of its anchor."""
    n = len(words.hash)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    half = STRETCH // 2
    rank = (LOCAL_ROUNDS - lasted[half:n - half + 1]).astype(np.uint64)
    low = (rank << np.uint64(62)) | (_rolling(words.hash, STRETCH) >> np.uint64(2))
    left, have = WINDOW - STRETCH + 1, 1
    while have < left:
        step = min(have, left - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    start = np.flatnonzero(words.doc[:n - WINDOW + 1] == words.doc[WINDOW - 1:])
    return start, low[start]


ASK, SEVERAL, KNOWN, SYMBOL, SYMBOL_KNOWN = range(5)
_ROWS = "part long, doc long, turn long, code int"


def _once(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(key, doc)``, whether the doc is the key's smallest, and whether the key has several docs."""
    order = np.lexsort((doc, key))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    doc, key = doc[new], key[new]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, len(key)))
    return doc, key, head, np.repeat(size > 1, size)


def _rows(doc: np.ndarray, key: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``part``: the key, by which rows meet, or for what is known a spread of it; ``part ^ turn`` is the key."""
    known = (code == KNOWN) | (code == SYMBOL_KNOWN)
    turn = np.where(known, mix(doc.view(np.uint64) + key), np.uint64(0))
    order = np.argsort(doc, kind="stable")  # neighbours of one document take less room
    doc, key, turn, code = doc[order], key[order], turn[order], code[order]
    for a in range(0, len(doc), 100_000):
        s = slice(a, a + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array((key[s] ^ turn[s]).view(np.int64)), pa.array(doc[s]), pa.array(turn[s].view(np.int64)), pa.array(code[s].astype(np.int32))],
                                         ["part", "doc", "turn", "code"])


def _send(held_doc: list, held_key: list, head_code: int, several_code: int, other_code: int) -> Iterator[pa.RecordBatch]:
    doc, key, head, several = _once(np.concatenate(held_doc), np.concatenate(held_key))
    yield from _rows(doc, key, np.where(~head, other_code, np.where(several, several_code, head_code)))


def _chunks(batches: Iterator[pa.RecordBatch], each: Callable) -> Iterator[pa.RecordBatch]:
    """``each(batch, a, b, texts)`` gives ``(doc, key)`` of windows and of symbols; they are sent chunk by chunk."""
    held, size = ([], [], [], []), 0

    def send() -> Iterator[pa.RecordBatch]:
        yield from _send(held[0], held[1], ASK, SEVERAL, KNOWN)
        if held[2]:
            yield from _send(held[2], held[3], SYMBOL, SYMBOL, SYMBOL_KNOWN)

    for batch in batches:
        for a, b, texts in blocks(batch, 0):
            for to, got in zip(held, each(batch, a, b, texts), strict=True):
                to.extend(got)
            size += len(held[0][-1]) if held[0] else 0
            if size > CHUNK:
                yield from send()
                held, size = ([], [], [], []), 0
    if held[0]:
        yield from send()


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(text, doc)`` to the rows of its anchors and symbols."""
    def each(batch, a, b, texts):
        ids = np.asarray(batch.column(1)[a:b])
        w = Words(texts)
        parse = Parse(w).local()
        start, key = anchors(w, parse.lasted)
        doc = w.doc[start]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        symbols = list(parse.symbols()) if parse.n else []
        return [ids[doc[new]]], [key[new]], [ids[s[0]] for s in symbols], [s[1] for s in symbols]
    return _chunks(batches, each)


def _within(keys: np.ndarray, doc: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each ``(doc, key)`` is in its document's list."""
    size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    marked = np.asarray(lists.flatten()).view(np.uint64)
    owner = np.repeat(np.arange(len(lists)), size)
    # One number a pair: equal numbers of different pairs are as rare as equal hashes.
    both = np.sort(mix(marked ^ (owner.astype(np.uint64) * _C)))
    want = mix(keys ^ (doc.astype(np.uint64) * _C))
    at = np.searchsorted(both, want)
    return (both[np.minimum(at, len(both) - 1)] == want) if len(both) else np.zeros(len(want), bool)


def _inside(w: Words, parse: Parse, lists: pa.Array) -> np.ndarray:
    """Whether a window that starts at each word lies inside a symbol of its document's list."""
    change = np.zeros(parse.n + 1, np.int64)
    for doc, name, start, size in parse.symbols() if parse.n else ():
        hit = _within(name, doc, lists)
        np.add.at(change, start[hit], 1)
        np.add.at(change, start[hit] + size[hit] - WINDOW + 1, -1)
    return np.cumsum(change[:-1]) > 0


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(text, doc, shared, long)`` to the rows of the windows that must be compared."""
    def each(batch, a, b, texts):
        ids = np.asarray(batch.column(1)[a:b])
        w = Words(texts)
        parse = Parse(w).local()
        start, key = anchors(w, parse.lasted)
        left = _within(key, w.doc[start], batch.column(2)[a:b]) & ~_inside(w, parse, batch.column(3)[a:b])[start]
        start = start[left]
        return [ids[w.doc[start]]], [_rolling(w.hash, WINDOW)[start] if len(start) else np.zeros(0, np.uint64)], [], []
    return _chunks(batches, each)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(text, doc, repeated, long)`` to ``(doc_id, n_words, n_removed, kept)``."""
    names = ["doc_id", "n_words", "n_removed", "kept"]
    for batch in batches:
        for a, b, texts in blocks(batch, 0):
            w = Words(texts)
            keep = np.ones(len(w.hash), bool)
            repeated, long = batch.column(2)[a:b], batch.column(3)[a:b]
            if len(w.hash) >= WINDOW and (len(repeated.flatten()) or len(long.flatten())):
                gone = _inside(w, Parse(w).local(), long)
                start = np.flatnonzero(w.doc[:len(w.hash) - WINDOW + 1] == w.doc[WINDOW - 1:])
                gone[start] |= _within(_rolling(w.hash, WINDOW)[start], w.doc[start], repeated)
                change = np.zeros(len(keep) + WINDOW + 1, np.int64)
                at = np.flatnonzero(gone)
                change[at] += 1
                change[at + WINDOW] -= 1
                keep = np.cumsum(change)[:len(keep)] <= 0
            kept = []
            for i, text in enumerate(texts):
                stay = keep[w.first[i]:w.first[i + 1]]
                words = text.split()
                kept.append(b" ".join(words if stay.all() else compress(words, stay.tolist())).decode())
            n = np.diff(w.first)
            left = np.bincount(w.doc[keep], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], pa.array(n, pa.int64()), pa.array(n - left, pa.int64()), pa.array(kept, pa.string())], names)


def _answered(rows: DataFrame) -> DataFrame:
    """Rows to ``(doc, key, symbol)``: what is shared (anchors), repeated (symbols)."""
    met = rows.selectExpr("part", "doc", "turn", "code", "min(doc) over (partition by part) as low", "max(doc) over (partition by part) as high",
                          "max(code) over (partition by part) as most")
    yes = "code in (1, 2, 4) or (code = 0 and (low <> high or most = 1)) or (code = 3 and low < doc)"
    return met.filter(yes).selectExpr("doc", "part ^ turn as key", "code >= 3 as symbol")


def _lists(rows: DataFrame, first: str, second: str) -> DataFrame:
    return rows.groupBy("doc").agg(F.collect_list(F.when(~F.col("symbol"), F.col("key"))).alias(first), F.collect_list(F.when(F.col("symbol"), F.col("key"))).alias(second))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``(doc_id, n_words, n_removed, kept)``: without the words of windows that start in a smaller document too.

    Windows are judged on the input.  A null text has no words; a text under
    13 words has no window.  A row without id is neither cut nor compared with.
    Rows of one id are one document; each is a row of the result.  Other columns
    are ignored.  An empty table gives no rows.
    """
    texts = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc"))
    known = texts.filter("doc is not null and text is not null")
    marks = store(_lists(_answered(known.mapInArrow(_ask, _ROWS)), "shared", "long"), "shared-anchors")
    asked = marks.filter(F.size("shared") > 0)
    # Texts without a shared anchor need not be moved.
    some = known.join(size_checked(asked.select("doc"), 2_000_000), "doc", "left_semi")
    windows = some.join(asked, "doc").select("text", "doc", "shared", "long").mapInArrow(_compare, _ROWS)
    again = windows.selectExpr("part", "doc", "turn", "code", "min(doc) over (partition by part) as low").filter("code = 2 or low < doc")
    again = again.selectExpr("doc", "part ^ turn as key", "false as symbol")
    long = marks.filter(F.size("long") > 0).select("doc", F.explode("long").alias("key"), F.lit(True).alias("symbol"))
    gone = store(_lists(again.unionByName(long), "repeated", "long"), "repeated-windows")
    cut = size_checked(gone.select("doc"), 2_000_000)
    none = F.array().cast("array<bigint>")
    whole = texts.join(cut, "doc", "left_anti").select("text", "doc", none.alias("repeated"), none.alias("long"))
    less = texts.join(cut, "doc", "left_semi").join(gone, "doc").select("text", "doc", "repeated", "long")
    schema = "doc_id long, n_words long, n_removed long, kept string"
    return whole.mapInArrow(_cut, schema).unionByName(less.mapInArrow(_cut, schema))

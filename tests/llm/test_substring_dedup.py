from __future__ import annotations

import random
import re

import numpy as np

from tests.llm.util import docs, prose
from tillpoint.llm import substring_dedup as sd
from tillpoint.llm.textscan import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first = {}
    for doc, text, *_ in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - 12):
            if doc is not None:
                g = tuple(w[i:i + 13])
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w = WORD.findall(text or "")
        gone = {k for i in range(len(w) - 12) if doc is not None and first[tuple(w[i:i + 13])] < doc for k in range(i, i + 13)}
        out.append((doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def run(spark, rows, parts=4, **kw):
    return sorted((tuple(r) for r in sd.dedup(docs(spark, rows, **kw).repartition(parts)).collect()), key=str)


def corpus(seed=3):
    r, rows = random.Random(seed), []
    passages = [prose(9000 + i, r.choice([12, 13, 14, 20, 60, 300]), 10 ** 6) for i in range(12)]
    for d in range(90):
        bits = []
        for k in range(r.randrange(1, 5)):
            bits += [prose(d * 50 + k, r.choice([0, 1, 3, 20, 90]), 10 ** 6), r.choice(passages)]
            if r.random() < 0.4:
                w = bits.pop().split()
                a = r.randrange(len(w))
                bits.append(" ".join(w[a:a + r.randrange(5, 40)]))
        rows.append("\n".join(bits))
    rows += rows[:8] + ["to " * 40, "to " * 13, "to " * 12, "a b " * 30, "b a " * 30, "x " + "to " * 25 + "y", "", None, " \t", "é " * 20, "z" * 9000, prose(1, 6000, 3)]
    r.shuffle(rows)
    return [(5 * i, t) for i, t in enumerate(rows)]


def test_equals_brute_force(spark):
    rows = corpus()
    assert run(spark, rows, extra=True) == brute(rows)


def test_small_chunks_ask_across_tasks(spark, monkeypatch):
    rows = corpus(8)
    one = run(spark, rows, parts=1)
    many = run(spark, rows, parts=13)
    assert one == many == brute(rows)


def test_odd_rows(spark):
    text = prose(2, 40, 10 ** 6)
    rows = [(4, text), (4, text), (None, text), (6, text), (7, "case " + text.upper())]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_inner_symbols_are_consistent():
    """The symbols inside a passage do not depend on what surrounds it."""
    passage = prose(5, 120, 10 ** 6)
    texts = [f"{prose(s, 7 * s)} {passage} {prose(50 + s, 5 * s)}".encode() for s in range(1, 6)]
    w = Words(texts)
    p = sd.Parse(w).local()
    inner = []
    for i in range(len(texts)):
        begin = w.first[i] + len(prose(i + 1, 7 * (i + 1)).split())
        mine = (p.doc == i) & (p.start >= begin + 8) & (p.end <= begin + 112)
        inner.append(p.name[mine].tolist())
    assert all(x == inner[0] for x in inner) and len(inner[0]) > 20


def test_whole_text_becomes_one_symbol():
    texts = [b"to " * 100, prose(3, 500).encode(), prose(3, 500).encode()]
    whole = {}
    for doc, name, start, size in sd.Parse(Words(texts)).local().symbols():
        for d, m, s, z in zip(doc, name, start, size, strict=True):
            if s == np.searchsorted(Words(texts).doc, d) and z == (100 if d == 0 else 500):
                whole[int(d)] = int(m)
    assert whole[1] == whole[2] and whole[0] != whole[1]

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tests.llm.util import docs, prose
from tillpoint.llm import jaccard
from tillpoint.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=5, threshold=75):
    sets = {}
    for doc, text, *_ in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    low = {d: d for d in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def edited(text, edits, seed):
    w, r = text.split(), random.Random(seed)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
    return " ".join(w)


def corpus():
    """Copies, near copies around the threshold, long and short texts, shared passages, a hot group."""
    r, rows = random.Random(4), []
    line = prose(999, 14, 10 ** 6)
    for b in range(25):
        n = r.choice([5, 6, 9, 20, 33, 64, 65, 150, 400])
        text = prose(b, n, 10 ** 6)
        for k in range(r.randrange(1, 6)):
            rows.append(edited(text, r.randrange(0, max(2, n // 16)), b * 100 + k) if k else text)
        rows.append(text.upper())
        rows.append(line + "\n" + prose(b + 500, r.choice([2, 5, 60]), 10 ** 6))
    base = prose(77, 120, 10 ** 6)
    rows += [edited(base, 3, 7000 + k) for k in range(60)] + [base] * 20 + [" ".join(base.split()[:100])]
    rows += ["to to to to to to to to", "to " * 300, "", None, " \t\n", "a", "A", "a b", "b a", "é à", "x" * 9000]
    r.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("bounds", [(16, 1024), (2, 6)])
def test_equals_brute_force(spark, monkeypatch, bounds):
    monkeypatch.setattr(jaccard, "CLASS_BOUNDS", bounds)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, rows, extra=True).repartition(5)).collect()}
    assert got == brute(rows)


def test_comparison_in_full_without_representatives(spark):
    rows = corpus()
    frame = docs(spark, rows)
    every = jaccard.profiles(frame, 5, 75, "doc_id", "text").filter("passed").groupBy("fp").min("doc_id").toDF("fp", "doc")
    texts = frame.join(every, frame.doc_id == every.doc).select("text", "fp")
    sets = jaccard.store(texts.mapInArrow(jaccard._sets(5), "fp long, n long, hashes array<long>"), "test")
    as_groups = lambda df: sorted(sorted(r.nodes) for r in df.groupBy("component").agg({"node": "collect_set"}).toDF("c", "nodes").collect())
    assert as_groups(jaccard.linked_sets(sets, 75, rounds=0)) == as_groups(jaccard.linked_sets(sets, 75))


def test_signatures_meet_for_every_linked_pair():
    r = np.random.default_rng(2)
    for _ in range(400):
        n = int(r.integers(1, 300))
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        out = r.random(len(x)) < r.random() * 0.3
        y = np.unique(np.concatenate([x[~out], r.integers(0, 1 << 63, int(out.sum() * r.random()), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not both or 100 * both < 75 * (len(x) + len(y) - both):
            continue
        klass = lambda h: 1 + (h % np.uint64(7) // np.uint64(3)).astype(np.int64)
        small, large = sorted((x, y), key=len)
        (sig, core), (other, _) = jaccard.signatures(small, klass(small), 75), jaccard.signatures(large, klass(large), 75)
        assert len(np.intersect1d(sig[core], other))


def test_odd_rows(spark):
    text = prose(1, 50)
    rows = [(5, text), (5, text), (None, text), (9, text), (None, None), (2, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 46, 5), (5, 46, 5), (None, 46, None), (9, 46, 5), (None, 0, None), (2, 0, 2)], key=str)
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 400), (600, 600)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 130)} == {100} and got[500] == 400 and 600 not in got


def test_copies_whose_original_is_missing(spark, monkeypatch):
    """Near copies of one text that is not there: most are no copies of each other, and few of their pairs are compared."""
    r, made = random.Random(9), []
    real = jaccard.store

    def store(df, name):
        out = real(df, name)
        if name == "candidates":
            made.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "store", store)
    base = [f"w{r.randrange(10 ** 5)}" for _ in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(3):
            w[r.randrange(150)] = f"e{r.randrange(10 ** 9)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in jaccard.near_duplicates(docs(spark, rows)).collect()}
    assert got == {d: c for d, (_, c) in brute(rows).items()}
    assert made[-1] < 160 * 159 / 2 * 0.05


def test_long_sets_far_from_their_representative(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONGEST", 20)  # differences too long to carry: pairs are compared all the same
    r, rows = random.Random(10), []
    base = [f"w{r.randrange(10 ** 5)}" for _ in range(120)]
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(120)] = f"e{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in jaccard.near_duplicates(docs(spark, rows)).collect()}
    assert got == {d: c for d, (_, c) in brute(rows).items()}

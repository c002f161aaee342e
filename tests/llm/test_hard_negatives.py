from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillpoint.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, part string, score string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def whole(x):
    y = 256 * x
    return math.floor(y) if math.isfinite(y) else int(x) * 256


def brute(rows, is_anchor, positives=5, negatives=10):
    rows = [(i, label, [whole(x) for x in v]) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    long = lambda s: s if -(1 << 63) <= s < 1 << 63 else None
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in rows if is_anchor(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in rows if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            wanted = [(n, t) for t, n, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, p, k + 1, n, long(-s), long(-t)) for k, (n, t) in enumerate(wanted[:negatives])]
    return sorted(out, key=repr)


def got(spark, rows, every=5, **more):
    df = hn.hard_negatives(table(spark, rows), F.col("vec_id") % every == 0, **more)
    return sorted([tuple(r) for r in df.collect()], key=repr)


def vectors(seed, n, size=12, labels=3, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(size)] for _ in range(labels)]
    return [(i, [float(np.float32(spread * (c + r.gauss(0, 1.2)))) for c in centres[i % labels]], r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("spread", [1e-3, 0.1, 1.0, 3e4, 1e12])
def test_packed_scores_are_exact(spread):
    rng = np.random.default_rng(3)
    a, c = np.floor(rng.normal(0, 256 * spread, (7, 20))), np.floor(rng.normal(1, 200 * spread, (45, 20)))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in c] for p in a]
    assert hn.packed_scores(a, c).tolist() == want
    assert hn.packed_scores(np.floor(a * 0), c).tolist() == [[0] * 45] * 7


def test_equals_brute_force(spark):
    rows = vectors(1, 300)
    assert got(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    assert len(got(spark, rows)) > 500


def test_cells_of_the_grid_give_the_same(spark, monkeypatch):
    rows = vectors(2, 240, spread=0.1)
    monkeypatch.setattr(hn, "GROUP", 32)
    monkeypatch.setattr(hn, "ANCHORS", 9)
    assert got(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_ties_repeats_nulls_and_odd_values(spark):
    same = [(i, [0.5, 0.25, -0.125], i % 2) for i in range(40)]
    odd = [(None, [1.0, 1.0, 1.0], 1), (50, None, 1), (55, [1.0, None, 0.0], 1), (60, [float("nan"), 1.0, 1.0], 1), (65, [float("inf"), 1.0, 1.0], 0),
           (70, [1.0, 1.0, 1.0], None), (75, [], 1), (80, [0.5], 0), (85, [0.0, 0.0, 0.0], 1), (90, [-0.5, -0.5, 0.3], 0), (95, [0.2, 0.3, 0.4, 0.5], 1)]
    rows = same + odd + [(100, [0.4, 0.1, 0.1], 0)] * 3 + [(101, [0.4, 0.1, 0.1], 0)] * 7 + [(102, [0.2, 0.1, 0.1], 1)] * 14
    assert got(spark, rows) == brute(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("large", [1e6, 1e12, 1e300, 1.5e308])
def test_a_large_vector_changes_no_other_score(spark, large):
    rows = vectors(4, 80, size=5) + [(200, [large, 1.0, 0.5, 0.0, 0.0], 0), (201, [-large, 0.5, 0.5, 1.0, 0.0], 1), (205, [large / 2, 1.0, 0.0, 0.5, 0.0], 1)]
    assert got(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_sortable_scores_order_and_return():
    r = random.Random(5)
    scores = sorted(r.choice([-1, 1]) * r.randrange(10 ** r.randrange(1, 40)) for _ in range(300))
    keys = [hn.sortable(s) for s in scores]
    assert [hn.score_of(*k) for k in keys] == scores
    assert [(k[1], k[0] or 0, k[2]) for k in keys] == sorted((k[1], k[0] or 0, k[2]) for k in keys)


def test_empty_and_without_anchors(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0], 0), (2, [1.0], 0)]) == []
    assert got(spark, [(5, [1.0], 0)]) == []

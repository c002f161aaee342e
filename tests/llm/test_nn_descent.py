from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillpoint.llm import nn_descent as nn

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, k=10):
    dim = 8
    keep = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in keep:
        if q % 10 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in keep if i != q)[:k]
            out[q] = [(i, d) for d, i in near]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA).withColumn("id", F.lit("clash")).withColumn("query", F.lit("clash"))


def run(spark, rows):
    got = {}
    for r in nn.nearest(table(spark, rows), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_recall_and_scores(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.3 * r.normal(size=8)).tolist()) for i in range(1500)]
    got, want = run(spark, rows), exact(rows)
    assert set(got) == set(want)
    hit = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.97 * 10 * len(want)
    at = dict(rows)
    for q, found in got.items():
        assert [k for k, _, _ in found] == list(range(1, 11))
        for _, i, s in found:
            x, y = (np.array(at[z], np.float32).astype(float) for z in (q, i))
            assert s == pytest.approx(float(np.sqrt(((x - y) ** 2).sum())), abs=1e-12)


def test_copies_ties_and_vectors_that_take_no_part(spark):
    r = np.random.default_rng(2)
    hot = r.normal(size=8).tolist()
    rows = [(i, hot) for i in range(0, 300)] + [(i, r.normal(size=8).tolist()) for i in range(300, 400)]
    rows += [(1000, None), (1010, [0.0] * 8), (1020, [1.0] * 7 + [None]), (1030, [float("nan")] * 8), (1040, [float("inf")] + [1.0] * 7), (1050, [1.0] * 5), (1060, []), (None, hot)]
    got, want = run(spark, rows), exact(rows)
    assert set(got) == set(want)
    for q in range(0, 300, 10):
        assert [i for _, i, _ in got[q]] == [i for i, _ in want[q]]


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0] * 8), (10, [2.0] * 8), (13, [4.0] * 8)]
    assert {q: [i for _, i, _ in v] for q, v in run(spark, rows).items()} == {0: [10, 13], 10: [0, 13]}
    assert run(spark, [(0, [1.0] * 8)]) == {} and run(spark, []) == {}


def test_near_equal_vectors_and_a_huge_one(spark):
    r = np.random.default_rng(3)
    group = r.normal(size=8)
    group /= np.linalg.norm(group)
    rows = [(i, (group + 1e-5 * r.normal(size=8)).tolist()) for i in range(2000)]
    centres = r.normal(size=(12, 8))
    rows += [(i, (centres[i % 12] + 0.3 * r.normal(size=8)).tolist()) for i in range(2000, 3000)]
    rows += [(3000, [1e8] + [1.0] * 7)]
    got, want = run(spark, rows), exact(rows)
    assert set(got) == set(want)
    recall = []
    for low, high in ((0, 2000), (2000, 3000)):
        asked = [q for q in want if low <= q < high]
        recall.append(sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in asked) / (10 * len(asked)))
    assert min(recall) >= 0.95, recall


@pytest.mark.parametrize("large", [1e300, 1.7e308])
def test_one_vector_beyond_floats_changes_no_other_answer(spark, large):
    r = np.random.default_rng(4)
    centres = r.normal(size=(9, 8))
    rows = [(i, (centres[i % 9] + 0.3 * r.normal(size=8)).tolist()) for i in range(1200)]
    more = [*rows, (1201, [large] + [1.0] * 7), (1202, [1e-300] * 8), (1210, [-large / 2] * 8)]
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in more], "vec_id long, embedding array<double>, label int")
    got = {}
    for x in nn.nearest(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    keep = np.array([v for _, v in rows])
    hit = [len({int(k) for k in np.argsort(np.sqrt(((keep - keep[q]) ** 2).sum(1)))[1:11]} & set(got[q])) for q in range(0, 1200, 10)]
    assert sum(hit) >= 0.95 * 10 * len(hit) and 1210 in got


def test_shortened_vectors_come_back():
    x = np.array([[1e300, 1.0, -3e299], [1e-310, 0.0, 5e-311], [0.5, -0.25, 3.0]])
    back = nn._matrix(__import__("pyarrow").array(nn.shortened(x)))
    assert np.allclose(back[0], [1e300, 0, -3e299], rtol=1e-7, atol=1e293) and np.allclose(back[2], x[2]) and back[1, 0] == pytest.approx(1e-310, rel=1e-6)
    d = nn._apart(back)
    assert d[0, 2] == pytest.approx(np.hypot(1e150, 3e149) * 1e150, rel=1e-6) and d[1, 2] == pytest.approx(float(np.sqrt((x[2] ** 2).sum())))

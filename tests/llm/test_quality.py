from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.util import docs, prose
from tillpoint.llm import quality


def junk(seed):
    r = random.Random(seed)
    return [" ".join(["spam"] * 80), " ".join(f"W{r.randrange(300)}!!" for _ in range(60)).upper(), " ".join(f"w{r.randrange(300)}###" for _ in range(60))][seed % 3]


def rows(n):
    return [(i, junk(i) if i % 4 == 0 else prose(i, 30 + i % 90)) for i in range(n)]


def labelled(spark, n):
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")


def test_interactions_equal_the_sum_over_pairs():
    first, index, value = quality.features([b"one two three two", b"", "für ÄÖ x ".encode() * 9])
    m = quality.Machine()
    m.linear, m.bias = np.random.default_rng(1).normal(size=quality.N_FEATURES), 0.3
    for r, got in enumerate(m.raw(first, index, value)):
        i, x = index[first[r]:first[r + 1]], value[first[r]:first[r + 1]].astype(float)
        v = m.factors[:, i]
        pairs = sum((v[:, a] @ v[:, b]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(got, 0.3 + m.linear[i] @ x + pairs)


def test_held_out_accuracy(spark):
    df = docs(spark, rows(900))
    scored = quality.score(df, quality.train(df, labelled(spark, 900))).withColumn("held_out", quality.held_out())
    got = scored.filter("held_out").collect()
    assert len(got) > 120 and np.mean([(r.score >= 0.3) == (r.doc_id % 4 != 0) for r in got]) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    df, labels = docs(spark, rows(300)), labelled(spark, 300)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(df, labels), quality.train(df.repartition(5), flipped)
    assert np.allclose(a.linear, b.linear) and np.allclose(a.factors, b.factors)


def test_edge_rows(spark):
    odd = [(1, None), (2, ""), (None, "a b"), (3, "x" * 50000), (3, "x" * 50000), (4, " \n ")]
    df = docs(spark, odd, extra=True)
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(df, quality.train(df, labels)).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    same = {r.text: r.score for r in got}
    assert same[None] == same[""]


def test_no_labels_and_no_documents(spark):
    df = docs(spark, [(1, "a")])
    machine = quality.train(df, labelled(spark, 0))
    assert quality.score(df, machine).first().score > 0
    assert quality.score(docs(spark, []), machine).count() == 0


def test_training_rows_are_given_back_to_the_system(spark, monkeypatch):
    real, held = quality.pa.default_memory_pool(), []

    class Pool:
        def release_unused(self):
            held.append(real.bytes_allocated())
            real.release_unused()
    before = real.bytes_allocated()
    monkeypatch.setattr(quality.pa, "default_memory_pool", Pool)
    for n in (60, 0):
        quality.train(docs(spark, rows(n) if n else []), labelled(spark, 60))
    assert held == [before, before]  # nothing of the rows is left when the pool is emptied

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.util import docs, prose
from tillpoint.llm import mixing


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Reshare the excess by weight, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else level * w[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    return target


ROWS = [(i, prose(i, (i * 13) % 300), ["a", "b", "c", None, "é", "Z"][min(5, i % 9)]) for i in range(300)]
ROWS += [(1000, None, "a"), (1001, "", "only-empty"), (1002, " \t\n", None), (7, ROWS[7][1], ROWS[7][2]), (None, "x y", "b"), (1003, prose(9, 20000), "c")]


def test_targets_taken_and_limits(spark):
    got = mixing.mixed_sizes(docs(spark, ROWS, extra=True)).collect()
    assert len(got) == len(ROWS)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += len((t or "").split())
    want = filled(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 64 + 1


def test_reruns_and_layouts_agree(spark):
    df = docs(spark, ROWS)
    key = lambda r: tuple(str(x) for x in r)
    a = sorted(mixing.mixed_sizes(df.repartition(2)).collect(), key=key)
    b = sorted(mixing.mixed_sizes(df.repartition(9)).collect(), key=key)
    assert a == b


def test_blocks_are_permuted_once_a_pass(spark):
    _, slots, _ = mixing.mix(docs(spark, ROWS))
    seen = defaultdict(list)
    for r in slots.collect():
        seen[r.source_key, r["pass"]].append(r.block)
    for blocks in seen.values():
        assert len(blocks) == len(set(blocks))
    assert len({r.shard for r in slots.collect()}) > 10


def test_empty_table(spark):
    assert mixing.mixed_sizes(docs(spark, [])).count() == 0


def test_small_sources_meet_their_targets(spark):
    sizes = {f"s{n:03d}": n for n in (*range(2, 20), 63, 64, 65, 66, 127, 128, 129, 130, 191, 193, 255, 257, 300)}
    rows = [(k, prose(k, n), s) for k, (s, n) in enumerate(sizes.items())]
    want = filled(sizes)
    taken = {r.source: r.taken for r in mixing.mixed_sizes(docs(spark, rows)).collect()}
    assert {s: taken[s] - want[s] for s in sizes if abs(taken[s] - want[s]) > 0.5 + 1e-6} == {}
    _, slots, _ = mixing.mix(docs(spark, rows))
    seen = [(r.source_key, r["pass"], r.block) for r in slots.collect()]
    assert len(seen) == len(set(seen))


def test_permutations_are_one_to_one_at_any_size(spark):
    for n in (1, 2, 3, 5, 64, 97, 4095, 4096, 10_007):
        df = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(n * 7).cast("long")).alias("p"))
        r = df.agg(F.countDistinct("p").alias("d"), F.min("p").alias("lo"), F.max("p").alias("hi")).first()
        assert (r.d, r.lo, r.hi) == (n, 0, n - 1)
    for n in (2 ** 34, 2 ** 40 + 12345, 2 ** 51 + 1):
        df = spark.range(0, 200_000).select(mixing._permuted(F.col("id") * (n // 200_000), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p"))
        r = df.agg(F.countDistinct("p").alias("d"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.avg("p").alias("mean")).first()
        assert r.d == 200_000 and 0 <= r.lo < 0.01 * n and 0.99 * n < r.hi < n and abs(r["mean"] / n - 0.5) < 0.01


def test_offsets_over_many_runs_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 2)
    monkeypatch.setattr(mixing, "BUCKET_RUN", 3)
    rows = [(i, " ".join(["w"] * (i % 7)), "ab"[i % 2]) for i in range(200)]
    laid = mixing.mix(docs(spark, rows))[0].collect()
    for s in "ab":
        spans = sorted((r["at"], r["size"]) for r in laid if r["source"] == s and r["size"])
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]


def test_shards_reach_the_result(spark):
    rows = [(i, " ".join(["w"] * 90), "ab"[i % 2]) for i in range(60)]
    got = mixing.mixed_sizes(docs(spark, rows)).collect()
    assert all((len(r.shards) > 0) == (r.taken > 0) and all(0 <= x < 64 for x in r.shards) for r in got) and len({x for r in got for x in r.shards}) > 20

"""Hard negatives by Kronecker-packed products.

Vectors are lists of integers, and scores are exact integer inner products.
Several candidates' components, made non-negative by a bias, lie side by side
in fields of one wide integer.  One multiplication by an anchor's component
(biased as well) multiplies all of them; a field is wide enough for the sum
over all components, so the fields of the sum never run into each other.
Taking the fields apart and the biases off gives the exact scores.

Numbers of usual size are packed into the 53 bits of a double, where sums of
products are exact integers and a matrix product does the additions.  Larger
ones, of any size, are packed into Python's wide integers.

Work is a grid: candidates in parts of some ``GROUP`` rows, anchors in blocks of
some ``ANCHORS`` rows, both dealt by hash, so neither a frequent label nor a
frequent vector makes a task larger.  Positives need only parts of the anchor's
label; negatives need all parts.  A cell of the grid returns its own best few,
and the best of those are the answer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import size_checked, store

GROUP, ANCHORS = 8192, 4096
#: Anchors whose scores are held at once; candidates to a wide integer.
STRIP, FIELDS = 256, 32
MANTISSA = 53
_KEY = ["anchor_id", "anchor_row"]
#: A score: its long value, or null beyond 64 bits, and then its digits in sortable form.
_SCORE = "score long, side int, wide string"


def packed_scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``c`` (integers as doubles, below 2 ** 53), or with Python's integers (dtype object)."""
    n, size = a.shape[1], len(c)
    if not n or not size or not len(a):
        return np.zeros((len(a), size), np.int64 if a.dtype != object else object)
    low_a, low_c = a.min(), c.min()
    most = int(a.max() - low_a) * int(c.max() - low_c) * n
    width = max(1, most.bit_length())
    in_double = a.dtype != object and c.dtype != object and width <= MANTISSA
    fields = MANTISSA // width if in_double else FIELDS
    if not in_double:
        a, c = a.astype(object), c.astype(object)
        a, c, low_a, low_c = (_whole(x) for x in (a, c, low_a, low_c))
    up = np.concatenate([c - low_c, np.zeros((-size % fields, n), c.dtype)]).reshape(-1, fields, n)
    wide = up[:, 0]
    for k in range(1, fields):
        wide = wide + up[:, k] * (2.0 ** (width * k) if in_double else 1 << width * k)
    sums = np.dot(a - low_a, wide.T)  # one product per anchor component and wide integer
    if in_double:
        sums = sums.astype(np.int64)
    mask, out = (1 << width) - 1, np.empty((len(a), wide.shape[0], fields), sums.dtype)
    for k in range(fields):
        out[:, :, k] = (sums >> width * k) & mask
    out = out.reshape(len(a), -1)[:, :size]
    exact = np.int64 if in_double else object
    as_is = (lambda x: x.astype(np.int64)) if in_double else (lambda x: x)
    return out.astype(exact) + as_is(a.sum(axis=1))[:, None] * int(low_c) + as_is((c - low_c).sum(axis=1))[None, :] * int(low_a)


def _whole(x):
    return np.frompyfunc(int, 1, 1)(x) if isinstance(x, np.ndarray) else int(x)


class Rows:
    """The vectors of a cell: ids, labels, copies, and integers; those that fit in a packed double apart from larger ones."""

    def __init__(self, table: pa.Table, scale: int):
        order = np.argsort(np.asarray(table["id"]), kind="stable")
        table = table.take(pa.array(order))
        self.table, self.n = table, len(order)
        self.id, self.label = np.asarray(table["id"]), np.asarray(table["label"])
        vecs = table["vec"].combine_chunks()
        sizes = np.asarray(vecs.value_lengths().fill_null(0)).astype(np.int64) if self.n else np.zeros(0, np.int64)
        flat = np.asarray(vecs.flatten(), np.float64) if self.n else np.zeros(0)
        self.wide_n = int(sizes.max()) if self.n else 0
        self.values = np.zeros((self.n, self.wide_n))
        self.values[np.arange(self.wide_n) < sizes[:, None]] = flat
        self.scale = scale

    def matrix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``(integers, which rows are small)``, each row filled up to ``n`` components with zeros."""
        filled = np.zeros((self.n, n))
        filled[:, :self.wide_n] = self.values
        with np.errstate(over="ignore"):
            scaled = np.floor(filled * self.scale)
        small = np.abs(scaled).max(axis=1, initial=0) <= 2 ** ((MANTISSA - max(1, n).bit_length()) // 2 - 1)
        return scaled, small

    def exact(self, rows: np.ndarray, n: int) -> np.ndarray:
        """Python integers of ``rows``: ``floor(scale * x)``, also where the product is no double."""
        filled = np.zeros((len(rows), n))
        filled[:, :self.wide_n] = self.values[rows]
        def one(x):
            y = x * self.scale
            return int(x) * self.scale if np.isinf(y) else int(np.floor(y))
        with np.errstate(over="ignore"):
            return np.frompyfunc(one, 1, 1)(filled).astype(object)


def score_strips(anchors: Rows, cands: Rows):
    """``(anchor rows, candidate rows, scores)``: exact scores of some anchors with some candidates, all pairs once."""
    n = max(anchors.wide_n, cands.wide_n)
    (a, small_a), (c, small_c) = anchors.matrix(n), cands.matrix(n)
    for rows_a, fast_a in ((np.flatnonzero(small_a), True), (np.flatnonzero(~small_a), False)):
        for rows_c, fast_c in ((np.flatnonzero(small_c), True), (np.flatnonzero(~small_c), False)):
            if not len(rows_c):
                continue
            for at in range(0, len(rows_a), STRIP):
                strip = rows_a[at:at + STRIP]
                if fast_a and fast_c:
                    yield strip, rows_c, packed_scores(a[strip], c[rows_c])
                else:
                    yield strip, rows_c, packed_scores(anchors.exact(strip, n), cands.exact(rows_c, n))


def sortable(score: int) -> tuple[int | None, int, str]:
    """``(long value or null, side, digits)`` such that side, value and digits order scores of any size."""
    if -(1 << 63) <= score < 1 << 63:
        return int(score), 0, ""
    digits = str(abs(score))
    if score > 0:
        return None, 1, f"{len(digits):05d}{digits}"
    return None, -1, f"{99999 - len(digits):05d}" + "".join(str(9 - int(d)) for d in digits)


def score_of(value: int | None, side: int, digits: str) -> int:
    if side == 0:
        return value
    return int(digits[5:]) if side > 0 else -int("".join(str(9 - int(d)) for d in digits[5:]))


def _first(scores: np.ndarray, chosen: np.ndarray, k: int) -> np.ndarray:
    """Of the candidates ``chosen`` (in order of id) the first ``k`` by score, ties by place."""
    s = scores[chosen]
    if s.dtype == object:
        return chosen[sorted(range(len(s)), key=lambda i: -s[i])[:k]]
    if len(s) > 8 * k:
        # Everything at least as good as the k-th, then in order.
        least = np.partition(s, len(s) - k)[len(s) - k]
        keep = np.flatnonzero(s >= least)
        chosen, s = chosen[keep], s[keep]
    return chosen[np.argsort(-s, kind="stable")[:k]]


def _emit(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


_OUT = {"anchor_id": pa.int64(), "anchor_row": pa.int64(), "place": pa.int32(), "id": pa.int64(), "copies": pa.int64(), "score": pa.int64(), "side": pa.int32(), "wide": pa.string()}
_OUT_SCHEMA = "anchor_id long, anchor_row long, place int, id long, copies long, " + _SCORE


def _positives(k: int, scale: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(left) and len(right):
            cands, anchors = Rows(left, scale), Rows(right, scale)
            copies, row = np.asarray(cands.table["copies"]), np.asarray(anchors.table["anchor_row"])
            for strip, at, scores in score_strips(anchors, cands):
                for i, s in zip(strip, scores, strict=True):
                    chosen = np.flatnonzero(cands.id[at] != anchors.id[i])
                    rows += [(int(anchors.id[i]), int(row[i]), 0, int(cands.id[at[j]]), int(copies[at[j]]), *sortable(int(s[j]))) for j in _first(s, chosen, k)]
        return _emit(rows, list(_OUT), list(_OUT.values()))
    return run


def _negatives(k: int, low: int, high: int, scale: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(left) and len(right):
            cands, anchors = Rows(left, scale), Rows(right, scale)
            copies, row, wanted = np.asarray(cands.table["copies"]), np.asarray(anchors.table["anchor_row"]), anchors.table["positives"].to_pylist()
            # The range of negative scores for each positive: low % to high % of its score, rounded inwards.
            ranges = [[(p["place"], -(-low * s // 100), high * s // 100) for p in ps for s in [score_of(p["score"], p["side"], p["wide"])]] for ps in wanted]
            for strip, at, scores in score_strips(anchors, cands):
                other = cands.label[at]
                for i, s in zip(strip, scores, strict=True):
                    mine = [r for r in ranges[i] if r[1] <= r[2]]
                    if not mine:
                        continue
                    # Of Python's integers if a bound is no 64-bit number.
                    if max(abs(x) for r in mine for x in r[1:]) >= 1 << 63:
                        s = s.astype(object)
                    within = np.flatnonzero((other != anchors.label[i]) & (s >= min(r[1] for r in mine)) & (s <= max(r[2] for r in mine)))
                    for place, a, b in mine:
                        chosen = within[(s[within] >= a) & (s[within] <= b)]
                        rows += [(int(anchors.id[i]), int(row[i]), place, int(cands.id[at[j]]), int(copies[at[j]]), *sortable(int(s[j]))) for j in _first(s, chosen, k)]
        return _emit(rows, list(_OUT), list(_OUT.values()))
    return run


def _ranked(found: DataFrame, k: int, out: str) -> DataFrame:
    """The first ``k`` of each anchor and place, a copy each, numbered from 1 in ``out``."""
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int")))).drop("copy", "copies")
    best = Window.partitionBy(*_KEY, "place").orderBy(F.desc("side"), F.desc("score"), F.desc("wide"), "id")
    return each.withColumn(out, F.row_number().over(best)).filter(F.col(out) <= k)


def taking_part(rows: DataFrame, anchors: Column, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``(id, label, vec, copies, anchor)``: the distinct rows that take part."""
    v = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("vec"),
                    F.coalesce(anchors, F.lit(False)).alias("anchor")).dropna()
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.filter(~F.exists("vec", odd)).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    return v.groupBy("id", "label", "vec").agg(F.count("*").alias("copies"), F.max("anchor").alias("anchor"))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
                   vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Rows where ``anchors`` holds are anchors.  A component ``x`` counts as ``floor(scale * x)``; a score is the exact
    inner product of such integers; higher scores come first, ties by smaller id.  An anchor's positives are its first
    ``positives`` rows of the same label and another id.  For each of them: the first ``negatives`` rows of other
    labels whose score is ``low`` to ``high`` percent of the positive's, numbered from 1 in ``rank``.

    Rows with a null id, label or vector, or a null or non-finite component take no part.  A shorter vector counts as
    filled up with zeros; an empty one scores 0 with all.  Repeated rows are repeated candidates; an anchor row that is
    repeated is answered once, rows of one id that differ are each an anchor.  A score beyond 64 bits is ranked exactly
    and given as null.  Other columns are ignored.  No anchors, or an empty table: no rows.
    """
    every = store(taking_part(rows, anchors, vec_id, embedding, label), "vectors")
    # Columns of their own, so that a cell's two sides can be told apart.
    own = [F.col(c).alias(c) for c in ("id", "label", "vec")]
    chosen = every.filter("anchor").select(*own, F.xxhash64("label", "vec").alias("anchor_row"))
    spread = F.xxhash64("id", "label", "vec")
    blocks = lambda n, per: F.greatest(F.ceil(n / F.lit(per)), F.lit(1)).cast("int")
    dealt = lambda column, n: F.pmod(column, n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    by_label = every.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("a")).filter("a > 0")
    by_label = store(by_label.select("label", blocks(F.col("n"), GROUP).alias("parts"), blocks(F.col("a"), ANCHORS).alias("blocks")), "labels")
    grid = size_checked(by_label, 100_000)
    key = ["label", "part", "block"]
    left = every.join(grid, "label").select("id", "label", "vec", "copies", dealt(spread, F.col("parts")).alias("part"), upto(F.col("blocks")).alias("block"))
    right = chosen.join(grid, "label").select(*own, "anchor_row", dealt(F.col("anchor_row"), F.col("blocks")).alias("block"), upto(F.col("parts")).alias("part"))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_positives(positives, scale), _OUT_SCHEMA)
    near = store(_ranked(found.drop("place").withColumn("place", F.lit(0)), positives, "nth").drop("place"), "positives")

    total = every.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("anchor").cast("long")), F.lit(0)).alias("a")).first()
    parts, count = F.lit(max(1, -(-total["n"] // GROUP))), F.lit(max(1, -(-total["a"] // ANCHORS)))
    wanted = near.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct(F.col("nth").alias("place"), "score", "side", "wide"))).alias("positives"))
    asked = chosen.withColumnRenamed("id", "anchor_id").join(wanted, _KEY).withColumnRenamed("anchor_id", "id")
    left = every.select("id", "label", "vec", "copies", dealt(spread, parts).alias("part"), upto(count).alias("block"))
    right = asked.select(*own, "anchor_row", "positives", dealt(F.col("anchor_row"), count).alias("block"), upto(parts).alias("part"))
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_negatives(negatives, low, high, scale), _OUT_SCHEMA)
    best = _ranked(found, negatives, "rank").select(*_KEY, "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.select(*_KEY, F.col("nth").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = best.join(named, [*_KEY, "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

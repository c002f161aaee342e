"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search in it.

Nodes are the distinct vectors; a vector's copies hang on its node.  The graph
starts from a few tables of blocks of similar vectors, whose members are
compared among themselves.  Each round then compares the neighbours of every
node (and those that have it as one) with each other: neighbours of neighbours
are likely neighbours.  A node keeps its ``degree`` nearest.  Rounds end when
few neighbours are new.

A search holds a pool of nodes for each query and replaces it, round by round,
with the nearest of the pool and of its nodes' neighbours.  Vectors travel as
floats, each scaled by a power of two of its own, and are compared in double
precision, so neither near-equal vectors nor a huge one change what the others'
distances say; the whole pool's distances are computed anew on the original
vectors before the answer.

Work is dealt in groups of bounded size, whose number grows with the table: a
group's vectors are sent to it once, however many of its nodes need them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import store

DEGREE = 30
TABLES, BLOCK = 4, 256
#: Centres to a group of the local join; queries to a group of the search.
CENTRES, QUERIES = 64, 4
#: Rounds end below this share of new neighbours, or after so many.
SETTLED, MOST_ROUNDS = 0.35, 7
POOL, SEARCH_ROUNDS = 256, 4
_EDGES = "a long, b long, d double"


def valid(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, vec)`` of the vectors that take part: with an id, of the most frequent length, finite and not zero."""
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec")).dropna()
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.filter(~F.exists("vec", odd) & F.exists("vec", lambda x: x != 0.0))
    v = v.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    sizes = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.filter(F.size("vec") == (sizes[0]["n"] if sizes else 0))


#: Components beyond this have no square in double precision.
LARGE = 2.0 ** 500


def shortened(x: np.ndarray) -> list[bytes]:
    """Each vector as floats, divided by a power of two of its own, and that power: no vector changes another's precision."""
    power = np.frexp(np.abs(x).max(axis=1, initial=0))[1] if len(x) else np.zeros(0, int)
    floats = np.ldexp(x, -power[:, None]).astype("<f4")
    return [f.tobytes() + p.tobytes() for f, p in zip(floats, power.astype("<i4"), strict=True)]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors that ``shortened`` wrote, in double precision."""
    if not len(column):
        return np.zeros((0, 1))
    raw = np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(len(column), -1)
    power = raw[:, -4:].copy().view("<i4")
    return np.ldexp(raw[:, :-4].copy().view("<f4").astype(float), power)


def _lengths(y: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the rows, also where squares would have no number."""
    most = np.abs(y).max(axis=1, initial=0)
    unit = np.where((most > LARGE) | ((most < 1 / LARGE) & (most > 0)), most, 1.0)
    y = y / unit[:, None]
    return unit * np.sqrt((y * y).sum(1))


def _apart(x: np.ndarray) -> np.ndarray:
    """Distances within ``x``; the products cancel for near-equal vectors, hence double precision."""
    large = np.abs(x).max(axis=1, initial=0) > LARGE
    small = np.where(large[:, None], 0.0, x) if large.any() else x
    own = (small * small).sum(1)
    d = np.sqrt(np.maximum(own[:, None] + own[None] - 2 * (small @ small.T), 0))
    for i in np.flatnonzero(large):
        d[i] = d[:, i] = _lengths(x / 2 - x[i] / 2) * 2
    return d


def _edges(a: list, b: list, d: list) -> pa.Table:
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return pa.table({"a": cat(a, np.int64), "b": cat(b, np.int64), "d": cat(d, np.float64)})


def _nearest(table: pa.Table, degree: int) -> pa.Table:
    """Distinct edges, the ``degree`` shortest of each ``a``."""
    a, b, d = (np.asarray(table.column(c)) for c in "abd")
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, d = a[new], b[new], d[new]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < degree
    return _edges([a[keep]], [b[keep]], [d[keep]])


def _block(degree: int):
    def run(table: pa.Table) -> pa.Table:
        ids, x = np.asarray(table.column("id")), _matrix(table.column("short"))
        if len(ids) < 2:
            return _edges([], [], [])
        d = _apart(x)
        np.fill_diagonal(d, np.inf)
        k = min(degree, len(ids) - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        return _edges([np.repeat(ids, k)], [ids[near].ravel()], [np.take_along_axis(d, near, 1).ravel()])
    return run


def _local_join(degree: int):
    def run(members: pa.Table, vectors: pa.Table) -> pa.Table:
        if not members.num_rows:
            return _edges([], [], [])
        ids, first = np.unique(np.asarray(vectors.column("node")), return_index=True)
        x, radius = _matrix(vectors.column("short"))[first], np.asarray(vectors.column("radius"))[first]
        centre, member = np.asarray(members.column("centre")), np.searchsorted(ids, np.asarray(members.column("id")))
        fresh = np.asarray(members.column("fresh"))
        order = np.argsort(centre, kind="stable")
        centre, member, fresh = centre[order], member[order], fresh[order]
        cuts = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1], [True]]))
        a, b, d = [], [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            m, f = member[s:e], fresh[s:e]
            if len(m) > 1 and f.any():
                near = _apart(x[m])
                i, j = np.nonzero((near < radius[m][:, None]) & (f[:, None] | f[None]) & (m[:, None] != m[None]))
                a.append(ids[m[i]])
                b.append(ids[m[j]])
                d.append(near[i, j])
        return _nearest(_edges(a, b, d), degree)
    return run


def _shortest(edges: DataFrame, degree: int) -> DataFrame:
    """``edges(a, b, d, old)`` to ``(a, b, d, fresh)``: the ``degree`` shortest of each ``a``."""
    edges = edges.groupBy("a", "b").agg(F.min("d").alias("d"), F.max("old").alias("old"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return edges.withColumn("place", place).filter(F.col("place") <= degree).select("a", "b", "d", "place", (F.col("old") == 0).alias("fresh"))


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, copies)``: ``(id, vec, short)`` of each distinct vector, by its smallest id, and ``(vec_id, id)`` of every vector."""
    vectors = store(vectors.withColumn("key", F.xxhash64("vec")), "vectors")
    nodes = vectors.groupBy("key", "vec").agg(F.min("vec_id").alias("id"))

    def shorten(batches):
        for batch in batches:
            v = batch.column(2)
            x = np.asarray(v.flatten()).reshape(len(v), -1) if len(v) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shortened(x), pa.binary())], ["id", "key", "vec", "short"])
    nodes = store(nodes.select("id", "key", "vec").mapInArrow(shorten, "id long, key long, vec array<double>, short binary"), "nodes")
    copies = vectors.join(nodes.select("id", F.col("key"), "vec"), ["key", "vec"]).select("vec_id", "id")
    return nodes.select("id", "vec", "short"), store(copies, "copies")


def _first_edges(nodes: DataFrame, n: int, degree: int) -> DataFrame:
    """Neighbours within blocks of vectors that lie on the same sides of random planes through the median of each component."""
    size = nodes.select(F.size("vec")).first()[0]
    middle = nodes.select(*[F.percentile_approx(F.get("vec", F.lit(i)), 0.5, 1000).alias(f"m{i}") for i in range(size)]).first()
    random, bits, tables = np.random.default_rng(3), max(0, int(np.ceil(np.log2(max(1, n / (0.75 * BLOCK)))))), []
    planes = random.normal(size=(TABLES, bits, size))
    middles = np.array(middle, float)

    def sides(batches):
        for batch in batches:
            v = batch.column(1)
            x = np.asarray(v.flatten()).reshape(len(v), -1) - middles
            for t in range(TABLES):
                cell = ((x @ planes[t].T) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), t, np.int32)), pa.array(cell.astype(np.int64))], ["id", "turn", "cell"])
    cells = store(nodes.select("id", "vec").mapInArrow(sides, "id long, turn int, cell long"), "cells")
    # A full cell is dealt out in several blocks.
    parts = cells.groupBy("turn", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    cells = cells.join(parts, ["turn", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "turn"), F.col("parts")))
    tables = cells.join(nodes.select("id", "short"), "id").select("turn", "cell", "part", "id", "short")
    found = tables.groupBy("turn", "cell", "part").applyInArrow(_block(degree), _EDGES)
    return store(_shortest(found.withColumn("old", F.lit(0)), degree), "graph")


def _around(graph: DataFrame, degree: int) -> DataFrame:
    """``(centre, id, fresh)``: each node's neighbours, and as many at most of the nodes that have it as one, drawn by hash."""
    there = graph.select(F.col("a").alias("centre"), F.col("b").alias("id"), "fresh")
    drawn = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b"), "a"))
    back = graph.select("a", "b", "fresh", drawn.alias("drawn")).filter(F.col("drawn") <= degree)
    return there.unionByName(back.select(F.col("b").alias("centre"), F.col("a").alias("id"), "fresh")).groupBy("centre", "id").agg(F.max("fresh").alias("fresh"))


def neighbour_graph(nodes: DataFrame, degree: int = DEGREE) -> DataFrame:
    """``(a, b, d, fresh)``: about the ``degree`` nearest nodes of every node; ``d`` is the distance as far as floats tell."""
    n = nodes.count()
    if n < 2:
        return nodes.sparkSession.createDataFrame([], "a long, b long, d double, place int, fresh boolean")
    graph, groups = _first_edges(nodes, n, degree), -(-n // CENTRES)
    for _ in range(MOST_ROUNDS):
        members = _around(graph, degree).withColumn("part", F.pmod(F.xxhash64("centre"), F.lit(groups)))
        members = store(members, "members")
        radius = graph.groupBy("a").agg(F.when(F.count("*") >= degree, F.max("d")).otherwise(float("inf")).alias("radius"))
        known = nodes.select("id", "short").join(radius.withColumnRenamed("a", "id"), "id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
        sent = members.select(F.col("part").alias("to"), F.col("id").alias("node")).distinct().join(known.withColumnRenamed("id", "node"), "node")
        found = members.groupBy("part").cogroup(sent.select("to", "node", "short", "radius").groupBy("to")).applyInArrow(_local_join(degree), _EDGES)
        every = found.withColumn("old", F.lit(0)).unionByName(graph.select("a", "b", "d", F.lit(1).alias("old")))
        graph = store(_shortest(every, degree), "graph")
        share = graph.agg(F.avg(F.col("fresh").cast("double"))).first()[0]
        if share < SETTLED:
            break
    return graph


def _distances(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
    """``pairs(query, id, done)`` and the vectors of both to ``(query, id, d, done)``."""
    ids, first = np.unique(np.asarray(vectors.column("node")), return_index=True)
    x = _matrix(vectors.column("short"))[first]
    q, i = np.asarray(pairs.column("query")), np.asarray(pairs.column("id"))
    left, right = np.searchsorted(ids, q), np.searchsorted(ids, i)
    d = np.empty(len(q))
    for s in range(0, len(q), 1 << 16):
        e = slice(s, s + (1 << 16))
        d[e] = _lengths(x[left[e]] / 2 - x[right[e]] / 2) * 2
    return pa.table({"query": q, "id": i, "d": d})


def search(nodes: DataFrame, graph: DataFrame, starts: DataFrame, pool: int = POOL, rounds: int = SEARCH_ROUNDS, degree: int = DEGREE) -> DataFrame:
    """``starts(query, id)``: nodes to look for, and where to begin; to ``(query, id, d)``, the pool of each query."""
    around = store(_around(graph, degree).select(F.col("centre").alias("id"), F.col("id").alias("next")), "around")
    groups = -(-starts.select("query").distinct().count() // QUERIES) or 1
    part = F.pmod(F.xxhash64("query"), F.lit(groups))
    seen = starts.select("query", "id", F.lit(0.0).alias("d"), F.lit(False).alias("done"))
    for _ in range(rounds):
        ahead = seen.filter(~F.col("done")).join(around, "id").select("query", F.col("next").alias("id")).distinct()
        ahead = store(ahead.withColumn("part", part), "ahead")
        needed = ahead.select("part", "id").union(ahead.select("part", "query")).distinct().toDF("to", "node")
        needed = needed.join(nodes.select(F.col("id").alias("node"), "short"), "node").select("to", "node", "short")
        found = ahead.groupBy("part").cogroup(needed.groupBy("to")).applyInArrow(_distances, "query long, id long, d double")
        every = found.withColumn("done", F.lit(False)).unionByName(seen.withColumn("done", F.lit(True)))
        every = every.groupBy("query", "id").agg(F.max("d").alias("d"), F.max("done").alias("done"))
        place = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
        seen = store(every.withColumn("place", place).filter(F.col("place") <= pool).drop("place"), "pool")
    return seen.select("query", "id", "d")


def _scores(batches):
    for batch in batches:
        x, y = (np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in (2, 3))
        d = np.sqrt(((x - y) ** 2).sum(1)) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64())], ["query", "id", "score"])


def nearest(rows: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each row where the condition ``is_query`` on
    ``vec_id`` holds, but not itself; ``score`` is the Euclidean distance in double precision, ties go to the smaller id.

    Rows without id and vectors that are null, empty, zero, hold null or
    non-finite components or have another length than most take no part.
    Rows of one id and one vector count once.  Other columns are ignored.  An
    empty table gives no rows.
    """
    vectors = valid(rows, vec_id, embedding).distinct()
    nodes, copies = nodes_of(vectors)
    graph = neighbour_graph(nodes)
    queries = store(copies.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("id").alias("query")), "queries")
    starts = queries.select("query", F.col("query").alias("id")).distinct()
    found = search(nodes, graph, starts)
    # Of a vector's copies the k + 1 smallest ids can be in an answer.
    order = F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))
    low = copies.withColumn("order", order).filter(F.col("order") <= k + 1).select("id", "vec_id")
    left = nodes.select(F.col("id").alias("query"), F.col("vec").alias("x"))
    right = nodes.select("id", F.col("vec").alias("y"))
    scored = found.join(left, "query").join(right, "id").select("query", "id", "x", "y").mapInArrow(_scores, "query long, id long, score double")
    answers = queries.join(scored, "query").join(low, "id").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

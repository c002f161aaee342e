"""Mixture-controlled packing of token streams into fixed-length sequences.

Each source is a queue of its documents' tokens.  A deficit round-robin deals
every window from all queues in proportion to their target weights: queue ``s``
has had ``floor(w_s * v_j)`` tokens after window ``j``, where ``v_j`` is the
virtual time at which all queues together have given ``j`` windows.  The
fractions that the floors leave are the deficits; they carry from window to
window because the floor is taken of the running total, and from partition to
partition because that total is a closed form of ``j``.  So every task finds
the place of its own documents alone, from the queues' sizes and from where its
documents begin in their queue.  A queue that runs dry leaves its share to the
others, in proportion.

Dealt windows follow one another in one stream, which is cut every
``length`` tokens: all sequences are full but the last.

Steps: (1) tokenise each document once and store its ids with its place in its
(task, source) run; (2) sum the runs, a row each; (3) place and cut each
document.  Nothing that grows with the corpus is shuffled but those sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import size_checked, store, text_or_empty
from tillpoint.llm.tokens import tokenizer

#: Queues of their own; smaller sources share one queue.
MOST_QUEUES = 1024
#: Rows of the (task, source) table up to which it is broadcast.
MOST_RUNS = 500_000

IDS_SCHEMA = "run int, queue_key string, doc_id long, run_start long, n_tokens long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, queue int"


class Deal:
    """The closed form of the deal: how many tokens each queue has given after each window."""

    def __init__(self, totals: list[int], weights: list[float], window: int):
        self.total = np.array(totals, np.int64)
        self.weight = np.array(weights, np.float64)
        self.window = window
        self.all = int(self.total.sum())
        ends = np.unique(self.total / self.weight) if len(totals) else np.zeros(0)
        self.times = np.concatenate([[0.0], ends])
        given = np.array([np.minimum(self.total, self.weight * t).sum() for t in ends])
        self.given = np.concatenate([[0.0], given])

    def after(self, j: np.ndarray) -> np.ndarray:
        """(queue, window): tokens given before window ``j``."""
        made = j.astype(np.float64) * self.window
        v = np.interp(made, self.given, self.times)
        out = np.minimum(self.total[:, None], np.floor(self.weight[:, None] * v[None, :]).astype(np.int64))
        out[:, made >= self.all] = self.total[:, None]
        return out

    def window_of(self, queue: int, at: int) -> int:
        """The window that takes token ``at`` of ``queue``."""
        j = int(np.interp(at / self.weight[queue], self.times, self.given) // self.window)
        while j > 0 and self.after(np.array([j]))[queue, 0] > at:
            j -= 1
        while self.after(np.array([j + 1]))[queue, 0] <= at:
            j += 1
        return j

    def pieces(self, queue: int, first: int, n: int, length: int, block: int = 512) -> Iterator[tuple[int, int, int]]:
        """``(start in the document, tokens, place in the stream)`` of tokens ``first..first+n`` of ``queue``."""
        j, done = self.window_of(queue, first), 0
        while done < n:
            given = self.after(np.arange(j, j + min(block, 2 + (n - done)) + 1))
            own, begin = given[queue], given[:, :-1].sum(0) + np.diff(given[:queue]).sum(0)
            for k in range(len(own) - 1):
                take = int(min(own[k + 1] - (first + done), n - done))
                if take <= 0:
                    continue
                at = int(begin[k] + first + done - own[k])
                while take:
                    cut = min(take, length - at % length)
                    yield done, cut, at
                    done, at, take = done + cut, at + cut, take - cut
                if done >= n:
                    return
            j += len(own) - 1


def _tokenise(path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        end = np.array([end_id], tok.width).tobytes()
        width, task, begun = len(end), TaskContext.get().partitionId(), {}
        names = ["run", "queue_key", "doc_id", "run_start", "n_tokens", "ids"]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows, held = [], 0
            for doc, key, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids, key = tok.ids(text.as_py()) + end, key.as_py()
                n = len(ids) // width
                at = begun.get(key, 0)
                begun[key] = at + n
                rows.append((task, key, doc.as_py(), at, n, ids))
                held += len(ids)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    return run


def _place(deal: Deal, length: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "queue"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            rows, held = [], 0
            for doc, queue, first, n, ids in zip(*(batch.column(i) for i in range(5)), strict=True):
                doc, queue, first, n = doc.as_py(), queue.as_py(), first.as_py(), n.as_py()
                ids = np.frombuffer(ids.as_buffer(), width).astype("<u4")
                for start, cut, at in deal.pieces(queue, first, n, length):
                    rows.append((doc, start, cut, ids[start:start + cut].tobytes(), n, at // length, at % length, queue))
                held += 4 * n
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    return run


def pack(docs: DataFrame, weights: dict[str | None, float] | None = None, length: int = 2048, end_id: int = 1,
         tokenizer_path: str | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Pack all documents; one row per piece of a document.

    ``weights``: target share of the tokens by source, any scale; a source that
    it lacks, or all without it, weighs as many tokens as it has.  Sources
    below one token a window on average, or beyond the ``MOST_QUEUES`` largest,
    share one queue that weighs their sum.

    Columns: ``doc_id``, ``start`` (ids of the document before the piece),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens`` (with
    the end id), ``sequence_id``, ``offset``, ``queue``.

    Null text and empty text are one end id.  A null source is a source of its
    own.  A null document id stays null.  Repeated rows are packed each.  Other
    columns are ignored.  An empty table gives no rows.  Sequences are full but
    the last one, which a reader pads.
    """
    tok = tokenizer(tokenizer_path)
    key = F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("queue_key"), text_or_empty(text).alias("text"))
    ids = store(ids.mapInArrow(_tokenise(tokenizer_path, end_id), IDS_SCHEMA), "token-ids")

    runs = store(ids.groupBy("run", "queue_key").agg(F.sum("n_tokens").alias("n")), "runs")
    sizes = runs.groupBy("queue_key").agg(F.sum("n").alias("n"))
    total = runs.agg(F.sum("n")).first()[0] or 0
    large = (sizes.filter(F.col("n") * length >= total).orderBy(F.desc("n"), "queue_key").limit(MOST_QUEUES).collect())
    queues = sorted((r["queue_key"], r["n"]) for r in large)
    rest = total - sum(n for _, n in queues)
    given = {"null" if k is None else f"={k}": v for k, v in (weights or {}).items()}
    totals, shares = [n for _, n in queues], [float(given.get(k, n)) for k, n in queues]
    if rest:
        totals, shares = [*totals, rest], [*shares, float(rest)]
    named = dict(queues)
    number = F.lit(len(queues))
    for i, k in enumerate(named):
        number = F.when(F.col("queue_key") == k, i).otherwise(number) if len(named) <= 64 else number
    if len(named) > 64:
        table = docs.sparkSession.createDataFrame([(k, i) for i, k in enumerate(named)], "queue_key string, i int")
        runs = runs.join(F.broadcast(table), "queue_key", "left").withColumn("queue", F.coalesce("i", number)).drop("i")
    else:
        runs = runs.withColumn("queue", number)
    # Where each run begins in its queue: runs of a queue in order of task, then source.
    order = Window.partitionBy("queue").orderBy("run", "queue_key").rowsBetween(Window.unboundedPreceding, -1)
    begins = store(runs.withColumn("queue_start", F.coalesce(F.sum("n").over(order), F.lit(0)))
                   .select("run", "queue_key", "queue", "queue_start"), "queue-starts")
    placed = ids.join(size_checked(begins, MOST_RUNS), ["run", "queue_key"])
    placed = placed.select("doc_id", "queue", (F.col("queue_start") + F.col("run_start")).alias("first"), "n_tokens", "ids")
    return placed.mapInArrow(_place(Deal(totals, shares, length), length, tok.width), PIECE_SCHEMA)

"""Filter interaction audit: what each of several filters removes, in every order of them.

A document is known by its failure mask, one bit a filter.  Orders are numbered
by their Lehmer rank, so all orders that begin alike are an interval of ranks.
A document of mask ``m`` falls at step ``s`` of just those orders whose first
``s - 1`` filters it passes and whose next it fails: for each such beginning
one interval.  The counts of a mask are added where its intervals begin and
taken off where they end; a running sum over the ranks then holds, for every
order and step at once, what falls there.  The same with beginnings that hold
an earlier failure gives what a step would have removed had it still been there.

Documents are reduced to counts by part and mask before any order is looked at,
so the work on orders does not grow with the documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import size_checked, store, text_or_empty

#: The five filters on documents, by the order of their bits.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 3
_MARKS = re.compile(rb"[#$%&*|]")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Orders grow with the factorial of the number of filters.
MOST_FILTERS = 7


def text_failures(text: bytes, n_chars: int) -> int:
    """Bits of the first four filters: few words, few distinct ones, much upper case, marks."""
    words = text.split()  # ASCII white space, as it is bytes
    upper = len(text) - len(text.translate(None, _UPPER))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
            | (100 * upper > MAX_UPPER * n_chars) << 2 | bool(_MARKS.search(text)) << 3)


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, masks = [], []
        for value in batch.column(2):
            text = value.as_py()
            raw = text.encode()
            digests.append(hashlib.sha256(raw).digest())
            masks.append(text_failures(raw, len(text)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
                                         ["doc_id", "part", "digest", "mask"])


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(doc_id, part, mask, n)``: rows of one id, part and text, how many they are and which filters they fail.

    A text is a copy (bit 4) if a row with a smaller id has the same one, known by its SHA-256.  The smallest id of
    each text is found by partial aggregation and then looked up by text and id together, so a text that a third of
    all rows have lands in no single task.  A null id is neither smaller nor larger than any: such a row is no copy.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty(text).alias("text"))
    rows = rows.mapInArrow(_examine, "doc_id long, part string, digest binary, mask int")
    rows = store(rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "examined")
    known = rows.filter("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marked = known.join(first, ["digest", "doc_id"], "left")
    marked = marked.select("doc_id", "part", F.when(F.col("is_first"), F.col("mask")).otherwise(F.col("mask") + 16).alias("mask"), "n")
    return marked.unionByName(rows.filter("doc_id is null").select("doc_id", "part", "mask", "n"))


def order_table(spark: SparkSession, filters: Sequence[str]) -> DataFrame:
    """``(rank, filter_order, step, bit)``: every order of the filters in lexicographic rank, a row a step."""
    rows = [(rank, "".join(filters[i] for i in order), step + 1, bit) for rank, order in enumerate(permutations(range(len(filters)))) for step, bit in enumerate(order)]
    return spark.createDataFrame(rows, "rank int, filter_order string, step int, bit int")


def intervals(k: int) -> list[tuple[int, int, int, int, int]]:
    """``(mask, step, redundant, begin, end)``: ranks of the orders in which a document of ``mask`` falls at ``step``,
    or (``redundant`` = 1) fails that step's filter after it has fallen.  Neighbouring intervals are one."""
    found: dict[tuple[int, int, int], list[list[int]]] = {}
    for step in range(1, k + 1):
        width = factorial(k - step)
        # Beginnings in lexicographic order have their intervals one after the other.
        for at, begun in enumerate(permutations(range(k), step)):
            before, this = sum(1 << i for i in begun[:-1]), 1 << begun[-1]
            for mask in range(1 << k):
                if mask & this:
                    runs = found.setdefault((mask, step, int(mask & before > 0)), [])
                    if runs and runs[-1][1] == at * width:
                        runs[-1][1] += width
                    else:
                        runs.append([at * width, (at + 1) * width])
    return [(*key, a, b) for key, runs in found.items() for a, b in runs]


def audit(counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """A row per part, order of the filters and step.

    ``counts(part, mask, n, good, toxic)``: documents by part and failure mask (bit ``i``: fails ``filters[i]``), in all
    and of two kinds; a part and mask may come in several rows.  Returns ``part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley``, zeros included; an empty table gives no rows.  Only
    tables whose size the number of filters fixes are broadcast.
    """
    k = len(filters)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"{k} filters: 1 to {MOST_FILTERS} can be put in every order")
    spark = counts.sparkSession
    sums = lambda names: [F.sum(c).cast("long").alias(c) for c in names]
    counts = counts.groupBy("part", "mask").agg(*sums(["n", "good", "toxic"]))
    parts = counts.groupBy("part").agg(F.sum("n").cast("long").alias("total"), F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).cast("long") for i in range(k)]).alias("only"))

    ends = [(m, s, r, at, sign) for m, s, r, a, b in intervals(k) for at, sign in ((a, 1), (b, -1)) if at < factorial(k)]
    ends = F.broadcast(spark.createDataFrame(ends, "mask int, step int, redundant int, rank int, sign int"))
    fallen = lambda c: (F.col(c) * F.col("sign") * (1 - F.col("redundant"))).alias(c)
    steps = counts.join(ends, "mask").select("part", "step", "rank", fallen("n"), fallen("good"), fallen("toxic"), (F.col("n") * F.col("sign") * F.col("redundant")).alias("again"))
    # Every rank has a row, also where nothing begins or ends.
    none = [F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic", "again")]
    every = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(k) - 1))).alias("rank"), *none)
    steps = steps.unionByName(every).groupBy("part", "step", "rank").agg(*sums(["n", "good", "toxic", "again"]))
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in ("n", "good", "toxic", "again")])

    steps = steps.join(F.broadcast(order_table(spark, filters)), ["rank", "step"]).join(parts, "part")
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"), F.col("again").alias("redundant"),
        F.col("only")[F.col("bit")].alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "bit")).alias("shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of the five document filters over ``docs``, with losses by ``labels(doc_id, quality, toxic)``.

    A null text is empty (it has few words and no others of the faults), a null part is the part "", rows without id have
    no label.  Several labels of one id count as any of them; null labels as none.  Repeated rows count each.
    Extra columns are ignored, whatever they are called.  Empty documents give no rows.
    """
    is_1 = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_1("quality").alias("is_good"), is_1("toxic").alias("is_toxic"))
    marks = store(marks.filter("is_good or is_toxic"), "label-marks")
    rows = failures(docs, doc_id, text, part)
    no = F.lit(False)
    known = rows.filter("doc_id is not null").join(size_checked(marks, 1_000_000), "doc_id", "left")
    rows = known.unionByName(rows.filter("doc_id is null").select("*", no.alias("is_good"), no.alias("is_toxic")))
    share = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c.removeprefix("is_"))
    counts = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("is_good"), share("is_toxic"))
    return audit(store(counts, "mask-counts"), FILTERS)

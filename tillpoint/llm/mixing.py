"""Mixing sources to target weights, in DataFrame operations alone.

Each source's documents, in a pseudorandom order, are one stream of words that
is packed into blocks of ``block_words`` words.  A source's target is a number
of block slots.  Each slot draws its output shard by a hash, so that a source's
counts over the shards are one multinomial draw with a given total, and a
shard's counts over the sources follow the targets.  A slot finds its block
by a pseudorandom permutation of the source's block numbers: pass 0 takes every
block at most once, pass 1 takes a second helping in another order.  Slots and
blocks meet in one join by (source, pass, block number).

A hot source is no hot key: documents are laid out in buckets whose sizes are
summed before the shuffle, first within runs of buckets and then over the runs,
and blocks are joined by number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import WORD, store

#: Rounds of the permutation's network, and turns that a number may take through it.
ROUNDS, WALK = 4, 64
#: Documents to a bucket, on average; buckets whose sizes are summed by one task.
BUCKET_DOCS, BUCKET_RUN = 512, 4096
#: Slots that one row of the small table of slots stands for.
CHUNK = 16384


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: sources in code-point order, null last, take
    ``weights`` in turn and share ``share`` of all sizes; no target is over ``most`` times its size.

    Resharing the excess by weight until none is above ends where
    ``target = min(most * size, level * weight)`` sums to the share.  The level
    follows from the sources in order of ``most * size / weight``: those below
    it are full, the others split what the full ones leave.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    place = (F.row_number().over(every) - 1) % n
    w = reduce(lambda e, i: F.when(F.col("place") == i, F.lit(weights[i])).otherwise(e), range(n), F.lit(0.0))
    t = sizes.withColumn("place", place).withColumn("weight", w)
    t = t.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", (share * F.sum("source_size").over(whole) - F.col("full")) / F.col("open"))
    # From the first source that is not full at its own level on, levels only fall: that one holds for all.
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(whole)
    t = t.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    return t.select("source", "source_size", "weight", "target")


def _shuffled(x, a, b, seed):
    """One-to-one on ``0..a*b-1``: the two digits of ``x`` are moved in turn, each by a hash of the other (a Feistel network)."""
    left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
    for k in range(ROUNDS):
        if k % 2:
            right = F.pmod(right + F.pmod(F.xxhash64(left, seed, F.lit(k)), b), b)
        else:
            left = F.pmod(left + F.pmod(F.xxhash64(right, seed, F.lit(k)), a), a)
    return left * b + right


def _permuted(i, n, seed):
    """A pseudorandom permutation of ``0..n-1``, for any ``n`` below 2 ** 52.

    The network works on the smallest rectangle of about ``sqrt(n)`` rows that
    holds ``n`` numbers; a number that lands beyond ``n`` goes through it again.
    Fewer than ``sqrt(n)`` numbers lie beyond, so below ``WALK ** 2`` numbers
    ``WALK`` turns reach all; above, a turn lands beyond with a chance of less
    than ``1 / WALK``, and that many in a row do not happen.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")
    first = _shuffled(i, a, b, seed)
    again = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(_shuffled(x, a, b, seed)))
    return F.when(first < n, first).otherwise(again)


def source_key(source: str):
    return F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def row_key(doc_id: str, text: str, source: str, seed: int):
    """A document's place in the pseudorandom order of its source."""
    return F.xxhash64(F.col(doc_id).cast("long"), source_key(source), F.col(text).cast("string"), F.lit(seed))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0,
        block_words: int = 64, shards: int = 64, seed: int = 17, doc_id: str = "doc_id", text: str = "text",
        source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(laid, slots, parts)``.

    ``laid``: each document (``row_key``, ``doc_id``, ``source``, ``size``,
    ``source_size``, ``target``, ``at``: its first word's place in the source's
    stream).  ``slots``: each block that the mix takes (``source_key``,
    ``block``, ``pass``, ``shard``, ``words``: it takes the block's first so
    many).  ``parts``: each document's share of a slot (``row_key``, ``pass``,
    ``shard``, ``block``, ``from_word`` in the document, ``n_words``).

    A null text has no words: its document is in ``laid`` alone.  A null source
    is a source of its own, the last.  Repeated rows are documents each, told
    apart by ``row_key``.  Other columns are ignored.  An empty table gives
    empty tables.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), source_key(source).alias("source_key"),
                       row_key(doc_id, text, source, seed).alias("row_key"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", "source", "source_key", "row_key",
                       F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"))
    # Equal rows would share a key; they follow one another in the stream.
    rows = store(rows.groupBy("doc_id", "source", "source_key", "row_key", "size").agg(F.count("*").alias("copies")), "sizes")
    n_docs = rows.count()
    buckets = max(1, -(-n_docs // BUCKET_DOCS))
    rows = rows.withColumn("bucket", F.pmod("row_key", F.lit(buckets)))
    weight = F.col("size") * F.col("copies")
    sums = rows.groupBy("source", "source_key", "bucket").agg(F.sum(weight).alias("n"))
    # Places of buckets in two steps: within runs of buckets, and of the runs, so that no task sorts all of a source's.
    sums = store(sums.withColumn("run", F.floor(F.col("bucket") / BUCKET_RUN)), "buckets")
    before = lambda over: over.rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.groupBy("source_key", "run").agg(F.sum("n").alias("n"))
    runs = runs.withColumn("run_at", F.coalesce(F.sum("n").over(before(Window.partitionBy("source_key").orderBy("run"))), F.lit(0))).drop("n")
    in_run = before(Window.partitionBy("source_key", "run").orderBy("bucket"))
    sums = sums.withColumn("bucket_in_run", F.coalesce(F.sum("n").over(in_run), F.lit(0))).join(runs, ["source_key", "run"])
    sums = sums.withColumn("bucket_at", F.col("run_at") + F.col("bucket_in_run")).select("source", "source_key", "bucket", "n", "bucket_at")
    sizes = targets(sums.groupBy("source", "source_key").agg(F.sum("n").alias("source_size")).drop("source_key"), weights, share, most)
    sizes = store(sizes.withColumn("source_key", source_key("source")), "targets")

    within = Window.partitionBy("source_key", "bucket").orderBy("row_key").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("bucket_in", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    laid = laid.join(sums.select("source_key", "bucket", "bucket_at"), ["source_key", "bucket"])
    laid = laid.join(sizes.drop("source"), "source_key")
    laid = laid.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    laid = laid.withColumn("at", F.col("bucket_at") + F.col("bucket_in") + (F.col("copy") - 1) * F.col("size"))
    laid = store(laid.select("row_key", "copy", "doc_id", "source", "source_key", "size", "source_size", "target", "at"), "laid")

    b = F.lit(block_words).cast("long")
    blocks = F.ceil(F.col("source_size") / b)
    # A pass takes its blocks whole, in the order of its slots; its last slot takes the words that are missing from
    # the target.  Only a source's last block may be short: where a pass takes it before its last slot, the
    # slots after it lie that much earlier, and one more slot may be needed.
    passes = sizes.filter(F.col("source_size") > 0).select("source_key", "source_size", "target", blocks.alias("blocks"), F.explode(
        F.array(*[F.lit(p) for p in range(int(-(-most // 1)))])).alias("pass"))
    passes = passes.withColumn("need", F.greatest(F.lit(0), F.least(F.col("source_size"), F.round("target").cast("long") - F.col("pass") * F.col("source_size"))))
    short = F.col("blocks") * b - F.col("source_size")
    passes = passes.withColumn("n_slots", F.least("blocks", F.ceil((F.col("need") + short) / b))).filter("need > 0")
    # The permutation is turned so that the slot of the last block is known: ``last``, itself drawn by hash.
    permuted = lambda slot: _permuted(slot, F.col("blocks"), F.xxhash64("source_key", "pass", F.lit(seed)))
    passes = passes.withColumn("last", F.pmod(F.xxhash64("source_key", "pass", F.lit(seed), F.lit("last")), F.col("blocks")))
    passes = passes.withColumn("turn", permuted(F.col("last")))
    # Slots in chunks first, dealt to as many tasks as their number asks for, so that a large source's slots are made by many.
    n_slots = passes.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    passes = passes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / CHUNK))))
    passes = passes.repartition(max(1, -(-int(n_slots) // (4 * CHUNK))), F.col("source_key"), "pass", "chunk")
    slots = passes.withColumn("slot", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n_slots"), (F.col("chunk") + 1) * CHUNK) - 1)))
    draw = F.xxhash64("source_key", "pass", "slot", F.lit(seed))
    slots = slots.withColumn("block", F.pmod(permuted(F.col("slot")) - F.col("turn") - 1, F.col("blocks")))
    slots = slots.withColumn("own", b - F.when(F.col("slot") == F.col("last"), short).otherwise(0))
    slots = slots.withColumn("at", F.col("slot") * b - F.when(F.col("last") < F.col("slot"), short).otherwise(0))
    slots = slots.select("source_key", "pass", F.pmod(draw, F.lit(shards)).alias("shard"), "block",
                         F.least(F.col("own"), F.col("need") - F.col("at")).alias("words")).filter("words > 0")
    spans = laid.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))))
    # Slots are made from a small table, so Spark would take them for a small one themselves: both sides are large.
    parts = spans.select("source_key", "row_key", "copy", "at", "size", "block").join(slots.hint("merge"), ["source_key", "block"])
    begin = F.greatest(F.col("at"), F.col("block") * b)
    end = F.least(F.col("at") + F.col("size"), F.col("block") * b + F.col("words"))
    parts = parts.filter(end > begin).select("row_key", "copy", "pass", "shard", "block", (begin - F.col("at")).alias("from_word"), (end - begin).alias("n_words"))
    return laid, slots, parts


def mixed_sizes(docs: DataFrame, **params) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``, ``source`` and ``shards``: the output shards that its slots drew."""
    laid, _, parts = mix(docs, **params)
    taken = parts.groupBy("row_key", "copy").agg(F.sum("n_words").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
    out = laid.join(taken, ["row_key", "copy"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "source",
                      F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", seed: int = 17, **params) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: for each document and pass the words that the pass takes.

    A pass that takes all of a document leaves its text as it is; else the
    taken words are joined by one space.  A document that no pass takes is not
    in the mix, one that both take is there twice.  ``n_chars``, where there is
    such a column, follows the text.
    """
    _, _, parts = mix(docs, doc_id=doc_id, text=text, source=source, seed=seed, **params)
    taken = parts.groupBy("row_key", "copy", "pass").agg(F.array_sort(F.collect_list(F.struct("from_word", "n_words"))).alias("taken"), F.sum("n_words").alias("total"))
    taken = taken.select(F.col("row_key").alias("__key"), F.col("taken").alias("__taken"), F.col("total").alias("__total"))
    rows = docs.withColumn("__key", row_key(doc_id, text, source, seed)).dropDuplicates(["__key"])
    rows = rows.join(taken, "__key").withColumn("__words", F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))
    slices = F.transform("__taken", lambda t: F.slice("__words", t["from_word"].cast("int") + 1, t["n_words"].cast("int")))
    cut = F.when(F.size("__words") == F.col("__total"), F.col(text)).otherwise(F.array_join(F.flatten(slices), " "))
    out = rows.withColumn(text, cut)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)

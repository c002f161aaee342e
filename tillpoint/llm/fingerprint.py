"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest hash among its inner
s-mers is its first or its last.  Whether it is one depends on the k-mer alone,
so an edit elsewhere never moves an anchor, and every ``k - s`` neighbouring
k-mers have one.  The fingerprint keeps the anchors with the ``anchors``
smallest hashes and where they stand; two fingerprints are compared on those
that fall below both sketches' ends, and only anchors that agree on one shift
of position count as matched.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import text_or_empty
from tillpoint.llm.textscan import mix, powers

K, S, ANCHORS = 16, 8, 48
#: Code points to one step of an anchor's place, and the steps by which places may differ.
STEP, SLACK = 32, 2
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_PLACES = 1 << 16


def fingerprints(texts: list[str], k: int = K, s: int = S, anchors: int = ANCHORS) -> list[str]:
    """A text's fingerprint: 12 hex digits an anchor (hash, place modulo 65536), by hash.

    A text without an anchor (fewer than about ``k`` code points) has the hash of the whole text; an empty one has an empty fingerprint.
    """
    raw = [t.encode("utf-32-le") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    codes = np.frombuffer(b"".join(raw), "<u4")
    n = len(codes)
    first = np.concatenate([[0], np.cumsum(size)])
    found = np.zeros(0, np.int64)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP)) * powers(_STEP, n), out=run[1:])
    back = powers(_BACK, n + 1)
    if n >= k:
        inner = mix((run[s:] - run[:-s]) * back[:n - s + 1])
        w, low, have = k - s + 1, inner, 1
        while have < w:
            step = min(have, w - have)
            low = np.minimum(low[:len(low) - step], low[step:])
            have += step
        found = np.flatnonzero((inner[:n - k + 1] == low) | (inner[w - 1:] == low))
        text = np.searchsorted(first, found, "right") - 1
        whole = found + k <= first[text + 1]
        found, text = found[whole], text[whole]
        hashes = (mix((run[found + k] - run[found]) * back[found]) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((found, hashes, text))
        found, text, hashes = found[order], text[order], hashes[order]
        new = np.ones(len(found), bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        found, text, hashes = found[new], text[new], hashes[new]
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        place = (found - first[text]) // STEP % _PLACES
    out = []
    for i in range(len(texts)):
        if len(found) and ends[i] < ends[i + 1]:
            a, b = ends[i], min(ends[i + 1], ends[i] + anchors)
            both = np.stack([hashes[a:b] >> 16, hashes[a:b] & 0xFFFF, place[a:b]], axis=1)
            out.append(both.astype(">u2").tobytes().hex())
        elif size[i]:
            h = int(mix((run[first[i + 1]:first[i + 1] + 1] - run[first[i]:first[i] + 1]) * back[first[i]:first[i] + 1])[0]) >> 32
            out.append(f"{h:08x}0000")
        else:
            out.append("")
    return out


def likeness(a: str, b: str, anchors: int = ANCHORS) -> float:
    """Estimated share of common anchors at consistent places, 0 to 1; equal fingerprints give 1, an empty and another 0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x = {a[i:i + 8]: int(a[i + 8:i + 12], 16) for i in range(0, len(a), 12)}
    y = {b[i:i + 8]: int(b[i + 8:i + 12], 16) for i in range(0, len(b), 12)}
    union = sorted({*x, *y})
    # A sketch says nothing of hashes beyond its end, unless it holds all of its text's.
    end = min((max(z) for z in (x, y) if len(z) >= anchors), default=union[-1])
    union = [h for h in union if h <= end]
    shifts = sorted((x[h] - y[h] + _PLACES // 2) % _PLACES for h in union if h in x and h in y)
    most = left = 0
    for right, shift in enumerate(shifts):
        while shift - shifts[left] > SLACK:
            left += 1
        most = max(most, right + 1 - left)
    return most / len(union)


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the falling ``cuts`` are above ``doc_id``: all for a null.  Looked up in two steps of about the root of their number."""
    step = int(len(cuts) ** 0.5) + 1
    parts = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    heads = F.from_json(F.lit(json.dumps([p[0] for p in parts])), "array<bigint>")
    table = F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")
    part = F.size(F.filter(heads, lambda c: c > doc_id))
    within = F.size(F.filter(F.get(table, part - 1), lambda c: c > doc_id))
    return F.when(doc_id.isNull(), len(cuts)).when(part == 0, 0).otherwise((part - 1) * step + within)


def with_next(docs: DataFrame, each: Callable[[Iterator[tuple[int | None, str, str]]], Iterator[tuple]], schema: str,
              buckets: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Apply ``each`` to ``(doc_id, text, text of the next document)`` in descending order of id; the first follows the last.

    Ids are cut into ranges, of which only the ends (one a range) reach the
    driver.  Each range's first document is sent to the range before it as
    well, so every text is shuffled once.  Documents of one id follow one
    another by hash of their text, those without id come last.
    """
    spark = docs.sparkSession
    n = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    cuts = sorted(set(cuts or []), reverse=True)
    ranges = _range_of(F.col("doc_id"), cuts) if cuts else F.lit(0)
    order: list[Column] = [F.col("doc_id").isNull().alias("absent"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("falling"), F.xxhash64("text").alias("tie")]
    rows = rows.select("doc_id", "text", ranges.alias("range"), *order)
    heads = rows.groupBy("range").agg(F.min(F.struct("absent", "falling", "tie")).alias("head")).orderBy("range").collect()
    tails = [(h["range"], *nxt["head"]) for h, nxt in zip(heads, [*heads[1:], *heads[:1]], strict=True)]
    tails = spark.createDataFrame(tails, "to_range int, absent boolean, falling long, tie long")
    extra = rows.join(F.broadcast(tails), ["absent", "falling", "tie"])  # a row for each range
    both = rows.select("range", F.lit(0).alias("tail"), "absent", "falling", "tie", "doc_id", "text").unionByName(
        extra.select(F.col("to_range").alias("range"), F.lit(1).alias("tail"), "absent", "falling", "tie", "doc_id", "text"))
    laid = both.repartition("range").sortWithinPartitions("range", "tail", "absent", "falling", "tie").select("range", "tail", "doc_id", "text")
    out_schema = spark.createDataFrame([], schema).schema
    names = out_schema.names

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        held = None
        for batch in batches:
            for where, tail, doc, words in zip(*batch.columns, strict=True):
                where, tail, doc, words = where.as_py(), tail.as_py(), doc.as_py(), words.as_py()
                if held is not None and held[0] == where:
                    yield held[1], held[2], words
                held = None if tail else (where, doc, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        types = [f.type for f in to_arrow_schema(out_schema)]
        rows = []
        for row in each(pairs(batches)):
            rows.append(row)
            if len(rows) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    return laid.mapInArrow(run, schema)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(pairs: Iterator[tuple[int | None, str, str]]) -> Iterator[tuple]:
    held, size = [], 0

    def done() -> Iterator[tuple]:
        edited = [t[:len(t) - len(t) // 2] + nxt[:len(t) // 2] for _, t, nxt in held]
        # Each next text but a range's last is the following row's own.
        own = fingerprints([t for _, t, _ in held] + [held[-1][2]])
        changed = fingerprints(edited)
        for i, (doc, t, _) in enumerate(held):
            yield (doc, len(t), hashlib.sha256(edited[i].encode()).hexdigest(), own[i], changed[i], likeness(own[i], changed[i]), likeness(own[i], own[i + 1]))

    for doc, t, nxt in pairs:
        if held and (size > 1 << 18 or held[-1][2] is not t):
            yield from done()
            held, size = [], 0
        held.append((doc, t, nxt))
        size += len(t)
    if held:
        yield from done()


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text (the second half replaced by the next document's start) and likenesses.

    A null text counts as empty; a null id stays null; repeated rows give a row
    each; other columns are ignored; an empty table gives no rows.  A lone
    document follows itself.
    """
    return with_next(docs, _compare, SCHEMA, doc_id=doc_id, text=text)

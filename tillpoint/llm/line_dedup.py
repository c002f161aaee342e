"""Line deduplication by a deletion-neighbourhood join.

Two lines are near copies if one edit (a code point inserted, deleted or
replaced) at most turns one into the other.  A line's variants are the line
without one code point, and the line itself as what a longer one may become.
Equal variants join: a line that is another one's variant is one insertion away,
and two lines whose variants without the same position are equal are one
replacement away.  Of the lines that share a variant only the earliest matters,
so the join is a minimum by hashed key and no pairs within a group are made.
Found pairs are verified on the lines themselves.

Variants are only made where a near copy can be.  Cut both lines of a pair, from
either end, at fixed shares of the longer one's length: one edit leaves all
segments but one as they are.  So a line first shares the hash of a half with
another line; of those, it shares what is left around one of eight segments.
Only within that segment are code points deleted.  In every group of shared
hashes one line at least has the group's length: two shorter ones meet
elsewhere.

A line is removed if an earlier line (by document id, then line number) is
equal or one edit away.  Lines are judged on the input, not on what is left.
Equal lines of any length go, lines of white space alone never.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import size_checked, store
from tillpoint.llm.textscan import mix, powers

#: ASCII white space but the line end.
SPACE = " \t\r\x0b\x0c"
#: Lines with fewer code points have no near copies, only equal ones: one edit makes another word of them.
MIN_CHARS = 8
#: Segments of a line; no more than ``MIN_CHARS``, so that none is empty.
SEGMENTS = 8
_STEP = 0x9E3779B97F4A7C15


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lh, doc, line, text, segments)`` to ``(key, pos, lh, doc, line)``: within each segment the deletions, or (position -1) the
    segment as it is, as a longer line may become by a deletion."""
    names = ["key", "pos", "lh", "doc", "line"]

    def made(parts: list[tuple]) -> pa.RecordBatch:
        per = [len(p[0]) for p in parts]
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)), pa.array(np.concatenate([p[1] for p in parts])),
            *(pa.array(np.repeat(np.array([p[c] for p in parts], np.int64), per)) for c in (2, 3, 4))], names)

    for batch in batches:
        parts, held = [], 0
        for lh, doc, line, text, segments in zip(*batch.columns, strict=True):
            codes = np.frombuffer(text.as_py().encode("utf-32-le"), "<u4").astype(np.uint64)
            each = mix((codes + np.uint64(1)) * np.uint64(_STEP))
            for seg in segments.as_py():
                more, at = divmod(seg["at"], SEGMENTS)
                m = len(codes) + more
                mid = each[m * at // SEGMENTS:len(codes) - (m - m * (at + 1) // SEGMENTS)]
                n, pw = len(mid), powers(_STEP, len(mid) + 1)
                left = np.concatenate([[np.uint64(0)], np.cumsum(mid * pw[:n])])
                if more:
                    keys, pos = left[n:], np.array([-1], np.int32)
                else:
                    # Behind a deleted code point every other one stands one place to the left.
                    right = np.concatenate([[np.uint64(0)], np.cumsum(mid[1:] * pw[:n - 1])])
                    keys, pos = left[:n] + (right[n - 1] - right), np.arange(n, dtype=np.int32)
                # Every segment has a key of its own, so only variants within the same rest meet.
                keys = mix(mix(keys) ^ np.uint64(seg["key"] % (1 << 64)))
                parts.append((keys, pos, lh.as_py(), doc.as_py(), line.as_py()))
                held += len(keys)
            if held > 1 << 17:
                yield made(parts)
                parts, held = [], 0
        if parts:
            yield made(parts)


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc, line, text, lh)``: every line that can be removed, without white space at its ends."""
    lines = docs.select(F.col(doc_id).cast("long").alias("doc"), F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("line", "raw"))
    lines = lines.select("doc", F.col("line").cast("long").alias("line"), F.btrim("raw", F.lit(SPACE)).alias("line_text"))
    return lines.filter((F.length("line_text") > 0) & F.col("doc").isNotNull()).withColumn("lh", F.xxhash64("line_text"))


def _around(line: Column, segments: int) -> Column:
    """Hashes of a line but one segment: first for cuts at shares of its own length, then of a line one code point longer."""
    keys = []
    for more in (0, 1):
        m = F.length(line) + more
        for at in range(segments):
            begin, end = (F.floor(m * k / segments).cast("int") for k in (at, at + 1))
            keys.append(F.xxhash64(m, F.lit(at), F.substr(line, F.lit(1), begin), F.right(line, m - end)))
    return F.array(*keys)


def _shared(rows: DataFrame, segments: int, name: str) -> DataFrame:
    """The ``key`` values that two different lines (``lh``) have, one of them at its own length."""
    own = F.max(F.col("at") < segments).alias("own")
    return store(rows.groupBy("key").agg(F.min("lh").alias("a"), F.max("lh").alias("b"), own).filter("a <> b and own").select("key"), name)


def near_earlier(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """Lines (``lh``) of ``distinct(lh, doc, line)`` with an earlier one that is one edit away."""
    lines = lines.filter(F.length("line_text") >= MIN_CHARS)
    halves = lines.select("lh", F.posexplode(_around(F.col("line_text"), 2)).alias("at", "key"))
    shared = _shared(halves, 2, "shared-halves")
    near = halves.join(size_checked(shared, 1_000_000), "key", "left_semi").select("lh").distinct()
    near = store(near.join(distinct, "lh"), "near-lines")
    texts = lines.select(F.col("lh").alias("h"), F.col("doc").alias("d"), F.col("line").alias("l"), "line_text")
    hit = (F.col("lh") == F.col("h")) & (F.col("doc") == F.col("d")) & (F.col("line") == F.col("l"))
    texts = texts.join(size_checked(near, 1_000_000), hit).select("lh", "doc", "line", "line_text")
    texts = store(texts.dropDuplicates(["lh"]), "near-texts")

    around = texts.select("lh", F.posexplode(_around(F.col("line_text"), SEGMENTS)).alias("at", "key"))
    shared = _shared(around, SEGMENTS, "shared-segments")
    segments = around.join(size_checked(shared, 1_000_000), "key", "left_semi").groupBy("lh").agg(F.collect_list(F.struct("at", "key")).alias("segments"))
    texts = store(texts.join(segments, "lh"), "segment-texts")
    variants = store(texts.mapInArrow(_variants, "key long, pos int, lh long, doc long, line long"), "variants")
    place = F.struct("doc", "line", "lh")
    whole = variants.filter("pos < 0").select("key", F.col("lh").alias("own"), place.alias("own_place"))
    cut = variants.filter("pos >= 0").select("key", "pos", "lh", place.alias("place"))
    # Rows whose variant no other line has say nothing; the minimum tells them apart.
    replaced = cut.groupBy("key", "pos").agg(F.min("place").alias("best"), F.max("lh").alias("a"), F.min("lh").alias("b")).filter("a <> b")
    pairs = cut.join(replaced.select("key", "pos", "best"), ["key", "pos"]).filter("best < place").select("lh", F.col("best.lh").alias("kept"))
    longer = cut.join(whole, "key").filter("own_place < place").select("lh", F.col("own").alias("kept"))
    first = cut.groupBy("key").agg(F.min("place").alias("best"))
    shorter = whole.join(first, "key").filter("best < own_place").select(F.col("own").alias("lh"), F.col("best.lh").alias("kept"))
    pairs = pairs.unionByName(longer).unionByName(shorter).distinct()
    a, b = texts.select("lh", "line_text"), texts.select(F.col("lh").alias("kept"), F.col("line_text").alias("kept_text"))
    pairs = pairs.join(a, "lh").join(b, "kept")
    return pairs.filter(F.levenshtein("line_text", "kept_text", 1).between(0, 1)).select("lh").distinct()


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, line)`` of every removed line, counted from 0."""
    lines = lines_of(docs, doc_id, text)
    every = store(lines.select("doc", "line", "lh"), "lines")
    distinct = every.groupBy("lh").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n"))
    distinct = store(distinct.select("lh", F.col("first.doc").alias("doc"), F.col("first.line").alias("line"), "n"), "distinct-lines")
    near = near_earlier(lines, distinct.drop("n")).withColumn("near", F.lit(True))
    marked = distinct.join(near, "lh", "left").filter("n > 1 or near").select(
        "lh", F.col("doc").alias("d"), F.col("line").alias("l"), F.coalesce("near", F.lit(False)).alias("near"))
    marked = store(marked, "marked-lines")
    hit = every.join(marked, "lh").filter(F.col("near") | (F.col("doc") != F.col("d")) | (F.col("line") != F.col("l")))
    return hit.select("doc", "line")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` without removed lines in ``text``, and with the numbers of lines it had and lost.

    A null text has no lines and stays null; an empty one has one line.  Lines
    under ``MIN_CHARS`` code points go only if they are equal to an earlier
    one; rows without id keep their text.  Rows
    of one id are one document: a line that several have at the same number is
    one line.  Other columns stay as they are; none may be called as the two
    new ones.  An empty table gives no rows.
    """
    if {n_lines, n_removed} & set(docs.columns):
        raise ValueError(f"the table has a column {n_lines} or {n_removed}; name others")
    marks = removed_lines(docs, doc_id, text).groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("line"))
    marks = marks.select(F.col("doc").alias("__doc"), F.col("line").alias("__gone"))
    out = docs.join(marks, F.col(doc_id).cast("long") == F.col("__doc"), "left")
    rows = F.split(F.col(text).cast("string"), "\n")
    gone = F.coalesce("__gone", F.array().cast("array<bigint>"))
    # Numbers that stay are a hashed set difference, so a document with many lines takes linear time.
    numbers = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(rows).cast("long") - 1), gone)
    kept = F.array_join(F.transform(numbers, lambda i: F.get(rows, i.cast("int"))), "\n")
    return out.select(*[F.when(F.size(gone) > 0, kept).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns],
                      F.coalesce(F.size(rows), F.lit(0)).cast("long").alias(n_lines), F.size(gone).cast("long").alias(n_removed))

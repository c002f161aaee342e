"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of word shingles, known by 64-bit hashes.  Two documents
link when the Jaccard similarity of their sets is at least ``threshold``
percent.

1. *Filter.*  Two sets that link differ in at most ``floor((1 - threshold) n)``
   of either's ``n`` shingles.  So among the shingles below a fixed hash bound a
   document can have no more than that many which no other set has.  Only
   documents that pass go on.  Each task sends one row a distinct shingle, so a
   shingle that a third of all documents hold is a few rows.
2. *Signatures.*  All shingles have one global order: rare ones first, then
   classes of frequent ones.  A rare shingle signs alone; of the shingles in
   class ``k`` each combination of ``k`` within one slot signs, slots being
   small parts of a class.  A document's prefix is extended until its slots
   hold ``sum(max(0, n_slot - (k - 1))) > floor((1 - threshold) n)`` shingles:
   two sets that link then share a whole signature, as no more shingles than
   that can be missing.  A set that links with one at least as large lacks even
   fewer, so the shorter prefix that this needs (its core) must share a
   signature with the larger set's prefix.  Slots depend on the size band of
   the larger set, so a long document has no more combinations a shingle than a
   short one.
3. *Verification.*  Within a signature, each document is compared with one
   representative, over two rounds with different ones; those that are in
   one component by then need no comparison.  Of what is left apart, two sets
   that met one representative are compared only if their differences from it
   allow a link; all others are compared in full.  So no link between
   different components is missed, and near copies of a text that is not there,
   which differ from each other at random, leave few pairs to compare.

Equal sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import size_checked, store
from tillpoint.llm.components import components
from tillpoint.llm.textscan import Words, blocks, mix, shingles

#: Share of the hash range that the filter looks at.
FILTER_SHARE = 0.35
#: Sampled shingles that a task holds before it sends them.
CHUNK = 1_000_000
#: Document frequency above which a shingle is in class 2, class 3.
CLASS_BOUNDS = (16, 1024)
#: Shingles of a set to one slot of class 2, class 3.
SLOT_SIZE = {2: 6, 3: 8}
#: Sets of fewer shingles than 2 ** this sign with single shingles alone.
SMALL_BAND = 5
#: Sets that met a representative, from which on rows carry their differences from it; differences that a row carries.
MANY, LONGEST = 32, 256
_C = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, hashes, fingerprint)``: text ``i`` has the distinct hashes ``first[i]:first[i + 1]``, in order.

    A text of fewer than ``size`` words has its whole sequence as one shingle; one without words has none.
    """
    w = Words(texts, lower=True)
    doc, h = shingles(w, size)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = [int(np.sum(w.hash[w.first[i]:w.first[i + 1]] * np.array([pow(int(_C), 2 * k + 1, 1 << 64) for k in range(count[i])], np.uint64))) + int(count[i]) for i in short]
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, mix(np.array([x % (1 << 64) for x in whole], np.uint64) ^ _C)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    run = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ _C))])
    n = np.diff(first).astype(np.uint64)
    return first, h, mix((run[first[1:]] - run[first[:-1]]) ^ (n * _C)).view(np.int64)


def _spare(n: np.ndarray, threshold: int) -> np.ndarray:
    """Shingles of a set of ``n`` that a linked one may lack: n - ceil(threshold * n / 100)."""
    return n - -(-threshold * n // 100)


TOKEN, SHARED, LOOKED, COPY = range(4)


def _sample(size: int, share: float):
    """``(text, doc_id)`` to ``(h, fp, code)`` rows.

    A shingle: its hash, a set that has it, TOKEN, or SHARED if several sets of this chunk have it.
    A document: its id, its set, LOOKED or COPY (of a set of this chunk), with the set's size and the number of its
    sampled shingles that no other set of the chunk has.
    """
    bound = np.uint64(int(share * 2.0**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size_held = 0

        def send() -> Iterator[pa.RecordBatch]:
            n = np.concatenate([x[1] for x in held])
            fp = np.concatenate([x[2] for x in held])
            ids = pa.concat_arrays([x[0] for x in held])
            doc = np.concatenate([x[3] + at for x, at in zip(held, np.cumsum([0] + [len(x[1]) for x in held]), strict=False)])
            h = np.concatenate([x[4] for x in held])
            looked = np.zeros(len(n), bool)
            looked[np.unique(fp, return_index=True)[1]] = True
            doc, h = doc[looked[doc]], h[looked[doc]]
            order = np.argsort(h, kind="stable")
            doc, h = doc[order], h[order]
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            several = np.diff(np.append(begin, len(h))) > 1
            alone = np.bincount(doc[begin[~several]], minlength=len(n))
            code = (n.astype(np.int64) << 33) | (alone << 2) | np.where(looked, LOOKED, COPY)
            # In the order of documents, so that a set's rows are neighbours.
            by_doc = np.argsort(doc[begin], kind="stable")
            begin, several = begin[by_doc], several[by_doc]
            names = ["h", "fp", "code"]
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp), pa.array(code)], names)
            for a in range(0, len(begin), 100_000):
                at = begin[a:a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(fp[doc[at]]), pa.array(np.where(several[a:a + 100_000], SHARED, TOKEN))], names)

        for batch in batches:
            for a, b, texts in blocks(batch, 0):
                first, h, fp = shingle_sets(texts, size)
                keep = h < bound
                doc = np.repeat(np.arange(len(texts)), np.diff(first))[keep]
                held.append((batch.column(1)[a:b], np.diff(first), fp, doc, h[keep]))
                size_held += int(keep.sum())
                if size_held > CHUNK:
                    yield from send()
                    held, size_held = [], 0
        if held:
            yield from send()
    return run


def _sets(size: int):
    """``(text, fp)`` to ``(fp, n, hashes)``; a text that is not the set ``fp`` gives no row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in blocks(batch, 0):
                first, h, fp = shingle_sets(texts, size)
                want = np.asarray(batch.column(1)[a:b])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
                out = pa.RecordBatch.from_arrays([pa.array(fp), pa.array(np.diff(first).astype(np.int64)), lists], ["fp", "n", "hashes"])
                yield out.filter(pa.array(want == fp))
    return run


_CHOICES: dict[tuple[int, int], np.ndarray] = {}


def _choices(n: int, k: int) -> np.ndarray:
    if (n, k) not in _CHOICES:
        _CHOICES[n, k] = np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k)
    return _CHOICES[n, k]


def signatures(h: np.ndarray, klass: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's signatures, and whether each is of its core.  ``klass``: each shingle's class, 1 to 3."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    order = np.lexsort((h, klass))
    h, klass = h[order], klass[order]
    spare, band, out, cores = int(_spare(np.int64(n), threshold)), n.bit_length() - 1, [], []
    # With a set of m >= n: at least threshold / (100 + threshold) * (n + m) shingles are common.
    core_spare = n - -(-2 * threshold * n // (100 + threshold))
    for b in (band, band + 1):
        # The next band's larger sets link with this one only if it is nearly as large.
        if b > band and 100 * n < threshold * (1 << b):
            break
        config = np.uint64(b + 1)
        k = klass if b >= SMALL_BAND else np.ones(n, np.int64)
        slot = np.zeros(n, np.int64)
        for c, per in SLOT_SIZE.items():
            slot[k == c] = (mix(h[k == c] ^ config) % np.uint64(max(1, (1 << b) // per))).astype(np.int64) + (c << 40)
        by_slot = np.argsort(slot, kind="stable")
        s = slot[by_slot]
        place = np.empty(n, np.int64)
        place[by_slot] = np.arange(n) - np.searchsorted(s, s)
        unit = (k == 1) | (place >= k - 1)
        units = np.cumsum(unit)
        end, core_end = (int(np.searchsorted(units, x + 1)) + 1 for x in (spare, core_spare))
        single = np.flatnonzero(k[:end] == 1)
        out.append(mix(h[single] * _C + config))
        cores.append(single < core_end)
        often = by_slot[(by_slot < end) & (s > 0)]
        if len(often):
            keys = slot[often]
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                c = int(keys[a] >> 40)
                if z - a >= c:
                    choice = _choices(int(z - a), c)
                    chosen = h[often[a:z]][choice]
                    cores.append(often[a:z][choice[:, -1]] < core_end)
                    both = mix(chosen[:, 0])
                    for j in range(1, c):
                        both = mix(both * _C + chosen[:, j])
                    out.append(both ^ mix(np.full(1, keys[a], np.int64).view(np.uint64) + config))
    sig, core = np.concatenate(out), np.concatenate(cores)
    order = np.lexsort((~core, sig))
    sig, core = sig[order], core[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    return sig[new], core[new]


def _sign(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x).view(np.int64)) for x in (sig, fp, n)), pa.array(np.concatenate(core))], ["sig", "fp", "n", "core"])

        for batch in batches:
            sig, fp, n, core, held = [], [], [], [], 0
            for f, hashes, often in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                h = np.sort(np.asarray(hashes.values).view(np.uint64))
                klass = np.ones(len(h), np.int64)
                for at in often.as_py() or ():
                    klass[np.searchsorted(h, np.uint64(at["h"] % (1 << 64)))] = at["class"]
                signed, cores = signatures(h, klass, threshold)
                sig.append(signed)
                core.append(cores)
                fp.append(np.full(len(signed), f.as_py(), np.int64))
                n.append(np.full(len(signed), len(h), np.int64))
                held += len(signed)
                if held > 1 << 17:
                    yield made()
                    sig, fp, n, core, held = [], [], [], [], 0
            if sig:
                yield made()
    return run


def profiles(docs: DataFrame, size: int, threshold: int, doc_id: str, text: str) -> DataFrame:
    """``(fp, doc_id, copies, n, spared)``: each document with its set, and whether the set passes the filter."""
    texts = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    rows = texts.mapInArrow(_sample(size, FILTER_SHARE), "h long, fp long, code long")
    # Each chunk has a shingle once, so a group has no more rows than there are chunks.
    rows = rows.withColumn("kind", F.col("code").bitwiseAND(3))
    rows = rows.selectExpr("h", "fp", "code", "kind", "min(if(kind < 2, fp, null)) over (partition by h) as a", "max(if(kind < 2, fp, null)) over (partition by h) as b",
                           "max(if(kind < 2, kind, 0)) over (partition by h) as shared")
    rows = rows.filter("kind >= 2 or (kind = 0 and (a <> b or shared = 1))")
    found = rows.selectExpr(
        "fp", "if(kind >= 2, h, null) as doc_id", "kind >= 2 as is_doc", "if(kind = 0, 1L, 0L) as credit", "if(kind = 2, 1L, 0L) as looked",
        "if(kind = 2, shiftright(code, 2) & 2147483647L, 0L) as alone", "if(kind >= 2, shiftright(code, 33), 0L) as n")
    found = found.groupBy("fp", "doc_id", "is_doc").agg(F.sum("credit").alias("credit"), F.sum("looked").alias("looked"), F.sum("alone").alias("alone"),
                                                         F.max("n").alias("n"), F.count("*").alias("copies"))
    found = store(found, "profiles")
    by_set = found.groupBy("fp").agg(F.sum("credit").alias("credit"), F.sum("looked").alias("looked"), F.sum("alone").alias("alone"), F.max("n").alias("n"))
    # A set that several chunks looked at has been counted as often.
    spare = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") / 100)
    passed = by_set.filter((F.col("n") > 0) & (F.col("alone") - F.col("credit") <= spare * F.col("looked"))).select("fp", F.lit(True).alias("passed"))
    return found.filter("is_doc").select("fp", "doc_id", "copies", "n").join(passed, "fp", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))


def compared(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``pairs(a, b)`` with the number of common shingles, ``both``, and whether they ``link``."""
    left = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (100 * both >= threshold * (F.col("na") + F.col("nb") - both)).alias("link"))


def _differences(tried: DataFrame, sets: DataFrame) -> DataFrame:
    """``(fp, rep, n_rep, lacks, adds)``: of the sets that were compared with a representative which many others were compared with
    too, which of its shingles the set lacks, and which others it has.

    Rows of signatures carry the lists, so they are made where groups are large
    alone, and of 16-bit numbers: a shingle's first 13 bits and, where several
    of a list have the same, which of them it is.  So two lists agree in at
    least as many numbers as shingles.  Long lists are left out (null)."""
    met = tried.select(F.col("a").alias("fp"), F.col("b").alias("rep")).union(tried.select("b", "a"))
    often = met.groupBy("rep").agg(F.count("*").alias("met")).filter(F.col("met") >= MANY)
    met = met.join(often, "rep").groupBy("fp").agg(F.max_by("rep", F.struct("met", F.bitwise_not("rep"))).alias("rep"))
    mine = sets.select("fp", F.col("hashes").alias("own"))
    reps = sets.select(F.col("fp").alias("rep"), F.col("hashes").alias("theirs"), F.col("n").alias("n_rep"))

    def listed(x):
        place = F.array_sort(F.transform(x, lambda h: F.shiftrightunsigned(h, 51).cast("int")))
        which = F.transform(place, lambda p, i: i + 1 - F.array_position(place, p))
        numbers = F.transform(F.arrays_zip(place.alias("p"), which.alias("w")), lambda z: (z["p"] * 8 + z["w"] - 32768).cast("short"))
        return F.when((F.size(x) <= LONGEST) & (F.size(x) > 0) & (F.array_max(which) < 8), numbers).when(F.size(x) == 0, F.array().cast("array<smallint>"))
    both = met.join(mine, "fp").join(reps, "rep")
    return both.select("fp", "rep", "n_rep", listed(F.array_except("theirs", "own")).alias("lacks"), listed(F.array_except("own", "theirs")).alias("adds"))


def _full(signed: DataFrame, apart: DataFrame, tried: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs of all sets in different components that meet in a signature of ``apart``.

    Two sets that share many signatures would come up at each of them.  A row
    knows the signatures just before it, so a pair is left to an earlier
    signature where both are seen to have one.  Of two sets that were compared
    with one representative their differences from it say how much they can
    have in common: what neither lacks of it, and what both add.  Copies of a
    text that is not there differ from each other at random, so few of their
    pairs are left.
    """
    met = store(_differences(tried, sets), "differences")
    rows = signed.join(apart.select("sig"), "sig").join(met, "fp", "left")
    before = lambda n: Window.partitionBy("fp").orderBy("sig").rowsBetween(-n, -1)
    own = rows.withColumn("before", F.collect_list("sig").over(before(16)))
    core = rows.filter("core").withColumn("before", F.collect_list("sig").over(before(8)))
    core = core.select("sig", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("before").alias("before_b"),
                       F.col("rep").alias("rep_b"), F.col("lacks").alias("lacks_b"), F.col("adds").alias("adds_b"))
    lacking = F.size("lacks") + F.size("lacks_b") - F.size(F.array_intersect("lacks", "lacks_b"))
    most = F.col("n_rep") - lacking + F.size(F.array_intersect("adds", "adds_b"))
    known = (F.col("rep") == F.col("rep_b")) & F.col("lacks").isNotNull() & F.col("lacks_b").isNotNull() & F.col("adds").isNotNull() & F.col("adds_b").isNotNull()
    cannot = F.coalesce(F.when(known, 100 * most < threshold * (F.col("n") + F.col("nb") - most)), F.lit(False))
    return own.join(core, "sig").filter(F.expr("component <> cb and n >= nb and not arrays_overlap(before, before_b)") & ~cannot)


def linked_sets(sets: DataFrame, threshold: int, rounds: int = 2) -> DataFrame:
    """``(node, component)`` of every set that links with another."""
    tokens = sets.select("fp", F.explode("hashes").alias("h"))
    low, high = CLASS_BOUNDS
    often = tokens.groupBy("h").agg(F.count("*").alias("df")).filter(F.col("df") > low)
    often = store(often.select("h", F.when(F.col("df") > high, 3).otherwise(2).alias("class")), "frequent-shingles")
    mine = tokens.join(size_checked(often, 500_000), "h").groupBy("fp").agg(F.collect_list(F.struct("h", "class")).alias("often"))
    signed = sets.join(mine, "fp", "left").select("fp", "hashes", "often").mapInArrow(_sign(threshold), "sig long, fp long, n long, core boolean")
    signed = store(signed, "signatures")
    shared = signed.groupBy("sig").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.max("core").alias("c")).filter("a <> b and c").select("sig")
    signed = signed.join(shared, "sig").withColumn("component", F.col("fp"))
    # The original of a group of near copies shares more signatures than they do: it represents them first.
    signed = signed.withColumn("pick", -(F.shiftleft(F.count("*").over(Window.partitionBy("fp")), 32) + F.col("fp").bitwiseAND(0xFFFFFFFF)))
    signed = store(signed, "shared-signatures")
    links = None
    tried = sets.sparkSession.createDataFrame([], "a long, b long, both int, link boolean")
    for turn in range(rounds + 1):
        # Signatures that still join several components, each with a representative that has it in its core.
        pick = F.col("pick") if turn == 0 else F.col("fp").bitwiseXOR(F.lit((turn * 0x9E3779B97F4A7C15) % (1 << 63)))
        apart = signed.groupBy("sig").agg(F.min(F.when(F.col("core"), pick)).alias("pick_b"), F.min("component").alias("c"), F.max("component").alias("d"))
        apart = apart.filter("c <> d").select("sig", "pick_b")
        if turn < rounds:
            rep = signed.filter("core").select("sig", pick.alias("pick_b"), F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
            # The core is the smaller set's; a larger representative is met by the cores of smaller sets.
            pairs = signed.join(apart.join(rep, ["sig", "pick_b"]), "sig").filter("component <> cb and (n >= nb or core)")
        else:
            pairs = _full(signed, apart, tried, sets, threshold)
        pairs = pairs.filter((100 * F.least("n", "nb") >= threshold * F.greatest("n", "nb")))
        pairs = pairs.select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).distinct()
        pairs = store(pairs.join(tried, ["a", "b"], "left_anti"), "candidates")
        if pairs.isEmpty():
            continue
        tried = tried.unionByName(store(compared(pairs, sets, threshold), "compared"))
        links = tried.filter("link").select("a", "b")
        if turn < rounds:
            known = components(links).withColumnRenamed("component", "now")
            signed = store(signed.join(known, signed.fp == known.node, "left").select("sig", "fp", "n", "core", "pick", F.coalesce("now", "fp").alias("component")), "shared-signatures")
    if links is None:
        return sets.select(F.col("fp").alias("node"), F.col("fp").alias("component")).limit(0)
    return components(links)


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row for each document; ``threshold`` in percent, 51 to 99.

    ``component_id`` is the smallest id that the document reaches by links,
    itself included.  A null text and a text without words have an empty set,
    which links with nothing.  Rows without id have no component and link with
    nothing.  Rows of one id and one set give one row each.  Other columns are
    ignored.  An empty table gives no rows.
    """
    every = store(profiles(docs, size, threshold, doc_id, text), "sets-of-documents")
    chosen = every.filter("passed and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"))
    chosen = store(chosen, "chosen")
    texts = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    texts = texts.join(size_checked(chosen, 2_000_000), texts.doc_id == chosen.doc).select("text", "fp")
    sets = store(texts.mapInArrow(_sets(size), "fp long, n long, hashes array<long>"), "sets")
    linked = store(linked_sets(sets, threshold), "linked")
    # The smallest id of a component: of its sets' smallest ids.
    own = every.filter("doc_id is not null and n > 0").groupBy("fp").agg(F.min("doc_id").alias("low"))
    grouped = own.join(linked, own.fp == linked.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    by_set = grouped.join(lowest, "component").select("fp", "component_id")
    out = every.join(by_set, "fp", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))

"""Corpus pipeline: raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.

All stages take an empty table and give no rows for it, judge rows (not ids)
one by one where rows share an id, keep columns that ``documents`` does not
have as they are, and choose names for columns of their own that the table
does not use.  Each says below what it makes of nulls, ties and repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm import common, jaccard, line_dedup, mixing, packing, quality


def unused(docs: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``docs`` is called so."""
    while name in docs.columns:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the quality classifier scores below 0.3 go.

    A null text is scored as an empty one.  A score of exactly 0.3 stays.  Equal
    rows have equal scores, so they stay or go together.  Rows without id are
    scored, but teach nothing."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = unused(docs, "quality_score")
    return quality.score(docs, machine, out=out).filter(F.col(out) >= 0.3).drop(out)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: lines that an earlier line equals or nearly equals go, and with them documents of which no word stays.

    A null or empty text stays as it is, a row without id keeps its lines.  Of equal lines the one of
    the smallest id, then line number, stays; rows of one id are one document here."""
    had, lost = unused(docs, "lines_had"), unused(docs, "lines_lost")
    out = line_dedup.dedup_lines(docs, n_lines=had, n_removed=lost)
    out = out.filter((F.col(lost) == 0) | F.col("text").rlike(common.WORD))
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.coalesce(n_chars, "n_chars")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: of each group of near duplicates one row stays, that with the smallest id (no id comes last), then key.

    Rows are judged each by itself, whatever their ids: rows of one id with
    different texts, and rows without id, are compared as any others.  Of
    wholly equal rows one stays.  Rows without words (null and empty texts too) are no one's copies.
    """
    # Maps have no hash of their own.
    plain = [F.to_json(F.struct(c)) if "map<" in docs.schema[c].dataType.simpleString() else F.col(c) for c in docs.columns]
    key = F.xxhash64(*plain, *[F.col(c).isNull() for c in docs.columns])
    keyed = docs.withColumn("__row", key)
    found = jaccard.near_duplicates(keyed.select("__row", "text"), doc_id="__row").filter("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("__row"), "component_id").agg(F.count("*").alias("copies"))
    found = common.store(found.join(keyed.select("__row", "doc_id").distinct(), "__row"), "components-of-rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    groups = found.groupBy("component_id").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = common.store(groups.select("component_id", F.col("first.__row").alias("stays")), "near-duplicate-groups")
    copies = found.join(common.size_checked(groups, 1_000_000), "component_id").filter("__row <> stays").select("__row")
    copies = common.store(copies, "near-duplicates")
    equal = common.store(found.filter("copies > 1").select("__row"), "equal-rows")
    left = keyed.join(common.size_checked(copies, 2_000_000), "__row", "left_anti")
    equal = common.size_checked(equal, 1_000_000)
    once = left.join(equal, "__row", "left_semi").dropDuplicates(["__row"])
    return left.join(equal, "__row", "left_anti").unionByName(once).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: sources are mixed to their target weights; a document stands for the words that each pass takes of it.

    A null source is a source of its own, the last.  Texts without words (null ones too) take no part and go, as
    nothing can be taken of them.  Which words a pass takes is drawn by hash, alike on every run."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: pack what is left; a row per piece.

    A null text is packed as an empty one: its end token alone.  Equal rows are packed each."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


STAGES = [("quality", keep_quality), ("line_dedup", drop_repeated_lines), ("near_duplicates", drop_near_duplicates),
          ("mixing", mix_sources), ("packing", pack_sequences)]
#: Hashes and a fitted model are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

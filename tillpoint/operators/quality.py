"""Data quality and profile (D-29, D-30, D-31, A-05, F-16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.operators.ranking import grouped_quantiles


def _long(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    """Unpivot ``cols`` into (column, value) rows (one narrow pass)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D-29 (numeric): type, count, mean, std, min, quartiles, max per column.

    Quartiles are exact and distributed (``grouped_quantile`` over the
    unpivoted frame), so no column is gathered into one task."""
    long = _long(df, cols, "double").where(F.col("value").isNotNull())
    base = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    qs = grouped_quantiles(long, ["column"], "value", [(0.25, "p25"), (0.5, "p50"), (0.75, "p75")])
    types = F.create_map(*[F.lit(x) for c in cols for x in (c, df.schema[c].dataType.simpleString())])
    return base.join(qs, "column", "left").withColumn("dtype", types[F.col("column")])


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D-29 (text): count, unique, most frequent value (ties: smallest) and its frequency."""
    long = _long(df, cols, "string").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("freq"))


def date_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D-29 (dates and times): type, count, unique, first, last, the most frequent (ties: the earliest) and its frequency.

    Counts by value first, so a day that most rows share is one row a task."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("timestamp_ntz").alias("value")) for c in cols])
    counts = df.select(F.explode(pairs).alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    types = F.create_map(*[F.lit(x) for c in cols for x in (c, df.schema[c].dataType.simpleString())])
    out = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), F.min("value").alias("first"), F.max("value").alias("last"),
                                       F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("freq"))
    return out.withColumn("dtype", types[F.col("column")])


def missing_by_column(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """D-30: null count per column, one aggregate pass, then unpivoted."""
    cols = list(cols or df.columns)
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("missing")) for c in cols])
    return agg.select(F.explode(pairs).alias("p")).select("p.column", "p.missing")


def row_digest(cols: Sequence[str]) -> Column:
    """128 bits of a row: two 64-bit hashes of every column, nulls told from values."""
    whole = [F.col(c) for c in cols] + [F.col(c).isNull() for c in cols]
    return F.struct(F.xxhash64(*whole).alias("a"), F.xxhash64(F.lit(1), *whole).alias("b"))


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None, digest: Column | None = None) -> DataFrame:
    """D-31: rows beyond the first occurrence of an identical row.

    Only digests are shuffled for all rows.  Rows whose digest comes once have
    no duplicate; the others are compared column by column, so rows that share
    a digest by chance are told apart."""
    cols = list(cols or df.columns)
    keyed = df.select(*cols).withColumn("_digest", row_digest(cols) if digest is None else digest)
    often = keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_digest")
    per_row = keyed.join(often, "_digest", "left_semi").groupBy("_digest", *cols).agg(F.count(F.lit(1)).alias("n"))
    return per_row.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def latest_sample(df: DataFrame, n: int = 5, offset: str = "+04:00") -> DataFrame:
    """A-05: newest rows with the stored time shifted from UTC to ``offset``,
    plus the local date and time-of-day text."""
    ts = F.col("ReceivedAt")
    return (df.orderBy(ts.desc(), F.col("OrderID")).limit(n)
              .select("OrderID", "ReceivedAt",
                      F.convert_timezone(F.lit("+00:00"), F.lit(offset), ts).alias("ReceivedAt_Local"),
                      F.to_date(ts).alias("Date_Local"), F.date_format(ts, "HH:mm:ss").alias("Time_Local")))


def day_fingerprints(df: DataFrame) -> DataFrame:
    """F-16: per-day change fingerprint md5(date_count_latest); a day whose
    fingerprint changed is the one to recompute."""
    g = df.where(F.col("Date").isNotNull()).groupBy("Date").agg(
        F.count(F.lit(1)).alias("rows"), F.max("ReceivedAt").alias("latest"))
    return g.withColumn("fingerprint", F.md5(F.concat_ws(
        "_", F.col("Date").cast("string"), F.col("rows").cast("string"), F.col("latest").cast("string"))))

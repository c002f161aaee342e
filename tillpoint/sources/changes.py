"""Refresh by change (F-16): a stored order table follows its sources, and only days that changed are written again.

With each version the table keeps what it was made from: the source files, and
a fingerprint of each of its days.

1. No file differs: nothing is read.
2. Files of orders or lines were added and nothing else: the new files alone
   say which days they touch.
3. Anything else (a file replaced or gone, a customer renamed): the days'
   fingerprints are computed anew from the sources and compared.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.sources.daytable import DayTable
from tillpoint.sources.snapshots import Version

SOURCE_TABLES = ("orders", "lineitem", "customer", "part", "nation")
Days = list[dt.date | None]


def source_files(spark: SparkSession, sf_dir: str, tables: Sequence[str] = SOURCE_TABLES) -> DataFrame:
    """``(table, path, length, modified)`` of every file; no file is read."""
    out = None
    for t in tables:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{sf_dir.rstrip('/')}/{t}.parquet")
                      .select(F.lit(t).alias("table"), "path", "length", F.unix_micros(F.col("modificationTime").cast("timestamp")).alias("modified")))
        out = files if out is None else out.unionByName(files)
    return out


def signature(files: DataFrame) -> str:
    """A short text that changes with any file's name, size or time."""
    row = files.agg(F.sum(F.xxhash64("table", "path", "length", "modified").cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha1(f"{row['h']}_{row['n']}".encode()).hexdigest()[:16]


def fingerprints(rows: DataFrame) -> DataFrame:
    """``(Date, rows, sum, mix)``: of each day the number of its rows, and their content in any order (two 64-bit hashes of every column)."""
    cols = sorted(c for c in rows.columns if c != "Month")
    # Nulls are told from the next column's value.
    whole = [F.col(c) for c in cols] + [F.col(c).isNull() for c in cols]
    return rows.groupBy("Date").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*whole).cast("decimal(38,0)")).alias("sum"),
                                    F.bit_xor(F.xxhash64(F.lit(1), *whole)).alias("mix"))


def days_that_differ(old: DataFrame, new: DataFrame) -> Days:
    """Days of either with another fingerprint in the other; one a calendar day at most."""
    both = old.exceptAll(new).unionByName(new.exceptAll(old))
    return [r[0] for r in both.select("Date").distinct().collect()]


def on_days(rows: DataFrame, days: Days) -> DataFrame:
    """Rows of these days (None: without a date), by month where the table has one."""
    dated = [d for d in days if d is not None]
    chosen = F.col("Date").isin(dated) if dated else F.lit(False)
    if dated and "Month" in rows.columns:
        chosen = chosen & F.col("Month").isin(sorted({d.strftime("%Y-%m") for d in dated}))
    return rows.where((chosen | F.col("Date").isNull()) if None in days else chosen)


def _days_of_new_files(spark: SparkSession, sf_dir: str, new: list) -> Days:
    base = sf_dir.rstrip("/")
    o_date = F.to_date("o_orderdate").alias("Date")
    days = None
    orders = [r["path"] for r in new if r["table"] == "orders"]
    lines = [r["path"] for r in new if r["table"] == "lineitem"]
    if orders:
        days = spark.read.parquet(*orders).select("o_orderkey", "o_orderdate")
    if lines:
        keys = spark.read.parquet(*lines).select(F.col("l_orderkey").alias("o_orderkey")).distinct()
        more = spark.read.parquet(f"{base}/orders.parquet").select("o_orderkey", "o_orderdate").join(keys, "o_orderkey", "left_semi")
        days = more if days is None else days.unionByName(more)
    if days is None:
        return []
    return [r[0] for r in days.select(o_date).distinct().collect()]


def changed_days(spark: SparkSession, sf_dir: str, table: DayTable, base: Version, files: DataFrame, build: Callable[[Days | None], DataFrame]) -> Days:
    known = table.log.read(base, "files")
    new, gone = files.exceptAll(known).collect(), known.exceptAll(files)
    if {r["table"] for r in new} <= {"orders", "lineitem"} and gone.isEmpty():
        found = _days_of_new_files(spark, sf_dir, new)
        # An order's time may lie in the day after its date.
        return sorted({d + dt.timedelta(days=k) for d in found if d is not None for k in (0, 1)}) + [None] * (None in found)
    return days_that_differ(table.log.read(base, "fingerprints"), fingerprints(build(None)))


def follow(spark: SparkSession, sf_dir: str, path: str, build: Callable[[Days | None], DataFrame], widen: Callable[..., DataFrame] | None = None) -> Days | None:
    """Bring the day table at ``path`` up to its sources; the days that were written, None for all of them.

    ``build(days)`` makes the rows of these days from the sources (None: of all),
    ``widen`` the table's columns of them (``DayTable.replace_days``)."""
    table = DayTable(spark, path, undated=True)
    files = source_files(spark, sf_dir)
    sign, base = signature(files), table.version()
    if base is None:
        table.replace_days(build(None), whole=True, keep=lambda rows: {"files": files, "fingerprints": fingerprints(rows)}, info={"signature": sign}, widen=widen)
        return None
    if base.info["signature"] == sign:
        return []
    days = changed_days(spark, sf_dir, table, base, files, (lambda d: widen(build(d))) if widen else build)
    old = table.log.read(base, "fingerprints")
    some = spark.createDataFrame([(d,) for d in days], "Date date")
    others = old.join(some.withColumn("again", F.lit(True)), old["Date"].eqNullSafe(some["Date"]), "left_anti") if days else old
    batch = build(days) if days else build([]).limit(0)
    table.replace_days(batch, also=days, keep=lambda rows: {"files": files, "fingerprints": others.unionByName(fingerprints(rows))}, info={"signature": sign}, widen=widen)
    return days

"""Sinks: replace-by-day table (A-09, T-03) and CSV export (A-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.sources.daytable import DayTable


def replace_by_day(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """A-09 as a query: drop stored rows on every date present in the batch,
    then append the batch.  A batch without valid dates deletes nothing."""
    days = batch.select("Date").where(F.col("Date").isNotNull()).distinct()
    return existing.join(days, "Date", "left_anti").unionByName(batch)


def write_replace_by_day(batch: DataFrame, path: str) -> None:
    """A-09 / T-03 as a plain Parquet sink: dynamic partition overwrite of the batch's days.

    Only the ``Date`` partitions present in the batch are replaced.  The batch
    must hold whole days (an export does).  Plain Parquet commits file by
    file: a reader during the write may see a day between its two states.
    ``publish_days`` changes all days at once."""
    (batch.where(F.col("Date").isNotNull())
          .hint("rebalance", F.col("Date")).sortWithinPartitions("Date")
          .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("Date").parquet(path))


def publish_days(batch: DataFrame, path: str) -> None:
    """A-09 / T-03: the days of the batch are replaced in the day table at ``path``, all of them in one version.

    Readers see the version before or the one after; a write that fails leaves
    the one before.  Another writer of one of the days is a ``Conflict``."""
    DayTable(batch.sparkSession, path).replace_days(batch)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a day table as of its latest version (whatever wrote it: ``publish_days`` or deliveries)."""
    return DayTable(spark, path).read().drop("Month")


def read_deliveries(spark: SparkSession, path: str) -> DataFrame:
    """The table that deliveries keep: of each day the rows of its latest whole delivery."""
    return read_days(spark, path)


def export_csv(df: DataFrame, path: str) -> None:
    """A-10: header CSV files of a result table."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)

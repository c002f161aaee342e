"""A table of days with whole replacements (A-09, T-01, T-03, F-16).

Rows lie in *parts*: a part is what one batch wrote, by month and in order of
the day, so files are few and a date filter skips most.  A version lists which
days of which parts count (``snapshots``); readers see one version, and a
write that fails, or is half done, is seen by nobody.

*Deliveries.*  A delivery is a folder of files.  Its batches are staged as
parts with a record of what each holds (file, day, rows); it counts once every
file that its mark names is there in full, and then all its days change in one
version.  Of the deliveries of a day the latest counts, by id.  A file that is
staged already is not staged again, so replays change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.sources.snapshots import Conflict, Snapshots, Version, names_in, remove

#: The delivery id of rows that were written without one; it sorts before all names of deliveries.
DIRECT = "-"
MAP = "part string, delivery_id string, Date date, rows long, live boolean"
_MARK = "delivery_file string, rows long"
#: Rows of a lookup by day that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def _day() -> Column:
    """A day to join by; rows without a date are a day of their own."""
    return F.coalesce(F.col("Date"), F.lit("0001-01-01").cast("date")).alias("_day")


class DayTable:
    """``undated`` keeps rows without a date, as one more day; else they are left out."""

    def __init__(self, spark: SparkSession, path: str, undated: bool = False):
        self.spark, self.path, self.undated = spark, path.rstrip("/"), undated
        self.log = Snapshots(spark, f"{self.path}/log")

    # Parts ----------------------------------------------------------------
    def _write_part(self, rows: DataFrame, part: str, widen: Callable[..., DataFrame] | None = None) -> None:
        """Rows as files of about the advisory size, whatever their number: Spark cuts large months and joins small ones.

        A batch of a stream (``b-``) is small and lies in one folder, in order of the day; else a part has a folder a month.
        Rows without ``delivery_id`` are written under ``DIRECT``.  ``widen`` projects the table's columns of rows that are dealt
        and sorted already, and keeps those that are named."""
        rows = (rows if self.undated else rows.where(F.col("Date").isNotNull())).withColumn("Month", F.date_format("Date", "yyyy-MM"))
        flat, direct = part.startswith("b-"), "delivery_id" not in rows.columns
        dealt = rows.hint("rebalance") if flat else rows.hint("rebalance", F.col("Month"))
        # The writer keeps this order if it begins with the folders that differ; a constant in it would make it sort once more.
        dealt = dealt.sortWithinPartitions(*[] if direct else ["delivery_id"], *[] if flat else ["Month"], "Date")
        dealt = widen(dealt, "Month") if widen else dealt
        dealt = dealt.withColumn("delivery_id", F.lit(DIRECT)) if direct else dealt
        by = ["delivery_id"] if flat else ["delivery_id", "Month"]
        dealt.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/data/part={part}")

    def _days_of(self, part: str, schema: T.StructType) -> DataFrame:
        rows = self._scan([f"{self.path}/data/part={part}"], schema)
        return rows.groupBy("part", "delivery_id", "Date").agg(F.count(F.lit(1)).alias("rows")).withColumn("live", F.lit(True))

    def _scan(self, folders: Sequence[str], schema: T.StructType) -> DataFrame:
        """Rows of part folders with ``part``, ``delivery_id`` and ``Month``."""
        batches = [f for f in folders if f.removeprefix(f"{self.path}/data/part=").startswith("b-")]
        out = None
        for some in (batches, [f for f in folders if f not in set(batches)]):
            if some:
                rows = self.spark.read.schema(_scan_schema(schema)).option("basePath", f"{self.path}/data").parquet(*some)
                out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], _scan_schema(schema))

    # Reading --------------------------------------------------------------
    def version(self) -> Version | None:
        return self.log.latest()

    def days(self, version: Version | None = None) -> DataFrame:
        """Which days of which parts a version lists, and whether they count."""
        version = version or self.version()
        rows = self.log.read(version) if version else None
        return rows if rows is not None else self.spark.createDataFrame([], MAP)

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version (the latest), with their ``Month``.

        Parts of which every day counts are plain scans, so filters reach the
        files; of the others the days that no longer count are taken away.
        The driver learns the names of the parts, one row each."""
        version = version or self.version()
        if version is None:
            raise FileNotFoundError(f"no version of {self.path} yet")
        schema = T.StructType.fromJson(version.info["schema"])
        kept = [f.name for f in schema.fields if f.name not in ("part", "delivery_id", "delivery_file", "Month")]
        return self._rows(version, schema).select(*kept, "Month")

    def _rows(self, version: Version, schema: T.StructType) -> DataFrame:
        listed = self.days(version)
        units = listed.groupBy("part", "delivery_id").agg(F.bool_and("live").alias("whole"), F.bool_or("live").alias("any")).where("any").collect()
        where = lambda u: f"{self.path}/data/part={u['part']}/delivery_id={u['delivery_id']}"
        whole, mixed = [where(u) for u in units if u["whole"]], [where(u) for u in units if not u["whole"]]
        out = self._scan(whole, schema)
        if mixed:
            dead = listed.where(~F.col("live")).select("part", "delivery_id", _day())
            small = dead.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            some = self._scan(mixed, schema).withColumn("_day", _day())
            out = out.unionByName(some.join(F.broadcast(dead) if small else dead, ["part", "delivery_id", "_day"], "left_anti").drop("_day"))
        return out

    # Writing --------------------------------------------------------------
    def replace_days(self, batch: DataFrame, also: Sequence = (), keep: Callable[[DataFrame], dict[str, DataFrame]] | None = None,
                     whole: bool = False, info: dict | None = None, widen: Callable[..., DataFrame] | None = None) -> Version:
        """A-09: the batch's days, and those of ``also``, hold the batch's rows alone from the next version on.

        ``whole`` replaces every day.  A batch without dates changes nothing but
        ``also``.  A reader during the write sees the version before.  If
        another writer commits one of these days meanwhile, ``Conflict`` is
        raised and nothing changes; other days are no conflict.  ``keep`` makes
        tables that are kept with the version out of the written rows; ``info``
        are small facts kept with it.  With ``widen(rows, *more)`` the batch
        holds narrow rows with their ``Date``, which are shuffled and sorted as
        such; it makes the table's columns of each row (and keeps ``more``)."""
        base, part = self.version(), uuid.uuid4().hex[:16]
        batch = batch.drop("Month", "part", "delivery_id")
        schema = (widen(batch) if widen else batch).schema
        self._write_part(batch, part, widen)
        if names_in(self.spark, f"{self.path}/data/part={part}/delivery_id={DIRECT}"):
            written, new = self._scan([f"{self.path}/data/part={part}"], schema), self._days_of(part, schema)
        else:
            written, new = self.spark.createDataFrame([], schema), self.spark.createDataFrame([], MAP)
        new = new.cache()  # a row a day
        gone = new.select(_day()).union(self.spark.createDataFrame([(d,) for d in also], "Date date").select(_day())).distinct()
        extra = keep(written.select(*schema.names)) if keep else {}
        facts = {k: v for k, v in (base.info if base else {}).items() if k == "deliveries"} | {"schema": schema.jsonValue()} | (info or {})
        start = base
        try:
            while True:
                after = self.days(base).withColumn("_day", _day()).join(gone.withColumn("goes", F.lit(True)), "_day", "left")
                after = after.withColumn("live", F.col("live") & F.col("goes").isNull() & F.lit(not whole)).drop("goes", "_day")
                try:
                    return self.log.commit(base, {"rows": _without_dead_parts(after.unionByName(new))} | extra, facts)
                except Conflict:
                    base = self.version()
                    had, has = (self.days(v).where("live").select("part", "delivery_id", "rows", _day()) for v in (start, base))
                    moved = has.exceptAll(had).unionByName(had.exceptAll(has))
                    if whole or extra or not moved.join(gone, "_day", "left_semi").isEmpty():
                        raise
                    facts = facts | {k: v for k, v in base.info.items() if k == "deliveries"}
        finally:
            new.unpersist()

    # Deliveries -----------------------------------------------------------
    def staged(self, deliveries: Sequence[str]) -> DataFrame:
        """``(delivery_id, delivery_file, Date, rows, part)``: what the parts of these deliveries hold."""
        schema = "delivery_file string, Date date, rows long, delivery_id string, part string"
        try:
            rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/staged").parquet(f"{self.path}/staged")
        except AnalysisException:
            rows = self.spark.createDataFrame([], schema)
        return rows.where(F.col("delivery_id").isin(list(deliveries))).select("delivery_id", "delivery_file", "Date", "rows", "part")

    def stage(self, batch: DataFrame) -> None:
        """Add a batch's files to their deliveries (columns ``delivery_id``, ``delivery_file``); nothing changes for readers yet.

        Names of the batch's files are collected: as many as a trigger takes.
        The part is named by them, so the same batch again overwrites itself."""
        names = sorted((r["delivery_id"], r["delivery_file"]) for r in batch.select("delivery_id", "delivery_file").distinct().collect())
        if not names:
            return
        have = self.staged(sorted({d for d, _ in names})).select("delivery_id", "delivery_file").distinct()
        have = {(r["delivery_id"], r["delivery_file"]) for r in have.collect()}
        todo = [n for n in names if n not in have]
        if not todo:
            return
        if have:
            batch = batch.where(F.struct("delivery_id", "delivery_file").isin([F.struct(F.lit(d).alias("delivery_id"), F.lit(f).alias("delivery_file")) for d, f in todo]))
        part = "b-" + uuid.uuid5(uuid.NAMESPACE_URL, repr(todo)).hex[:16]
        self._write_part(batch, part)
        record = batch.groupBy("delivery_id", "delivery_file", "Date").agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit(part))
        # One file a delivery and batch: the record is there whole or not at all.
        (record.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy("delivery_id", "part").parquet(f"{self.path}/staged"))

    def commit_deliveries(self, marks: DataFrame, schema: T.StructType) -> Version | None:
        """A version with every delivery that is whole by ``marks(delivery_id, delivery_file, rows)`` and not in yet.

        All files that a mark names must be staged with as many rows (a file without
        rows needs none).  Until then a delivery changes nothing."""
        base = self.version()
        marks = marks.groupBy("delivery_id", "delivery_file").agg(F.max("rows").alias("due"))
        ids = [r[0] for r in marks.select("delivery_id").distinct().collect()]
        ids = [d for d in ids if d not in (base.info.get("deliveries", []) if base else [])]
        if not ids:
            return None
        staged = self.staged(ids)
        there = staged.groupBy("delivery_id", "delivery_file").agg(F.sum("rows").alias("got"))
        state = marks.where(F.col("delivery_id").isin(ids)).join(there, ["delivery_id", "delivery_file"], "left")
        state = state.groupBy("delivery_id").agg(F.bool_and(F.coalesce("got", F.lit(0)) == F.col("due")).alias("whole"))
        ready = sorted(r[0] for r in state.where("whole").collect())
        if not ready:
            return None
        new = staged.where(F.col("delivery_id").isin(ready) & F.col("Date").isNotNull())
        new = new.groupBy("part", "delivery_id", "Date").agg(F.sum("rows").alias("rows")).withColumn("live", F.lit(True))
        while True:
            every = self.days(base).unionByName(new)
            best = every.where("live").groupBy("Date").agg(F.max("delivery_id").alias("best"))
            rows = every.join(best, "Date", "left").withColumn("live", F.col("live") & (F.col("delivery_id") == F.col("best"))).drop("best")
            known = base.info.get("deliveries", []) if base else []
            try:
                return self.log.commit(base, {"rows": _without_dead_parts(rows)}, {"schema": schema.jsonValue(), "deliveries": sorted({*known, *ready})})
            except Conflict:
                base = self.version()

    # Upkeep ---------------------------------------------------------------
    def compact(self) -> Version:
        """All rows that count in one part, by delivery and month; readers of older versions are not disturbed.

        Rows keep their delivery, so one that completes later is judged as before."""
        base = self.version()
        schema = T.StructType.fromJson(base.info["schema"])
        part = uuid.uuid4().hex[:16]
        self._write_part(self._rows(base, schema).drop("Month", "part"), part)
        return self.log.commit(base, {"rows": self._days_of(part, schema)}, {k: v for k, v in base.info.items() if k != "folder"})

    def vacuum(self, keep: int = 2) -> None:
        """Remove versions but the last ``keep``, and parts that none of these lists and no delivery still waits with."""
        self.log.forget(keep)
        numbers = [int(n) for n in names_in(self.spark, f"{self.path}/log/commits") if n.isdigit()]
        used, done = set(), set()
        for n in numbers:
            v = self.log.version(n)
            used |= {r[0] for r in self.days(v).select("part").distinct().collect()}
            done |= set(v.info.get("deliveries", []))
        waiting = [n.removeprefix("delivery_id=") for n in names_in(self.spark, f"{self.path}/staged") if n.startswith("delivery_id=")]
        for d in waiting:
            if d not in done:
                used |= {n.removeprefix("part=") for n in names_in(self.spark, f"{self.path}/staged/delivery_id={d}")}
        for name in names_in(self.spark, f"{self.path}/data"):
            if name.startswith("part=") and name.removeprefix("part=") not in used:
                remove(self.spark, f"{self.path}/data/{name}")


def _scan_schema(schema: T.StructType) -> T.StructType:
    full = T.StructType([f for f in schema.fields if f.name not in ("part", "delivery_id", "Month")])
    for name in ("part", "delivery_id", "Month"):
        full = full.add(name, "string")
    return full


def _without_dead_parts(rows: DataFrame) -> DataFrame:
    """A part of which no day counts is not listed any more."""
    alive = rows.groupBy("part", "delivery_id").agg(F.bool_or("live").alias("any")).where("any").select("part", "delivery_id")
    return rows.join(alive, ["part", "delivery_id"], "left_semi").select("part", "delivery_id", "Date", "rows", "live").coalesce(1)


def read_marks(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """``(delivery_id, delivery_file, rows)`` from the marks (``complete.json``) of delivery folders that have one."""
    out = spark.createDataFrame([], "delivery_id string, " + _MARK)
    for folder in folders:
        if names_in(spark, f"{folder}/complete.json") or "complete.json" in names_in(spark, folder):
            rows = spark.read.schema(_MARK).json(f"{folder}/complete.json")
            out = out.unionByName(rows.select(F.lit(folder.rstrip("/").rsplit("/delivery-", 1)[1]).alias("delivery_id"), "delivery_file", "rows"))
    return out

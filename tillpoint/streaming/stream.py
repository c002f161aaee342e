"""Structured Streaming: incremental order loads and rolling totals (T-01..T-04).

The dashboard polls the table's latest timestamp and reloads; here arriving
order files are read as a stream (``Trigger.AvailableNow`` for catch-up
runs, a processing-time trigger in production), each delivery replaces the
days it carries in the day-partitioned table, and rolling totals and the
freshness maximum are streaming aggregations.

Watermarks need TIMESTAMP (not NTZ) event time.  Wall-clock NTZ values are
mapped to an instant as if they were UTC — zone-free, by epoch arithmetic —
and window starts are mapped back the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillpoint.session import shared_dir
from tillpoint.sources.daytable import DayTable, read_marks
from tillpoint.sources.snapshots import Conflict, Snapshots, names_in, remove


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def ntz_to_instant(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), col))


def instant_to_ntz(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_add("MICROSECOND", F.unix_micros(col), _epoch())


def order_stream(spark: SparkSession, landing: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """T-01: arriving Parquet order files as a stream (fixed schema, no inference).

    A delivery is a folder ``delivery-<id>`` of any number of files, ids (letters, digits, ``._-``) in
    order of arrival; the columns ``delivery_id`` and ``delivery_file`` name each row's.
    ``files_per_batch`` only paces the stream: no result depends on it."""
    rows = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
                 .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(landing))
    path, where = F.col("_metadata.file_path"), r"^(.*/delivery-([A-Za-z0-9._-]+))/(.+)$"
    return rows.select(*schema.fieldNames(), F.regexp_extract(path, where, 2).alias("delivery_id"),
                       F.regexp_extract(path, where, 3).alias("delivery_file"), F.regexp_extract(path, where, 1).alias("delivery_folder"))


def load_incrementally(stream: DataFrame, table: str, checkpoint: str, available_now: bool = True):
    """T-01 + T-03: each micro-batch stages its files; a delivery counts once all files of its mark are there.

    A delivery's mark is ``complete.json`` in its folder, a line a file with
    the number of its rows (``stage_landing`` writes one).  A day may come in any
    number of files and batches; its delivery replaces the earlier one in a
    single version of the table, so readers see whole deliveries only.  The
    checkpoint makes the load restartable; a file that is replayed is not
    taken twice.  ``settle`` looks at marks that came after the last file."""
    schema = StructType([f for f in stream.schema.fields if not f.name.startswith("delivery_")])

    def add(batch: DataFrame, _epoch: int) -> None:
        days = DayTable(batch.sparkSession, table)
        folders = [r[0] for r in batch.select("delivery_folder").where("delivery_id <> ''").distinct().collect()]
        days.stage(batch.where("delivery_id <> ''").drop("delivery_folder"))
        days.commit_deliveries(read_marks(batch.sparkSession, folders), schema)
    w = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="60 seconds")
    return w.start()


def settle(spark: SparkSession, landing: str, table: str, schema: StructType) -> None:
    """Let deliveries count that are whole by now, also if their mark came after their last file."""
    folders = [f"{landing.rstrip('/')}/{n}" for n in names_in(spark, landing) if n.startswith("delivery-")]
    DayTable(spark, table).commit_deliveries(read_marks(spark, folders), schema)


def rolling_totals(stream: DataFrame, ts: str, value: str, width: str, watermark: str) -> DataFrame:
    """T-02: tumbling-window count and sum of ``value`` on event time ``ts``."""
    ev = stream.withColumn("_event_time", ntz_to_instant(ts)).withWatermark("_event_time", watermark)
    return (ev.groupBy(F.window("_event_time", width).alias("w"))
              .agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total")))


def freshness_stream(stream: DataFrame, ts: str = "ReceivedAt") -> DataFrame:
    """T-04: running maximum of the order time (and rows seen)."""
    return stream.agg(F.max(ts).alias("latest_received"), F.count(F.lit(1)).alias("rows_seen"))


def run_to_table(agg: DataFrame, table: str, checkpoint: str, available_now: bool = True,
                 state_partitions: int | None = None, keys: list[str] | None = None, fold_every: int = 16):
    """Run an aggregation stream in update mode into a Parquet table in the shared folder.

    Each micro-batch writes the rows that changed to a folder of its own
    (``epoch=``), which a replay of the batch overwrites; ``read_totals`` takes
    each key's last row.  With ``keys`` every ``fold_every`` batches are folded into one version
    (``snapshots``) and removed, so what is kept and read is a row a key.  With a watermark the state of closed windows goes, so
    neither the state nor a batch's write grows with the history.

    The state holds one row per open window, not per order: ``state_partitions`` sets how many partitions
    it gets (recorded in the checkpoint at the first run), else the session's setting does.  The stream snapshots the
    session conf at start, so the session's own setting is restored right away."""
    spark = agg.sparkSession
    log = Snapshots(spark, f"{table}-log")

    def add(batch: DataFrame, epoch: int) -> None:
        last = log.latest()
        if last is not None and epoch <= last.info["epoch"]:
            return  # a replay of a batch that is folded already
        batch.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")
        if keys is not None and len(names_in(spark, table)) >= fold_every:
            rows = read_totals(spark, table, keys).withColumn("epoch", F.lit(epoch))
            try:
                log.commit(last, {"rows": rows}, {"epoch": epoch})
            except Conflict:
                return
            for name in names_in(spark, table):
                if name.startswith("epoch=") and int(name.removeprefix("epoch=")) <= epoch:
                    remove(spark, f"{table}/{name}")
    w = (agg.writeStream.outputMode("update").foreachBatch(add)
            .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="60 seconds")
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        return w.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)


def read_totals(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The current totals that ``run_to_table`` keeps: each key's row of the last batch that changed it."""
    log = Snapshots(spark, f"{table}-log")
    last = log.latest()
    rows = log.read(last) if last else None
    folders = [n for n in names_in(spark, table) if n.startswith("epoch=") and (last is None or int(n.removeprefix("epoch=")) > last.info["epoch"])]
    if folders:
        new = spark.read.option("basePath", table).parquet(*[f"{table}/{n}" for n in folders]).withColumn("epoch", F.col("epoch").cast("int"))
        rows = new if rows is None else rows.unionByName(new)
    if rows is None:
        raise FileNotFoundError(f"no totals in {table} yet")
    others = [c for c in rows.columns if c not in (*keys, "epoch")]
    last_row = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "epoch").alias("_last"))
    return last_row.select(*keys, "_last.*")


def stage_landing(df: DataFrame, landing: str, delivery: str = "0001", files: int | None = None, mark: bool = True) -> None:
    """Write source rows as the landing files of one delivery, rows in no order (``files``: how many; else as the rows lie), and its mark."""
    rows = dealt(df, files) if files else df
    folder = f"{landing}/delivery-{delivery}"
    rows.write.mode("overwrite").parquet(folder)
    if mark:
        mark_complete(df.sparkSession, folder, df.schema)


def dealt(df: DataFrame, files: int) -> DataFrame:
    """Rows in ``files`` parts by a hash of the whole row: were they dealt in turns, a task would have to sort all of its rows
    first, so that it deals alike if it runs again."""
    return df.repartition(files, F.xxhash64(*df.columns))


def mark_complete(spark: SparkSession, folder: str, schema: StructType) -> None:
    """The mark of a delivery whose files are all there: each file with the number of its rows."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/delivery-[A-Za-z0-9._-]+/(.+)$", 1)
    rows = rows.groupBy(name.alias("delivery_file")).agg(F.count(F.lit(1)).alias("rows"))
    rows.coalesce(1).write.mode("overwrite").json(f"{folder}/complete.json")


class WindowTotals:
    """T-02: tumbling-window totals with a watermark that closes windows, and a way back in for late rows.

    Each micro-batch is reduced to a row a window (count and sum) under its
    epoch.  The watermark of a batch is the latest event time of the batches
    before it less ``delay``; it is kept with the epoch, so a replay sees the
    same one.  Rows of windows that it has closed are corrections: they are
    kept apart and folded into the closed totals.

    Every ``fold_every`` batches the epochs are folded: closed windows join the
    totals of their month, which only months with a correction change, and
    open ones go on.  So neither the open rows nor a batch's work grow with
    the history.  Both steps are versions of a table (``snapshots``).
    """

    def __init__(self, spark: SparkSession, table: str, width: str, delay: str, fold_every: int = 8):
        self.spark, self.table, self.width, self.delay, self.fold_every = spark, table.rstrip("/"), width, delay, fold_every
        self.log = Snapshots(spark, f"{self.table}/log")

    def start(self, stream: DataFrame, ts: str, value: str, checkpoint: str, available_now: bool = True):
        def add(batch: DataFrame, epoch: int) -> None:
            self.add(batch.select(F.col(ts).alias("_ts"), F.col(value).alias("_value")), epoch)
        w = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="60 seconds")).start()

    def _epochs(self) -> list[int]:
        return sorted(int(n.removeprefix("epoch=")) for n in names_in(self.spark, f"{self.table}/epochs") if n.startswith("epoch="))

    def _folded(self) -> int:
        last = self.log.latest()
        return last.info["epoch"] if last else -1

    def watermark(self, epoch: int):
        """The instant before which the batch of ``epoch`` finds windows closed; None for the first."""
        seen = [e for e in self._epochs() if e < epoch and e > self._folded()]
        last, latest = self.log.latest(), []
        if last and last.info["latest"] is not None:
            latest.append(F.timestamp_micros(F.lit(last.info["latest"])))
        if seen:
            rows = self.spark.read.parquet(*[f"{self.table}/epochs/epoch={e}" for e in seen])
            top = rows.agg(F.unix_micros(F.max("latest")).alias("t")).first()["t"]
            if top is not None:
                latest.append(F.timestamp_micros(F.lit(top)))
        if not latest:
            return None
        top = F.greatest(*latest) if len(latest) > 1 else latest[0]
        return top - F.expr(f"INTERVAL {self.delay}")

    def add(self, batch: DataFrame, epoch: int) -> None:
        """Take a micro-batch of ``_ts`` and ``_value``; a replay of one that is folded already changes nothing."""
        if epoch <= self._folded():
            return
        closed_before = self.watermark(epoch)
        rows = batch.withColumn("_at", ntz_to_instant("_ts")).where(F.col("_at").isNotNull())
        sums = rows.groupBy(F.window("_at", self.width).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("_value").alias("total"), F.max("_at").alias("latest"))
        late = F.lit(False) if closed_before is None else F.col("w.end") <= closed_before
        sums.withColumn("late", late).write.mode("overwrite").parquet(f"{self.table}/epochs/epoch={epoch}")
        if len([e for e in self._epochs() if e > self._folded()]) >= self.fold_every:
            self.fold()

    def _parts(self, last, epochs: list[int]) -> list[DataFrame]:
        cols = ["w", "events", "total", "late"]
        parts = [self.spark.read.parquet(*[f"{self.table}/epochs/epoch={e}" for e in epochs]).select(*cols)] if epochs else []
        if last is not None:
            parts.append(self.log.read(last, "open").select(*cols))
        return parts

    def fold(self) -> None:
        """Join the epochs so far: what the watermark has closed into the totals of its month, the rest as open windows."""
        last = self.log.latest()
        epochs = [e for e in self._epochs() if e > self._folded()]
        if not epochs:
            return
        closed_before = self.watermark(epochs[-1] + 1)
        tops = self.spark.read.parquet(*[f"{self.table}/epochs/epoch={e}" for e in epochs]).agg(F.unix_micros(F.max("latest")).alias("t")).first()["t"]
        known = last.info["latest"] if last else None
        latest = max((t for t in (tops, known) if t is not None), default=None)
        parts = self._parts(last, epochs)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = rows.groupBy("w").agg(F.sum("events").alias("events"), F.sum("total").alias("total"), F.bool_or("late").alias("late"))
        is_closed = F.lit(False) if closed_before is None else F.col("w.end") <= closed_before
        ready = rows.where(is_closed).withColumn("month", F.date_format(instant_to_ntz(F.col("w.start")), "yyyy-MM"))
        name = f"{epochs[-1]:010d}"
        months = dict(last.info["months"]) if last else {}
        touched = [r[0] for r in ready.select("month").distinct().collect()]
        if touched:
            had = [f"{self.table}/closed/{months[m]}/month={m}" for m in touched if m in months]
            if had:
                old = self.spark.read.option("basePath", f"{self.table}/closed").parquet(*had).select("w", "events", "total", "late")
                ready = ready.drop("month").unionByName(old).groupBy("w").agg(F.sum("events").alias("events"), F.sum("total").alias("total"), F.bool_or("late").alias("late"))
                ready = ready.withColumn("month", F.date_format(instant_to_ntz(F.col("w.start")), "yyyy-MM"))
            ready.hint("rebalance", F.col("month")).write.mode("overwrite").partitionBy("month").parquet(f"{self.table}/closed/fold={name}")
            months |= dict.fromkeys(touched, f"fold={name}")
        still = rows.where(~is_closed).coalesce(1)
        info = {"epoch": epochs[-1], "latest": latest, "months": months}
        try:
            self.log.commit(last, {"open": still}, info)
        except Conflict:
            return  # another run of the same batches folded them
        for e in self._epochs():
            if e <= epochs[-1]:
                remove(self.spark, f"{self.table}/epochs/epoch={e}")

    def open_rows(self) -> int:
        """Rows kept for windows that may still change: of open windows and of epochs that are not folded yet."""
        parts = self._parts(self.log.latest(), [e for e in self._epochs() if e > self._folded()])
        return sum(p.count() for p in parts)

    def read(self) -> DataFrame:
        """``w`` (the window), ``events``, ``total`` and ``late`` (whether rows came after it had been closed), as of now."""
        last = self.log.latest()
        parts = self._parts(last, [e for e in self._epochs() if e > self._folded()])
        if last is not None and last.info["months"]:
            folders = [f"{self.table}/closed/{f}/month={m}" for m, f in sorted(last.info["months"].items())]
            parts.append(self.spark.read.option("basePath", f"{self.table}/closed").parquet(*folders).select("w", "events", "total", "late"))
        if not parts:
            raise FileNotFoundError(f"no totals in {self.table} yet")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("w").agg(F.sum("events").alias("events"), F.sum("total").alias("total"), F.bool_or("late").alias("late"))


def scratch(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, f"stream/{name}")

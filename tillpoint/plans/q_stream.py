"""Streaming queries (T-01..T-04): each runs a catch-up (AvailableNow) stream
over landing files staged from the driver tables, then returns the batch
read of the streamed result; the SQL twin is the plain batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.plans import frames
from tillpoint.plans.catalog import register
from tillpoint.operators import sync
from tillpoint.operators.enrich import with_essential_columns
from tillpoint.plans.sqlparts import BASE as BASE_E
from tillpoint.plans.sqlparts import with_ctes
from tillpoint.sources import sink
from tillpoint.sources.daytable import DayTable
from tillpoint.sources.canonical import ORDERS_SQL
from tillpoint.streaming import stream as st

ORD = [ORDERS_SQL.strip()]
#: Windows close two days behind the latest row; later rows are folded in as corrections.
DELAY = "2 days"


def _staged_orders(spark, sf, *columns):
    """The orders as one delivery whose files cut across days."""
    o = frames.orders(spark, sf)
    o = o.select(*columns) if columns else o
    landing = st.scratch(spark, "landing-orders")
    st.stage_landing(o, landing, files=13)
    return landing, o.schema


def _load(spark, sf):
    landing, schema = _staged_orders(spark, sf)
    table = st.scratch(spark, "orders-by-day")
    q = st.load_incrementally(st.order_stream(spark, landing, schema, files_per_batch=4), table,
                              st.scratch(spark, "ckpt-load"))
    q.awaitTermination()
    return table, schema


@register("t01_incremental_load", "T-01", with_ctes(*ORD, final="""
SELECT Date, count(*) AS orders, CAST(SUM(GrossPrice) AS DOUBLE) AS gross FROM orders_c GROUP BY Date"""))
def t01_incremental_load(spark, sf):
    """Order files streamed in micro-batches into the day-partitioned table."""
    table, _ = _load(spark, sf)
    t = sink.read_deliveries(spark, table)
    return t.groupBy("Date").agg(F.count(F.lit(1)).alias("orders"), F.sum("GrossPrice").cast("double").alias("gross"))


@register("t03_resent_days_replace", ("T-03", "A-09"), with_ctes(*ORD, """
bd AS (SELECT DISTINCT Date FROM orders_c ORDER BY Date DESC LIMIT 3),
batch AS (SELECT * REPLACE (Tips + 1 AS Tips) FROM orders_c WHERE Date IN (SELECT Date FROM bd)),
merged AS (SELECT * FROM orders_c WHERE Date NOT IN (SELECT Date FROM bd) UNION ALL SELECT * FROM batch)""",
                                                                final="""
SELECT Date, count(*) AS orders, CAST(SUM(Tips) AS DOUBLE) AS tips FROM merged GROUP BY Date"""))
def t03_resent_days_replace(spark, sf):
    """After the incremental load, a re-sent delivery of the latest three days
    arrives late, a few files a batch; it replaces exactly those days."""
    table, schema = _load(spark, sf)
    o = frames.orders(spark, sf)
    resent = sync.on_dates(o, [F.lit(d) for d in sync.latest_days(o, 3)])
    resent = resent.withColumn("Tips", (F.col("Tips") + 1).cast(T.DecimalType(18, 4)))
    landing2 = st.scratch(spark, "landing-resent")
    st.stage_landing(resent, landing2, "0002", files=4)
    q = st.load_incrementally(st.order_stream(spark, landing2, schema, files_per_batch=2), table, st.scratch(spark, "ckpt-resent"))
    q.awaitTermination()
    t = sink.read_deliveries(spark, table)
    return t.groupBy("Date").agg(F.count(F.lit(1)).alias("orders"), F.sum("Tips").cast("double").alias("tips"))


def _window_query(spark, stream, ts, value, width, name):
    totals = st.WindowTotals(spark, st.scratch(spark, f"totals-{name}"), width, DELAY)
    totals.start(stream, ts, value, st.scratch(spark, f"ckpt-{name}")).awaitTermination()
    return totals.read().select(st.instant_to_ntz(F.col("w.start")).alias("window_start"), "events", "total")


def _staged(spark, df, name, files):
    landing = st.scratch(spark, f"landing-{name}")
    st.stage_landing(df, landing, files=files)
    return st.order_stream(spark, landing, df.schema, files_per_batch=4)


@register("t03_half_delivery_changes_nothing", ("T-03", "T-01"), with_ctes(*ORD, """
n AS (SELECT Date, count(*) AS orders, CAST(SUM(Tips) AS DOUBLE) AS tips FROM orders_c GROUP BY Date),
bd AS (SELECT DISTINCT Date FROM orders_c ORDER BY Date DESC LIMIT 2)""", final="""
SELECT Date, orders, tips, tips + CASE WHEN Date IN (SELECT Date FROM bd) THEN orders ELSE 0 END AS tips_after FROM n"""))
def t03_half_delivery_changes_nothing(spark, sf):
    """A re-sent delivery of which a file and the mark are still to come changes no day; once both are there all its days change."""
    o = frames.orders(spark, sf)
    days = DayTable(spark, st.scratch(spark, "orders-published"))
    days.replace_days(o)
    resent = sync.on_dates(o, [F.lit(d) for d in sync.latest_days(o, 2)]).withColumn("Tips", (F.col("Tips") + 1).cast(T.DecimalType(18, 4)))
    landing, ckpt = st.scratch(spark, "landing-half"), st.scratch(spark, "ckpt-half")
    on_time = F.col("UniqueOrderID") % 2 == 0

    def arrive(rows, name):
        rows.write.parquet(f"{landing}/delivery-0002/{name}")
        st.load_incrementally(st.order_stream(spark, landing, o.schema), days.path, ckpt).awaitTermination()
    arrive(resent.where(on_time), "a")
    totals = lambda name: days.read().groupBy("Date").agg(F.count(F.lit(1)).alias("orders"), F.sum("Tips").cast("double").alias(name))
    half = totals("tips")
    arrive(resent.where(~on_time), "b")
    st.mark_complete(spark, f"{landing}/delivery-0002", o.schema)
    st.settle(spark, landing, days.path, o.schema)
    return half.join(totals("tips_after").drop("orders"), "Date")


@register("t02_hourly_event_totals", "T-02", """
SELECT date_trunc('hour', ts) AS window_start, count(*) AS events, SUM(value) AS total FROM events
WHERE ts IS NOT NULL GROUP BY 1""")
def t02_hourly_event_totals(spark, sf):
    """Tumbling 1-hour windows over the events table.  The landing files cut across
    time, so most rows come after their window was closed and go the way of corrections."""
    ev = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").select("ts", "value")
    return _window_query(spark, _staged(spark, ev, "events-hourly", 7), "ts", "value", "1 hour", "events-hourly")


@register("t02_daily_order_totals", "T-02", with_ctes(*ORD, final="""
SELECT CAST(Date AS TIMESTAMP) AS window_start, count(*) AS events, CAST(SUM(GrossPrice) AS DOUBLE) AS total
FROM orders_c GROUP BY Date"""))
def t02_daily_order_totals(spark, sf):
    """Tumbling day windows of order gross over streamed order files."""
    o = frames.orders(spark, sf).select("ReceivedAt", "GrossPrice")
    r = _window_query(spark, _staged(spark, o, "orders-daily", 7), "ReceivedAt", "GrossPrice", "1 day", "orders-daily")
    return r.withColumn("total", F.col("total").cast("double"))


@register("t04_running_freshness", ("T-04", "A-03"), with_ctes(*ORD, final="""
SELECT max(ReceivedAt) AS latest_received, count(*) AS rows_seen FROM orders_c"""))
def t04_running_freshness(spark, sf):
    landing, schema = _staged_orders(spark, sf, "ReceivedAt")
    table = st.scratch(spark, "freshness")
    agg = st.freshness_stream(st.order_stream(spark, landing, schema, files_per_batch=4))
    st.run_to_table(agg, table, st.scratch(spark, "ckpt-fresh"), keys=[], fold_every=2).awaitTermination()
    return st.read_totals(spark, table, []).select("latest_received", "rows_seen")


@register("t02_hourly_net_sale", "T-02", with_ctes(*BASE_E, final="""
SELECT date_trunc('hour', ReceivedAt) AS window_start, count(*) AS events,
       CAST(SUM(net_sale_vat) AS DOUBLE) / 1.05 AS total
FROM e GROUP BY 1"""))
def t02_hourly_net_sale(spark, sf):
    """Hourly net-sale totals on the order stream: the derived columns (with
    the stream-static broadcast join to the code lookup) are applied in the
    stream, and the exact VAT-inclusive base is summed per window."""
    landing, schema = _staged_orders(spark, sf)
    s = with_essential_columns(st.order_stream(spark, landing, schema, files_per_batch=4))
    r = _window_query(spark, s, "ReceivedAt", "net_sale_vat", "1 hour", "orders-hourly")
    return r.select("window_start", "events", (F.col("total").cast("double") / 1.05).alias("total"))

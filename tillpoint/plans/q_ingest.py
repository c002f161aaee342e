"""Ingestion and sink queries (A-01, A-02, A-05..A-12, F-16, D-29..D-31) and SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.operators import discount_perf as dp
from tillpoint.operators import quality
from tillpoint.operators import sync
from tillpoint.plans import frames
from tillpoint.plans.catalog import register
from tillpoint.plans.sqlparts import BASE, quantile_sql, with_ctes
from tillpoint.session import shared_dir
from tillpoint.sources import changes, landing, sink
from tillpoint.sources.canonical import ORDER_COLUMNS, ORDERS_SQL, joined_view, order_columns
from tillpoint.sources.daytable import DayTable

ORD = [ORDERS_SQL.strip()]
KEPT = [*BASE, "k AS (SELECT * FROM e WHERE COALESCE(GrossPrice <> Discount, TRUE))"]
NET = "CAST(SUM(net_sale_vat) AS DOUBLE) / 1.05"

_CLEAN_MONEY = [*landing.COERCED_NUMERIC, *landing.OTHER_MONEY]
_CLEAN_COLS = [*landing.COLUMN_MAP.values(), "Date"]


def _clean_sql(c: str) -> str:
    if c == "Discount":
        return "CAST(CASE WHEN UniqueOrderID % 103 = 5 THEN 0 ELSE COALESCE(Discount, 0) END AS DOUBLE) AS Discount"
    return f"CAST(COALESCE({c}, 0) AS DOUBLE) AS {c}" if c in _CLEAN_MONEY else c


@register("a06_clean_landing_export", ("A-06", "A-07", "A-08", "A-11", "F-13"), with_ctes(*ORD, final=f"""
SELECT {', '.join(map(_clean_sql, _CLEAN_COLS))} FROM orders_c WHERE UniqueOrderID % 101 <> 7"""))
def a06_clean_landing_export(spark, sf):
    """Untyped export (human headers, text cells, bad cells) → cleaned canonical rows.

    The export is every order of the tables; the landing rule plants an
    unparsable time on keys ≡ 7 (mod 101) and a non-numeric discount on keys
    ≡ 5 (mod 103).  The twin's ``% 101 <> 7`` is the cleaning step itself
    (rows without a valid time are dropped), not a sampling filter."""
    raw = landing.landing_export(frames.orders(spark, sf))
    clean = landing.clean_export(raw)
    return clean.select(*[F.col(c).cast("double").alias(c) if c in _CLEAN_MONEY else F.col(c) for c in _CLEAN_COLS])


_LOAD_SQL = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in _CLEAN_MONEY else c for c in landing.LOAD_COLUMNS)


@register("a01_range_load", ("A-01", "H-01"), with_ctes(*ORD, final=f"""
SELECT {_LOAD_SQL}
FROM orders_c WHERE ReceivedAt >= TIMESTAMP '1998-01-01 00:00:00' AND ReceivedAt < TIMESTAMP '1998-04-01 00:00:00'"""))
def a01_range_load(spark, sf):
    """A-01: 1998-01-01 through the whole of 1998-03-31, newest first."""
    r = landing.load_range(frames.orders(spark, sf), "1998-01-01", "1998-03-31")
    return r.select(*[F.col(c).cast("double").alias(c) if c in _CLEAN_MONEY else F.col(c) for c in landing.LOAD_COLUMNS])


@register("a02_present_day_load", ("A-02", "B-11"), with_ctes(*ORD, final="""
SELECT count(*) AS orders, max(ReceivedAt) AS latest FROM orders_c
WHERE ReceivedAt >= CAST(date_trunc('month', (SELECT max(Date) FROM orders_c)) AS TIMESTAMP)
  AND ReceivedAt < CAST((SELECT max(Date) FROM orders_c) + 1 AS TIMESTAMP)"""))
def a02_present_day_load(spark, sf):
    """A-02 / B-11: month start → as-of day (the latest date) read in full."""
    o = frames.orders(spark, sf)
    as_of = sync.latest_days(o, 1)[0]
    r = landing.load_range(o, as_of.replace(day=1), as_of)
    return r.agg(F.count(F.lit(1)).alias("orders"), F.max("ReceivedAt").alias("latest"))


@register("a09_replace_by_day", ("A-09", "T-03"), with_ctes(*ORD, """
bd AS (SELECT DISTINCT Date FROM orders_c ORDER BY Date DESC LIMIT 3),
batch AS (SELECT * REPLACE (Tips + 1 AS Tips) FROM orders_c WHERE Date IN (SELECT Date FROM bd)),
merged AS (SELECT * FROM orders_c WHERE Date NOT IN (SELECT Date FROM bd) UNION ALL SELECT * FROM batch)""",
                                                         final="""
SELECT Date, count(*) AS orders, CAST(SUM(Tips) AS DOUBLE) AS tips FROM merged GROUP BY Date"""))
def a09_replace_by_day(spark, sf):
    """A-09: a re-sent export of the latest three days replaces those days."""
    o = frames.orders(spark, sf)
    batch = sync.on_dates(o, [F.lit(d) for d in sync.latest_days(o, 3)]).withColumn("Tips", (F.col("Tips") + 1).cast(T.DecimalType(18, 4)))
    merged = sink.replace_by_day(o, batch)
    return merged.groupBy("Date").agg(F.count(F.lit(1)).alias("orders"),
                                      F.sum("Tips").cast("double").alias("tips"))


@register("a09_atomic_replace", "A-09", with_ctes(*ORD, """
bd AS (SELECT DISTINCT Date FROM orders_c ORDER BY Date DESC LIMIT 3),
n AS (SELECT Date, count(*) AS orders, CAST(SUM(Tips) AS DOUBLE) AS tips FROM orders_c GROUP BY Date)""", final="""
SELECT Date, orders, tips, tips + CASE WHEN Date IN (SELECT Date FROM bd) THEN orders ELSE 0 END AS tips_after FROM n"""))
def a09_atomic_replace(spark, sf):
    """A-09: three days replaced in one version; a reader that holds the version before still sees all of it."""
    o = frames.orders(spark, sf)
    days = DayTable(spark, shared_dir(spark, "orders-published"))
    first = days.replace_days(o)
    days.replace_days(sync.on_dates(o, [F.lit(d) for d in sync.latest_days(o, 3)]).withColumn("Tips", (F.col("Tips") + 1).cast(T.DecimalType(18, 4))))
    totals = lambda version, name: days.read(version).groupBy("Date").agg(F.count(F.lit(1)).alias("orders"), F.sum("Tips").cast("double").alias(name))
    return totals(first, "tips").join(totals(None, "tips_after").drop("orders"), "Date")


@register("f16_changed_days_rebuilt", "F-16", with_ctes(*ORD, """
n AS (SELECT Date, count(*) AS orders, CAST(SUM(Total) AS DOUBLE) AS total FROM orders_c GROUP BY Date),
cut AS (SELECT max(Date) - 40 AS day FROM orders_c),
late AS (SELECT Date, count(*) AS orders FROM orders_c, cut WHERE Date = cut.day OR Date = cut.day + 1 GROUP BY Date)""", final="""
SELECT n.Date, n.orders, n.total, COALESCE(l.orders, 0) AS rewritten FROM n LEFT JOIN late l USING (Date)"""))
def f16_changed_days_rebuilt(spark, sf):
    """F-16: the sources lack the lines of one day at first; when a file with them arrives, only that day is written again
    (and the day after, into which times may reach).  ``rewritten`` counts the rows that the second build wrote."""
    base = sf.rstrip("/")
    copy = shared_dir(spark, "sources")
    read = lambda t: spark.read.parquet(f"{base}/{t}.parquet")
    day = F.date_sub(F.lit(sync.latest_days(frames.orders(spark, sf), 1)[0]), 40)
    keys = read("orders").where(F.to_date("o_orderdate") == day).select(F.col("o_orderkey").alias("l_orderkey"))
    for t in changes.SOURCE_TABLES:
        rows = read(t).join(keys, "l_orderkey", "left_anti") if t == "lineitem" else read(t)
        rows.write.parquet(f"{copy}/{t}.parquet")
    path = shared_dir(spark, "followed")
    follow = lambda: changes.follow(spark, copy, path, lambda days: joined_view(spark, copy, days), order_columns)
    follow()
    table = DayTable(spark, path, undated=True)
    first = table.version()
    read("lineitem").join(keys, "l_orderkey", "left_semi").write.mode("append").parquet(f"{copy}/lineitem.parquet")
    follow()
    known = table.days(first).select("part").distinct()
    again = table.days().where("live").join(known, "part", "left_anti").select("Date", F.col("rows").alias("rewritten"))
    n = table.read().groupBy("Date").agg(F.count(F.lit(1)).alias("orders"), F.sum("Total").cast("double").alias("total"))
    return n.join(again, "Date", "left").select("Date", "orders", "total", F.coalesce("rewritten", F.lit(0)).cast("long").alias("rewritten"))


_BRAND_SQL = with_ctes(*KEPT, f"""
dk AS (SELECT *, Profit_Margin AS CM FROM k WHERE Calculated_Discount > 0)""", final=f"""
SELECT Brand, count(OrderID) AS Orders, CAST(SUM(calc_discount_vat) AS DOUBLE) / 1.05 AS Total_Discount,
  CAST(SUM(calc_discount_vat) AS DOUBLE) / 1.05 / CAST(count(calc_discount_vat) AS DOUBLE) AS Avg_Discount,
  SUM(CM) AS Total_CM, AVG(CM) AS Avg_CM, {NET} AS Total_Net_Sale
FROM dk WHERE Brand IS NOT NULL GROUP BY Brand""")


@register("a10_csv_export_roundtrip", "A-10", _BRAND_SQL)
def a10_csv_export_roundtrip(spark, sf):
    """A-10: the brand discount table written as header CSV and read back."""
    t = dp.cm_breakdown(dp.discounted(frames.kept(spark, sf)), ["Brand"])
    path = shared_dir(spark, "exports/brand_discount")
    sink.export_csv(t, path)
    return sink.read_csv(spark, path, t.schema)


@register("a12_text_coercion", "A-12", with_ctes(*KEPT, final="""
SELECT CAST(Date AS VARCHAR) AS Date, CAST(count(OrderID) AS VARCHAR) AS orders, Channel
FROM k WHERE Date IS NOT NULL AND Channel IS NOT NULL GROUP BY Date, Channel"""))
def a12_text_coercion(spark, sf):
    k = frames.kept(spark, sf).where(F.col("Date").isNotNull() & F.col("Channel").isNotNull())
    return landing.as_text(k.groupBy("Date", "Channel").agg(F.count("OrderID").alias("orders"))
                           .select("Date", "orders", "Channel"))


@register("a05_latest_sample_local_time", ("A-05", "F-11"), with_ctes(*ORD, final="""
SELECT OrderID, ReceivedAt, ReceivedAt + INTERVAL 4 HOUR AS ReceivedAt_Local,
       CAST(ReceivedAt AS DATE) AS Date_Local, strftime(ReceivedAt, '%H:%M:%S') AS Time_Local
FROM orders_c ORDER BY ReceivedAt DESC, OrderID LIMIT 5"""))
def a05_latest_sample_local_time(spark, sf):
    return quality.latest_sample(frames.orders(spark, sf))


@register("f16_day_fingerprints", "F-16", with_ctes(*ORD, final="""
SELECT Date, count(*) AS rows, max(ReceivedAt) AS latest,
       md5(concat_ws('_', CAST(Date AS VARCHAR), CAST(count(*) AS VARCHAR), CAST(max(ReceivedAt) AS VARCHAR)))
       AS fingerprint
FROM orders_c WHERE Date IS NOT NULL GROUP BY Date"""))
def f16_day_fingerprints(spark, sf):
    return quality.day_fingerprints(frames.orders(spark, sf))


#: The numeric columns of the order table with its derived ones, and their types.
_NUM = {c: "decimal(18,4)" for c in _CLEAN_MONEY} | {
    "UniqueOrderID": "bigint", "net_sale": "double", "Calculated_Discount": "double", "Profit_Margin": "double",
    "Discount_Percentage": "double", "Hour": "int", "Minute": "int"}
_CAT = [c for c in ORDER_COLUMNS if c not in _NUM and c not in ("ReceivedAt", "Date")] + ["Discount_Group", "DayOfWeek", "Order_Size_Category"]


def _num_profile_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS column_, CAST({c} AS DOUBLE) AS v FROM e" for c in _NUM)
    qs = [quantile_sql("lg", ["column_"], "v", p, n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    types = ", ".join(f"('{c}', '{k}')" for c, k in _NUM.items())
    return with_ctes(*BASE, f"lg AS ({parts})", f"t(column_, dtype) AS (VALUES {types})", f"q1 AS ({qs[0]})", f"q2 AS ({qs[1]})", f"q3 AS ({qs[2]})",
                     final="""
SELECT b.column_ AS column, t.dtype, count, mean, std, min, max, p25, p50, p75
FROM (SELECT column_, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max
      FROM lg WHERE v IS NOT NULL GROUP BY column_) b JOIN t ON t.column_ = b.column_
LEFT JOIN q1 ON q1.column_ = b.column_ LEFT JOIN q2 ON q2.column_ = b.column_ LEFT JOIN q3 ON q3.column_ = b.column_""")


@register("d29_numeric_profile", ("D-29",), _num_profile_sql())
def d29_numeric_profile(spark, sf):
    return quality.numeric_profile(frames.essential(spark, sf), list(_NUM))


def _cat_profile_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS column_, CAST({c} AS VARCHAR) AS v FROM e" for c in _CAT)
    return with_ctes(*BASE, f"lg AS ({parts})", """
cn AS (SELECT column_, v, count(*) AS n FROM lg WHERE v IS NOT NULL GROUP BY column_, v)""", final="""
SELECT column_ AS column, SUM(n) AS count, count(*) AS unique,
       arg_min(v, (-n, v)) AS top, max(n) AS freq FROM cn GROUP BY column_""")


@register("d29_categorical_profile", "D-29", _cat_profile_sql())
def d29_categorical_profile(spark, sf):
    return quality.categorical_profile(frames.essential(spark, sf), _CAT)


@register("d29_date_profile", "D-29", with_ctes(*ORD, """
lg AS (SELECT 'ReceivedAt' AS column_, 'timestamp_ntz' AS dtype, ReceivedAt AS v FROM orders_c UNION ALL SELECT 'Date', 'date', CAST(Date AS TIMESTAMP) FROM orders_c),
cn AS (SELECT column_, dtype, v, count(*) AS n FROM lg WHERE v IS NOT NULL GROUP BY ALL)""", final="""
SELECT column_ AS column, dtype, CAST(SUM(n) AS BIGINT) AS count, count(*) AS unique, min(v) AS first, max(v) AS last, arg_min(v, (-n, v)) AS top, max(n) AS freq FROM cn GROUP BY ALL"""))
def d29_date_profile(spark, sf):
    """D-29 for the columns of dates and times."""
    return quality.date_profile(frames.orders(spark, sf), ["ReceivedAt", "Date"])


@register("d30_missing_by_column", "D-30", with_ctes(*ORD, final=" UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count_if({c} IS NULL) AS BIGINT) AS missing FROM orders_c" for c in ORDER_COLUMNS)))
def d30_missing_by_column(spark, sf):
    return quality.missing_by_column(frames.orders(spark, sf), ORDER_COLUMNS)


@register("d31_duplicate_rows", "D-31", with_ctes(*ORD, """
staged AS (SELECT * FROM orders_c UNION ALL SELECT * FROM orders_c WHERE UniqueOrderID % 50 = 0)""", final=f"""
SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM staged GROUP BY {', '.join(ORDER_COLUMNS)})"""))
def d31_duplicate_rows(spark, sf):
    """D-31 over whole rows.  Rows are unique by order id, so the staged input repeats those whose key ends a run of fifty."""
    o = frames.orders(spark, sf)
    return quality.duplicate_rows(o.unionByName(o.where(F.col("UniqueOrderID") % 50 == 0)), ORDER_COLUMNS)

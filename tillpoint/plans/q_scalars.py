"""Row-level column sets and scalar functions (B-01, B-02, F-01..F-15) and SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.functions.exprs import (time_range_text, floor_minute, format_local, histogram_bucket, ordinal_day,
                                       seconds_of_day, to_local)
from tillpoint.operators.params import fetch, lit
from tillpoint.plans import frames
from tillpoint.plans.catalog import register
from tillpoint.plans.sqlparts import BASE, EXTENDED_SQL, with_ctes
from tillpoint.sources.canonical import ORDERS_SQL

EXT = [ORDERS_SQL.strip(), EXTENDED_SQL.strip()]
KEPT = [*BASE, "k AS (SELECT * FROM e WHERE COALESCE(GrossPrice <> Discount, TRUE))"]

_B01 = ["OrderID", "Date", "Hour", "Minute", "DayOfWeek", "Discount_Group", "net_sale", "Calculated_Discount",
        "Profit_Margin", "Discount_Percentage", "Order_Size_Category"]


@register("b01_essential_columns", ("B-01", "C-02", "F-01", "F-02", "F-03", "F-04", "F-07"),
          with_ctes(*BASE, final=f"SELECT {', '.join(_B01)} FROM e"))
def b01_essential_columns(spark, sf):
    return frames.essential(spark, sf).select(*_B01)


_B02 = ["OrderID", "Discount_Group", "net_sale", "Calculated_Discount", "Profit_Margin", "Discount_Percentage",
        "Revenue_After_Delivery", "Total_Fees", "Order_Profitability", "Order_Size_Category", "Discount_Category",
        "Is_Weekend", "Time_Period", "Customer_Order_Count", "Customer_Total_Spent", "Customer_Avg_Order",
        "Customer_Value_Tier", "Revenue_Per_Item", "Tip_Percentage", "High_Value_Order", "Discounted_Order",
        "Premium_Customer"]


@register("b02_extended_columns", ("B-02", "C-01", "C-03", "E-01", "D-35", "F-04"),
          with_ctes(*EXT, final=f"SELECT {', '.join(_B02)} FROM x"))
def b02_extended_columns(spark, sf):
    return frames.extended(spark, sf).select(*_B02)


@register("f07_calendar_parts", ("F-07", "F-09", "F-10", "F-11", "F-12"), with_ctes(*BASE, final="""
SELECT OrderID, Date, CAST(hour(ReceivedAt) AS INTEGER) AS hour, CAST(minute(ReceivedAt) AS INTEGER) AS minute,
       CAST(isodow(ReceivedAt) - 1 AS INTEGER) AS weekday, dayname(ReceivedAt) AS day_name,
       CAST(month(ReceivedAt) AS INTEGER) AS month, CAST(Date - DATE '0001-01-01' + 1 AS BIGINT) AS ordinal,
       CAST(hour(ReceivedAt) * 3600 + minute(ReceivedAt) * 60 + second(ReceivedAt) AS DOUBLE) AS seconds_of_day,
       date_trunc('minute', ReceivedAt) AS minute_start,
       ReceivedAt + INTERVAL 4 HOUR AS local_time,
       strftime(ReceivedAt, '%Y-%m-%d %H:%M:%S') AS local_text,
       strftime(date_trunc('minute', ReceivedAt), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(ReceivedAt, '%Y-%m-%d %H:%M:%S')
         || ' (UAE Local Time)' AS range_text
FROM e"""))
def f07_calendar_parts(spark, sf):
    """F-07 date parts (weekday Monday = 0, Python ordinal), F-09 seconds of
    day, F-10 minute floor, F-11 UTC → +04:00, F-12 formatted text."""
    e = frames.essential(spark, sf)
    ts = F.col("ReceivedAt")
    return e.select("OrderID", "Date", F.hour(ts).alias("hour"), F.minute(ts).alias("minute"),
                    F.weekday(ts).alias("weekday"), F.date_format(ts, "EEEE").alias("day_name"),
                    F.month(ts).alias("month"), ordinal_day("Date").alias("ordinal"),
                    seconds_of_day(ts).alias("seconds_of_day"), floor_minute(ts).alias("minute_start"),
                    to_local(ts, "+04:00", "+00:00").alias("local_time"),
                    format_local(ts).alias("local_text"),
                    time_range_text(floor_minute(ts), ts).alias("range_text"))


def _hist_sql(n: int) -> str:
    return with_ctes(*KEPT, "mm AS (SELECT min(net_sale) AS lo, max(net_sale) AS hi FROM k)", final=f"""
SELECT CAST(CASE WHEN mm.hi = mm.lo THEN 1
                 ELSE least({n}, CAST(floor((net_sale - mm.lo) / (mm.hi - mm.lo) * CAST({n} AS DOUBLE)) + 1 AS BIGINT))
            END AS BIGINT) AS bucket, count(*) AS orders
FROM k, mm WHERE net_sale IS NOT NULL GROUP BY 1""")


for _n in (20, 30, 50):
    def _mk(n):
        def q(spark, sf):
            k = frames.kept(spark, sf)
            p = fetch(k, lo=F.min("net_sale"), hi=F.max("net_sale"))
            b = histogram_bucket("net_sale", lit(p["lo"]).cast("double"), lit(p["hi"]).cast("double"), n)
            return (k.where(F.col("net_sale").isNotNull()).groupBy(b.alias("bucket"))
                     .agg(F.count(F.lit(1)).alias("orders")))
        q.__doc__ = f"F-06: net sale histogram, {n} equal-width buckets."
        return q
    register(f"f06_net_sale_histogram_{_n}", "F-06", _hist_sql(_n))(_mk(_n))

"""KPI, series, filter and period queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.operators import kpis, sync
from tillpoint.plans import frames
from tillpoint.plans.catalog import register
from tillpoint.plans.sqlparts import BASE, with_ctes

KEPT = [*BASE, "k AS (SELECT * FROM e WHERE COALESCE(GrossPrice <> Discount, TRUE))"]
NET = "CAST(SUM(net_sale_vat) AS DOUBLE) / 1.05"
CD = "CAST(SUM(calc_discount_vat) AS DOUBLE) / 1.05"


def _kpi_sql(src: str) -> str:
    return f"""SELECT CAST(count(*) AS BIGINT) AS total_orders,
  CAST(COALESCE(round_even({NET}, 0), 0) AS BIGINT) AS total_revenue,
  CAST(COALESCE(round_even({NET} / CAST(count(net_sale_vat) AS DOUBLE), 0), 0) AS BIGINT) AS avg_order_value,
  CAST(count(DISTINCT CustomerName) AS BIGINT) AS total_customers,
  CAST(COALESCE(round_even({CD}, 0), 0) AS BIGINT) AS total_discount,
  CAST(CASE WHEN CAST(SUM(GrossPrice) AS DOUBLE) > 0
            THEN COALESCE(round_even({CD} / CAST(SUM(GrossPrice) AS DOUBLE) * 100, 0), 0) ELSE 0 END AS BIGINT)
       AS discount_rate,
  CAST(COALESCE(round_even(CAST(SUM(Delivery) AS DOUBLE) / CAST(count(Delivery) AS DOUBLE), 0), 0) AS BIGINT)
       AS avg_delivery_fee,
  CAST(COALESCE(round_even(CAST(SUM(Tips) AS DOUBLE), 0), 0) AS BIGINT) AS total_tips
FROM {src}"""


@register("d01_kpis", "D-01", with_ctes(*KEPT, final=_kpi_sql("k")))
def d01_kpis(spark, sf):
    """D-01 over every order (fully discounted ones removed)."""
    return kpis.kpis(frames.kept(spark, sf))


@register("d01_kpis_month_to_date", ("D-01", "B-10", "B-11"), with_ctes(*KEPT, """
mtd AS (SELECT * FROM k WHERE Date BETWEEN date_trunc('month', (SELECT max(Date) FROM k))::DATE
                                 AND (SELECT max(Date) FROM k))""", final=_kpi_sql("mtd")))
def d01_kpis_month_to_date(spark, sf):
    """D-01 on the month-to-date window of the latest date (B-10 / B-11)."""
    k = frames.kept(spark, sf)
    return kpis.kpis(sync.month_to_date(k))


@register("d02_daily_series", ("D-02", "H-01"), with_ctes(*KEPT, final=f"""
SELECT Date, {NET} AS net_sale, count(OrderID) AS orders, {CD} AS discount
FROM k WHERE Date IS NOT NULL GROUP BY Date"""))
def d02_daily_series(spark, sf):
    return sync.daily_series(frames.kept(spark, sf))


for _dim in ("Channel", "PaymentMethod", "Brand"):
    def _mk(dim):
        def q(spark, sf):
            return kpis.sales_by(frames.kept(spark, sf), dim)
        q.__doc__ = f"D-10: net sale by {dim}."
        return q
    register(f"d10_sales_by_{_dim.lower()}", "D-10", with_ctes(*KEPT, final=f"""
SELECT {_dim}, {NET} AS net_sale FROM k WHERE {_dim} IS NOT NULL GROUP BY {_dim}"""))(_mk(_dim))


@register("h02_top_addresses", "H-02", with_ctes(*KEPT, final=f"""
SELECT Address, {NET} AS net_sale FROM k WHERE Address IS NOT NULL GROUP BY Address
ORDER BY net_sale DESC, Address LIMIT 10"""))
def h02_top_addresses(spark, sf):
    return kpis.top_by_sales(frames.kept(spark, sf), "Address", 10)


@register("d22_free_summary", "D-22", with_ctes(*KEPT, final=f"""
SELECT Brand, Channel, {NET} AS net_sale, CAST(count(OrderID) AS DOUBLE) AS OrderID,
       {CD} AS Calculated_Discount, AVG(Profit_Margin) AS Profit_Margin
FROM k WHERE Brand IS NOT NULL AND Channel IS NOT NULL GROUP BY Brand, Channel
ORDER BY net_sale DESC, Brand, Channel LIMIT 20"""))
def d22_free_summary(spark, sf):
    return kpis.free_summary(frames.kept(spark, sf), ["Brand", "Channel"],
                             ["net_sale", "OrderID", "Calculated_Discount", "Profit_Margin"], 20)


@register("d27_period_comparison", ("D-27", "G-17", "C-05"), with_ctes(*BASE, """
dd AS (SELECT Date FROM (SELECT DISTINCT Date FROM e WHERE Date IS NOT NULL) ORDER BY Date LIMIT 2),
p AS (SELECT min(Date) AS d1, CASE WHEN count(*) = 2 THEN max(Date) END AS d2 FROM dd),
a AS (SELECT p.d1, p.d2,
   CAST(SUM(CASE WHEN Date = p.d1 THEN net_sale_vat END) AS DOUBLE) / 1.05 AS f_net,
   CAST(SUM(CASE WHEN Date = p.d2 THEN net_sale_vat END) AS DOUBLE) / 1.05 AS s_net,
   CAST(count(CASE WHEN Date = p.d1 THEN OrderID END) AS DOUBLE) AS f_orders,
   CAST(count(CASE WHEN Date = p.d2 THEN OrderID END) AS DOUBLE) AS s_orders,
   CAST(SUM(CASE WHEN Date = p.d1 THEN calc_discount_vat END) AS DOUBLE) / 1.05 AS f_cd,
   CAST(SUM(CASE WHEN Date = p.d2 THEN calc_discount_vat END) AS DOUBLE) / 1.05 AS s_cd,
   SUM(CASE WHEN Date = p.d1 THEN Profit_Margin END) AS f_pm,
   SUM(CASE WHEN Date = p.d2 THEN Profit_Margin END) AS s_pm
 FROM e, p WHERE Date IN (p.d1, p.d2) GROUP BY p.d1, p.d2),
r AS (
 SELECT d1 AS First_Date, d2 AS Second_Date, 'net_sale' AS Metric, COALESCE(f_net, 0) AS First, COALESCE(s_net, 0) AS Second FROM a
 UNION ALL SELECT d1, d2, 'OrderID', COALESCE(f_orders, 0), COALESCE(s_orders, 0) FROM a
 UNION ALL SELECT d1, d2, 'Calculated_Discount', COALESCE(f_cd, 0), COALESCE(s_cd, 0) FROM a
 UNION ALL SELECT d1, d2, 'Profit_Margin', COALESCE(f_pm, 0), COALESCE(s_pm, 0) FROM a)""", final="""
SELECT *, Second - First AS Difference,
  CASE WHEN Metric = 'net_sale' AND Second - First > 0 THEN 'Net sales increased'
       WHEN Metric = 'net_sale' THEN 'Net sales decreased'
       WHEN Metric = 'Profit_Margin' AND Second - First < 0 THEN 'Profit margin dropped'
       WHEN Metric = 'Calculated_Discount' AND Second - First > 0 THEN 'Discount outlay increased' END AS Insight
FROM r"""))
def d27_period_comparison(spark, sf):
    """D-27 / G-17: the two earliest dates (the period selector's defaults)."""
    return kpis.period_comparison(frames.essential(spark, sf))


@register("d32_freshness", ("D-32", "A-03", "A-04"), with_ctes(*BASE, final="""
SELECT max(ReceivedAt) AS latest_received, min(ReceivedAt) AS earliest_received,
       count(*) AS total_records FROM e"""))
def d32_freshness(spark, sf):
    return kpis.freshness(frames.essential(spark, sf))


@register("d35_high_value_threshold", ("D-35", "E-02"), with_ctes(*BASE, """
r AS (SELECT net_sale, row_number() OVER (ORDER BY net_sale) AS rn, count(*) OVER () AS n
      FROM e WHERE net_sale IS NOT NULL)""", final="""
SELECT CASE WHEN t >= 0.5 THEN b - (b - a) * (1.0 - t) ELSE a + (b - a) * t END AS net_sale_p80
FROM (SELECT max(CASE WHEN rn = floor((n - 1) * 0.8) + 1 THEN net_sale END) AS a,
             max(CASE WHEN rn = ceil((n - 1) * 0.8) + 1 THEN net_sale END) AS b,
             (max(n) - 1) * 0.8 - floor((max(n) - 1) * 0.8) AS t FROM r)"""))
def d35_high_value_threshold(spark, sf):
    return kpis.high_value_threshold(frames.essential(spark, sf))


@register("b15_hundred_percent_orders", "B-15", with_ctes(*BASE, final="""
SELECT CAST(count_if(Discount_Percentage >= 100) AS BIGINT) AS orders_100pct FROM e"""))
def b15_hundred_percent_orders(spark, sf):
    return kpis.hundred_percent_count(frames.essential(spark, sf))


@register("b12_channel_values", "B-12", with_ctes(*BASE, final="""
SELECT DISTINCT Channel FROM e WHERE Channel IS NOT NULL"""))
def b12_channel_values(spark, sf):
    return kpis.distinct_values(frames.essential(spark, sf), "Channel")


@register("b04_membership_filter", ("B-04", "B-03"), with_ctes(*BASE, f"""
f AS (SELECT * FROM e WHERE Channel IN ('1-URGENT', '2-HIGH')
        AND Date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31')""", final=f"""
SELECT Channel, Brand, count(*) AS orders, {NET} AS net_sale FROM f GROUP BY Channel, Brand"""))
def b04_membership_filter(spark, sf):
    """B-04 channel membership (brand selection empty = all) inside a B-03 date range."""
    e = sync.between_dates(frames.essential(spark, sf), "1998-01-01", "1999-12-31")
    f = kpis.membership(e, channels=["1-URGENT", "2-HIGH"])
    return f.groupBy("Channel", "Brand").agg(
        F.count(F.lit(1)).alias("orders"), (F.sum("net_sale_vat").cast("double") / 1.05).alias("net_sale"))


@register("b06_discounted_only", "B-06", with_ctes(*KEPT, final=f"""
SELECT Channel, count(*) AS orders, {CD} AS discount FROM k
WHERE Calculated_Discount > 0 AND Channel IS NOT NULL GROUP BY Channel"""))
def b06_discounted_only(spark, sf):
    k = frames.kept(spark, sf).where(F.col("Calculated_Discount") > 0).where(F.col("Channel").isNotNull())
    return k.groupBy("Channel").agg(F.count(F.lit(1)).alias("orders"),
                                    (F.sum("calc_discount_vat").cast("double") / 1.05).alias("discount"))


@register("b09_hour_ceiling", "B-09", with_ctes(*KEPT, final=f"""
SELECT Hour, count(*) AS orders, {NET} AS net_sale FROM k WHERE Hour <= 12 GROUP BY Hour"""))
def b09_hour_ceiling(spark, sf):
    k = sync.hour_ceiling(frames.kept(spark, sf), 12)
    return k.groupBy("Hour").agg(F.count(F.lit(1)).alias("orders"),
                                 (F.sum("net_sale_vat").cast("double") / 1.05).alias("net_sale"))


@register("e03_latest_two_dates", "E-03", with_ctes(*BASE, final="""
SELECT Date, CAST(row_number() OVER (ORDER BY Date DESC) AS BIGINT) AS date_rank
FROM (SELECT DISTINCT Date FROM e WHERE Date IS NOT NULL ORDER BY Date DESC LIMIT 2)"""))
def e03_latest_two_dates(spark, sf):
    return sync.latest_two_dates(frames.essential(spark, sf))


_WEEK_SQL = f"""
ds AS (SELECT Date, {NET} AS net_sale, count(OrderID) AS orders, {CD} AS discount
       FROM k WHERE Date IS NOT NULL GROUP BY Date),
rk AS (SELECT *, row_number() OVER (ORDER BY Date DESC) AS r FROM ds)"""


@register("e04_last_vs_previous_week", "E-04", with_ctes(*KEPT, _WEEK_SQL, final="""
SELECT avg(CASE WHEN r <= 7 THEN net_sale END) AS recent_avg,
       avg(CASE WHEN r > 7 AND r <= 14 THEN net_sale END) AS previous_avg FROM rk"""))
def e04_last_vs_previous_week(spark, sf):
    return sync.last_vs_previous_week(frames.kept(spark, sf))


@register("g05_trend_prediction", ("G-05", "E-04", "D-02"), with_ctes(*KEPT, _WEEK_SQL, """
ag AS (SELECT avg(net_sale) AS avg_net_sale, avg(discount) AS avg_discount, avg(orders) AS avg_orders,
              count(*) AS n_days, avg(CASE WHEN r <= 7 THEN net_sale END) AS recent_avg,
              avg(CASE WHEN r > 7 AND r <= 14 THEN net_sale END) AS previous_avg FROM rk),
tf AS (SELECT *, CASE WHEN n_days >= 14 AND previous_avg > 0 THEN recent_avg / previous_avg ELSE 1.0 END
              AS trend_factor FROM ag WHERE (SELECT count(*) FROM k) >= 7)""", final="""
SELECT n_days, trend_factor, avg_net_sale * trend_factor AS predicted_net_sale,
       avg_discount * trend_factor AS predicted_discount, avg_orders * trend_factor AS predicted_orders,
       CASE WHEN avg_net_sale * trend_factor + avg_discount * trend_factor > 0
            THEN avg_discount * trend_factor / (avg_net_sale * trend_factor + avg_discount * trend_factor) * 100
            ELSE 0.0 END AS predicted_discount_pct FROM tf"""))
def g05_trend_prediction(spark, sf):
    return sync.trend_prediction(frames.kept(spark, sf))


_LAST2 = """
l2 AS (SELECT max(Date) AS latest, max(ReceivedAt) AS max_ts FROM e),
p2 AS (SELECT l2.*, (SELECT max(Date) FROM e WHERE Date < l2.latest) AS prev,
              hour(max_ts) * 3600 + minute(max_ts) * 60 + second(max_ts) + microsecond(max_ts) % 1000000 / 1e6 AS tod
       FROM l2)"""
_TOD = "(hour(ReceivedAt) * 3600 + minute(ReceivedAt) * 60 + second(ReceivedAt) + microsecond(ReceivedAt) % 1000000 / 1e6)"


@register("g01_time_synced_comparison", ("G-01", "F-09", "C-05"), with_ctes(*BASE, _LAST2, f"""
sc AS (SELECT e.*, e.Date = p2.latest AS il FROM e, p2
       WHERE e.Date = p2.latest OR (e.Date = p2.prev AND {_TOD} <= p2.tod)),
ag AS (SELECT CAST(count_if(il) AS DOUBLE) AS L_Orders, CAST(count_if(NOT il) AS DOUBLE) AS P_Orders,
   CAST(SUM(CASE WHEN il THEN net_sale_vat END) AS DOUBLE) / 1.05 AS L_net_sale,
   CAST(SUM(CASE WHEN NOT il THEN net_sale_vat END) AS DOUBLE) / 1.05 AS P_net_sale,
   CAST(SUM(CASE WHEN il THEN calc_discount_vat END) AS DOUBLE) / 1.05 AS L_cd,
   CAST(SUM(CASE WHEN NOT il THEN calc_discount_vat END) AS DOUBLE) / 1.05 AS P_cd,
   SUM(CASE WHEN il THEN Profit_Margin END) AS L_pm, SUM(CASE WHEN NOT il THEN Profit_Margin END) AS P_pm
   FROM sc),
lg AS (
  SELECT 'Orders' AS Metric, COALESCE(L_Orders, 0) AS Latest, COALESCE(P_Orders, 0) AS Previous_Synced FROM ag
  UNION ALL SELECT 'net_sale', COALESCE(L_net_sale, 0), COALESCE(P_net_sale, 0) FROM ag
  UNION ALL SELECT 'Calculated_Discount', COALESCE(L_cd, 0), COALESCE(P_cd, 0) FROM ag
  UNION ALL SELECT 'Profit_Margin', COALESCE(L_pm, 0), COALESCE(P_pm, 0) FROM ag)""", final="""
SELECT p2.latest AS Latest_Date, p2.prev AS Previous_Date, Metric, lg.Latest, Previous_Synced,
       lg.Latest - Previous_Synced AS Delta,
       (lg.Latest - Previous_Synced) / CASE WHEN Previous_Synced = 0 THEN 1.0 ELSE Previous_Synced END * 100
       AS Pct_Change
FROM lg, p2"""))
def g01_time_synced_comparison(spark, sf):
    return sync.time_synced_comparison(frames.essential(spark, sf))


@register("g04_same_day_projection", "G-04", with_ctes(*BASE, _LAST2, f"""
ag AS (SELECT COALESCE(SUM(CASE WHEN e.Date = p2.prev THEN net_sale_vat END), 0) AS pf,
              COALESCE(SUM(CASE WHEN e.Date = p2.latest THEN net_sale_vat END), 0) AS td,
              COALESCE(SUM(CASE WHEN e.Date = p2.prev AND {_TOD} <= p2.tod THEN net_sale_vat END), 0) AS ps
       FROM e, p2 WHERE e.Date IN (p2.latest, p2.prev))""", final="""
SELECT p2.latest AS Latest_Date, p2.prev AS Previous_Date,
       CAST(pf AS DOUBLE) / 1.05 + CAST(td - ps AS DOUBLE) / 1.05 AS Prediction,
       CAST(pf AS DOUBLE) / 1.05 AS Previous_Day_Net_Sale, CAST(td - ps AS DOUBLE) / 1.05 AS Net_Sale_Diff
FROM ag, p2"""))
def g04_same_day_projection(spark, sf):
    return sync.same_day_projection(frames.essential(spark, sf))


@register("g03_single_date_sync", "G-03", with_ctes(*KEPT, """
lt AS (SELECT * FROM k WHERE Date = (SELECT max(Date) FROM k))""", final=f"""
SELECT Channel, count(*) AS orders, {NET} AS net_sale FROM lt
WHERE ReceivedAt <= date_trunc('minute', (SELECT max(ReceivedAt) FROM lt)) GROUP BY Channel"""))
def g03_single_date_sync(spark, sf):
    """G-03: the latest date alone, cut at its last order floored to the minute."""
    k = frames.kept(spark, sf)
    one = sync.single_date_sync(sync.on_dates(k, [sync.latest_date(k)]))
    return one.groupBy("Channel").agg(F.count(F.lit(1)).alias("orders"),
                                      (F.sum("net_sale_vat").cast("double") / 1.05).alias("net_sale"))


@register("h09_latest_orders_preview", ("H-09", "H-01", "A-01"), with_ctes(*BASE, final="""
SELECT OrderID, ReceivedAt, Channel, Brand, net_sale FROM e ORDER BY ReceivedAt DESC, OrderID LIMIT 20"""))
def h09_latest_orders_preview(spark, sf):
    """H-01 / H-09: newest 20 orders (the load query's ORDER BY ReceivedAt DESC)."""
    return (frames.essential(spark, sf).select("OrderID", "ReceivedAt", "Channel", "Brand", "net_sale")
            .orderBy(F.col("ReceivedAt").desc(), "OrderID").limit(20))

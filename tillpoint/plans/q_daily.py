"""Views over any range of days from daily cells and customer bitmaps (D-01..D-18), and SQL twins over the orders themselves."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from tillpoint.operators import daily, sync
from tillpoint.plans import frames
from tillpoint.plans.catalog import register
from tillpoint.plans.q_discounts import AVG_CD, CD, LABELS, NET, RANGE, _RANGE_TABLE_SQL
from tillpoint.plans.q_metrics import KEPT, _kpi_sql
from tillpoint.plans.sqlparts import with_ctes

#: The last days of the ranges that ``d01_kpis_by_range`` asks for, back from the latest day, and how many days they have.
RANGES = [("last_week", 0, 7), ("last_quarter", 0, 90), ("year_before", 365, 365), ("one_day", 100, 1), ("most", 30, 2000)]
#: One range for the breakdowns: 200 days that end 50 before the latest.
BACK, LONG = 50, 200


def _span(spark, sf, back, n):
    latest = sync.latest_days(frames.kept(spark, sf), 1)[0]
    end = latest - dt.timedelta(days=back)
    return end - dt.timedelta(days=n - 1), end


def _in(back: int, n: int) -> str:
    return f"Date BETWEEN (SELECT max(Date) FROM k) - {back + n - 1} AND (SELECT max(Date) FROM k) - {back}"


_SPAN = [*KEPT, f"kr AS (SELECT * FROM k WHERE {_in(BACK, LONG)})"]
_SPAN_DISC = [*_SPAN, f"dk AS (SELECT *, Profit_Margin AS CM, {RANGE} AS Discount_Range FROM kr WHERE Calculated_Discount > 0)", LABELS]


@register("d01_kpis_by_range", "D-01", with_ctes(*KEPT, *[f"r_{name} AS (SELECT * FROM k WHERE {_in(back, n)})" for name, back, n in RANGES],
                                                final=" UNION ALL ".join(f"SELECT '{name}' AS period, * FROM ({_kpi_sql('r_' + name)})" for name, _, _ in RANGES)))
def d01_kpis_by_range(spark, sf):
    """D-01 for five ranges: sums of daily cells, and distinct customers by or-ed bitmaps; no order is read."""
    cells, bitmaps = frames.daily_cells(spark, sf), frames.customer_bitmaps(spark, sf)
    each = [daily.kpis(cells, bitmaps, *_span(spark, sf, back, n)).withColumn("period", F.lit(name)) for name, back, n in RANGES]
    return reduce(lambda a, b: a.unionByName(b), each)


for _dim in ("Brand", "Channel"):
    def _mk(dim):
        def q(spark, sf):
            return daily.distinct_customers(frames.customer_bitmaps(spark, sf), (dim,), *_span(spark, sf, BACK, LONG))
        q.__doc__ = f"Distinct customers of 200 days by {dim}, from bitmaps."
        return q
    register(f"d01_customers_by_{_dim.lower()}", "D-01", with_ctes(*_SPAN, final=f"""
SELECT {_dim}, count(DISTINCT CustomerName) AS total_customers FROM kr WHERE {_dim} IS NOT NULL AND CustomerName IS NOT NULL GROUP BY {_dim}"""))(_mk(_dim))


@register("d02_daily_series_cells", "D-02", with_ctes(*KEPT, final=f"""
SELECT Date, {NET} AS net_sale, count(OrderID) AS orders, {CD} AS discount FROM k WHERE Date IS NOT NULL GROUP BY Date"""))
def d02_daily_series_cells(spark, sf):
    return daily.daily_series(frames.daily_cells(spark, sf))


for _dim in ("Channel", "PaymentMethod", "Brand"):
    def _mk_sales(dim):
        def q(spark, sf):
            return daily.sales_by(frames.daily_cells(spark, sf), dim, *_span(spark, sf, BACK, LONG))
        q.__doc__ = f"D-10 of 200 days by {dim}, from daily cells."
        return q
    register(f"d10_range_sales_by_{_dim.lower()}", "D-10", with_ctes(*_SPAN, final=f"SELECT {_dim}, {NET} AS net_sale FROM kr WHERE {_dim} IS NOT NULL GROUP BY {_dim}"))(_mk_sales(_dim))

for _name, _dims, _id in (("d04_range_discount_by_brand", ["Brand"], "D-04"), ("d05_range_discount_by_address", ["Address"], "D-05"),
                          ("d06_range_discount_by_brand_address", ["Brand", "Address"], "D-06")):
    def _mk_cm(dims):
        def q(spark, sf):
            return daily.cm_breakdown(frames.daily_cells(spark, sf), dims, *_span(spark, sf, BACK, LONG))
        q.__doc__ = f"Discounted orders of 200 days by {' × '.join(dims)}, from daily cells."
        return q
    _where = " AND ".join(f"{d} IS NOT NULL" for d in _dims)
    register(_name, _id, with_ctes(*_SPAN_DISC, final=f"""
SELECT {', '.join(_dims)}, count(OrderID) AS Orders, {CD} AS Total_Discount, {AVG_CD} AS Avg_Discount, SUM(CM) AS Total_CM, AVG(CM) AS Avg_CM, {NET} AS Total_Net_Sale
FROM dk WHERE {_where} GROUP BY {', '.join(_dims)}"""))(_mk_cm(_dims))

for _name, _dims, _id in (("d11_range_discount_by_channel", ["Channel"], "D-11"), ("d12_range_discount_by_date", ["Date"], "D-12"), ("d13_range_discount_by_address", ["Address"], "D-13"),
                          ("d14_range_discount_by_brand", ["Brand"], "D-14"), ("d15_range_brand_channel_matrix", ["Brand", "Channel"], "D-15")):
    def _mk_deep(dims):
        def q(spark, sf):
            return daily.deep_dive(frames.daily_cells(spark, sf), dims, *_span(spark, sf, BACK, LONG))
        q.__doc__ = f"Discount performance of 200 days by {' × '.join(dims)}, from daily cells."
        return q
    _where = " AND ".join(f"{d} IS NOT NULL" for d in _dims)
    register(_name, _id, with_ctes(*_SPAN, final=f"""
SELECT *, CASE WHEN Total_Sales <> 0 THEN Total_Discount / Total_Sales * 100 ELSE 0 END AS Discount_Rate_Pct FROM (
SELECT {', '.join(_dims)}, {CD} AS Total_Discount, {AVG_CD} AS Avg_Discount, count(OrderID) AS Orders, {NET} AS Total_Sales FROM kr WHERE {_where} GROUP BY {', '.join(_dims)})"""))(_mk_deep(_dims))


@register("d07_range_table_cells", "D-07", _RANGE_TABLE_SQL)
def d07_range_table_cells(spark, sf):
    """D-07 over all days, from daily cells."""
    return daily.range_table(frames.daily_cells(spark, sf))


@register("d16_range_code_effectiveness", "D-16", with_ctes(*_SPAN, final=f"""
SELECT DiscountCode, count(OrderID) AS Uses, {CD} AS Total_Discount, {AVG_CD} AS Avg_Discount FROM kr WHERE DiscountCode IS NOT NULL GROUP BY DiscountCode"""))
def d16_range_code_effectiveness(spark, sf):
    return daily.code_effectiveness(frames.daily_cells(spark, sf), *_span(spark, sf, BACK, LONG))


@register("d18_range_scorecard", "D-18", with_ctes(*_SPAN, final=f"""
SELECT *, CASE WHEN Total_Sales + Total_Discount <> 0 THEN Total_Discount / (Total_Sales + Total_Discount) * 100 END AS Discount_Rate_Pct, Total_Sales - Total_Discount AS Profit FROM (
SELECT Location, Brand, count(OrderID) AS Total_Orders, {CD} AS Total_Discount, {AVG_CD} AS Avg_Discount, {NET} AS Total_Sales,
  {NET} / CAST(count(net_sale_vat) AS DOUBLE) AS Avg_Sale FROM kr WHERE Location IS NOT NULL AND Brand IS NOT NULL GROUP BY Location, Brand)"""))
def d18_range_scorecard(spark, sf):
    return daily.scorecard(frames.daily_cells(spark, sf), *_span(spark, sf, BACK, LONG))

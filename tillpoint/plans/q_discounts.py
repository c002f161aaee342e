"""Discount performance queries (D-04..D-21, D-34, G-16, H-06, H-07, C-02, C-03) and SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.functions import discounts as dg
from tillpoint.operators import discount_perf as dp
from tillpoint.operators import kpis, sync
from tillpoint.plans import frames
from tillpoint.plans.catalog import register
from tillpoint.plans.sqlparts import BASE, with_ctes

KEPT = [*BASE, "k AS (SELECT * FROM e WHERE COALESCE(GrossPrice <> Discount, TRUE))"]
NET = "CAST(SUM(net_sale_vat) AS DOUBLE) / 1.05"
CD = "CAST(SUM(calc_discount_vat) AS DOUBLE) / 1.05"
AVG_CD = f"({CD} / CAST(count(calc_discount_vat) AS DOUBLE))"
RANGE = """CASE WHEN Calculated_Discount > 0 AND Calculated_Discount <= 10 THEN '1-10'
     WHEN Calculated_Discount > 10 AND Calculated_Discount <= 25 THEN '11-25'
     WHEN Calculated_Discount > 25 AND Calculated_Discount <= 50 THEN '26-50'
     WHEN Calculated_Discount > 50 AND Calculated_Discount <= 100 THEN '51-100'
     WHEN Calculated_Discount > 100 THEN '100+' END"""
LABELS = ("labels(Discount_Range, Range_Order) AS (VALUES ('1-10', 1), ('11-25', 2), ('26-50', 3), "
          "('51-100', 4), ('100+', 5))")
DISC = [*KEPT, f"dk AS (SELECT *, Profit_Margin AS CM, {RANGE} AS Discount_Range FROM k WHERE Calculated_Discount > 0)",
        LABELS]


def _cm_sql(dims: list[str]) -> str:
    where = " AND ".join(f"{d} IS NOT NULL" for d in dims)
    return f"""SELECT {', '.join(dims)}, count(OrderID) AS Orders, {CD} AS Total_Discount,
  {AVG_CD} AS Avg_Discount, SUM(CM) AS Total_CM, AVG(CM) AS Avg_CM, {NET} AS Total_Net_Sale
FROM dk WHERE {where} GROUP BY {', '.join(dims)}"""


for _name, _dims, _id in (("d04_discount_by_brand", ["Brand"], "D-04"),
                          ("d05_discount_by_address", ["Address"], "D-05"),
                          ("d06_discount_by_brand_address", ["Brand", "Address"], "D-06")):
    def _mk(dims):
        def q(spark, sf):
            return dp.cm_breakdown(dp.discounted(frames.kept(spark, sf)), dims)
        q.__doc__ = f"Discounted orders by {' × '.join(dims)} with CM (D-09 chain)."
        return q
    register(_name, (_id, "B-06", "D-09"), with_ctes(*DISC, final=_cm_sql(_dims)))(_mk(_dims))


_RANGE_TABLE_SQL = with_ctes(*DISC, f"""
g AS (SELECT Discount_Range, {NET} AS n_, count(net_sale_vat) AS nn, count(OrderID) AS o_, {CD} AS cd_,
             count(calc_discount_vat) AS ncd, SUM(CM) AS cm_, AVG(CM) AS acm
      FROM dk WHERE Discount_Range IS NOT NULL GROUP BY Discount_Range)""", """
rt AS (SELECT l.Discount_Range, l.Range_Order,
   CAST(COALESCE(round_even(n_, 0), 0) AS BIGINT) AS Total_Net_Sales,
   CAST(COALESCE(round_even(n_ / CAST(nn AS DOUBLE), 0), 0) AS BIGINT) AS Average_Order_Value,
   CAST(COALESCE(o_, 0) AS BIGINT) AS Number_of_Orders,
   CAST(COALESCE(round_even(cd_ / CAST(ncd AS DOUBLE), 0), 0) AS BIGINT) AS Average_Discount_Amount,
   CAST(COALESCE(round_even(cm_, 0), 0) AS BIGINT) AS Total_CM,
   CAST(COALESCE(round_even(acm, 0), 0) AS BIGINT) AS Average_CM
 FROM labels l LEFT JOIN g ON l.Discount_Range = g.Discount_Range)""", final="SELECT * FROM rt")


@register("d07_discount_range_table", ("D-07", "F-04", "F-14", "U-05"), _RANGE_TABLE_SQL)
def d07_discount_range_table(spark, sf):
    return dp.range_table(dp.discounted(frames.kept(spark, sf)))


@register("d08_net_sale_by_range", "D-08", with_ctes(*DISC, f"""
g AS (SELECT Discount_Range, {NET} AS n_ FROM dk WHERE Discount_Range IS NOT NULL GROUP BY Discount_Range)""",
                                                      final="""
SELECT l.Discount_Range, l.Range_Order, COALESCE(n_, 0.0) AS net_sale
FROM labels l LEFT JOIN g ON l.Discount_Range = g.Discount_Range"""))
def d08_net_sale_by_range(spark, sf):
    return dp.range_net_sale(dp.discounted(frames.kept(spark, sf)))


@register("d21_range_verdicts", "D-21", _RANGE_TABLE_SQL.replace("SELECT * FROM rt", """
SELECT Discount_Range, Total_CM, Average_CM,
  CASE WHEN Total_CM < 0 THEN 'Negative' WHEN Average_CM < 2 THEN 'Marginal'
       WHEN Total_CM > 0 AND Average_CM > 5 THEN 'Profitable' END AS Verdict FROM rt"""))
def d21_range_verdicts(spark, sf):
    return dp.range_verdicts(dp.range_table(dp.discounted(frames.kept(spark, sf))))


@register("d20_pair_verdicts", "D-20", with_ctes(*DISC, f"pr AS ({_cm_sql(['Brand', 'Address'])})", """
fl AS (SELECT *, CASE WHEN Total_CM < 0 THEN 'Negative'
                      WHEN Total_CM > 0 AND Avg_CM > 5 THEN 'Profitable' END AS Verdict
       FROM pr WHERE Total_Discount > 0)""", final="""
SELECT * FROM (SELECT concat_ws(' @ ', Brand, Address) AS Pair, Brand, Address, Total_CM, Verdict FROM fl
  WHERE Verdict = 'Profitable' ORDER BY Total_Discount DESC, Brand, Address LIMIT 10)
UNION ALL
SELECT * FROM (SELECT concat_ws(' @ ', Brand, Address) AS Pair, Brand, Address, Total_CM, Verdict FROM fl
  WHERE Verdict = 'Negative' ORDER BY Total_Discount DESC, Brand, Address LIMIT 10)"""))
def d20_pair_verdicts(spark, sf):
    return dp.pair_verdicts(dp.cm_breakdown(dp.discounted(frames.kept(spark, sf)), ["Brand", "Address"]))


@register("h07_top_pairs_by_cm", "H-07", with_ctes(*DISC, f"pr AS ({_cm_sql(['Brand', 'Address'])})", final="""
SELECT * FROM pr ORDER BY Total_CM DESC, Brand, Address LIMIT 30"""))
def h07_top_pairs_by_cm(spark, sf):
    pairs = dp.cm_breakdown(dp.discounted(frames.kept(spark, sf)), ["Brand", "Address"])
    return pairs.orderBy(F.col("Total_CM").desc(), "Brand", "Address").limit(30)


def _deep_sql(dims: list[str]) -> str:
    where = " AND ".join(f"{d} IS NOT NULL" for d in dims)
    return f"""SELECT {', '.join(dims)}, {CD} AS Total_Discount, {AVG_CD} AS Avg_Discount,
  count(OrderID) AS Orders, {NET} AS Total_Sales,
  CASE WHEN {NET} <> 0 THEN {CD} / ({NET}) * 100 ELSE 0.0 END AS Discount_Rate_Pct
FROM e WHERE {where} GROUP BY {', '.join(dims)}"""


for _name, _dims, _id, _n in (("d11_discount_by_channel_top10", ["Channel"], "D-11", 10),
                              ("d13_discount_by_address_top10", ["Address"], "D-13", 10),
                              ("d14_discount_by_brand_top10", ["Brand"], "D-14", 10),
                              ("d15_brand_channel_matrix_top20", ["Brand", "Channel"], "D-15", 20)):
    def _mk2(dims, n):
        def q(spark, sf):
            t = dp.deep_dive(frames.essential(spark, sf), dims)
            return dp.top_by_discount(t, dims, n)
        q.__doc__ = f"Deep dive by {' × '.join(dims)}: top {n} by total discount."
        return q
    register(_name, (_id, "H-07"), with_ctes(*BASE, final=f"""
SELECT * FROM ({_deep_sql(_dims)}) ORDER BY Total_Discount DESC, {', '.join(_dims)} LIMIT {_n}"""))(_mk2(_dims, _n))


@register("d12_discount_by_date_last14", "D-12", with_ctes(*BASE, final=f"""
SELECT * FROM ({_deep_sql(['Date'])}) ORDER BY Date DESC LIMIT 14"""))
def d12_discount_by_date_last14(spark, sf):
    """D-12: per date, the latest 14 dates; only these are read."""
    e = frames.essential(spark, sf)
    t = dp.deep_dive(sync.on_dates(e, [F.lit(d) for d in sync.latest_days(e, 14)]), ["Date"])
    return t.orderBy(F.col("Date").desc()).limit(14)


@register("d16_code_effectiveness", ("D-16", "H-07"), with_ctes(*BASE, final=f"""
SELECT DiscountCode, count(OrderID) AS Uses, {CD} AS Total_Discount, {AVG_CD} AS Avg_Discount
FROM e WHERE DiscountCode IS NOT NULL GROUP BY DiscountCode ORDER BY Total_Discount DESC, DiscountCode LIMIT 10"""))
def d16_code_effectiveness(spark, sf):
    return dp.code_effectiveness(frames.essential(spark, sf)).orderBy(
        F.col("Total_Discount").desc(), "DiscountCode").limit(10)


@register("d17_fine_discount_ranges", "D-17", with_ctes(*BASE, LABELS, f"""
g AS (SELECT {RANGE} AS Discount_Range, OrderID, calc_discount_vat, Discount_Percentage FROM e),
a AS (SELECT Discount_Range, count(OrderID) AS o_, {CD} AS Total_Discount, {AVG_CD} AS Avg_Discount,
             AVG(Discount_Percentage) AS Avg_Discount_Rate
      FROM g WHERE Discount_Range IS NOT NULL GROUP BY Discount_Range)""", final="""
SELECT l.Discount_Range, l.Range_Order, CAST(COALESCE(o_, 0) AS BIGINT) AS Orders, Total_Discount,
       Avg_Discount, Avg_Discount_Rate
FROM labels l LEFT JOIN a ON l.Discount_Range = a.Discount_Range"""))
def d17_fine_discount_ranges(spark, sf):
    return dp.fine_ranges(frames.essential(spark, sf))


_CARD = f"""card AS (SELECT Location, Brand, count(OrderID) AS Total_Orders, {CD} AS Total_Discount,
  {AVG_CD} AS Avg_Discount, {NET} AS Total_Sales, ({NET}) / CAST(count(net_sale_vat) AS DOUBLE) AS Avg_Sale
 FROM e WHERE Location IS NOT NULL AND Brand IS NOT NULL GROUP BY Location, Brand),
card2 AS (SELECT *, CASE WHEN Total_Sales + Total_Discount <> 0
                         THEN Total_Discount / (Total_Sales + Total_Discount) * 100 END AS Discount_Rate_Pct,
                 Total_Sales - Total_Discount AS Profit FROM card)"""


@register("d18_location_brand_scorecard", "D-18", with_ctes(*BASE, _CARD, final="SELECT * FROM card2"))
def d18_location_brand_scorecard(spark, sf):
    return dp.scorecard(frames.essential(spark, sf))


@register("d19_scorecard_verdicts", "D-19", with_ctes(*BASE, _CARD, final="""
SELECT * FROM (SELECT *, 'Good' AS Verdict FROM card2 WHERE Profit > 0 AND Discount_Rate_Pct < 35 AND Total_Sales > 0
               ORDER BY Profit DESC, Location, Brand LIMIT 10)
UNION ALL
SELECT * FROM (SELECT *, 'Bad' AS Verdict FROM card2 WHERE Profit < 0 OR Discount_Rate_Pct > 50
               ORDER BY Profit ASC, Location, Brand LIMIT 10)"""))
def d19_scorecard_verdicts(spark, sf):
    return dp.scorecard_verdicts(dp.scorecard(frames.essential(spark, sf)))


@register("d34_largest_discount", "D-34", with_ctes(*BASE, final="""
SELECT max(Calculated_Discount) AS max_discount FROM e"""))
def d34_largest_discount(spark, sf):
    return kpis.largest_discount(frames.essential(spark, sf))


@register("h06_deepest_discounts", "H-06", with_ctes(*BASE, final="""
SELECT OrderID, CustomerName, Channel, Address, Date, CAST(GrossPrice AS DOUBLE) AS GrossPrice,
       Calculated_Discount, DiscountCode
FROM e ORDER BY Calculated_Discount DESC, OrderID LIMIT 10"""))
def h06_deepest_discounts(spark, sf):
    return dp.deepest_discounts(frames.essential(spark, sf), 10)


def _top_sql(dim: str) -> str:
    return (f"SELECT 'top_{dim.lower()}' AS Insight, CAST({dim} AS VARCHAR) AS Item, Discount_Rate_Pct AS Value "
            f"FROM ({_deep_sql([dim])}) ORDER BY Total_Discount DESC, {dim} LIMIT 1")


@register("g16_discount_insights", "G-16", with_ctes(*BASE, final=f"""
SELECT * FROM ({_top_sql('Channel')})
UNION ALL SELECT * FROM ({_top_sql('Address')})
UNION ALL SELECT * FROM ({_top_sql('Brand')})
UNION ALL SELECT * FROM (SELECT 'top_code' AS Insight, DiscountCode AS Item, CAST(count(OrderID) AS DOUBLE) AS Value
  FROM e WHERE DiscountCode IS NOT NULL GROUP BY DiscountCode ORDER BY {CD} DESC, DiscountCode LIMIT 1)
UNION ALL SELECT 'max_discount', NULL, max(Calculated_Discount) FROM e"""))
def g16_discount_insights(spark, sf):
    return dp.insights(frames.essential(spark, sf))


@register("c02_discount_group_lookup", ("C-02", "U-01", "F-13"), with_ctes(*BASE, final=f"""
SELECT Discount_Group, count(*) AS orders, {NET} AS net_sale, {CD} AS discount FROM e GROUP BY Discount_Group"""))
def c02_discount_group_lookup(spark, sf):
    """C-02: orders per exact-lookup discount group (null → None, miss → Other)."""
    return frames.essential(spark, sf).groupBy("Discount_Group").agg(
        F.count(F.lit(1)).alias("orders"), (F.sum("net_sale_vat").cast("double") / 1.05).alias("net_sale"),
        (F.sum("calc_discount_vat").cast("double") / 1.05).alias("discount"))


_PREFIX = "CASE WHEN DiscountCode IS NULL THEN 'None' " + " ".join(
    f"WHEN starts_with(upper(DiscountCode), '{p}') THEN '{g}'" for p, g in dg.PREFIX_GROUPS) + " ELSE 'Other' END"


@register("c03_discount_prefix_groups", ("C-03", "U-01"), with_ctes(*BASE, final=f"""
SELECT {_PREFIX} AS Prefix_Group, count(*) AS orders FROM orders_c GROUP BY 1"""))
def c03_discount_prefix_groups(spark, sf):
    """C-03: first-matching code prefix group (the extended column set's rule)."""
    o = frames.orders(spark, sf)
    return o.groupBy(dg.prefix_group("DiscountCode").alias("Prefix_Group")).agg(F.count(F.lit(1)).alias("orders"))

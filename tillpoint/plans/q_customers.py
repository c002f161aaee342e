"""Customer analytics queries (D-03, D-23..D-26, D-33, E-01, E-02, G-07..G-09, G-13..G-15, H-05, S-03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.operators import customers as cu
from tillpoint.operators.enrich import with_customer_stats
from tillpoint.plans import frames
from tillpoint.plans.catalog import register
from tillpoint.plans.sqlparts import BASE, EXTENDED_SQL, with_ctes
from tillpoint.sources.canonical import ORDERS_SQL

KEPT = [*BASE, "k AS (SELECT * FROM e WHERE COALESCE(GrossPrice <> Discount, TRUE))"]
EXT = [ORDERS_SQL.strip(), EXTENDED_SQL.strip()]
NET = "CAST(SUM(net_sale_vat) AS DOUBLE) / 1.05"
CD = "CAST(SUM(calc_discount_vat) AS DOUBLE) / 1.05"


def _days(a: str, b: str) -> str:
    return f"CAST(floor((epoch({b}) - epoch({a})) / 86400) AS BIGINT)"


def ew_bin_sql(x: str, lo: str, hi: str, n: int) -> str:
    """SQL twin of ``equal_width_bin``."""
    lo_, hi_ = f"CAST({lo} AS DOUBLE)", f"CAST({hi} AS DOUBLE)"
    pad = f"(CASE WHEN {lo_} = 0 THEN CAST(0.001 AS DOUBLE) ELSE abs({lo_}) * CAST(0.001 AS DOUBLE) END)"
    lo2 = f"(CASE WHEN {lo_} = {hi_} THEN {lo_} - {pad} ELSE {lo_} END)"
    hi2 = f"(CASE WHEN {lo_} = {hi_} THEN {hi_} + {pad} ELSE {hi_} END)"
    step = f"(({hi2} - {lo2}) / CAST({n} AS DOUBLE))"
    terms = " + ".join(f"(CASE WHEN CAST({x} AS DOUBLE) > CAST({i} AS DOUBLE) * {step} + {lo2} THEN 1 ELSE 0 END)"
                       for i in range(1, n))
    return f"(CASE WHEN {x} IS NOT NULL THEN 1 + {terms} END)"


def _segment_sql(x: str, edges, labels) -> str:
    parts = []
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = f"{x} > {lo}" + ("" if hi == float("inf") else f" AND {x} <= {hi}")
        parts.append(f"WHEN {cond} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


_CT = f"""
ct AS (SELECT CustomerName, Telephone, Address, {NET} AS Total_Spent, count(net_sale_vat) AS Order_Count,
              {CD} AS Total_Discount, min(ReceivedAt) AS First_Order, max(ReceivedAt) AS Last_Order
       FROM k WHERE CustomerName IS NOT NULL AND Telephone IS NOT NULL AND Address IS NOT NULL
       GROUP BY CustomerName, Telephone, Address),
ct2 AS (SELECT *, Total_Spent / CAST(Order_Count AS DOUBLE) AS Avg_Order_Value,
               {_days('First_Order', 'Last_Order')} AS Customer_Lifetime_Days,
               {_segment_sql('Total_Spent', cu.SEGMENT_EDGES, cu.SEGMENT_LABELS)} AS Segment FROM ct)"""


@register("d03_customer_table", ("D-03", "F-08", "F-04"), with_ctes(*KEPT, _CT, final="SELECT * FROM ct2"))
def d03_customer_table(spark, sf):
    return cu.customer_table(frames.kept(spark, sf))


@register("d26_behaviour_summary", "D-26", with_ctes(*KEPT, _CT, """
sg AS (SELECT Segment, count(*) AS n FROM ct2 WHERE Segment IS NOT NULL GROUP BY Segment)""", final="""
SELECT AVG(CASE WHEN Order_Count > 1 THEN 1.0 ELSE 0.0 END) * 100 AS Repeat_Rate_Pct,
       count_if(NOT (Order_Count > 1)) AS New_Customers, count_if(Order_Count > 1) AS Repeat_Customers,
       AVG(Customer_Lifetime_Days) AS Avg_Lifetime_Days,
       (SELECT Segment FROM sg ORDER BY n DESC, Segment LIMIT 1) AS Largest_Segment
FROM ct2"""))
def d26_behaviour_summary(spark, sf):
    return cu.behaviour_summary(cu.customer_table(frames.kept(spark, sf)))


@register("g15_value_segment_counts", ("G-15", "D-33"), with_ctes(*KEPT, _CT, final="""
SELECT Segment, count(*) AS customers FROM ct2 WHERE Segment IS NOT NULL GROUP BY Segment"""))
def g15_value_segment_counts(spark, sf):
    return cu.segment_counts(cu.customer_table(frames.kept(spark, sf)), "Segment")


_CLV = f"""
cg AS (SELECT CustomerName, {NET} AS total_revenue, count(net_sale_vat) AS purchase_frequency,
              min(ReceivedAt) AS first_purchase, max(ReceivedAt) AS last_purchase
       FROM e WHERE CustomerName IS NOT NULL GROUP BY CustomerName),
c1 AS (SELECT *, total_revenue / CAST(purchase_frequency AS DOUBLE) AS avg_order_value,
              COALESCE({_days('first_purchase', 'last_purchase')}, 0) AS lifespan_days FROM cg),
c2 AS (SELECT *, CAST(purchase_frequency AS DOUBLE) / (CAST(lifespan_days AS DOUBLE) / CAST(365 AS DOUBLE)
              + CAST(1 AS DOUBLE)) AS purchase_frequency_yearly FROM c1),
c3 AS (SELECT *, avg_order_value * purchase_frequency_yearly
              * (CAST(lifespan_days AS DOUBLE) / CAST(365 AS DOUBLE) + CAST(1 AS DOUBLE)) AS clv FROM c2),
mm AS (SELECT min(clv) AS lo, max(clv) AS hi FROM c3),
c4 AS (SELECT c3.*, {ew_bin_sql('clv', 'mm.lo', 'mm.hi', 3)} AS b_ FROM c3, mm),
clv AS (SELECT * EXCLUDE (b_), CASE b_ WHEN 1 THEN 'Low Value' WHEN 2 THEN 'Medium Value'
               WHEN 3 THEN 'High Value' END AS clv_segment FROM c4)"""


@register("g07_customer_lifetime_value", ("G-07", "F-05", "F-08"), with_ctes(*BASE, _CLV, final="SELECT * FROM clv"))
def g07_customer_lifetime_value(spark, sf):
    return cu.clv(frames.essential(spark, sf))


@register("g08_clv_summary", "G-08", with_ctes(*BASE, _CLV, final="""
SELECT AVG(clv) AS avg_clv, count_if(clv_segment = 'High Value') AS high_value_customers,
       AVG(avg_order_value) AS avg_aov, AVG(purchase_frequency) AS avg_frequency,
       count_if(clv_segment = 'High Value') / count(*) * 100 AS high_value_pct,
       count_if(clv_segment = 'Low Value') > count(*) * 0.5 AS low_value_majority,
       count(*) AS customers FROM clv"""))
def g08_clv_summary(spark, sf):
    return cu.clv_summary(cu.clv(frames.essential(spark, sf)))


@register("g08_clv_by_segment", "G-08", with_ctes(*BASE, _CLV, final="""
SELECT clv_segment, AVG(clv) AS avg_clv, count(*) AS customer_count, SUM(total_revenue) AS total_revenue
FROM clv WHERE clv_segment IS NOT NULL GROUP BY clv_segment"""))
def g08_clv_by_segment(spark, sf):
    return cu.clv_by_segment(cu.clv(frames.essential(spark, sf)))


@register("h05_top_customers_by_clv", "H-05", with_ctes(*BASE, _CLV, final="""
SELECT CustomerName, clv, total_revenue, purchase_frequency, avg_order_value FROM clv
ORDER BY clv DESC, CustomerName LIMIT 20"""))
def h05_top_customers_by_clv(spark, sf):
    t = cu.clv(frames.essential(spark, sf))
    return (t.orderBy(F.col("clv").desc(), "CustomerName").limit(20)
             .select("CustomerName", "clv", "total_revenue", "purchase_frequency", "avg_order_value"))


_CHURN = f"""
ch AS (SELECT CustomerName, {NET} AS total_spent, count(net_sale_vat) AS purchase_count,
              min(ReceivedAt) AS first_purchase, max(ReceivedAt) AS last_purchase
       FROM e WHERE CustomerName IS NOT NULL GROUP BY CustomerName),
chf AS (SELECT *, total_spent / CAST(purchase_count AS DOUBLE) AS avg_order_value,
               {_days('last_purchase', '(SELECT max(ReceivedAt) FROM e)')} AS recency,
               COALESCE({_days('first_purchase', 'last_purchase')}, 0) AS lifetime FROM ch),
chf2 AS (SELECT *, CAST(recency > {cu.CHURN_DAYS} AS INTEGER) AS is_churned FROM chf)"""


@register("g09_churn_features", ("G-09", "U-03"), with_ctes(*BASE, _CHURN, final="SELECT * FROM chf2"))
def g09_churn_features(spark, sf):
    return cu.churn_features(frames.essential(spark, sf))


def _rfm_case() -> str:
    parts = []
    for name, codes in cu.RFM_SEGMENTS:
        lst = ", ".join(f"'{c}'" for c in codes)
        parts.append(f"WHEN RFM_Score IN ({lst}) THEN '{name}'")
    return "CASE " + " ".join(parts) + f" ELSE '{cu.OTHER_SEGMENT}' END"


_RFM = f"""
rg AS (SELECT CustomerName, {_days('max(ReceivedAt)', '(SELECT max(ReceivedAt) FROM e)')} AS Recency,
              count(CustomerName) AS Frequency, {NET} AS Monetary
       FROM e WHERE CustomerName IS NOT NULL GROUP BY CustomerName),
rr AS (SELECT *, row_number() OVER (ORDER BY Frequency, CustomerName) AS F_Rank,
              row_number() OVER (ORDER BY Monetary, CustomerName) AS M_Rank FROM rg),
rp AS (SELECT min(Recency) AS rlo, max(Recency) AS rhi, count(*) AS n FROM rr),
rs AS (SELECT rr.* EXCLUDE (F_Rank, M_Rank),
              CAST(6 - {ew_bin_sql('Recency', 'rp.rlo', 'rp.rhi', 5)} AS INTEGER) AS R_Score,
              CAST({ew_bin_sql('F_Rank', '1', 'rp.n', 5)} AS INTEGER) AS F_Score,
              CAST({ew_bin_sql('M_Rank', '1', 'rp.n', 5)} AS INTEGER) AS M_Score FROM rr, rp),
rs2 AS (SELECT *, CAST(R_Score AS VARCHAR) || CAST(F_Score AS VARCHAR) || CAST(M_Score AS VARCHAR) AS RFM_Score
        FROM rs),
rfm AS (SELECT *, {_rfm_case()} AS Segment FROM rs2)"""


@register("g13_rfm", ("G-13", "E-02", "F-05", "F-17", "U-02", "U-03"), with_ctes(*BASE, _RFM,
                                                                          final="SELECT * FROM rfm"))
def g13_rfm(spark, sf):
    return cu.rfm(frames.essential(spark, sf))


@register("g14_rfm_summary", ("G-14", "D-33"), with_ctes(*BASE, _RFM, final="""
SELECT Segment, AVG(Recency) AS Avg_Recency, AVG(Frequency) AS Avg_Frequency, AVG(Monetary) AS Avg_Monetary,
       SUM(Monetary) AS Total_Revenue, count(*) AS Customer_Count FROM rfm GROUP BY Segment"""))
def g14_rfm_summary(spark, sf):
    return cu.rfm_summary(cu.rfm(frames.essential(spark, sf)))


@register("e02_first_occurrence_rank", "E-02", with_ctes(*BASE, _RFM, final="""
SELECT CustomerName, Frequency, CAST(F_Rank AS BIGINT) AS F_Rank FROM rr"""))
def e02_first_occurrence_rank(spark, sf):
    """E-02: rank(method='first') of purchase frequency over all customers."""
    from tillpoint.operators.ranking import global_rank
    e = frames.essential(spark, sf)
    g = e.where(F.col("CustomerName").isNotNull()).groupBy("CustomerName").agg(
        F.count("CustomerName").alias("Frequency"))
    return global_rank(g, ["Frequency", "CustomerName"], "F_Rank")


_TIER = f"""
tb AS (SELECT * FROM x WHERE Customer_Value_Tier IS NOT NULL),
tpc AS (SELECT Customer_Value_Tier, CustomerName, count(*) AS n_ FROM tb WHERE CustomerName IS NOT NULL
        GROUP BY Customer_Value_Tier, CustomerName),
trep AS (SELECT Customer_Value_Tier, count(*) AS Total_Customers, count_if(n_ > 1) AS Repeat_Customers
         FROM tpc GROUP BY Customer_Value_Tier),
tg AS (SELECT Customer_Value_Tier, count(OrderID) AS Total_Orders, {NET} AS Total_Spent,
              {NET} / CAST(count(net_sale_vat) AS DOUBLE) AS Avg_Order_Value, {CD} AS Total_Discount,
              {CD} / CAST(count(calc_discount_vat) AS DOUBLE) AS Avg_Discount, AVG(Profit_Margin) AS Profit_Margin
       FROM tb GROUP BY Customer_Value_Tier),
tm AS (SELECT tg.*, trep.Total_Customers, trep.Repeat_Customers,
              trep.Repeat_Customers / CAST(trep.Total_Customers AS DOUBLE) * 100 AS Repeat_Rate_Pct
       FROM tg LEFT JOIN trep ON tg.Customer_Value_Tier = trep.Customer_Value_Tier)"""


@register("d23_value_tier_metrics", ("D-23", "B-02", "C-01", "U-04"), with_ctes(*EXT, _TIER,
                                                                         final="SELECT * FROM tm"))
def d23_value_tier_metrics(spark, sf):
    return cu.tier_metrics(frames.extended(spark, sf))


@register("d25_value_tier_actions", "D-25", with_ctes(*EXT, _TIER, final="""
SELECT Customer_Value_Tier,
  CASE WHEN Profit_Margin > 10 AND Repeat_Rate_Pct > 50 THEN 'upsell_loyalty'
       WHEN Profit_Margin > 10 AND Repeat_Rate_Pct <= 50 THEN 'reactivate'
       WHEN Profit_Margin <= 10 AND Repeat_Rate_Pct > 50 THEN 'raise_order_value'
       WHEN Profit_Margin <= 10 AND Repeat_Rate_Pct <= 50 THEN 'win_back' END AS Action,
  Avg_Order_Value > 100 AS Promote_High_Ticket, Total_Customers < 20 AS Small_Segment,
  Profit_Margin > 10 AS Profitable_Segment, Profit_Margin < 5 AS Low_Margin_Segment,
  Repeat_Rate_Pct > 50 AS High_Repeat_Segment FROM tm"""))
def d25_value_tier_actions(spark, sf):
    return cu.tier_actions(cu.tier_metrics(frames.extended(spark, sf)))


@register("d24_value_tier_counts", "D-24", with_ctes(*EXT, """
tc AS (SELECT Customer_Value_Tier, count(*) AS orders FROM x WHERE Customer_Value_Tier IS NOT NULL
       GROUP BY Customer_Value_Tier)""", final="""
SELECT *, Customer_Value_Tier = (SELECT Customer_Value_Tier FROM tc ORDER BY orders DESC, Customer_Value_Tier
                                 LIMIT 1) AS is_mode FROM tc"""))
def d24_value_tier_counts(spark, sf):
    return cu.tier_counts(frames.extended(spark, sf))


@register("s03_customer_tier_pairs", "S-03", with_ctes(*EXT, final="""
SELECT DISTINCT CustomerName, Customer_Value_Tier FROM x"""))
def s03_customer_tier_pairs(spark, sf):
    return frames.extended(spark, sf).select("CustomerName", "Customer_Value_Tier").dropDuplicates()


@register("e01_customer_totals_on_orders", ("E-01", "C-01"), with_ctes(*KEPT, """
cs AS (SELECT CustomerName AS cs_key, CAST(count(net_sale_vat) AS BIGINT) AS Customer_Order_Count,
              CAST(SUM(net_sale_vat) AS DOUBLE) / 1.05 AS Customer_Total_Spent,
              CAST(SUM(net_sale_vat) AS DOUBLE) / 1.05 / count(net_sale_vat) AS Customer_Avg_Order
       FROM k WHERE CustomerName IS NOT NULL GROUP BY CustomerName)""", final="""
SELECT OrderID, CustomerName, net_sale, Customer_Order_Count, Customer_Total_Spent, Customer_Avg_Order
FROM k LEFT JOIN cs ON k.CustomerName = cs.cs_key"""))
def e01_customer_totals_on_orders(spark, sf):
    """E-01 / C-01: per-customer totals on every order (aggregate, then join back)."""
    k = frames.kept(spark, sf).select("OrderID", "CustomerName", "net_sale", "net_sale_vat")
    return with_customer_stats(k).select("OrderID", "CustomerName", "net_sale", "Customer_Order_Count",
                                         "Customer_Total_Spent", "Customer_Avg_Order")

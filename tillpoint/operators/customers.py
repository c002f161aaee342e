"""Customer analytics (D-03, D-23..D-26, D-33, G-07..G-09, G-13..G-15, E-01, E-02, F-05, F-17).

Every per-customer table is a ``groupBy`` on the customer key (partial
aggregation first, so a hot walk-in name is collapsed map-side).  Global
parameters (latest order time, min/max for equal-width bins) come from one
small aggregate each; first-occurrence ranks use the distributed global rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.exprs import VAT_FACTOR, dbl, elapsed_days, equal_width_bin, fixed_bins
from tillpoint.operators.metrics import calc_discount_sum, net_sale_sum
from tillpoint.operators.params import fetch, lit, ts_lit
from tillpoint.operators.ranking import global_rank

# Customer value segments of the behaviour tab.
SEGMENT_EDGES = [0, 100, 500, 1000, float("inf")]
SEGMENT_LABELS = ["Low Value", "Medium Value", "High Value", "VIP"]
CLV_LABELS = ["Low Value", "Medium Value", "High Value"]
CHURN_DAYS = 90

# RFM code sets per segment, checked in this order (the
# 'Cannot Lose Them' set is contained in 'At Risk', so it is never reached).
RFM_SEGMENTS = [
    ("Champions", ["555", "554", "544", "545", "454", "455", "445"]),
    ("Loyal Customers", ["543", "444", "435", "355", "354", "345", "344", "335"]),
    ("Potential Loyalists", ["512", "511", "422", "421", "412", "411", "311"]),
    ("New Customers", ["533", "532", "531", "523", "522", "521", "515", "514", "513", "425", "424", "413",
                       "414", "415", "315", "314", "313"]),
    ("At Risk", ["155", "154", "144", "214", "215", "115", "114"]),
    ("Cannot Lose Them", ["155", "154", "144", "214", "215", "115"]),
    ("Hibernating", ["331", "321", "231", "241", "251"]),
]
OTHER_SEGMENT = "Others"


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = df
    for k in keys:
        out = out.where(F.col(k).isNotNull())
    return out


def customer_table(df: DataFrame, keys: Sequence[str] = ("CustomerName", "Telephone", "Address")) -> DataFrame:
    """D-03: spend, mean order, orders, discount, first/last order, lifetime days, segment."""
    keys = [k for k in keys if k in df.columns]
    g = _keyed(df, keys).groupBy(*keys).agg(
        net_sale_sum().alias("Total_Spent"), F.count("net_sale_vat").alias("Order_Count"),
        calc_discount_sum().alias("Total_Discount"),
        F.min("ReceivedAt").alias("First_Order"), F.max("ReceivedAt").alias("Last_Order"))
    return (g.withColumn("Avg_Order_Value", F.col("Total_Spent") / dbl("Order_Count"))
             .withColumn("Customer_Lifetime_Days", elapsed_days("First_Order", "Last_Order"))
             .withColumn("Segment", fixed_bins("Total_Spent", SEGMENT_EDGES, SEGMENT_LABELS)))


def behaviour_summary(table: DataFrame) -> DataFrame:
    """D-26: repeat rate, new / repeat counts, mean lifetime, largest segment."""
    seg = (table.where(F.col("Segment").isNotNull()).groupBy("Segment").agg(F.count(F.lit(1)).alias("n"))
                .agg(F.min_by("Segment", F.struct(-F.col("n"), F.col("Segment"))).alias("s")))
    largest = seg.scalar()
    rep = F.col("Order_Count") > 1
    return table.agg(
        (F.avg(F.when(rep, 1.0).otherwise(0.0)) * 100).alias("Repeat_Rate_Pct"),
        F.count_if(~rep).alias("New_Customers"), F.count_if(rep).alias("Repeat_Customers"),
        F.avg("Customer_Lifetime_Days").alias("Avg_Lifetime_Days"),
        largest.alias("Largest_Segment"))


def segment_counts(table: DataFrame, col: str = "Segment") -> DataFrame:
    """D-33 / G-15: customers per segment."""
    return table.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("customers"))


def clv(df: DataFrame, key: str = "CustomerName") -> DataFrame:
    """G-07: revenue, AOV, frequency, first/last purchase, lifespan, yearly
    frequency, CLV and three equal-width CLV segments.  The lifespan factors
    cancel, so CLV equals total revenue up to rounding."""
    g = _keyed(df, [key]).groupBy(key).agg(
        net_sale_sum().alias("total_revenue"), F.count("net_sale_vat").alias("purchase_frequency"),
        F.min("ReceivedAt").alias("first_purchase"), F.max("ReceivedAt").alias("last_purchase"))
    years = F.col("lifespan_days") / F.lit(365.0) + F.lit(1.0)
    t = (g.withColumn("avg_order_value", F.col("total_revenue") / dbl("purchase_frequency"))
          .withColumn("lifespan_days", F.coalesce(elapsed_days("first_purchase", "last_purchase"), F.lit(0)))
          .withColumn("purchase_frequency_yearly", dbl("purchase_frequency") / years)
          .withColumn("clv", F.col("avg_order_value") * F.col("purchase_frequency_yearly") * years))
    return with_equal_width_segment(t, "clv", CLV_LABELS, "clv_segment")


def with_equal_width_segment(t: DataFrame, value: str, labels: Sequence[str], out: str) -> DataFrame:
    """F-05 on a per-customer table: equal-width bins over [min, max].

    The bounds are a subquery over the same aggregate, whose exchange Spark runs once for both."""
    p = t.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))).scalar()
    b = equal_width_bin(value, p["lo"], p["hi"], len(labels))
    expr = None
    for i, lab in enumerate(labels):
        expr = F.when(b == i + 1, F.lit(lab)) if expr is None else expr.when(b == i + 1, F.lit(lab))
    return t.withColumn(out, expr)


def clv_summary(t: DataFrame) -> DataFrame:
    """G-08: averages, high-value count and share, low-value majority flag."""
    n = F.count(F.lit(1))
    high = F.count_if(F.col("clv_segment") == "High Value")
    low = F.count_if(F.col("clv_segment") == "Low Value")
    return t.agg(F.avg("clv").alias("avg_clv"), high.alias("high_value_customers"),
                 F.avg("avg_order_value").alias("avg_aov"), F.avg("purchase_frequency").alias("avg_frequency"),
                 (high / n * 100).alias("high_value_pct"), (low > n * 0.5).alias("low_value_majority"),
                 n.alias("customers"))


def clv_by_segment(t: DataFrame) -> DataFrame:
    """G-08: per CLV segment mean CLV, customers and revenue."""
    return t.where(F.col("clv_segment").isNotNull()).groupBy("clv_segment").agg(
        F.avg("clv").alias("avg_clv"), F.count(F.lit(1)).alias("customer_count"),
        F.sum("total_revenue").alias("total_revenue"))


def churn_features(df: DataFrame, key: str = "CustomerName", churn_days: int = CHURN_DAYS) -> DataFrame:
    """G-09: spend, AOV, orders, recency to the latest order overall, lifetime, churned flag."""
    now = ts_lit(fetch(df, t=F.max("ReceivedAt"))["t"])
    g = _keyed(df, [key]).groupBy(key).agg(
        net_sale_sum().alias("total_spent"), F.count("net_sale_vat").alias("purchase_count"),
        F.min("ReceivedAt").alias("first_purchase"), F.max("ReceivedAt").alias("last_purchase"))
    return (g.withColumn("avg_order_value", F.col("total_spent") / dbl("purchase_count"))
             .withColumn("recency", elapsed_days(F.col("last_purchase"), now))
             .withColumn("lifetime", F.coalesce(elapsed_days("first_purchase", "last_purchase"), F.lit(0)))
             .withColumn("is_churned", (F.col("recency") > churn_days).cast("int")))


def rfm_segment(code: str | Column = "RFM_Score") -> Column:
    """F-17 / U-02: first matching code set wins; otherwise 'Others'."""
    c = F.col(code) if isinstance(code, str) else code
    expr = None
    for name, codes in RFM_SEGMENTS:
        expr = F.when(c.isin(codes), F.lit(name)) if expr is None else expr.when(c.isin(codes), F.lit(name))
    return expr.otherwise(F.lit(OTHER_SEGMENT))


def rfm(df: DataFrame, key: str = "CustomerName") -> DataFrame:
    """G-13: recency / frequency / monetary, scores and segment.

    R: equal-width bins of recency, low recency scores 5.  F and M:
    equal-width bins of the first-occurrence rank (ties by the key, as the
    grouped frame is key-ordered), computed with the distributed global rank.
    """
    now = ts_lit(fetch(df, t=F.max("ReceivedAt"))["t"])
    g = _keyed(df, [key]).groupBy(key).agg(
        elapsed_days(F.max("ReceivedAt"), now).alias("Recency"),
        F.count(key).alias("Frequency"), net_sale_sum().alias("Monetary"))
    ranked = global_rank(g, ["Frequency", key], "F_Rank")
    ranked = global_rank(ranked, ["Monetary", key], "M_Rank")
    p = fetch(ranked, rlo=F.min("Recency"), rhi=F.max("Recency"), n=F.count(F.lit(1)))
    n = p["n"] or 0
    r_bin = equal_width_bin("Recency", lit(p["rlo"]).cast("double"), lit(p["rhi"]).cast("double"), 5)
    one, big = F.lit(1.0), F.lit(float(n))
    out = (ranked.withColumn("R_Score", (F.lit(6) - r_bin).cast("int"))
                 .withColumn("F_Score", equal_width_bin("F_Rank", one, big, 5).cast("int"))
                 .withColumn("M_Score", equal_width_bin("M_Rank", one, big, 5).cast("int")))
    out = out.withColumn("RFM_Score", F.concat(F.col("R_Score").cast("string"), F.col("F_Score").cast("string"),
                                               F.col("M_Score").cast("string")))
    return out.withColumn("Segment", rfm_segment("RFM_Score")).drop("F_Rank", "M_Rank")


def rfm_summary(t: DataFrame) -> DataFrame:
    """G-14: per segment mean recency, frequency, monetary, total monetary and customers."""
    return t.groupBy("Segment").agg(
        F.avg("Recency").alias("Avg_Recency"), F.avg("Frequency").alias("Avg_Frequency"),
        F.avg("Monetary").alias("Avg_Monetary"), F.sum("Monetary").alias("Total_Revenue"),
        F.count(F.lit(1)).alias("Customer_Count"))


def tier_metrics(df: DataFrame, key: str = "CustomerName", tier: str = "Customer_Value_Tier") -> DataFrame:
    """D-23: per value tier customers, orders, spend, AOV, discount, margin,
    repeat customers (more than one order within the tier) and repeat rate.
    Two-level aggregation: per (tier, customer), then per tier."""
    base = df.where(F.col(tier).isNotNull())
    per_cust = (base.where(F.col(key).isNotNull()).groupBy(tier, key)
                    .agg(F.count(F.lit(1)).alias("_n")))
    rep = per_cust.groupBy(tier).agg(F.count(F.lit(1)).alias("Total_Customers"),
                                     F.count_if(F.col("_n") > 1).alias("Repeat_Customers"))
    g = base.groupBy(tier).agg(
        F.count("OrderID").alias("Total_Orders"), net_sale_sum().alias("Total_Spent"),
        (net_sale_sum() / dbl(F.count("net_sale_vat"))).alias("Avg_Order_Value"),
        calc_discount_sum().alias("Total_Discount"),
        (dbl(F.sum("calc_discount_vat")) / F.lit(VAT_FACTOR) / dbl(F.count("calc_discount_vat")))
        .alias("Avg_Discount"),
        F.avg("Profit_Margin").alias("Profit_Margin"))
    j = g.join(rep, tier, "left")
    return j.withColumn("Repeat_Rate_Pct", F.col("Repeat_Customers") / dbl("Total_Customers") * 100)


def tier_actions(metrics: DataFrame) -> DataFrame:
    """D-25: action codes per tier (margin 10 / repeat 50 quadrant, AOV > 100,
    fewer than 20 customers, margin < 5)."""
    pm, rr = F.col("Profit_Margin"), F.col("Repeat_Rate_Pct")
    quadrant = (F.when((pm > 10) & (rr > 50), F.lit("upsell_loyalty"))
                 .when((pm > 10) & (rr <= 50), F.lit("reactivate"))
                 .when((pm <= 10) & (rr > 50), F.lit("raise_order_value"))
                 .when((pm <= 10) & (rr <= 50), F.lit("win_back")))
    return metrics.select(
        "Customer_Value_Tier", quadrant.alias("Action"),
        (F.col("Avg_Order_Value") > 100).alias("Promote_High_Ticket"),
        (F.col("Total_Customers") < 20).alias("Small_Segment"),
        (pm > 10).alias("Profitable_Segment"), (pm < 5).alias("Low_Margin_Segment"),
        (rr > 50).alias("High_Repeat_Segment"))


def tier_counts(df: DataFrame, tier: str = "Customer_Value_Tier") -> DataFrame:
    """D-24: order rows per tier (value counts) with the mode flagged."""
    g = df.where(F.col(tier).isNotNull()).groupBy(tier).agg(F.count(F.lit(1)).alias("orders"))
    top = fetch(g, t=F.min_by(tier, F.struct(-F.col("orders"), F.col(tier))))["t"]
    return g.withColumn("is_mode", F.col(tier) == F.lit(top))

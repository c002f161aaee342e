"""Discount performance (D-04..D-21, D-34, G-16, H-06, H-07).

Two generic grouped tables cover the per-brand / address / pair (``cm_breakdown``)
and per channel / date / address / brand (``deep_dive``) views; the range
tables list every range, empty ones included, by joining to the fixed label
table (a 5-row broadcast).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.exprs import bin_ordinal, dbl, fixed_bins, ratio
from tillpoint.operators.metrics import calc_discount_sum, net_sale_sum

# Discount range edges and labels.
RANGE_EDGES = [0, 10, 25, 50, 100, float("inf")]
RANGE_LABELS = ["1-10", "11-25", "26-50", "51-100", "100+"]
# Verdict thresholds of the scorecards.
GOOD_RATE_MAX, BAD_RATE_MIN = 35, 50
PROFITABLE_AVG_CM, MARGINAL_AVG_CM = 5, 2


def with_cm(df: DataFrame) -> DataFrame:
    """D-09: order CM = Profit_Margin if present, else Order_Profitability,
    else net − discount − delivery − VAT − surcharge (plan-time choice)."""
    if "Profit_Margin" in df.columns:
        return df.withColumn("CM", F.col("Profit_Margin"))
    if "Order_Profitability" in df.columns:
        return df.withColumn("CM", F.col("Order_Profitability"))
    return df.withColumn("CM", F.col("net_sale") - F.col("Calculated_Discount") - dbl("Delivery")
                         - dbl("VAT") - dbl("Surcharge"))


def discounted(df: DataFrame) -> DataFrame:
    """B-06 + D-09 + range: discounted orders with CM and Discount_Range."""
    d = with_cm(df.where(F.col("Calculated_Discount") > 0))
    return (d.withColumn("Discount_Range", fixed_bins("Calculated_Discount", RANGE_EDGES, RANGE_LABELS))
             .withColumn("Range_Order", bin_ordinal("Calculated_Discount", RANGE_EDGES)))


def cm_breakdown(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """D-04 / D-05 / D-06: orders, discount sum/mean, CM sum/mean, net sale."""
    keyed = df
    for d in dims:
        keyed = keyed.where(F.col(d).isNotNull())
    n = F.count("OrderID")
    return (keyed.groupBy(*dims)
                 .agg(n.alias("Orders"), calc_discount_sum().alias("Total_Discount"),
                      (calc_discount_sum() / dbl(F.count("calc_discount_vat"))).alias("Avg_Discount"),
                      F.sum("CM").alias("Total_CM"), F.avg("CM").alias("Avg_CM"),
                      net_sale_sum().alias("Total_Net_Sale")))


def range_labels(spark) -> DataFrame:
    return spark.createDataFrame([(lab, i + 1) for i, lab in enumerate(RANGE_LABELS)],
                                 "Discount_Range string, Range_Order int")


def _round_int(c: Column) -> Column:
    return F.coalesce(F.bround(c, 0), F.lit(0.0)).cast("long")


def range_table(disc: DataFrame) -> DataFrame:
    """D-07: per discount range (all five listed): net sum and mean, orders,
    mean discount, CM sum and mean — each rounded to an integer (NaN → 0)."""
    g = (disc.where(F.col("Discount_Range").isNotNull()).groupBy("Discount_Range")
             .agg(net_sale_sum().alias("_net"), F.count("net_sale_vat").alias("_n_net"),
                  F.count("OrderID").alias("_orders"),
                  calc_discount_sum().alias("_cd"), F.count("calc_discount_vat").alias("_n_cd"),
                  F.sum("CM").alias("_cm"), F.avg("CM").alias("_avg_cm")))
    labels = range_labels(disc.sparkSession)
    j = labels.join(g, "Discount_Range", "left")
    return j.select(
        "Discount_Range", "Range_Order",
        _round_int(F.col("_net")).alias("Total_Net_Sales"),
        _round_int(F.col("_net") / dbl("_n_net")).alias("Average_Order_Value"),
        F.coalesce(F.col("_orders"), F.lit(0)).cast("long").alias("Number_of_Orders"),
        _round_int(F.col("_cd") / dbl("_n_cd")).alias("Average_Discount_Amount"),
        _round_int(F.col("_cm")).alias("Total_CM"),
        _round_int(F.col("_avg_cm")).alias("Average_CM"))


def range_net_sale(disc: DataFrame) -> DataFrame:
    """D-08: net sale per discount range (every range; empty → 0)."""
    g = disc.where(F.col("Discount_Range").isNotNull()).groupBy("Discount_Range").agg(net_sale_sum().alias("_net"))
    labels = range_labels(disc.sparkSession)
    return labels.join(g, "Discount_Range", "left").select(
        "Discount_Range", "Range_Order", F.coalesce(F.col("_net"), F.lit(0.0)).alias("net_sale"))


def range_verdicts(table: DataFrame) -> DataFrame:
    """D-21: negative CM, marginal (avg < 2), profitable (avg > 5), in that order."""
    v = (F.when(F.col("Total_CM") < 0, F.lit("Negative"))
          .when(F.col("Average_CM") < MARGINAL_AVG_CM, F.lit("Marginal"))
          .when((F.col("Total_CM") > 0) & (F.col("Average_CM") > PROFITABLE_AVG_CM), F.lit("Profitable")))
    return table.select("Discount_Range", "Total_CM", "Average_CM", v.alias("Verdict"))


def pair_verdicts(pairs: DataFrame, n: int = 10) -> DataFrame:
    """D-20: brand@location with discount: CM < 0 negative; CM > 0 and
    mean CM > 5 profitable; the first n of each by total discount."""
    v = (F.when(F.col("Total_CM") < 0, F.lit("Negative"))
          .when((F.col("Total_CM") > 0) & (F.col("Avg_CM") > PROFITABLE_AVG_CM), F.lit("Profitable")))
    flagged = (pairs.where(F.col("Total_Discount") > 0).withColumn("Verdict", v)
                    .where(F.col("Verdict").isNotNull()))
    neg = flagged.where(F.col("Verdict") == "Negative").orderBy(
        F.col("Total_Discount").desc(), "Brand", "Address").limit(n)
    pos = flagged.where(F.col("Verdict") == "Profitable").orderBy(
        F.col("Total_Discount").desc(), "Brand", "Address").limit(n)
    return pos.unionByName(neg).select(
        F.concat_ws(" @ ", "Brand", "Address").alias("Pair"), "Brand", "Address", "Total_CM", "Verdict")


def deep_dive(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """D-11..D-15: discount sum/mean, orders and net sale per dims, with the
    discount rate as % of sales (0 when there are no sales)."""
    keyed = df
    for d in dims:
        keyed = keyed.where(F.col(d).isNotNull())
    g = keyed.groupBy(*dims).agg(
        calc_discount_sum().alias("Total_Discount"),
        (calc_discount_sum() / dbl(F.count("calc_discount_vat"))).alias("Avg_Discount"),
        F.count("OrderID").alias("Orders"), net_sale_sum().alias("Total_Sales"))
    return g.withColumn("Discount_Rate_Pct", ratio("Total_Discount", "Total_Sales", 100.0))


def top_by_discount(t: DataFrame, dims: Sequence[str], n: int) -> DataFrame:
    """H-07: the first ``n`` rows by total discount (ties by the dimensions)."""
    return t.orderBy(F.col("Total_Discount").desc(), *dims).limit(n)


def code_effectiveness(df: DataFrame) -> DataFrame:
    """D-16: uses, discount sum and mean per discount code."""
    g = df.where(F.col("DiscountCode").isNotNull()).groupBy("DiscountCode").agg(
        F.count("OrderID").alias("Uses"), calc_discount_sum().alias("Total_Discount"),
        (calc_discount_sum() / dbl(F.count("calc_discount_vat"))).alias("Avg_Discount"))
    return g


def fine_ranges(df: DataFrame) -> DataFrame:
    """D-17: orders, discount sum/mean and mean discount % per range over all
    orders (every range listed; the rate falls back to the mean discount when
    the frame has no Discount_Percentage)."""
    d = df.withColumn("Discount_Range", fixed_bins("Calculated_Discount", RANGE_EDGES, RANGE_LABELS))
    rate = "Discount_Percentage" if "Discount_Percentage" in df.columns else "Calculated_Discount"
    g = d.where(F.col("Discount_Range").isNotNull()).groupBy("Discount_Range").agg(
        F.count("OrderID").alias("_orders"), calc_discount_sum().alias("Total_Discount"),
        (calc_discount_sum() / dbl(F.count("calc_discount_vat"))).alias("Avg_Discount"),
        F.avg(rate).alias("Avg_Discount_Rate"))
    labels = range_labels(df.sparkSession)
    return labels.join(g, "Discount_Range", "left").select(
        "Discount_Range", "Range_Order", F.coalesce(F.col("_orders"), F.lit(0)).cast("long").alias("Orders"),
        "Total_Discount", "Avg_Discount", "Avg_Discount_Rate")


def scorecard(df: DataFrame) -> DataFrame:
    """D-18: Location × Brand orders, discount, sales, rate = disc / (sales + disc), profit."""
    keyed = df.where(F.col("Location").isNotNull() & F.col("Brand").isNotNull())
    g = keyed.groupBy("Location", "Brand").agg(
        F.count("OrderID").alias("Total_Orders"), calc_discount_sum().alias("Total_Discount"),
        (calc_discount_sum() / dbl(F.count("calc_discount_vat"))).alias("Avg_Discount"),
        net_sale_sum().alias("Total_Sales"), (net_sale_sum() / dbl(F.count("net_sale_vat"))).alias("Avg_Sale"))
    rate = F.when(F.col("Total_Sales") + F.col("Total_Discount") != 0,
                  F.col("Total_Discount") / (F.col("Total_Sales") + F.col("Total_Discount")) * 100)
    return (g.withColumn("Discount_Rate_Pct", rate)
             .withColumn("Profit", F.col("Total_Sales") - F.col("Total_Discount")))


def scorecard_verdicts(card: DataFrame, n: int = 10) -> DataFrame:
    """D-19: performing well (profit > 0, rate < 35, sales > 0) top n by
    profit; hurt by discounts (profit < 0 or rate > 50) bottom n by profit."""
    good = (card.where((F.col("Profit") > 0) & (F.col("Discount_Rate_Pct") < GOOD_RATE_MAX)
                       & (F.col("Total_Sales") > 0))
                .orderBy(F.col("Profit").desc(), "Location", "Brand").limit(n)
                .withColumn("Verdict", F.lit("Good")))
    bad = (card.where((F.col("Profit") < 0) | (F.col("Discount_Rate_Pct") > BAD_RATE_MIN))
               .orderBy(F.col("Profit").asc(), "Location", "Brand").limit(n)
               .withColumn("Verdict", F.lit("Bad")))
    return good.unionByName(bad)


def deepest_discounts(df: DataFrame, n: int = 10) -> DataFrame:
    """H-06: the ``n`` orders with the largest calculated discount."""
    cols = [c for c in ["OrderID", "CustomerName", "Channel", "Address", "Date", "GrossPrice",
                        "Calculated_Discount", "DiscountCode"] if c in df.columns]
    return (df.orderBy(F.col("Calculated_Discount").desc(), "OrderID").limit(n)
              .select(*cols).withColumn("GrossPrice", dbl("GrossPrice")))


def insights(df: DataFrame) -> DataFrame:
    """G-16: top channel / address / brand by total discount with its rate,
    the code with the largest total discount and its uses, and the largest
    single discount — as (Insight, Item, Value) rows.

    One scan: the four groupings and the grand total are grouping sets of one
    aggregate, of which each insight keeps its first row."""
    dims = {"Channel": "top_channel", "Address": "top_address", "Brand": "top_brand", "DiscountCode": "top_code"}
    keys = [F.col(d) for d in dims]
    g = df.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        calc_discount_sum().alias("cd"), net_sale_sum().alias("net"), F.count("OrderID").alias("n"), F.max("Calculated_Discount").alias("most"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    which = F.lit("max_discount")
    for d, name in dims.items():
        which = F.when(F.col(f"_g_{d}") == 0, F.lit(name)).otherwise(which)
    item = F.coalesce(*[F.col(d).cast("string") for d in dims])
    value = (F.when(F.col("Insight") == "max_discount", F.col("most")).when(F.col("Insight") == "top_code", dbl("n"))
              .otherwise(ratio("cd", "net", 100.0)))
    g = g.withColumn("Insight", which).withColumn("Item", item).withColumn("Value", value)
    # Groups of a null value are no items.
    g = g.where((F.col("Insight") == "max_discount") | F.col("Item").isNotNull())
    first = F.min_by(F.struct("Item", "Value"), F.struct(-F.coalesce("cd", F.lit(float("-inf"))), F.col("Item")))
    return g.groupBy("Insight").agg(first.alias("f")).select("Insight", "f.Item", "f.Value")

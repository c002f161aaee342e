"""Derived order columns (B-01 essential, B-02 extended, C-01/E-01 customer stats).

Money stays exact: ``net_sale_vat`` and ``calc_discount_vat`` are the
VAT-inclusive DECIMAL amounts behind ``net_sale`` and ``Calculated_Discount``;
aggregates sum those and divide by 1.05 once (see ``metrics``).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.functions import discounts as dg
from tillpoint.functions.exprs import VAT_FACTOR, bin_ordinal, day_name, dbl, fixed_bins, ratio
from tillpoint.operators.ranking import exact_quantile

NET_VAT_TYPE = T.DecimalType(20, 4)
DISC_VAT_TYPE = T.DecimalType(20, 5)

# Bin edges and labels of the dashboard's ordered categories.
ORDER_SIZE_EDGES = [0, 25, 75, 150, float("inf")]
ORDER_SIZE_LABELS = ["Small", "Medium", "Large", "XLarge"]
DISCOUNT_CAT_EDGES = [0, 1, 10, 25, float("inf")]
DISCOUNT_CAT_LABELS = ["No Discount", "Low", "Medium", "High"]
TIME_PERIOD_EDGES = [0, 6, 12, 18, 24]
TIME_PERIOD_LABELS = ["Night", "Morning", "Afternoon", "Evening"]
VALUE_TIER_EDGES = [0, 100, 500, 1000, float("inf")]
VALUE_TIER_LABELS = ["Bronze", "Silver", "Gold", "Platinum"]
WEEKEND_DAYS = ["Saturday", "Sunday"]
HIGH_VALUE_QUANTILE = 0.8
PREMIUM_MIN_ORDERS = 5


def _half_rule(half_rule: tuple[str, str]) -> Column:
    return (F.col("Channel") == F.lit(half_rule[0])) & (F.col("Brand") == F.lit(half_rule[1]))


def money_rules(df: DataFrame, half_rule: tuple[str, str] = dg.HALF_RULE) -> DataFrame:
    """net sale and calculated discount from gross, discount and the group."""
    staff = F.coalesce(F.col("Discount_Group") == F.lit(dg.STAFF_GROUP), F.lit(False))
    half = F.coalesce(_half_rule(half_rule), F.lit(False))
    g, d = F.col("GrossPrice"), F.col("Discount")
    net_vat = F.when(staff, g - d).otherwise(g).cast(NET_VAT_TYPE)
    cd_vat = (F.when(staff, F.lit(0))
               .when(half, d * F.lit(Decimal("0.5")))
               .otherwise(d)).cast(DISC_VAT_TYPE)
    return (df.withColumn("net_sale_vat", net_vat)
              .withColumn("calc_discount_vat", cd_vat)
              .withColumn("net_sale", dbl("net_sale_vat") / F.lit(VAT_FACTOR))
              .withColumn("Calculated_Discount", dbl("calc_discount_vat") / F.lit(VAT_FACTOR)))


def with_time_parts(df: DataFrame, ts: str = "ReceivedAt") -> DataFrame:
    """F-07: Date, Hour, Minute, DayOfWeek from the wall-clock timestamp."""
    out = df
    if "Date" not in df.columns:
        out = out.withColumn("Date", F.to_date(ts))
    return (out.withColumn("Hour", F.hour(ts))
               .withColumn("Minute", F.minute(ts))
               .withColumn("DayOfWeek", day_name(ts)))


def with_essential_columns(orders: DataFrame,
                           half_rule: tuple[str, str] = dg.HALF_RULE,
                           groups_path: str = dg.DATA_FILE) -> DataFrame:
    """B-01: the column set every dashboard view starts from."""
    df = orders
    if "DiscountCode" in df.columns:
        df = dg.with_discount_group(df, path=groups_path)
    else:
        df = df.withColumn("Discount_Group", F.lit(None).cast("string"))
    return essential_columns(df, half_rule)


def essential_columns(grouped: DataFrame, half_rule: tuple[str, str] = dg.HALF_RULE) -> DataFrame:
    """B-01 of orders that have their ``Discount_Group``: projections alone, so rows stay in order."""
    df = money_rules(grouped, half_rule)
    df = with_time_parts(df)
    return (df
            .withColumn("Profit_Margin", ratio(F.col("net_sale") - dbl("Discount"), "GrossPrice", 100.0))
            .withColumn("Discount_Percentage", ratio("Discount", "GrossPrice", 100.0))
            .withColumn("Order_Size_Category", fixed_bins("net_sale", ORDER_SIZE_EDGES, ORDER_SIZE_LABELS)))


def customer_stats(df: DataFrame, key: str = "CustomerName") -> DataFrame:
    """C-01: count / sum / mean of net sale per customer (null key dropped).

    Partial aggregation collapses a hot customer before the shuffle.
    """
    return (df.where(F.col(key).isNotNull())
              .groupBy(key)
              .agg(F.count("net_sale_vat").alias("Customer_Order_Count"),
                   F.sum("net_sale_vat").alias("_cs_sum"))
              .select(key, F.col("Customer_Order_Count").cast("long").alias("Customer_Order_Count"),
                      (dbl("_cs_sum") / F.lit(VAT_FACTOR)).alias("Customer_Total_Spent"),
                      (dbl("_cs_sum") / F.lit(VAT_FACTOR) / F.col("Customer_Order_Count"))
                      .alias("Customer_Avg_Order")))


def with_customer_stats(df: DataFrame, key: str = "CustomerName") -> DataFrame:
    """C-01 / E-01: per-customer totals on every order.

    Aggregate-then-join rather than a window: a window partitioned by the
    customer would put a hot name (walk-ins) into one task; the join lets AQE
    split the skewed side or broadcast a small stats table.
    """
    return df.join(customer_stats(df, key), key, "left")


def with_extended_columns(orders: DataFrame,
                          half_rule: tuple[str, str] = dg.HALF_RULE,
                          customer_key: str = "CustomerName") -> DataFrame:
    """B-02: the extended column set, with the discount defined before use."""
    df = orders
    if "DiscountCode" in df.columns:
        df = df.withColumn("Discount_Group", dg.prefix_group("DiscountCode"))
    else:
        df = df.withColumn("Discount_Group", F.lit(None).cast("string"))
    df = money_rules(df, half_rule)
    df = with_time_parts(df)
    net, cd = F.col("net_sale"), F.col("Calculated_Discount")
    fees = dbl(F.col("Delivery") + F.col("Surcharge") + F.col("VAT"))
    df = (df
          .withColumn("Profit_Margin", ratio(net - cd, "GrossPrice", 100.0))
          .withColumn("Discount_Percentage", ratio(cd, "GrossPrice", 100.0))
          .withColumn("Revenue_After_Delivery", net - dbl("Delivery"))
          .withColumn("Total_Fees", fees)
          .withColumn("Order_Profitability", net - cd - F.col("Total_Fees"))
          .withColumn("Order_Size_Category", fixed_bins(net, ORDER_SIZE_EDGES, ORDER_SIZE_LABELS))
          .withColumn("Discount_Category", fixed_bins(dbl("Discount"), DISCOUNT_CAT_EDGES,
                                                      DISCOUNT_CAT_LABELS))
          .withColumn("Is_Weekend", F.col("DayOfWeek").isin(WEEKEND_DAYS))
          .withColumn("Time_Period", fixed_bins("Hour", TIME_PERIOD_EDGES, TIME_PERIOD_LABELS,
                                                include_lowest=True)))
    # A scalar subquery: it runs with the query, and only if the column is used.
    q80 = exact_quantile(df, "net_sale", HIGH_VALUE_QUANTILE, "q").scalar()
    if customer_key in df.columns:
        df = with_customer_stats(df, customer_key)
        df = df.withColumn("Customer_Value_Tier",
                           fixed_bins("Customer_Total_Spent", VALUE_TIER_EDGES, VALUE_TIER_LABELS))
    item = dbl("ItemPrice")
    df = (df
          .withColumn("Revenue_Per_Item", net / F.when(item == 0, F.lit(1.0)).otherwise(item))
          .withColumn("Tip_Percentage", ratio("Tips", net, 100.0))
          .withColumn("High_Value_Order", F.coalesce(net > q80, F.lit(False)))
          .withColumn("Discounted_Order", dbl("Discount") > 0)
          .withColumn("Premium_Customer",
                      F.coalesce(F.col("Customer_Order_Count") > PREMIUM_MIN_ORDERS, F.lit(False))
                      if "Customer_Order_Count" in df.columns else F.lit(False)))
    return df

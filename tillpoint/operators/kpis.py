"""KPI sets, breakdowns and period comparisons (D-01, D-02, D-10, D-22, D-27, D-32, D-35, G-17, H-02)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.exprs import VAT_FACTOR, dbl
from tillpoint.operators.params import date_lit, fetch
from tillpoint.operators.ranking import exact_quantile
from tillpoint.operators.sync import end_days, on_dates


def _round_int(c: Column) -> Column:
    """Python ``round`` (half to even) to a whole number; 0 for a missing value."""
    return F.coalesce(F.bround(c, 0), F.lit(0.0)).cast("long")


def kpis(df: DataFrame) -> DataFrame:
    """D-01: orders, revenue, AOV, distinct customers, discount, discount rate
    (of gross), average delivery fee and tips, each rounded to an integer.
    Fully discounted orders are expected to be removed already (B-05)."""
    net = dbl(F.sum("net_sale_vat")) / F.lit(VAT_FACTOR)
    cd = dbl(F.sum("calc_discount_vat")) / F.lit(VAT_FACTOR)
    gross = dbl(F.sum("GrossPrice"))
    n = F.count(F.lit(1))
    return df.agg(
        n.cast("long").alias("total_orders"),
        _round_int(net).alias("total_revenue"),
        _round_int(net / dbl(F.count("net_sale_vat"))).alias("avg_order_value"),
        F.countDistinct("CustomerName").cast("long").alias("total_customers"),
        _round_int(cd).alias("total_discount"),
        F.when(gross > 0, _round_int(cd / gross * 100)).otherwise(F.lit(0)).cast("long").alias("discount_rate"),
        _round_int(dbl(F.sum("Delivery")) / dbl(F.count("Delivery"))).alias("avg_delivery_fee"),
        _round_int(dbl(F.sum("Tips"))).alias("total_tips"))


def sales_by(df: DataFrame, dim: str) -> DataFrame:
    """D-10: net sale per value of ``dim`` (null values dropped)."""
    return (df.where(F.col(dim).isNotNull()).groupBy(dim)
              .agg((dbl(F.sum("net_sale_vat")) / F.lit(VAT_FACTOR)).alias("net_sale")))


def top_by_sales(df: DataFrame, dim: str, n: int = 10) -> DataFrame:
    """H-02: the ``n`` values of ``dim`` with the largest net sale (ties by name)."""
    return sales_by(df, dim).orderBy(F.col("net_sale").desc(), F.col(dim)).limit(n)


# The sandbox's metric menu (column, label); Profit_Margin is averaged.
SANDBOX_METRICS = [("net_sale", "Net Sales"), ("OrderID", "Orders"),
                   ("Calculated_Discount", "Discount"), ("CM", "Contribution Margin"),
                   ("Profit_Margin", "Profit Margin")]


def free_summary(df: DataFrame, dims: Sequence[str], metrics: Sequence[str],
                 top_n: int = 20, descending: bool = True) -> DataFrame:
    """D-22: sum of the chosen metrics per combination of 1–3 dimensions
    (mean for Profit_Margin; Orders is a count), sorted by the first metric,
    top N.  Ties are broken by the dimensions.  Metrics and dimensions that the
    frame lacks are not offered: they are left out, as the menu leaves them out."""
    dims = [d for d in dims if d in df.columns]
    base = {"net_sale": "net_sale_vat", "Calculated_Discount": "calc_discount_vat"}
    metrics = [m for m in metrics if base.get(m, m) in df.columns]
    if not dims or not metrics:
        raise ValueError("choose at least one dimension and one metric that the orders have")
    keyed = df
    for d in dims:
        keyed = keyed.where(F.col(d).isNotNull())
    aggs = []
    for m in metrics:
        if m == "OrderID":
            aggs.append(F.count("OrderID").cast("double").alias("OrderID"))
        elif m == "Profit_Margin":
            aggs.append(F.avg("Profit_Margin").alias("Profit_Margin"))
        elif m == "net_sale":
            aggs.append((dbl(F.sum("net_sale_vat")) / F.lit(VAT_FACTOR)).alias("net_sale"))
        elif m == "Calculated_Discount":
            aggs.append((dbl(F.sum("calc_discount_vat")) / F.lit(VAT_FACTOR)).alias("Calculated_Discount"))
        else:
            aggs.append(dbl(F.sum(m)).alias(m))
    first = F.col(metrics[0])
    order = [first.desc() if descending else first.asc()] + [F.col(d) for d in dims]
    return keyed.groupBy(*dims).agg(*aggs).orderBy(*order).limit(top_n)


def period_comparison(df: DataFrame, first_date=None, second_date=None) -> DataFrame:
    """D-27 + G-17: summed metrics on two chosen dates (default: the two
    earliest dates), the difference second − first, and direction words."""
    if first_date is None or second_date is None:
        days = end_days(df, 2, latest=False)
        first_date, second_date = (days + [None, None])[:2]
    d1, d2 = date_lit(first_date), date_lit(second_date)
    day = F.col("Date")

    def on(d, c):
        return F.sum(F.when(day == d, c))
    agg = on_dates(df, [d1, d2]).agg(
        (dbl(on(d1, F.col("net_sale_vat"))) / F.lit(VAT_FACTOR)).alias("f_net"),
        (dbl(on(d2, F.col("net_sale_vat"))) / F.lit(VAT_FACTOR)).alias("s_net"),
        F.count(F.when(day == d1, F.col("OrderID"))).cast("double").alias("f_orders"),
        F.count(F.when(day == d2, F.col("OrderID"))).cast("double").alias("s_orders"),
        (dbl(on(d1, F.col("calc_discount_vat"))) / F.lit(VAT_FACTOR)).alias("f_cd"),
        (dbl(on(d2, F.col("calc_discount_vat"))) / F.lit(VAT_FACTOR)).alias("s_cd"),
        on(d1, F.col("Profit_Margin")).alias("f_pm"),
        on(d2, F.col("Profit_Margin")).alias("s_pm"))
    z = F.lit(0.0)
    cols = {}
    for m, tag in (("net_sale", "net"), ("OrderID", "orders"), ("Calculated_Discount", "cd"),
                   ("Profit_Margin", "pm")):
        f, s = F.coalesce(F.col(f"f_{tag}"), z), F.coalesce(F.col(f"s_{tag}"), z)
        cols[m] = (f, s)
    stack = agg.select(d1.alias("First_Date"), d2.alias("Second_Date"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("Metric"), f.alias("First"), s.alias("Second"), (s - f).alias("Difference"))
        for m, (f, s) in cols.items()])).alias("r")).select("First_Date", "Second_Date", "r.*")
    diff = F.col("Difference")
    insight = (F.when((F.col("Metric") == "net_sale") & (diff > 0), F.lit("Net sales increased"))
                .when(F.col("Metric") == "net_sale", F.lit("Net sales decreased"))
                .when((F.col("Metric") == "Profit_Margin") & (diff < 0), F.lit("Profit margin dropped"))
                .when((F.col("Metric") == "Calculated_Discount") & (diff > 0), F.lit("Discount outlay increased")))
    return stack.withColumn("Insight", insight)


def freshness(df: DataFrame) -> DataFrame:
    """D-32 / A-03 / A-04: latest and earliest order time and row count."""
    return df.agg(F.max("ReceivedAt").alias("latest_received"),
                  F.min("ReceivedAt").alias("earliest_received"),
                  F.count(F.lit(1)).alias("total_records"))


def high_value_threshold(df: DataFrame, p: float = 0.8) -> DataFrame:
    """D-35: exact 80th percentile of net sale (distributed, no single buffer)."""
    return exact_quantile(df, "net_sale", p, "net_sale_p80")


def largest_discount(df: DataFrame) -> DataFrame:
    """D-34."""
    return df.agg(F.max("Calculated_Discount").alias("max_discount"))


def hundred_percent_count(df: DataFrame) -> DataFrame:
    """B-15: orders whose discount is at least the gross price."""
    return df.agg(F.count_if(F.col("Discount_Percentage") >= 100).cast("long").alias("orders_100pct"))


def distinct_values(df: DataFrame, dim: str) -> DataFrame:
    """B-12: sorted distinct non-null values of a dimension."""
    return df.select(dim).where(F.col(dim).isNotNull()).distinct().orderBy(dim)


def membership(df: DataFrame, channels: Sequence[str] = (), brands: Sequence[str] = ()) -> DataFrame:
    """B-04: channel / brand filters; an empty selection means no filter."""
    out = df
    if channels:
        out = out.where(F.col("Channel").isin(list(channels)))
    if brands:
        out = out.where(F.col("Brand").isin(list(brands)))
    return out

"""Daily cells: sums by day and dimension that add up, and customers as bitmaps (D-01..D-18 over any range of days).

``cells`` reduces the orders of a day to one row for each value of each
dimension set in ``CUBES``, in a single pass (grouping sets).  Every measure is
an exact sum or a count, so the rows of any days add up to the range's totals.
The views below read cells of a range and no orders.

Distinct customers do not add up.  ``customer_bitmaps`` keeps, by day, Brand,
Channel and bucket of 64 customer numbers, which of them ordered; or-ing the
bits of any of these rows counts each customer once, exactly.  A bucket is one
number, so a day on which few customers of many ordered has as few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.exprs import VAT_FACTOR, dbl, fixed_bins, ratio
from tillpoint.operators.discount_perf import RANGE_EDGES, RANGE_LABELS, range_labels
from tillpoint.operators.ranking import global_rank

DIMENSIONS = ["Brand", "Channel", "Address", "Location", "PaymentMethod", "DiscountCode", "Discount_Range"]
#: The dimension sets that the views ask for; the first is the day itself.
CUBES = [(), ("Brand",), ("Channel",), ("Address",), ("PaymentMethod",), ("DiscountCode",), ("Discount_Range",),
         ("Brand", "Address"), ("Brand", "Channel"), ("Brand", "Location")]
CUSTOMER_DIMENSIONS = ["Brand", "Channel"]


def cube_name(dims: Sequence[str]) -> str:
    return "+".join(d for d in DIMENSIONS if d in dims) or "day"


def _measures() -> list[Column]:
    off = F.col("Calculated_Discount") > 0
    sums = {"net": "net_sale_vat", "cd": "calc_discount_vat", "gross": "GrossPrice", "delivery": "Delivery", "tips": "Tips"}
    out = [F.count(F.lit(1)).alias("rows"), F.count("OrderID").alias("orders"), F.count(F.when(off, F.col("OrderID"))).alias("off_orders")]
    for name, c in sums.items():
        out += [F.sum(c).cast("decimal(38,5)").alias(name), F.count(c).alias(f"n_{name}")]
    for name, c in (("net", "net_sale_vat"), ("cd", "calc_discount_vat")):
        out += [F.sum(F.when(off, F.col(c))).cast("decimal(38,5)").alias(f"off_{name}"), F.count(F.when(off, F.col(c))).alias(f"n_off_{name}")]
    # Margins and rates are ratios of orders: their sums are doubles.
    for name, c in (("cm", F.when(off, F.col("Profit_Margin"))), ("rate", F.col("Discount_Percentage"))):
        out += [F.sum(c).alias(name), F.count(c).alias(f"n_{name}")]
    return out


def cells(orders: DataFrame) -> DataFrame:
    """``Date, cube, <dimensions>, <sums and counts>`` of enriched orders (fully discounted ones removed by the caller)."""
    rows = orders.withColumn("Discount_Range", fixed_bins("Calculated_Discount", RANGE_EDGES, RANGE_LABELS))
    keys = ["Date", *DIMENSIONS]
    sets = [[F.col("Date"), *[F.col(d) for d in dims]] for dims in CUBES]
    got = rows.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_set"), *_measures())
    # A key that is not in a set counts a bit, the first key the highest.
    number = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k != "Date" and k not in dims): cube_name(dims) for dims in CUBES}
    names = F.create_map(*[F.lit(x) for n, name in number.items() for x in (n, name)])
    return got.withColumn("cube", names[F.col("_set").cast("int")]).drop("_set")


def _days(table: DataFrame, dims: Sequence[str], start, end) -> DataFrame:
    out = table
    if start is not None:
        first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
        out = out.where(F.col("Date").between(first, last))
        if "Month" in table.columns:
            out = out.where(F.col("Month").between(F.date_format(first, "yyyy-MM"), F.date_format(last, "yyyy-MM")))
    for d in dims:
        out = out.where(F.col(d).isNotNull())
    return out


def _range(table: DataFrame, dims: Sequence[str], start, end) -> DataFrame:
    name = cube_name(dims)
    if name not in {cube_name(c) for c in CUBES} or not set(dims) <= set(DIMENSIONS):
        raise ValueError(f"no daily cells by {list(dims)}")
    return _days(table.where(F.col("cube") == name), dims, start, end)


def _money(c: str) -> Column:
    return dbl(F.sum(c)) / F.lit(VAT_FACTOR)


def _mean(c: str) -> Column:
    return _money(c) / F.nullif(F.sum(f"n_{c}"), F.lit(0)).cast("double")


def _whole(c: Column) -> Column:
    return F.coalesce(F.bround(c, 0), F.lit(0.0)).cast("long")


def kpis(table: DataFrame, bitmaps: DataFrame, start=None, end=None) -> DataFrame:
    """D-01 over the days ``start`` to ``end`` (both; all days without)."""
    cd, gross = _money("cd"), dbl(F.sum("gross"))
    out = _range(table, (), start, end).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("total_orders"), _whole(_money("net")).alias("total_revenue"), _whole(_mean("net")).alias("avg_order_value"),
        _whole(cd).alias("total_discount"), F.when(gross > 0, _whole(cd / gross * 100)).otherwise(F.lit(0)).cast("long").alias("discount_rate"),
        _whole(dbl(F.sum("delivery")) / F.nullif(F.sum("n_delivery"), F.lit(0)).cast("double")).alias("avg_delivery_fee"), _whole(dbl(F.sum("tips"))).alias("total_tips"))
    return out.crossJoin(distinct_customers(bitmaps, (), start, end))  # one row each


def daily_series(table: DataFrame) -> DataFrame:
    """D-02: net sale, orders and discount of each day."""
    return _range(table, (), None, None).where(F.col("Date").isNotNull()).groupBy("Date").agg(_money("net").alias("net_sale"), F.sum("orders").alias("orders"), _money("cd").alias("discount"))


def sales_by(table: DataFrame, dim: str, start=None, end=None) -> DataFrame:
    """D-10 over a range."""
    return _range(table, [dim], start, end).groupBy(dim).agg(_money("net").alias("net_sale"))


def cm_breakdown(table: DataFrame, dims: Sequence[str], start=None, end=None) -> DataFrame:
    """D-04 / D-05 / D-06 over a range: discounted orders."""
    found = _range(table, dims, start, end).groupBy(*dims).agg(
        F.sum("off_orders").alias("Orders"), _money("off_cd").alias("Total_Discount"), _mean("off_cd").alias("Avg_Discount"),
        F.sum("cm").alias("Total_CM"), (F.sum("cm") / F.nullif(F.sum("n_cm"), F.lit(0)).cast("double")).alias("Avg_CM"), _money("off_net").alias("Total_Net_Sale"), F.sum("n_off_cd").alias("_n"))
    return found.where("_n > 0").drop("_n")


def deep_dive(table: DataFrame, dims: Sequence[str], start=None, end=None) -> DataFrame:
    """D-11..D-15 over a range."""
    dated = list(dims) == ["Date"]
    rows = _range(table, [] if dated else dims, start, end)
    rows = rows.where(F.col("Date").isNotNull()) if dated else rows
    g = rows.groupBy(*dims).agg(_money("cd").alias("Total_Discount"), _mean("cd").alias("Avg_Discount"), F.sum("orders").alias("Orders"), _money("net").alias("Total_Sales"))
    return g.withColumn("Discount_Rate_Pct", ratio("Total_Discount", "Total_Sales", 100.0))


def code_effectiveness(table: DataFrame, start=None, end=None) -> DataFrame:
    """D-16 over a range."""
    return _range(table, ["DiscountCode"], start, end).groupBy("DiscountCode").agg(F.sum("orders").alias("Uses"), _money("cd").alias("Total_Discount"), _mean("cd").alias("Avg_Discount"))


def range_table(table: DataFrame, start=None, end=None) -> DataFrame:
    """D-07 over a range: every discount range is listed."""
    g = _range(table, ["Discount_Range"], start, end).groupBy("Discount_Range").agg(
        _money("off_net").alias("_net"), _mean("off_net").alias("_avg"), F.sum("off_orders").alias("_orders"), _mean("off_cd").alias("_cd"), F.sum("cm").alias("_cm"),
        (F.sum("cm") / F.nullif(F.sum("n_cm"), F.lit(0)).cast("double")).alias("_avg_cm"))
    return range_labels(table.sparkSession).join(g, "Discount_Range", "left").select(
        "Discount_Range", "Range_Order", _whole(F.col("_net")).alias("Total_Net_Sales"), _whole(F.col("_avg")).alias("Average_Order_Value"),
        F.coalesce("_orders", F.lit(0)).cast("long").alias("Number_of_Orders"), _whole(F.col("_cd")).alias("Average_Discount_Amount"),
        _whole(F.col("_cm")).alias("Total_CM"), _whole(F.col("_avg_cm")).alias("Average_CM"))


def scorecard(table: DataFrame, start=None, end=None) -> DataFrame:
    """D-18 over a range."""
    g = _range(table, ["Brand", "Location"], start, end).groupBy("Location", "Brand").agg(
        F.sum("orders").alias("Total_Orders"), _money("cd").alias("Total_Discount"), _mean("cd").alias("Avg_Discount"), _money("net").alias("Total_Sales"), _mean("net").alias("Avg_Sale"))
    both = F.col("Total_Sales") + F.col("Total_Discount")
    return g.withColumn("Discount_Rate_Pct", F.when(both != 0, F.col("Total_Discount") / both * 100)).withColumn("Profit", F.col("Total_Sales") - F.col("Total_Discount"))


# Customers -------------------------------------------------------------------
def customer_numbers(orders: DataFrame, known: DataFrame | None = None, key: str = "CustomerName") -> DataFrame:
    """``(<key>, number)``: a dense number for each customer; those in ``known`` keep theirs, new ones follow."""
    names = orders.select(key).where(F.col(key).isNotNull()).distinct()
    if known is None:
        return global_rank(names, [key], "number").withColumn("number", F.col("number") - 1)
    top = known.agg(F.coalesce(F.max("number"), F.lit(-1)).alias("m")).first()["m"]
    new = names.join(known, key, "left_anti")
    return known.unionByName(global_rank(new, [key], "number").withColumn("number", F.col("number") + F.lit(top)))


def customer_bitmaps(orders: DataFrame, numbers: DataFrame, key: str = "CustomerName") -> DataFrame:
    """``Date, Brand, Channel, bucket, bits``: which customers of a bucket of 64 ordered that day.

    A customer's further orders of the day set the same bit, so no distinct rows are needed first."""
    rows = orders.select("Date", *CUSTOMER_DIMENSIONS, key).join(numbers, key)
    bit = F.expr("shiftleft(1L, cast(number & 63 as int))")
    return rows.groupBy("Date", *CUSTOMER_DIMENSIONS, F.shiftright("number", 6).alias("bucket")).agg(F.bit_or(bit).alias("bits"))


def distinct_customers(bitmaps: DataFrame, dims: Sequence[str] = (), start=None, end=None) -> DataFrame:
    """``total_customers`` of a range of days, by ``dims`` (none, Brand, Channel or both): days are or-ed by bucket, then bits are counted."""
    if not set(dims) <= set(CUSTOMER_DIMENSIONS):
        raise ValueError(f"no customer bitmaps by {cube_name(dims)}")
    buckets = _days(bitmaps, dims, start, end).groupBy(*dims, "bucket").agg(F.bit_or("bits").alias("bits"))
    total = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("total_customers")
    return buckets.groupBy(*dims).agg(total) if dims else buckets.agg(total)

"""Canonical order table built from the driver's star schema.

One row per order with the order-table column names of the sales system.
The money columns stay DECIMAL(18,4): line sums are exact, so every later
total equals the sum of its parts and matches a SQL engine bit for bit.

Scale notes
-----------
* lineitem is aggregated per order first (partial aggregation map-side, money
  as whole numbers of its smallest unit and the first line as one number, so
  the aggregation hashes and never sorts lines).
* Orders and their names are joined while rows are narrow: ``joined_orders``
  has the dozen columns that come from the tables, ``order_columns`` makes all
  others of them.  A writer shuffles and sorts the former and widens last.
* customer, lines and part grow with the data, so they are plain equi-joins;
  Spark broadcasts them only when its measured size is under the configured
  threshold, otherwise sort-merge.  The customer comes first, when a row is
  smallest.
* nation has a fixed 25 rows (a TPC-H invariant), so it is broadcast.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.sources.tables import read_table

MONEY = T.DecimalType(18, 4)

# Fixed values of the test-data mapping: order key modulo 97
# picks the discount code; code 0 is a staff meal that discounts the whole bill.
CODE_MODULUS = 97
STAFF_CODE = "100% Staff Meal"
HALF_RULE_CODE = "Talabat 20%"
UNKNOWN_CODE = "UNKNOWN-CODE"
DEFAULT_CODE = "Disc_20"
# Spread of order times within the day: (o_orderkey * 7919) % 86400 seconds.
TIME_MULTIPLIER = 7919

ORDER_COLUMNS = [
    "OrderID", "UniqueOrderID", "SequenceNumber", "ReceivedAt", "Brand", "Channel",
    "Location", "Type", "CustomerName", "Telephone", "Address", "VATID", "Currency",
    "ItemPrice", "Surcharge", "Delivery", "NetSales", "GrossPrice", "Discount", "VAT",
    "Total", "ChannelServiceCharge", "PaymentMethod", "PaymentType", "FortID",
    "DiscountCode", "DeliveryPartnerName", "DeliveryPlan", "Note", "CustomerNote",
    "EmployeeName", "Tips", "SourceSheet", "Date",
]


def _money(c: Column) -> Column:
    return c.cast(MONEY)


#: A line's number and its part key as one number that a hashed aggregation can hold (0 for a null; a struct would be sorted).
_LINE = "coalesce(cast(l_linenumber as decimal(19,0)) + 2000000000000000001BD, 0BD)"
_PART = "coalesce(cast(l_partkey as decimal(19,0)) + 9223372036854775809BD, 0BD)"
_PART_SPAN = "20000000000000000000BD"


def order_lines(lineitem: DataFrame) -> DataFrame:
    """Per-order money sums and the first line's part key.

    The first line is that of the smallest line number, then part key, nulls
    first.  Sums are of whole hundredths or ten-thousandths, exact as the
    decimals they stand for."""
    price, share = "cast(l_extendedprice as decimal(12,2))", "cast({} as decimal(4,2))"
    sums = lineitem.groupBy("l_orderkey").agg(
        F.expr(f"sum(cast({price} * 100BD as bigint))").alias("gross"),
        F.expr(f"sum(cast({price} * {share.format('l_discount')} * 10000BD as bigint))").alias("disc"),
        F.expr(f"sum(cast({price} * {share.format('l_tax')} * 10000BD as bigint))").alias("vat"),
        F.expr(f"min(cast({_LINE} * {_PART_SPAN} as decimal(38,0)) + {_PART})").alias("first_line"))
    part = f"cast(nullif(cast(first_line % {_PART_SPAN} as decimal(20,0)), 0BD) - 9223372036854775809BD as bigint)"
    money = "cast(cast({0} as decimal(19,0)) * {1}BD as decimal(18,4)) as {0}"
    return sums.selectExpr("l_orderkey", money.format("gross", "0.01"), money.format("disc", "0.0001"), money.format("vat", "0.0001"), f"{part} as first_part")


def _received() -> Column:
    return F.timestamp_add("SECOND", (F.col("o_orderkey") * TIME_MULTIPLIER) % 86400, F.col("o_orderdate"))


def discount_code() -> Column:
    slot = F.col("o_orderkey") % CODE_MODULUS
    return (F.when(slot == 0, F.lit(STAFF_CODE))
             .when(slot == 1, F.lit(HALF_RULE_CODE))
             .when(slot == 2, F.lit(None).cast("string"))
             .when(slot == 3, F.lit(UNKNOWN_CODE))
             .otherwise(F.lit(DEFAULT_CODE)))


def joined_orders(orders: DataFrame, lineitem: DataFrame, customer: DataFrame, part: DataFrame, nation: DataFrame) -> DataFrame:
    """An order's columns from the tables and its ``Date``; ``order_columns`` makes the canonical ones of them."""
    lines = order_lines(lineitem.select("l_orderkey", "l_partkey", "l_linenumber",
                                        "l_extendedprice", "l_discount", "l_tax"))
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                      "o_orderpriority")
    cust = customer.select("c_custkey", "c_name", "c_nationkey")
    brand = part.select(F.col("p_partkey"), F.col("p_brand"))
    nat = F.broadcast(nation.select("n_nationkey", "n_name"))
    return (o.join(cust, o.o_custkey == cust.c_custkey, "left")
             .join(nat, F.col("c_nationkey") == nat.n_nationkey, "left")
             .join(lines, o.o_orderkey == lines.l_orderkey, "left")
             .join(brand, lines.first_part == brand.p_partkey, "left")
             .select(*o.columns, "c_name", "n_name", "gross", "disc", "vat", "p_brand", F.to_date(_received()).alias("Date")))


def order_columns(joined: DataFrame, *more: str) -> DataFrame:
    """The canonical columns of ``joined_orders``, and ``more`` of its columns: a projection, so rows stay in order."""
    key = F.col("o_orderkey")
    code_slot = key % CODE_MODULUS
    gross = _money(F.coalesce(F.col("gross"), F.lit(0)))
    disc = _money(F.when(code_slot == 0, gross).otherwise(F.coalesce(F.col("disc"), F.lit(0))))
    vat = _money(F.coalesce(F.col("vat"), F.lit(0)))
    delivery = _money(key % 20)
    tips = _money(key % 5)
    zero = _money(F.lit(0))
    null_str = F.lit(None).cast("string")

    return joined.select(
        key.cast("string").alias("OrderID"),
        key.alias("UniqueOrderID"),
        (key % 1000).cast("string").alias("SequenceNumber"),
        _received().alias("ReceivedAt"),
        F.col("p_brand").alias("Brand"),
        F.col("o_orderpriority").alias("Channel"),
        F.col("n_name").alias("Location"),
        F.when(key % 20 == 0, F.lit("Pickup")).otherwise(F.lit("Delivery")).alias("Type"),
        F.col("c_name").alias("CustomerName"),
        F.col("o_custkey").cast("string").alias("Telephone"),
        F.concat(F.col("n_name"), F.lit("-"), (F.col("o_custkey") % 10).cast("string")).alias("Address"),
        null_str.alias("VATID"),
        F.lit("AED").alias("Currency"),
        gross.alias("ItemPrice"),
        zero.alias("Surcharge"),
        delivery.alias("Delivery"),
        _money(gross - disc).alias("NetSales"),
        gross.alias("GrossPrice"),
        disc.alias("Discount"),
        vat.alias("VAT"),
        _money(gross - disc + vat + delivery).alias("Total"),
        zero.alias("ChannelServiceCharge"),
        F.col("o_orderstatus").alias("PaymentMethod"),
        null_str.alias("PaymentType"),
        null_str.alias("FortID"),
        discount_code().alias("DiscountCode"),
        null_str.alias("DeliveryPartnerName"),
        null_str.alias("DeliveryPlan"),
        null_str.alias("Note"),
        null_str.alias("CustomerNote"),
        null_str.alias("EmployeeName"),
        tips.alias("Tips"),
        F.lit("orders").alias("SourceSheet"),
        "Date", *more,
    )


def build_orders(orders: DataFrame, lineitem: DataFrame, customer: DataFrame,
                 part: DataFrame, nation: DataFrame) -> DataFrame:
    return order_columns(joined_orders(orders, lineitem, customer, part, nation))


def joined_view(spark: SparkSession, sf_dir: str, days: Sequence[dt.date | None] | None = None) -> DataFrame:
    """``joined_orders`` over the driver tables in ``sf_dir``, of all days or of ``days`` alone (None: rows without a date).

    For chosen days the orders are filtered at the scan and only their lines
    are aggregated, so the work goes with those days."""
    orders, lineitem = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    if days is not None:
        on = F.to_date("o_orderdate")
        dated = sorted(d for d in days if d is not None)
        # An order's time lies within a day of its date: the scan may skip all else.
        near = F.lit(False)
        if dated:
            near = F.col("o_orderdate").between(F.lit(dated[0] - dt.timedelta(days=1)).cast(orders.schema["o_orderdate"].dataType),
                                                F.lit(dated[-1] + dt.timedelta(days=1)).cast(orders.schema["o_orderdate"].dataType))
            near = near & on.isin([d + dt.timedelta(days=k) for d in dated for k in (-1, 0)])
        orders = orders.where((near | on.isNull()) if None in days else near)
        lineitem = lineitem.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    out = joined_orders(orders, lineitem, read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "nation"))
    if days is None:
        return out
    chosen = F.col("Date").isin(dated) if dated else F.lit(False)
    return out.where((chosen | F.col("Date").isNull()) if None in days else chosen)


def orders_view(spark: SparkSession, sf_dir: str, days: Sequence[dt.date | None] | None = None) -> DataFrame:
    """Canonical order DataFrame over the driver tables in ``sf_dir``, of all days or of ``days`` alone."""
    return order_columns(joined_view(spark, sf_dir, days))


# DuckDB twin of ``build_orders`` used by the oracle SQL.
ORDERS_SQL = f"""
li AS (
  SELECT l_orderkey,
         SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS gross,
         SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS disc,
         SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS vat,
         min(struct_pack(ln := l_linenumber, pk := l_partkey)).pk AS first_pk
  FROM lineitem GROUP BY l_orderkey
),
oj AS (
  SELECT o.o_orderkey AS k, o.o_custkey, o.o_orderstatus, o.o_orderdate, o.o_orderpriority,
         CAST(COALESCE(li.gross, 0) AS DECIMAL(18,4)) AS g,
         CAST(COALESCE(li.disc, 0) AS DECIMAL(18,4)) AS d0,
         CAST(COALESCE(li.vat, 0) AS DECIMAL(18,4)) AS v,
         p.p_brand, c.c_name, n.n_name
  FROM orders o
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey
  LEFT JOIN part p ON li.first_pk = p.p_partkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
),
ob AS (
  SELECT *, CASE WHEN k % {CODE_MODULUS} = 0 THEN g ELSE d0 END AS dd FROM oj
),
orders_c AS (
  SELECT CAST(k AS VARCHAR) AS OrderID,
         k AS UniqueOrderID,
         CAST(k % 1000 AS VARCHAR) AS SequenceNumber,
         o_orderdate + to_seconds((k * {TIME_MULTIPLIER}) % 86400) AS ReceivedAt,
         p_brand AS Brand,
         o_orderpriority AS Channel,
         n_name AS Location,
         CASE WHEN k % 20 = 0 THEN 'Pickup' ELSE 'Delivery' END AS Type,
         c_name AS CustomerName,
         CAST(o_custkey AS VARCHAR) AS Telephone,
         n_name || '-' || CAST(o_custkey % 10 AS VARCHAR) AS Address,
         CAST(NULL AS VARCHAR) AS VATID,
         'AED' AS Currency,
         g AS ItemPrice,
         CAST(0 AS DECIMAL(18,4)) AS Surcharge,
         CAST(k % 20 AS DECIMAL(18,4)) AS Delivery,
         CAST(g - dd AS DECIMAL(18,4)) AS NetSales,
         g AS GrossPrice,
         CAST(dd AS DECIMAL(18,4)) AS Discount,
         v AS VAT,
         CAST(g - dd + v + CAST(k % 20 AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS Total,
         CAST(0 AS DECIMAL(18,4)) AS ChannelServiceCharge,
         o_orderstatus AS PaymentMethod,
         CAST(NULL AS VARCHAR) AS PaymentType,
         CAST(NULL AS VARCHAR) AS FortID,
         CASE k % {CODE_MODULUS} WHEN 0 THEN '{STAFF_CODE}' WHEN 1 THEN '{HALF_RULE_CODE}'
              WHEN 2 THEN NULL WHEN 3 THEN '{UNKNOWN_CODE}' ELSE '{DEFAULT_CODE}' END AS DiscountCode,
         CAST(NULL AS VARCHAR) AS DeliveryPartnerName,
         CAST(NULL AS VARCHAR) AS DeliveryPlan,
         CAST(NULL AS VARCHAR) AS Note,
         CAST(NULL AS VARCHAR) AS CustomerNote,
         CAST(NULL AS VARCHAR) AS EmployeeName,
         CAST(k % 5 AS DECIMAL(18,4)) AS Tips,
         'orders' AS SourceSheet,
         CAST(o_orderdate + to_seconds((k * {TIME_MULTIPLIER}) % 86400) AS DATE) AS Date
  FROM ob
)"""

"""Landing files → canonical order rows (A-01, A-02, A-06..A-08, A-11, A-12).

The daily export arrives with human headers and untyped cells.  Cleaning is
plan-time renaming plus ``try_cast`` expressions: bad numbers become 0 and a
row whose order time does not parse is dropped, without any Python per row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.functions.exprs import normalize_header

MONEY = T.DecimalType(18, 4)

# Normalised export header -> canonical column name.
COLUMN_MAP = {
    "brand": "Brand",
    "channel": "Channel",
    "location": "Location",
    "unique_order_id": "UniqueOrderID",
    "order_id": "OrderID",
    "sequence_number": "SequenceNumber",
    "received_at": "ReceivedAt",
    "type": "Type",
    "customer_name": "CustomerName",
    "telephone": "Telephone",
    "address": "Address",
    "vat_id": "VATID",
    "currency": "Currency",
    "item_price": "ItemPrice",
    "surcharge": "Surcharge",
    "delivery": "Delivery",
    "net_sales": "NetSales",
    "gross_price": "GrossPrice",
    "discount": "Discount",
    "vat": "VAT",
    "total_receipt_total": "Total",
    "channel_service_charge": "ChannelServiceCharge",
    "payment_method": "PaymentMethod",
    "payment_type": "PaymentType",
    "fort_id": "FortID",
    "discount_code": "DiscountCode",
    "delivery_partner_name": "DeliveryPartnerName",
    "delivery_plan": "DeliveryPlan",
    "note": "Note",
    "customer_note": "CustomerNote",
    "employee_name": "EmployeeName",
    "tips": "Tips",
    "sourcesheet": "SourceSheet",
}

# The seven columns coerced to numbers with missing -> 0.
COERCED_NUMERIC = ["GrossPrice", "Discount", "VAT", "Delivery", "Tips", "Surcharge", "Total"]
OTHER_MONEY = ["ItemPrice", "NetSales", "ChannelServiceCharge"]

# Columns of the dashboard's range load (plus the two its analyses need).
LOAD_COLUMNS = ["OrderID", "CustomerName", "Telephone", "ReceivedAt", "GrossPrice", "Discount", "Delivery",
                "Tips", "VAT", "Surcharge", "Total", "Channel", "Brand", "Location", "PaymentMethod",
                "DiscountCode", "Address"]


def normalize_headers(df: DataFrame) -> DataFrame:
    """A-06: strip, non-word runs -> '_', collapse, trim '_', lower (plan time)."""
    return df.toDF(*[normalize_header(c) for c in df.columns])


def rename_columns(df: DataFrame) -> DataFrame:
    """A-07: normalised header -> canonical name for the columns present."""
    return df.withColumnsRenamed({k: v for k, v in COLUMN_MAP.items() if k in df.columns})


def enforce_types(df: DataFrame) -> DataFrame:
    """A-08: ids as text, UniqueOrderID as a nullable long, ReceivedAt parsed
    zone-free; rows without a valid ReceivedAt are dropped."""
    out = df
    for c in ("OrderID", "SequenceNumber"):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("string"))
    if "UniqueOrderID" in out.columns:
        out = out.withColumn("UniqueOrderID", F.col("UniqueOrderID").try_cast("bigint"))
    out = out.withColumn("ReceivedAt", F.col("ReceivedAt").cast("string").try_cast("timestamp_ntz"))
    return out.where(F.col("ReceivedAt").isNotNull())


def coerce_numeric(df: DataFrame, cols=None) -> DataFrame:
    """A-11: numbers from text, unparsable or missing -> 0."""
    out = df
    for c in cols or COERCED_NUMERIC + OTHER_MONEY:
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string").try_cast(MONEY), F.lit(0).cast(MONEY)))
    return out


def clean_export(raw: DataFrame) -> DataFrame:
    """A-06 → A-07 → A-08 → A-11, plus the Date column."""
    df = coerce_numeric(enforce_types(rename_columns(normalize_headers(raw))))
    return df.withColumn("Date", F.to_date("ReceivedAt"))


def human_header(column: str) -> str:
    """Export-style header for a canonical column (inverse of the map, title case)."""
    key = next(k for k, v in COLUMN_MAP.items() if v == column)
    return " ".join(w.capitalize() for w in key.split("_"))


# Fixed values of the test landing file: which order keys carry a bad cell.
BAD_TIME_MOD, BAD_TIME_REM = 101, 7
BAD_NUMBER_MOD, BAD_NUMBER_REM = 103, 5


def landing_export(orders: DataFrame) -> DataFrame:
    """An untyped export built from canonical rows: human headers, text cells,
    an unparsable order time on some rows and a non-numeric discount on others."""
    key = F.col("UniqueOrderID")
    cols = []
    for c in COLUMN_MAP.values():
        v = F.col(c).cast("string")
        if c == "ReceivedAt":
            v = F.when(key % BAD_TIME_MOD == BAD_TIME_REM, F.lit("not a time")).otherwise(v)
        if c == "Discount":
            v = F.when(key % BAD_NUMBER_MOD == BAD_NUMBER_REM, F.lit("n/a")).otherwise(v)
        cols.append(v.alias(human_header(c)))
    return orders.select(*cols)


def load_range(orders: DataFrame, start: dt.date | str, end: dt.date | str,
               columns=None) -> DataFrame:
    """A-01 / A-02: orders from the start of ``start`` through the whole of
    ``end`` (half-open at end + 1 day, so the present day is read in full),
    newest first."""
    s = F.lit(str(start)).cast("date").cast("timestamp_ntz")
    e = F.date_add(F.lit(str(end)).cast("date"), 1).cast("timestamp_ntz")
    cols = [c for c in (columns or LOAD_COLUMNS) if c in orders.columns]
    rows = orders.where((F.col("ReceivedAt") >= s) & (F.col("ReceivedAt") < e))
    if "Month" in orders.columns:  # partition pruning on a stored table
        rows = rows.where(F.col("Month").between(str(start)[:7], str(end)[:7]))
    return (rows.select(*cols).orderBy(F.col("ReceivedAt").desc(), F.col("OrderID")))


def as_text(df: DataFrame) -> DataFrame:
    """A-12: every column as text for display / export."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])

"""Hand-made order frames (FIXTURES.md F1) for unit tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

SCHEMA = T.StructType([
    T.StructField("OrderID", T.StringType()),
    T.StructField("UniqueOrderID", T.LongType()),
    T.StructField("ReceivedAt", T.TimestampNTZType()),
    T.StructField("Brand", T.StringType()),
    T.StructField("Channel", T.StringType()),
    T.StructField("Location", T.StringType()),
    T.StructField("CustomerName", T.StringType()),
    T.StructField("Telephone", T.StringType()),
    T.StructField("Address", T.StringType()),
    T.StructField("ItemPrice", MONEY),
    T.StructField("Surcharge", MONEY),
    T.StructField("Delivery", MONEY),
    T.StructField("GrossPrice", MONEY),
    T.StructField("Discount", MONEY),
    T.StructField("VAT", MONEY),
    T.StructField("Total", MONEY),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("DiscountCode", T.StringType()),
    T.StructField("Tips", MONEY),
])

DEFAULTS = dict(Brand="B1", Channel="C1", Location="L1", CustomerName="alice", Telephone="1", Address="A-1",
                ItemPrice=10, Surcharge=0, Delivery=5, GrossPrice=105, Discount=0, VAT=5, Total=110,
                PaymentMethod="Card", DiscountCode=None, Tips=1)


def orders(spark, rows):
    out = []
    for i, r in enumerate(rows):
        d = {**DEFAULTS, **r}
        ts = d.get("ReceivedAt", dt.datetime(2024, 1, 2, 12, 0, 0))
        if isinstance(ts, str):
            ts = dt.datetime.fromisoformat(ts)
        row = []
        for f in SCHEMA.fields:
            if f.name == "OrderID":
                row.append(str(d.get("OrderID", i + 1)))
            elif f.name == "UniqueOrderID":
                row.append(int(d.get("OrderID", i + 1)))
            elif f.name == "ReceivedAt":
                row.append(ts)
            elif isinstance(f.dataType, T.DecimalType):
                v = d[f.name]
                row.append(None if v is None else Decimal(str(v)))
            else:
                row.append(d[f.name])
        out.append(tuple(row))
    df = spark.createDataFrame(out, SCHEMA)
    return df.withColumn("Date", F.to_date("ReceivedAt"))

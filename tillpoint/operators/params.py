"""Data-dependent scalar parameters (latest date, cut-off instant, counts).

Each step computes all of its scalars in one aggregate job and inlines them
as literals — what Spark itself does for an uncorrelated scalar subquery, but
without re-running nested subqueries inside each other.  Only one row of a
few values reaches the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fetch(df: DataFrame, **exprs: Column) -> dict:
    row = df.agg(*[e.alias(k) for k, e in exprs.items()]).first()
    return row.asDict() if row is not None else {k: None for k in exprs}


def lit(v) -> Column:
    """Literal of a fetched value; timestamps stay zone-free (TIMESTAMP_NTZ)."""
    if v is None:
        return F.lit(None)
    if isinstance(v, dt.datetime):
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(v, dt.date):
        return F.lit(v.isoformat()).cast("date")
    return F.lit(v)


def date_lit(v) -> Column:
    return F.lit(None).cast("date") if v is None else F.lit(v.isoformat()).cast("date")


def ts_lit(v) -> Column:
    return F.lit(None).cast("timestamp_ntz") if v is None else lit(v)

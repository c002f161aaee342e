"""Discount-code grouping (C-02 exact lookup, C-03 prefix rules)."""

from __future__ import annotations

import csv
import os
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAFF_GROUP = "Total Discount (Staff Meals & Others)"
AGG_GROUP = "Total Discount (Agg)"
NO_CODE_GROUP = "None"
UNKNOWN_GROUP = "Other"

# Code-prefix groups of the extended column set, checked in this order.
PREFIX_GROUPS = [
    ("EMP", "Employee"),
    ("PROMO", "Promotion"),
    ("LOYAL", "Loyalty"),
    ("WELCOME", "Welcome"),
    ("BIRTHDAY", "Birthday"),
]

# The channel/brand pair whose discount counts half.
HALF_RULE = ("Talabat", "Manoushe Street")

DATA_FILE = os.path.join(os.path.dirname(__file__), "data", "discount_groups.csv")


@lru_cache(maxsize=4)
def group_pairs(path: str = DATA_FILE) -> tuple[tuple[str, str], ...]:
    """(key, group) pairs keyed on upper(trim(name)); a later row wins."""
    out: dict[str, str] = {}
    with open(path, encoding="utf-8", newline="") as f:
        rows = csv.reader(line for line in f if not line.startswith("#"))
        next(rows)  # header
        for name, group in rows:
            out[name.strip().upper()] = group
    return tuple(out.items())


def group_table(spark: SparkSession, path: str = DATA_FILE) -> DataFrame:
    """The lookup as a small DataFrame; its size is fixed by the file."""
    return spark.createDataFrame(list(group_pairs(path)), "_dg_key string, _dg_group string")


def code_key(code: str | Column = "DiscountCode") -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.upper(F.trim(c))


def with_discount_group(df: DataFrame, code: str = "DiscountCode",
                        out: str = "Discount_Group", path: str = DATA_FILE) -> DataFrame:
    """C-02: exact lookup on upper(trim(code)); null -> 'None', miss -> 'Other'.

    The lookup is broadcast: it has a fixed, file-bounded row count.
    """
    spark = df.sparkSession
    lookup = F.broadcast(group_table(spark, path))
    keyed = df.withColumn("_code_key", code_key(code))
    j = keyed.join(lookup, keyed["_code_key"] == lookup["_dg_key"], "left")
    grp = (F.when(F.col(code).isNull(), F.lit(NO_CODE_GROUP))
            .otherwise(F.coalesce(lookup["_dg_group"], F.lit(UNKNOWN_GROUP))))
    return j.withColumn(out, grp).drop("_code_key", "_dg_key", "_dg_group")


def prefix_group(code: str | Column = "DiscountCode") -> Column:
    """C-03: first matching prefix of upper(code); null -> 'None'; else 'Other'."""
    c = F.col(code) if isinstance(code, str) else code
    up = F.upper(c)
    expr = F.when(c.isNull(), F.lit(NO_CODE_GROUP))
    for prefix, group in PREFIX_GROUPS:
        expr = expr.when(up.startswith(prefix), F.lit(group))
    return expr.otherwise(F.lit(UNKNOWN_GROUP))


def sql_group_values(path: str = DATA_FILE) -> str:
    """SQL VALUES list of the lookup (for the DuckDB twin)."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({q(k)}, {q(g)})" for k, g in group_pairs(path))

"""Shared measures over the enriched order frame.

Money sums run over exact DECIMAL columns and are converted to double once,
so totals do not depend on the order in which partitions are combined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillpoint.functions.exprs import VAT_FACTOR, dbl

# Cost shares of the pivot's contribution margin.
FOOD_COST_SHARE = 0.206
COMMISSION_SHARE = 0.24


def net_sale_sum() -> Column:
    return dbl(F.sum("net_sale_vat")) / F.lit(VAT_FACTOR)


def calc_discount_sum() -> Column:
    return dbl(F.sum("calc_discount_vat")) / F.lit(VAT_FACTOR)


def pivot_cm(net: Column, disc: Column) -> Column:
    """CM of a pivot cell: net − 20.6 % food cost − 24 % commission − discount."""
    return net - net * F.lit(FOOD_COST_SHARE) - net * F.lit(COMMISSION_SHARE) - disc

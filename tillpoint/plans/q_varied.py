"""The same queries over a varied order table, so that every branch of their rules has rows.

The driver tables hold large orders, one value tier, no channel of the half
rule and no tied order times.  Here each order of the tables is kept but
reshaped by its keys: totals from a few cents to thousands, deep discounts, the
half rule's channel and brand, codes with a prefix, and orders of one instant.
The SQL twin reshapes the same way.
"""

from __future__ import annotations

from tillpoint.functions import discounts as dg
from tillpoint.plans import frames
from tillpoint.plans.catalog import REGISTRY, register
from tillpoint.sources.canonical import ORDERS_SQL

HALF_CHANNEL, HALF_BRAND = dg.HALF_RULE
_SCALE = "(CASE CAST(Telephone AS BIGINT) % 6 WHEN 0 THEN CAST(1 AS DECIMAL(5,4)) WHEN 1 THEN CAST(0.05 AS DECIMAL(5,4)) WHEN 2 THEN CAST(0.003 AS DECIMAL(5,4)) " \
         "WHEN 3 THEN CAST(0.0008 AS DECIMAL(5,4)) WHEN 4 THEN CAST(0.0003 AS DECIMAL(5,4)) ELSE CAST(0.0001 AS DECIMAL(5,4)) END)"
_DEEP = "CASE WHEN UniqueOrderID % 11 = 0 OR Brand LIKE '%1' THEN CAST(GrossPrice AS DECIMAL(18,4)) * CAST(1.5 AS DECIMAL(5,4)) ELSE Discount * CAST(1 AS DECIMAL(5,4)) END"
_CODES = " ".join(f"WHEN UniqueOrderID % 97 = {10 + i} THEN '{p.lower()}-{i}'" for i, (p, _) in enumerate(dg.PREFIX_GROUPS))

#: Column rules that Spark and DuckDB read alike; ``{last}`` is the latest day of the table.
RULES = {
    "Channel": f"CASE WHEN UniqueOrderID % 7 = 0 THEN '{HALF_CHANNEL}' ELSE Channel END",
    "Brand": f"CASE WHEN UniqueOrderID % 21 = 0 THEN '{HALF_BRAND}' ELSE Brand END",
    "GrossPrice": f"CAST(GrossPrice * {_SCALE} AS DECIMAL(18,4))",
    "ItemPrice": f"CAST(ItemPrice * {_SCALE} AS DECIMAL(18,4))",
    "Discount": f"CAST(CAST({_DEEP} AS DECIMAL(18,4)) * {_SCALE} AS DECIMAL(18,4))",
    "DiscountCode": f"CASE {_CODES} ELSE DiscountCode END",
}

VARIED_SQL = "orders_c AS (SELECT * REPLACE (" + ", ".join(f"{rule} AS {c}" for c, rule in RULES.items()) + """,
  CAST(Date AS TIMESTAMP) + to_seconds(CASE WHEN Date = (SELECT max(Date) FROM orders_0) AND UniqueOrderID % 2 = 0 THEN 39600 ELSE 43200 END) AS ReceivedAt)
FROM orders_0)"""


def varied_sql(sql: str) -> str:
    plain = ORDERS_SQL.strip()
    if plain not in sql:
        raise ValueError("the query does not start from the order table")
    return sql.replace(plain, plain.replace("orders_c AS (", "orders_0 AS (") + ",\n" + VARIED_SQL)


#: Queries with branches that the tables as they are do not reach.
NAMES = ["b01_essential_columns", "b02_extended_columns", "c02_discount_group_lookup", "c03_discount_prefix_groups", "d01_kpis", "d03_customer_table", "d04_discount_by_brand",
         "d07_discount_range_table", "d08_net_sale_by_range", "d17_fine_discount_ranges", "d19_scorecard_verdicts", "d20_pair_verdicts", "d21_range_verdicts",
         "d23_value_tier_metrics", "d24_value_tier_counts", "d25_value_tier_actions", "d26_behaviour_summary", "g15_value_segment_counts", "g16_discount_insights",
         "p01_channel_date_pivot", "p07_combined_changes", "s03_customer_tier_pairs"]


def _mk(query):
    def q(spark, sf):
        return query.build(spark, frames.Varied(sf, RULES))
    q.__doc__ = f"``{query.name}`` over the varied orders."
    return q


for _name in NAMES:
    _query = REGISTRY[_name]
    register(f"{_name}_varied", _query.ids, varied_sql(_query.sql))(_mk(_query))

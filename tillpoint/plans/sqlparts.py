"""DuckDB twins of the shared frames, as CTE fragments.

Each registered query's oracle SQL is ``WITH <fragments>, <own CTEs> SELECT``
over the driver's pre-registered tables, mirroring the Spark plan step by step.
"""

from __future__ import annotations

from tillpoint.functions import discounts as dg
from tillpoint.sources.canonical import ORDERS_SQL

STAFF = dg.STAFF_GROUP.replace("'", "''")
HALF_CH, HALF_BR = dg.HALF_RULE

DISCOUNT_MAP_SQL = f"dgm(code_key, discount_group) AS (VALUES {dg.sql_group_values()})"

ESSENTIAL_SQL = f"""
e0 AS (
  SELECT o.*, CASE WHEN o.DiscountCode IS NULL THEN 'None'
                   ELSE COALESCE(m.discount_group, 'Other') END AS Discount_Group
  FROM orders_c o LEFT JOIN dgm m ON upper(trim(o.DiscountCode)) = m.code_key
),
e1 AS (
  SELECT *,
    CASE WHEN Discount_Group = '{STAFF}' THEN CAST(GrossPrice - Discount AS DECIMAL(20,4))
         ELSE CAST(GrossPrice AS DECIMAL(20,4)) END AS net_sale_vat,
    CASE WHEN Discount_Group = '{STAFF}' THEN CAST(0 AS DECIMAL(20,5))
         WHEN Channel = '{HALF_CH}' AND Brand = '{HALF_BR}' THEN CAST(Discount * 0.5 AS DECIMAL(20,5))
         ELSE CAST(Discount AS DECIMAL(20,5)) END AS calc_discount_vat
  FROM e0
),
e2 AS (
  SELECT *, CAST(net_sale_vat AS DOUBLE) / 1.05 AS net_sale,
         CAST(calc_discount_vat AS DOUBLE) / 1.05 AS Calculated_Discount,
         CAST(hour(ReceivedAt) AS INTEGER) AS Hour,
         CAST(minute(ReceivedAt) AS INTEGER) AS Minute,
         dayname(ReceivedAt) AS DayOfWeek
  FROM e1
),
e AS (
  SELECT *,
    CASE WHEN CAST(GrossPrice AS DOUBLE) <> 0
         THEN (net_sale - CAST(Discount AS DOUBLE)) / CAST(GrossPrice AS DOUBLE) * 100 ELSE 0.0 END AS Profit_Margin,
    CASE WHEN CAST(GrossPrice AS DOUBLE) <> 0
         THEN CAST(Discount AS DOUBLE) / CAST(GrossPrice AS DOUBLE) * 100 ELSE 0.0 END AS Discount_Percentage,
    CASE WHEN net_sale > 0 AND net_sale <= 25 THEN 'Small'
         WHEN net_sale > 25 AND net_sale <= 75 THEN 'Medium'
         WHEN net_sale > 75 AND net_sale <= 150 THEN 'Large'
         WHEN net_sale > 150 THEN 'XLarge' END AS Order_Size_Category
  FROM e2
)"""

BASE = [ORDERS_SQL.strip(), DISCOUNT_MAP_SQL, ESSENTIAL_SQL.strip()]

# B-05 + B-08 + B-07 + G-02/G-03 (the command-centre frame) -------------------
SYNC_SQL = """
d AS (SELECT * FROM e WHERE COALESCE(GrossPrice <> Discount, TRUE)),
dp AS (SELECT max(Date) AS latest, greatest(max(Date) - 1, min(Date)) AS prev FROM d),
sel AS (SELECT d.* FROM d, dp WHERE d.Date IN (dp.prev, dp.latest)),
sp AS (
  SELECT count(DISTINCT Date) AS n, max(Date) AS latest,
         (SELECT max(Date) FROM sel WHERE Date < (SELECT max(Date) FROM sel)) AS prev,
         (SELECT max(ReceivedAt) FROM sel WHERE Date = (SELECT max(Date) FROM sel)) AS max_ts
  FROM sel
),
sp3 AS (
  SELECT *, CAST(prev AS TIMESTAMP) + (max_ts - date_trunc('day', max_ts)) AS cutoff,
         (SELECT count(*) FROM sel WHERE ReceivedAt = sp.max_ts) AS n_at_max
  FROM sp
),
synced AS (
  SELECT s.* FROM sel s, sp3
  WHERE sp3.n = 2 AND (s.Date = sp3.latest OR (s.Date = sp3.prev AND s.ReceivedAt < sp3.cutoff))
  UNION ALL
  SELECT x.* EXCLUDE (rn_) FROM (
    SELECT s.*, row_number() OVER (ORDER BY s.OrderID) AS rn_ FROM sel s, sp3
    WHERE sp3.n = 2 AND s.Date = sp3.prev AND s.ReceivedAt = sp3.cutoff) x, sp3
  WHERE x.rn_ <= sp3.n_at_max
  UNION ALL
  SELECT s.* FROM sel s JOIN (SELECT Date AS dm_date, max(ReceivedAt) AS m FROM sel GROUP BY Date) dm
    ON s.Date = dm.dm_date, sp3
  WHERE sp3.n <> 2 AND s.ReceivedAt <= date_trunc('minute', dm.m)
),
pp AS (SELECT CASE WHEN min(Date) <> max(Date) THEN min(Date) END AS prev, max(Date) AS latest FROM synced)"""


def with_ctes(*parts: str, final: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + final


def ratio_sql(num: str, den: str, scale: str = "100") -> str:
    return f"(CASE WHEN CAST({den} AS DOUBLE) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * {scale} ELSE 0.0 END)"


def cm_sql(net: str, disc: str) -> str:
    return f"({net} - {net} * 0.206 - {net} * 0.24 - {disc})"


def two_date_sums_sql(src: str, dims: list[str], rollup: bool) -> str:
    """Conditional sums for the two dates of ``src`` (uses CTE ``pp``)."""
    where = " AND ".join(f"{d} IS NOT NULL" for d in dims)
    group = f"ROLLUP({', '.join(dims)})" if rollup else ", ".join(dims)
    gid = f"GROUPING({', '.join(dims)})" if rollup else "0"
    def s(day: str, v: str) -> str:
        return f"COALESCE(SUM(CASE WHEN Date = pp.{day} THEN {v} END), 0)"
    return f"""SELECT {', '.join(dims)}, {gid} AS gid,
      {s('prev', 'net_sale_vat')} AS p_net, {s('latest', 'net_sale_vat')} AS l_net,
      {s('prev', 'calc_discount_vat')} AS p_cd, {s('latest', 'calc_discount_vat')} AS l_cd,
      {s('prev', 'GrossPrice')} AS p_gross, {s('latest', 'GrossPrice')} AS l_gross,
      any_value(pp.prev) AS prev, any_value(pp.latest) AS latest
    FROM {src}, pp WHERE {where} GROUP BY {group}"""


# B-02 extended column set (prefix groups, customer stats, 80th percentile) --
_PREFIX = "CASE WHEN DiscountCode IS NULL THEN 'None' " + " ".join(
    f"WHEN starts_with(upper(DiscountCode), '{p}') THEN '{g}'" for p, g in dg.PREFIX_GROUPS) + " ELSE 'Other' END"

EXTENDED_SQL = f"""
x0 AS (SELECT o.*, {_PREFIX} AS Discount_Group FROM orders_c o),
x1 AS (
  SELECT *,
    CASE WHEN Discount_Group = '{STAFF}' THEN CAST(GrossPrice - Discount AS DECIMAL(20,4))
         ELSE CAST(GrossPrice AS DECIMAL(20,4)) END AS net_sale_vat,
    CASE WHEN Discount_Group = '{STAFF}' THEN CAST(0 AS DECIMAL(20,5))
         WHEN Channel = '{HALF_CH}' AND Brand = '{HALF_BR}' THEN CAST(Discount * 0.5 AS DECIMAL(20,5))
         ELSE CAST(Discount AS DECIMAL(20,5)) END AS calc_discount_vat
  FROM x0
),
x2 AS (
  SELECT *, CAST(net_sale_vat AS DOUBLE) / 1.05 AS net_sale,
         CAST(calc_discount_vat AS DOUBLE) / 1.05 AS Calculated_Discount,
         CAST(hour(ReceivedAt) AS INTEGER) AS Hour, CAST(minute(ReceivedAt) AS INTEGER) AS Minute,
         dayname(ReceivedAt) AS DayOfWeek
  FROM x1
),
xcs AS (
  SELECT CustomerName AS cs_key, CAST(count(net_sale_vat) AS BIGINT) AS Customer_Order_Count,
         CAST(SUM(net_sale_vat) AS DOUBLE) / 1.05 AS Customer_Total_Spent,
         CAST(SUM(net_sale_vat) AS DOUBLE) / 1.05 / count(net_sale_vat) AS Customer_Avg_Order
  FROM x2 WHERE CustomerName IS NOT NULL GROUP BY CustomerName
),
xr AS (SELECT net_sale, row_number() OVER (ORDER BY net_sale) AS rn, count(*) OVER () AS n
       FROM x2 WHERE net_sale IS NOT NULL),
xq AS (
  SELECT CASE WHEN t >= 0.5 THEN b - (b - a) * (1.0 - t) ELSE a + (b - a) * t END AS q80
  FROM (SELECT max(CASE WHEN rn = floor((n - 1) * 0.8) + 1 THEN net_sale END) AS a,
               max(CASE WHEN rn = ceil((n - 1) * 0.8) + 1 THEN net_sale END) AS b,
               (max(n) - 1) * 0.8 - floor((max(n) - 1) * 0.8) AS t FROM xr)
),
x AS (
  SELECT x2.*,
    CASE WHEN CAST(GrossPrice AS DOUBLE) <> 0
         THEN (net_sale - Calculated_Discount) / CAST(GrossPrice AS DOUBLE) * 100 ELSE 0.0 END AS Profit_Margin,
    CASE WHEN CAST(GrossPrice AS DOUBLE) <> 0
         THEN Calculated_Discount / CAST(GrossPrice AS DOUBLE) * 100 ELSE 0.0 END AS Discount_Percentage,
    net_sale - CAST(Delivery AS DOUBLE) AS Revenue_After_Delivery,
    CAST(Delivery + Surcharge + VAT AS DOUBLE) AS Total_Fees,
    net_sale - Calculated_Discount - CAST(Delivery + Surcharge + VAT AS DOUBLE) AS Order_Profitability,
    CASE WHEN net_sale > 0 AND net_sale <= 25 THEN 'Small' WHEN net_sale > 25 AND net_sale <= 75 THEN 'Medium'
         WHEN net_sale > 75 AND net_sale <= 150 THEN 'Large' WHEN net_sale > 150 THEN 'XLarge' END
         AS Order_Size_Category,
    CASE WHEN CAST(Discount AS DOUBLE) > 0 AND CAST(Discount AS DOUBLE) <= 1 THEN 'No Discount'
         WHEN CAST(Discount AS DOUBLE) > 1 AND CAST(Discount AS DOUBLE) <= 10 THEN 'Low'
         WHEN CAST(Discount AS DOUBLE) > 10 AND CAST(Discount AS DOUBLE) <= 25 THEN 'Medium'
         WHEN CAST(Discount AS DOUBLE) > 25 THEN 'High' END AS Discount_Category,
    DayOfWeek IN ('Saturday', 'Sunday') AS Is_Weekend,
    CASE WHEN Hour >= 0 AND Hour <= 6 THEN 'Night' WHEN Hour > 6 AND Hour <= 12 THEN 'Morning'
         WHEN Hour > 12 AND Hour <= 18 THEN 'Afternoon' WHEN Hour > 18 AND Hour <= 24 THEN 'Evening' END
         AS Time_Period,
    xcs.Customer_Order_Count, xcs.Customer_Total_Spent, xcs.Customer_Avg_Order,
    CASE WHEN Customer_Total_Spent > 0 AND Customer_Total_Spent <= 100 THEN 'Bronze'
         WHEN Customer_Total_Spent > 100 AND Customer_Total_Spent <= 500 THEN 'Silver'
         WHEN Customer_Total_Spent > 500 AND Customer_Total_Spent <= 1000 THEN 'Gold'
         WHEN Customer_Total_Spent > 1000 THEN 'Platinum' END AS Customer_Value_Tier,
    net_sale / CASE WHEN CAST(ItemPrice AS DOUBLE) = 0 THEN 1.0 ELSE CAST(ItemPrice AS DOUBLE) END
         AS Revenue_Per_Item,
    CASE WHEN net_sale <> 0 THEN CAST(Tips AS DOUBLE) / net_sale * 100 ELSE 0.0 END AS Tip_Percentage,
    COALESCE(net_sale > xq.q80, FALSE) AS High_Value_Order,
    CAST(Discount AS DOUBLE) > 0 AS Discounted_Order,
    COALESCE(Customer_Order_Count > 5, FALSE) AS Premium_Customer
  FROM x2 LEFT JOIN xcs ON x2.CustomerName = xcs.cs_key, xq
)"""


def quantile_sql(src: str, keys: list[str], value: str, p: float, name: str) -> str:
    """Exact linear-interpolated quantile per group, numpy's interpolation
    (the rule ``grouped_quantile`` uses), as a SELECT over ``src``."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    k = ", ".join(keys)
    sel = f"{k}, " if keys else ""
    grp = f" GROUP BY {k}" if keys else ""
    pos = f"(CAST(n_ - 1 AS DOUBLE) * CAST({p} AS DOUBLE))"
    return f"""SELECT {sel}CASE WHEN max(t_) >= 0.5 THEN max(b_) - (max(b_) - max(a_)) * (1.0 - max(t_))
                  ELSE max(a_) + (max(b_) - max(a_)) * max(t_) END AS {name}
FROM (SELECT {sel}CASE WHEN rn_ = floor({pos}) + 1 THEN v_ END AS a_,
             CASE WHEN rn_ = ceil({pos}) + 1 THEN v_ END AS b_,
             {pos} - floor({pos}) AS t_
      FROM (SELECT {sel}CAST({value} AS DOUBLE) AS v_,
                   row_number() OVER ({part}ORDER BY CAST({value} AS DOUBLE)) AS rn_,
                   count(*) OVER ({part.strip()}) AS n_
            FROM {src} WHERE {value} IS NOT NULL)){grp}"""

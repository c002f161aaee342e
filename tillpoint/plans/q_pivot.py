"""Command-centre pivot queries (P-01..P-11, H-03, H-04, D-22) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.operators import pivot, sync
from tillpoint.plans import frames
from tillpoint.plans.catalog import register
from tillpoint.plans.sqlparts import (BASE, SYNC_SQL, cm_sql, quantile_sql, ratio_sql,
                                      two_date_sums_sql, with_ctes)

CMD = [*BASE, SYNC_SQL]
NET = "(CAST({t}_net AS DOUBLE) / 1.05)"
DISC = "(CAST({t}_cd AS DOUBLE) / 1.05)"


def _wide_sql(dim: str) -> str:
    cols = [f"CASE WHEN gid <> 0 THEN 'Total' ELSE CAST({dim} AS VARCHAR) END AS {dim}",
            "prev AS Previous_Date", "latest AS Latest_Date", "gid"]
    for side, t in (("Previous", "p"), ("Latest", "l")):
        net, disc = NET.format(t=t), DISC.format(t=t)
        pct = (f"CASE WHEN gid <> 0 THEN (CASE WHEN {net} > 0 THEN {disc} / {net} * 100 ELSE 0.0 END) "
               f"ELSE {ratio_sql(disc, f'{t}_gross')} END")
        cols += [f"{net} AS {side}_Net_Sale", f"{disc} AS {side}_Discount",
                 f"{pct} AS {side}_Discount_Pct", f"{cm_sql(net, disc)} AS {side}_CM"]
    deltas = ", ".join(f"Latest_{m} - Previous_{m} AS {m}_Delta"
                       for m in ("Net_Sale", "Discount", "Discount_Pct", "CM"))
    return (f"g AS ({two_date_sums_sql('synced', [dim], True)}),\n"
            f"w0 AS (SELECT {', '.join(cols)} FROM g),\n"
            f"w AS (SELECT * EXCLUDE (gid), {deltas} FROM w0)")


WIDE_SQL = with_ctes(*CMD, _wide_sql("Channel"), final="SELECT * FROM w")


@register("p01_channel_date_pivot", ("P-01", "P-02", "P-03", "B-05", "B-07", "B-08", "G-02", "G-03",
                                     "E-05", "S-01", "S-02", "C-04"), WIDE_SQL)
def p01_channel_date_pivot(spark, sf):
    """Flagship: Channel × (previous, latest date) with totals and deltas."""
    return pivot.two_date_pivot(frames.synced(spark, sf), "Channel")


#: A chosen pair: the third and the fifth latest day that have orders.
_PAIR = (4, 2)
_NTH = "(SELECT Date FROM (SELECT DISTINCT Date FROM d WHERE Date IS NOT NULL) ORDER BY Date DESC LIMIT 1 OFFSET {})"
_CHOSEN_SYNC = SYNC_SQL.replace("SELECT max(Date) AS latest, greatest(max(Date) - 1, min(Date)) AS prev FROM d", f"SELECT {_NTH.format(_PAIR[1])} AS latest, {_NTH.format(_PAIR[0])} AS prev")
assert _CHOSEN_SYNC != SYNC_SQL


def _chosen(spark, sf):
    e = frames.essential(spark, sf)
    days = sync.latest_days(sync.drop_fully_discounted(e), 5)
    return frames.command_centre(e, *[days[k] for k in _PAIR])


@register("p01_chosen_pair", ("P-01", "B-07", "G-02"), with_ctes(*BASE, _CHOSEN_SYNC, _wide_sql("Channel"), final="SELECT * FROM w"))
def p01_chosen_pair(spark, sf):
    """The command centre for two chosen dates instead of the latest two."""
    return pivot.two_date_pivot(_chosen(spark, sf), "Channel")


_LONG_SQL = with_ctes(*CMD, _wide_sql("Channel"), final="""
SELECT Channel, Previous_Date AS Date, Previous_Net_Sale AS Net_Sale, Previous_Discount AS Discount,
       Previous_Discount_Pct AS Discount_Pct, Previous_CM AS CM FROM w WHERE Previous_Date IS NOT NULL
UNION ALL
SELECT Channel, Latest_Date, Latest_Net_Sale, Latest_Discount, Latest_Discount_Pct, Latest_CM FROM w""")


@register("p01_pivot_long", "P-01", _LONG_SQL)
def p01_pivot_long(spark, sf):
    return pivot.pivot_long(pivot.two_date_pivot(frames.synced(spark, sf), "Channel"), "Channel")


@register("p02_pivot_totals", ("P-02", "S-02"), with_ctes(*CMD, _wide_sql("Channel"),
          final="SELECT * FROM w WHERE Channel = 'Total'"))
def p02_pivot_totals(spark, sf):
    t = pivot.two_date_pivot(frames.synced(spark, sf), "Channel")
    return t.where(F.col("Channel") == "Total")


@register("p03_pivot_deltas", "P-03", with_ctes(*CMD, _wide_sql("Channel"), final="""
SELECT Channel, Net_Sale_Delta, Discount_Delta, Discount_Pct_Delta, CM_Delta FROM w"""))
def p03_pivot_deltas(spark, sf):
    t = pivot.two_date_pivot(frames.synced(spark, sf), "Channel")
    return t.select("Channel", "Net_Sale_Delta", "Discount_Delta", "Discount_Pct_Delta", "CM_Delta")


# P-04 / P-05: general pivot over the whole kept frame -------------------------
KEPT = [*BASE, "k AS (SELECT * FROM e WHERE COALESCE(GrossPrice <> Discount, TRUE))"]

_SQL_AGG = {"sum": "SUM(CAST({v} AS DOUBLE))", "mean": "AVG(CAST({v} AS DOUBLE))",
            "count": "CAST(COUNT({v}) AS DOUBLE)", "median": "median(CAST({v} AS DOUBLE))",
            "std": "stddev_samp(CAST({v} AS DOUBLE))", "min": "MIN(CAST({v} AS DOUBLE))",
            "max": "MAX(CAST({v} AS DOUBLE))"}


def _general_pivot_sql(rows: list[str], cols: list[str], value: str, how: str) -> str:
    dims = rows + cols
    sel = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dims)
    where = " AND ".join(f"{d} IS NOT NULL" for d in dims)
    agg = _SQL_AGG[how].format(v=value)
    sets = []
    for s in (dims, rows, cols, []):
        if s not in sets:
            sets.append(s)
    parts = []
    for s in sets:
        proj = ", ".join(d if d in s else f"'Total' AS {d}" for d in dims)
        if how == "median":
            inner = quantile_sql("pv", s, value, 0.5, "value")
            parts.append(f"SELECT {proj}, value FROM ({inner})")
            continue
        group = f" GROUP BY {', '.join(s)}" if s else ""
        parts.append(f"SELECT {proj}, {agg} AS value FROM pv{group}")
    return with_ctes(*KEPT, f"pv AS (SELECT {sel}, {value} FROM k WHERE {where})",
                     final="\nUNION ALL\n".join(parts))


for _how in pivot.AGGREGATIONS:
    def _mk(how):
        def q(spark, sf):
            return pivot.general_pivot(frames.kept(spark, sf), ["Channel"], ["PaymentMethod"],
                                       "net_sale", how)
        q.__doc__ = f"P-04: Channel × PaymentMethod pivot of net sale ({how}) with margins."
        return q
    register(f"p04_general_pivot_{_how}", "P-04",
             _general_pivot_sql(["Channel"], ["PaymentMethod"], "net_sale", _how))(_mk(_how))


@register("p04_pivot_hour_by_weekday", "P-04",
          _general_pivot_sql(["DayOfWeek"], ["Hour"], "Discount_Percentage", "mean"))
def p04_pivot_hour_by_weekday(spark, sf):
    return pivot.general_pivot(frames.kept(spark, sf), ["DayOfWeek"], ["Hour"], "Discount_Percentage", "mean")


@register("p05_group_summary", "P-05", with_ctes(*KEPT, final="""
SELECT Brand, round(AVG(CAST(net_sale AS DOUBLE)), 2) AS net_sale FROM k WHERE Brand IS NOT NULL GROUP BY Brand"""))
def p05_group_summary(spark, sf):
    return pivot.group_summary(frames.kept(spark, sf), ["Brand"], "net_sale", "mean")


@register("p05_group_summary_median", "P-05", with_ctes(*KEPT, "q AS (" + quantile_sql(
    "k", ["Location"], "net_sale", 0.5, "net_sale") + ")", final="SELECT Location, round(net_sale, 2) AS net_sale FROM q"))
def p05_group_summary_median(spark, sf):
    return pivot.group_summary(frames.kept(spark, sf), ["Location"], "net_sale", "median")


# P-06 / H-03 / P-10: per-dimension two-date summaries ---------------------------
def _dim_summary_sql(dim: str) -> str:
    cols = [f"CAST({dim} AS VARCHAR) AS Item"]
    for side, t in (("Previous", "p"), ("Latest", "l")):
        net, disc = NET.format(t=t), DISC.format(t=t)
        cols += [f"{net} AS {side}_Net_Sale", f"{disc} AS {side}_Discount",
                 f"{ratio_sql(disc, f'{t}_gross')} AS {side}_Discount_Pct"]
    return (f"g AS ({two_date_sums_sql('synced', [dim], False)}),\n"
            f"s0 AS (SELECT {', '.join(cols)} FROM g),\n"
            "s AS (SELECT *, Latest_Net_Sale - Previous_Net_Sale AS Net_Sale_Diff, "
            "Latest_Discount - Previous_Discount AS Discount_Diff, "
            "Latest_Discount_Pct - Previous_Discount_Pct AS Discount_Pct_Diff, "
            "Latest_Net_Sale + Previous_Net_Sale AS Total_Net_Sale FROM s0)")


for _dim in ("Brand", "Location", "Channel"):
    def _mk_dim(dim):
        def q(spark, sf):
            return pivot.dimension_date_summary(frames.synced(spark, sf), dim)
        q.__doc__ = f"P-06: {dim} × Date summary with differences and total."
        return q
    register(f"p06_{_dim.lower()}_date_summary", "P-06",
             with_ctes(*CMD, _dim_summary_sql(_dim), final="SELECT * FROM s"))(_mk_dim(_dim))


@register("h03_top_bottom_brand", "H-03", with_ctes(*CMD, _dim_summary_sql("Brand"), final="""
SELECT * FROM (SELECT *, 'Top' AS Rank_Group FROM s ORDER BY Total_Net_Sale DESC, Item ASC LIMIT 10)
UNION ALL
SELECT * FROM (SELECT *, 'Bottom' AS Rank_Group FROM s ORDER BY Total_Net_Sale ASC, Item DESC LIMIT 10)"""))
def h03_top_bottom_brand(spark, sf):
    return pivot.top_bottom(pivot.dimension_date_summary(frames.synced(spark, sf), "Brand"), 10)


@register("p10_best_worst_brand", "P-10", with_ctes(*CMD, _dim_summary_sql("Brand"), final="""
SELECT (SELECT Item FROM s ORDER BY Total_Net_Sale DESC, Item DESC LIMIT 1) AS Best_Item,
       (SELECT max(Total_Net_Sale) FROM s) AS Best_Total,
       (SELECT Item FROM s ORDER BY Total_Net_Sale ASC, Item ASC LIMIT 1) AS Worst_Item,
       (SELECT min(Total_Net_Sale) FROM s) AS Worst_Total,
       (SELECT max(Total_Net_Sale) - min(Total_Net_Sale) FROM s) AS Gap"""))
def p10_best_worst_brand(spark, sf):
    return pivot.best_worst(pivot.dimension_date_summary(frames.synced(spark, sf), "Brand"))


# P-07 / P-08 / H-04: combined-dimension changes ----------------------------------
def _changes_sql() -> str:
    dims = ["Location", "Brand", "Channel"]
    label = "concat_ws(' | ', " + ", ".join(f"'{d}: ' || CAST({d} AS VARCHAR)" for d in dims) + ")"
    pn, ln = NET.format(t="p"), NET.format(t="l")
    pd_, ld = DISC.format(t="p"), DISC.format(t="l")
    ppct, lpct = ratio_sql(pd_, "p_gross"), ratio_sql(ld, "l_gross")
    return (f"g AS ({two_date_sums_sql('synced', dims, False)}),\n"
            f"c AS (SELECT {label} AS Combined_Dimensions, Location, Brand, Channel, "
            f"{pn} AS Previous_Net_Sale, {ln} AS Latest_Net_Sale, {ln} - {pn} AS Net_Sale_Diff, "
            f"CASE WHEN {pn} > 0 THEN ({ln} - {pn}) / {pn} * 100 ELSE 0.0 END AS Net_Sale_Pct_Change, "
            f"{pd_} AS Previous_Discount, {ld} AS Latest_Discount, {ld} - {pd_} AS Discount_Diff, "
            f"{ppct} AS Previous_Discount_Pct, {lpct} AS Latest_Discount_Pct, "
            f"{lpct} - {ppct} AS Discount_Pct_Diff FROM g)")


CHANGES = [*CMD, _changes_sql()]


@register("p07_combined_changes", "P-07", with_ctes(*CHANGES, final="SELECT * FROM c"))
def p07_combined_changes(spark, sf):
    return pivot.combined_changes(frames.synced(spark, sf))


@register("p08_change_counts", "P-08", with_ctes(*CHANGES, final="""
SELECT count_if(Net_Sale_Diff < 0) AS Declines, count_if(Net_Sale_Diff > 0) AS Improvements,
       count(*) AS Combinations,
       (SELECT Combined_Dimensions FROM c WHERE Net_Sale_Diff < 0
        ORDER BY Net_Sale_Diff ASC, Combined_Dimensions ASC LIMIT 1) AS Worst_Decline,
       min(CASE WHEN Net_Sale_Diff < 0 THEN Net_Sale_Diff END) AS Worst_Decline_Value,
       (SELECT Combined_Dimensions FROM c WHERE Net_Sale_Diff > 0
        ORDER BY Net_Sale_Diff DESC, Combined_Dimensions ASC LIMIT 1) AS Best_Improvement,
       max(CASE WHEN Net_Sale_Diff > 0 THEN Net_Sale_Diff END) AS Best_Improvement_Value
FROM c"""))
def p08_change_counts(spark, sf):
    return pivot.change_counts(pivot.combined_changes(frames.synced(spark, sf)))


@register("h04_largest_declines", "H-04", with_ctes(*CHANGES, final="""
SELECT * FROM c WHERE Net_Sale_Diff < 0 ORDER BY Net_Sale_Diff ASC, Combined_Dimensions LIMIT 15"""))
def h04_largest_declines(spark, sf):
    return pivot.largest_changes(pivot.combined_changes(frames.synced(spark, sf)), "declines")


@register("h04_largest_improvements", "H-04", with_ctes(*CHANGES, final="""
SELECT * FROM c WHERE Net_Sale_Diff > 0 ORDER BY Net_Sale_Diff DESC, Combined_Dimensions LIMIT 15"""))
def h04_largest_improvements(spark, sf):
    return pivot.largest_changes(pivot.combined_changes(frames.synced(spark, sf)), "improvements")


@register("h04_largest_abs_changes", ("H-04", "F-15"), with_ctes(*CHANGES, final="""
SELECT *, abs(Net_Sale_Diff) AS Abs_Net_Sale_Diff FROM c
ORDER BY abs(Net_Sale_Diff) DESC, Combined_Dimensions LIMIT 20"""))
def h04_largest_abs_changes(spark, sf):
    return pivot.largest_changes(pivot.combined_changes(frames.synced(spark, sf)), "all")


# P-09: insights over the flagship -----------------------------------------------
_INSIGHTS_SQL = with_ctes(*CMD, _wide_sql("Channel"), """
per AS (SELECT Channel, Previous_Net_Sale + Latest_Net_Sale AS tot,
        CASE WHEN Previous_Net_Sale + Latest_Net_Sale <> 0
             THEN (Previous_Discount + Latest_Discount) / (Previous_Net_Sale + Latest_Net_Sale) * 100 END AS dpct,
        Net_Sale_Delta AS delta FROM w WHERE Channel <> 'Total')""", """
t AS (SELECT Previous_Date AS pdate, Latest_Date AS ldate, Previous_Net_Sale AS pt, Latest_Net_Sale AS lt
      FROM w WHERE Channel = 'Total')""", final="""
SELECT (SELECT Channel FROM per ORDER BY tot DESC, Channel LIMIT 1) AS Top_Channel,
       (SELECT max(tot) FROM per) AS Top_Channel_Sales,
       (SELECT Channel FROM per WHERE dpct IS NOT NULL ORDER BY dpct DESC, Channel LIMIT 1) AS Highest_Discount_Channel,
       (SELECT max(dpct) FROM per) AS Highest_Discount_Pct,
       CASE WHEN t.pdate IS NULL OR t.lt >= t.pt THEN t.ldate ELSE t.pdate END AS Best_Date,
       CASE WHEN t.pdate IS NULL THEN t.lt ELSE greatest(t.lt, t.pt) END AS Best_Date_Sales,
       (SELECT max(tot) FROM per) - (SELECT CASE WHEN count(*) >= 2 THEN min(tot) END
                                     FROM (SELECT tot FROM per ORDER BY tot DESC LIMIT 2)) AS Gap_To_Runner_Up,
       CASE WHEN t.pdate IS NULL THEN NULL
            WHEN greatest(t.lt, t.pt) > least(t.lt, t.pt) THEN 'increasing' ELSE 'decreasing' END AS Trend,
       (SELECT Channel FROM per ORDER BY delta DESC, Channel LIMIT 1) AS Best_Improvement,
       (SELECT max(delta) FROM per) AS Best_Improvement_Value,
       (SELECT Channel FROM per ORDER BY delta ASC, Channel LIMIT 1) AS Biggest_Decline,
       (SELECT min(delta) FROM per) AS Biggest_Decline_Value
FROM t""")


@register("p09_pivot_insights", "P-09", _INSIGHTS_SQL)
def p09_pivot_insights(spark, sf):
    return pivot.pivot_insights(pivot.two_date_pivot(frames.synced(spark, sf), "Channel"), "Channel")


@register("p11_heatmap_cells", "P-11", with_ctes(*KEPT, final=f"""
SELECT Channel, Date, CAST(SUM(net_sale_vat) AS DOUBLE) / 1.05 AS Net_Sale,
       CAST(SUM(calc_discount_vat) AS DOUBLE) / 1.05 AS Discount,
       {ratio_sql('CAST(SUM(calc_discount_vat) AS DOUBLE) / 1.05', 'SUM(GrossPrice)')} AS Discount_Pct,
       {cm_sql('(CAST(SUM(net_sale_vat) AS DOUBLE) / 1.05)', '(CAST(SUM(calc_discount_vat) AS DOUBLE) / 1.05)')} AS CM,
       COUNT(OrderID) AS Orders
FROM k WHERE Channel IS NOT NULL AND Date IS NOT NULL GROUP BY Channel, Date"""))
def p11_heatmap_cells(spark, sf):
    """P-11 over every date: the Channel × Date matrix without totals."""
    return pivot.channel_date_cells(frames.kept(spark, sf), "Channel")


#: The channels and weekdays that the driver tables hold; SQL must name its columns.
_CHANNELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _matrix_sql(row: str, col: str, labels: list[str], how: str, margins: bool) -> str:
    """Conditional aggregates over the orders, with the margins as further columns and a further row."""
    agg = {"sum": f"SUM(CASE WHEN {{}} THEN {VALUE} END)", "mean": f"AVG(CASE WHEN {{}} THEN {VALUE} END)"}[how]
    cells = [f"COALESCE({agg.format(f'{col} = {chr(39)}{x}{chr(39)}')}, 0) AS \"{x}\"" for x in labels] + ([f"COALESCE({agg.format('TRUE')}, 0) AS \"Total\""] if margins else [])
    src = f"FROM k WHERE {row} IS NOT NULL AND {col} IS NOT NULL"
    one = f"SELECT {row}, {', '.join(cells)} {src} GROUP BY {row}"
    return f"{one} UNION ALL SELECT 'Total', {', '.join(cells)} {src}" if margins else one


VALUE = "net_sale"

for _how in ("sum", "mean"):
    def _mk_wide(how):
        def q(spark, sf):
            long = pivot.general_pivot(frames.kept(spark, sf), ["Brand"], ["Channel"], "net_sale", how)
            return pivot.wide_matrix(long, ["Brand"], ["Channel"])
        q.__doc__ = f"P-04 as the wide table ({how}): brands by channels, with totals, missing cells 0."
        return q
    register(f"p04_wide_pivot_{_how}", "P-04", with_ctes(*KEPT, final=_matrix_sql("Brand", "Channel", _CHANNELS, _how, True)))(_mk_wide(_how))


@register("p11_heatmap_matrix", "P-11", with_ctes(*KEPT, final=_matrix_sql("Channel", "DayOfWeek", _WEEKDAYS, "sum", False)))
def p11_heatmap_matrix(spark, sf):
    """P-11: the heatmap as a matrix without totals, channels by weekdays."""
    k = frames.kept(spark, sf).where(F.col("Channel").isNotNull() & F.col("DayOfWeek").isNotNull())
    return pivot.wide_matrix(k.groupBy("Channel", "DayOfWeek").agg(F.sum("net_sale").alias("value")), ["Channel"], ["DayOfWeek"])

"""Channel × Date pivots, totals, period deltas and change rankings (P-01..P-11, H-03, H-04).

The dashboard builds three pivots and merges them by index; here one
conditional aggregation over the (already date-filtered) frame produces
every cell, so there is a single shuffle keyed on the row dimension.  The
two-date tables have a fixed schema (Previous_* / Latest_* / *_Delta)
whatever the dates are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.exprs import VAT_FACTOR, dbl, ratio
from tillpoint.operators.metrics import pivot_cm
from tillpoint.operators.params import date_lit, fetch, lit
from tillpoint.operators.ranking import grouped_quantile

TOTAL_LABEL = "Total"
DIMENSIONS = ("Location", "Brand", "Channel")


def _date_pair(df: DataFrame) -> tuple[Column, Column]:
    """(previous, latest) of the dates present; previous is null with one date."""
    p = fetch(df, lo=F.min("Date"), hi=F.max("Date"))
    lo = p["lo"] if p["lo"] != p["hi"] else None
    return date_lit(lo), date_lit(p["hi"])


def _sum_on(flag: str, value: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col(flag), F.col(value))), F.lit(0))


def _two_date_sums(df: DataFrame, dims: Sequence[str], totals: bool) -> tuple[DataFrame, Column, Column]:
    prev, latest = _date_pair(df)
    keyed = df
    for d in dims:
        keyed = keyed.where(F.col(d).isNotNull())
    # Flag the two dates in a projection: scalar subqueries may not sit inside
    # aggregate arguments.
    keyed = keyed.select(*dims, "net_sale_vat", "calc_discount_vat", "GrossPrice",
                         F.coalesce(F.col("Date") == prev, F.lit(False)).alias("_on_p"),
                         F.coalesce(F.col("Date") == latest, F.lit(False)).alias("_on_l"))
    aggs = [
        _sum_on("_on_p", "net_sale_vat").alias("_p_net"), _sum_on("_on_l", "net_sale_vat").alias("_l_net"),
        _sum_on("_on_p", "calc_discount_vat").alias("_p_cd"), _sum_on("_on_l", "calc_discount_vat").alias("_l_cd"),
        _sum_on("_on_p", "GrossPrice").alias("_p_gross"), _sum_on("_on_l", "GrossPrice").alias("_l_gross"),
    ]
    if totals:
        g = keyed.rollup(*dims).agg(*aggs, F.grouping_id().alias("_gid"))
        g = g.where((F.col("_gid") == 0) | (F.col("_gid") == (1 << len(dims)) - 1))
    else:
        g = keyed.groupBy(*dims).agg(*aggs, F.lit(0).alias("_gid"))
    return g, prev, latest


def two_date_pivot(df: DataFrame, dim: str = "Channel") -> DataFrame:
    """P-01 + P-02 + P-03, the command-centre table.

    Per ``dim`` value and per date: Net_Sale, Discount (calculated),
    Discount_Pct (discount / gross), CM; a Total row whose Discount_Pct is
    discount / net sale; and newer − older deltas of the four metrics.
    Missing cells are 0, as in a pivot with ``fill_value=0``.
    """
    g, prev, latest = _two_date_sums(df, [dim], totals=True)
    is_total = F.col("_gid") != 0
    cols = [F.when(is_total, F.lit(TOTAL_LABEL)).otherwise(F.col(dim).cast("string")).alias(dim),
            prev.alias("Previous_Date"), latest.alias("Latest_Date")]
    for side, tag in (("Previous", "_p"), ("Latest", "_l")):
        net = dbl(f"{tag}_net") / F.lit(VAT_FACTOR)
        disc = dbl(f"{tag}_cd") / F.lit(VAT_FACTOR)
        pct = F.when(is_total, F.when(net > 0, disc / net * 100).otherwise(F.lit(0.0))) \
               .otherwise(ratio(disc, dbl(f"{tag}_gross"), 100.0))
        cols += [net.alias(f"{side}_Net_Sale"), disc.alias(f"{side}_Discount"),
                 pct.alias(f"{side}_Discount_Pct"), pivot_cm(net, disc).alias(f"{side}_CM")]
    wide = g.select(*cols)
    for m in ("Net_Sale", "Discount", "Discount_Pct", "CM"):
        wide = wide.withColumn(f"{m}_Delta", F.col(f"Latest_{m}") - F.col(f"Previous_{m}"))
    # Row order is left to the presenter (Total last); a global sort of a
    # few rows would cost an extra sampling job.
    return wide


def pivot_long(table: DataFrame, dim: str = "Channel") -> DataFrame:
    """P-01 in long form: one row per (dim, date) cell of the two-date table."""
    metrics = ("Net_Sale", "Discount", "Discount_Pct", "CM")
    prev = table.select(dim, F.col("Previous_Date").alias("Date"),
                        *[F.col(f"Previous_{m}").alias(m) for m in metrics]).where(F.col("Date").isNotNull())
    latest = table.select(dim, F.col("Latest_Date").alias("Date"),
                          *[F.col(f"Latest_{m}").alias(m) for m in metrics])
    return prev.unionByName(latest)


#: Columns that a wide table may have.
MOST_COLUMNS = 1000


def wide_matrix(cells: DataFrame, rows: Sequence[str], cols: Sequence[str], value: str = "value", most: int = MOST_COLUMNS) -> DataFrame:
    """P-04 / P-11 as a wide table: a row for each ``rows`` value, a column for each ``cols`` value, missing cells 0.

    ``cells`` is in long form, a row a cell (``general_pivot``, margins and
    all).  The column labels are looked up first, at most ``most`` of them (more is
    an error, as no one could read them); with the labels known the pivot
    is one aggregate.  Several ``cols`` are joined by " | "; ``Total`` columns come last."""
    label = F.concat_ws(" | ", *[F.col(c).cast("string") for c in cols])
    cells = cells.withColumn("_label", label)
    found = [r[0] for r in cells.select("_label").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} columns: choose other column dimensions")
    if {*found} & {*rows}:
        raise ValueError(f"a column would be called as a row dimension: {sorted({*found} & {*rows})}")
    found.sort(key=lambda x: (x.split(" | ").count(TOTAL_LABEL), x))
    if not found:
        return cells.select(*rows).distinct()
    return cells.groupBy(*rows).pivot("_label", found).agg(F.first(value)).fillna(0, found)


def channel_date_cells(df: DataFrame, dim: str = "Channel") -> DataFrame:
    """P-11 / heatmap cells: per (dim, Date) net sale, discount, discount %, CM, orders."""
    g = (df.where(F.col(dim).isNotNull() & F.col("Date").isNotNull())
           .groupBy(dim, "Date")
           .agg(F.sum("net_sale_vat").alias("_net"), F.sum("calc_discount_vat").alias("_cd"),
                F.sum("GrossPrice").alias("_gross"), F.count("OrderID").alias("Orders")))
    net = dbl("_net") / F.lit(VAT_FACTOR)
    disc = dbl("_cd") / F.lit(VAT_FACTOR)
    return g.select(dim, "Date", net.alias("Net_Sale"), disc.alias("Discount"),
                    ratio(disc, "_gross", 100.0).alias("Discount_Pct"),
                    pivot_cm(net, disc).alias("CM"), "Orders")


def dimension_date_summary(df: DataFrame, dim: str) -> DataFrame:
    """P-06: per item of Brand / Location / Channel, both dates' net sale,
    discount and discount %, the newer − older differences, and the total."""
    g, prev, latest = _two_date_sums(df, [dim], totals=False)
    cols = [F.col(dim).cast("string").alias("Item")]
    for side, tag in (("Previous", "_p"), ("Latest", "_l")):
        net = dbl(f"{tag}_net") / F.lit(VAT_FACTOR)
        disc = dbl(f"{tag}_cd") / F.lit(VAT_FACTOR)
        cols += [net.alias(f"{side}_Net_Sale"), disc.alias(f"{side}_Discount"),
                 ratio(disc, dbl(f"{tag}_gross"), 100.0).alias(f"{side}_Discount_Pct")]
    out = g.select(*cols)
    return (out.withColumn("Net_Sale_Diff", F.col("Latest_Net_Sale") - F.col("Previous_Net_Sale"))
               .withColumn("Discount_Diff", F.col("Latest_Discount") - F.col("Previous_Discount"))
               .withColumn("Discount_Pct_Diff", F.col("Latest_Discount_Pct") - F.col("Previous_Discount_Pct"))
               .withColumn("Total_Net_Sale", F.col("Latest_Net_Sale") + F.col("Previous_Net_Sale")))


def top_bottom(summary: DataFrame, n: int = 10) -> DataFrame:
    """H-03: top n and bottom n items by total net sale (ties by item)."""
    top = (summary.orderBy(F.col("Total_Net_Sale").desc(), F.col("Item")).limit(n)
                  .withColumn("Rank_Group", F.lit("Top")))
    bottom = (summary.orderBy(F.col("Total_Net_Sale").asc(), F.col("Item").desc()).limit(n)
                     .withColumn("Rank_Group", F.lit("Bottom")))
    return top.unionByName(bottom)


def best_worst(summary: DataFrame) -> DataFrame:
    """P-10: best and worst item by total net sale and the gap between them."""
    best = F.max_by("Item", F.struct(F.col("Total_Net_Sale"), F.col("Item")))
    worst = F.min_by("Item", F.struct(F.col("Total_Net_Sale"), F.col("Item")))
    return summary.agg(best.alias("Best_Item"), F.max("Total_Net_Sale").alias("Best_Total"),
                       worst.alias("Worst_Item"), F.min("Total_Net_Sale").alias("Worst_Total")) \
                  .withColumn("Gap", F.col("Best_Total") - F.col("Worst_Total"))


def combined_changes(df: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """P-07: change per combination of the dimensions between the two dates."""
    dims = [d for d in dims if d in df.columns]
    g, prev, latest = _two_date_sums(df, dims, totals=False)
    label = F.concat_ws(" | ", *[F.concat(F.lit(f"{d}: "), F.col(d).cast("string")) for d in dims])
    pn = dbl("_p_net") / F.lit(VAT_FACTOR)
    ln = dbl("_l_net") / F.lit(VAT_FACTOR)
    pd_ = dbl("_p_cd") / F.lit(VAT_FACTOR)
    ld = dbl("_l_cd") / F.lit(VAT_FACTOR)
    ppct = ratio(pd_, dbl("_p_gross"), 100.0)
    lpct = ratio(ld, dbl("_l_gross"), 100.0)
    return g.select(
        label.alias("Combined_Dimensions"), *dims,
        pn.alias("Previous_Net_Sale"), ln.alias("Latest_Net_Sale"), (ln - pn).alias("Net_Sale_Diff"),
        F.when(pn > 0, (ln - pn) / pn * 100).otherwise(F.lit(0.0)).alias("Net_Sale_Pct_Change"),
        pd_.alias("Previous_Discount"), ld.alias("Latest_Discount"), (ld - pd_).alias("Discount_Diff"),
        ppct.alias("Previous_Discount_Pct"), lpct.alias("Latest_Discount_Pct"),
        (lpct - ppct).alias("Discount_Pct_Diff"))


def change_counts(changes: DataFrame) -> DataFrame:
    """P-08: declines, improvements, total, worst and best combination."""
    d = F.col("Net_Sale_Diff")
    lab = F.col("Combined_Dimensions")
    return changes.agg(
        F.count_if(d < 0).alias("Declines"), F.count_if(d > 0).alias("Improvements"),
        F.count(F.lit(1)).alias("Combinations"),
        F.min_by(lab, F.when(d < 0, F.struct(d, lab))).alias("Worst_Decline"),
        F.min(F.when(d < 0, d)).alias("Worst_Decline_Value"),
        F.min_by(lab, F.when(d > 0, F.struct(-d, lab))).alias("Best_Improvement"),
        F.max(F.when(d > 0, d)).alias("Best_Improvement_Value"))


def largest_changes(changes: DataFrame, kind: str) -> DataFrame:
    """H-04: 15 largest declines, 15 largest improvements or 20 largest |changes|."""
    d = F.col("Net_Sale_Diff")
    if kind == "declines":
        return changes.where(d < 0).orderBy(d.asc(), "Combined_Dimensions").limit(15)
    if kind == "improvements":
        return changes.where(d > 0).orderBy(d.desc(), "Combined_Dimensions").limit(15)
    return (changes.withColumn("Abs_Net_Sale_Diff", F.abs(d))
                   .orderBy(F.col("Abs_Net_Sale_Diff").desc(), "Combined_Dimensions").limit(20))


def pivot_insights(table: DataFrame, dim: str = "Channel") -> DataFrame:
    """P-09: one-row insight set over the two-date table.  Channel facts
    exclude the Total row; date facts use it.  Ties go to the smaller name."""
    rows = table.where(F.col(dim) != F.lit(TOTAL_LABEL))
    total = F.col("Previous_Net_Sale") + F.col("Latest_Net_Sale")
    disc = F.col("Previous_Discount") + F.col("Latest_Discount")
    per = rows.select(dim, total.alias("_tot"),
                      F.when(total != 0, disc / total * 100).alias("_dpct"),
                      F.col("Net_Sale_Delta").alias("_delta"))
    second = lit(fetch(per.select("_tot").orderBy(F.col("_tot").desc()).limit(2),
                       v=F.when(F.count(F.lit(1)) >= 2, F.min("_tot")))["v"]).cast("double")
    t = fetch(table.where(F.col(dim) == F.lit(TOTAL_LABEL)), pd=F.max("Previous_Date"),
              ld=F.max("Latest_Date"), pt=F.max("Previous_Net_Sale"), lt=F.max("Latest_Net_Sale"))
    prev_date, latest_date = date_lit(t["pd"]), date_lit(t["ld"])
    pt, lt = lit(t["pt"]).cast("double"), lit(t["lt"]).cast("double")
    best_date = F.when(prev_date.isNull() | (lt >= pt), latest_date).otherwise(prev_date)
    best_sales = F.when(prev_date.isNull(), lt).otherwise(F.greatest(lt, pt))
    trend = (F.when(prev_date.isNull(), F.lit(None).cast("string"))
              .when(F.greatest(lt, pt) > F.least(lt, pt), F.lit("increasing"))
              .otherwise(F.lit("decreasing")))
    top_sales = F.max("_tot")
    return per.agg(
        F.min_by(dim, F.struct(-F.col("_tot"), F.col(dim))).alias("Top_Channel"),
        top_sales.alias("Top_Channel_Sales"),
        F.min_by(dim, F.when(F.col("_dpct").isNotNull(), F.struct(-F.col("_dpct"), F.col(dim))))
        .alias("Highest_Discount_Channel"),
        F.max("_dpct").alias("Highest_Discount_Pct"),
        best_date.alias("Best_Date"), best_sales.alias("Best_Date_Sales"),
        (top_sales - second).alias("Gap_To_Runner_Up"),
        trend.alias("Trend"),
        F.min_by(dim, F.struct(-F.col("_delta"), F.col(dim))).alias("Best_Improvement"),
        F.max("_delta").alias("Best_Improvement_Value"),
        F.min_by(dim, F.struct(F.col("_delta"), F.col(dim))).alias("Biggest_Decline"),
        F.min("_delta").alias("Biggest_Decline_Value"))


AGGREGATIONS = ("sum", "mean", "count", "median", "std", "min", "max")


def _agg_expr(value: str, how: str) -> Column:
    v = dbl(value)
    return {"sum": F.sum(v), "mean": F.avg(v), "count": F.count(v).cast("double"),
            "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}[how]


def general_pivot(df: DataFrame, rows: Sequence[str], cols: Sequence[str], value: str,
                  how: str = "sum") -> DataFrame:
    """P-04: pivot of ``value`` by ``rows`` × ``cols`` with grand-total margins
    computed from the raw rows (GROUPING SETS), in long form.

    Dimension columns are strings; a margin carries ``Total`` in the
    dimensions it aggregates away.  Null dimension values are dropped, as in
    a pandas pivot.  ``median`` uses the distributed exact quantile.
    """
    rows, cols = list(rows), list(cols)
    dims = rows + cols
    keyed = df
    for d in dims:
        keyed = keyed.where(F.col(d).isNotNull())
    keyed = keyed.select(*[F.col(d).cast("string").alias(d) for d in dims], F.col(value))
    sets = []
    for st in (dims, rows, cols, []):
        if st not in sets:
            sets.append(st)
    if how == "median":
        # One ranked pass for every margin: expand each row into its grouping
        # sets (as Spark's Expand does for GROUPING SETS), then rank per set.
        expanded = keyed.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("_set"), *[(F.col(d) if d in st else F.lit(TOTAL_LABEL)).alias(d)
                                                for d in dims], F.col(value).alias("_v"))
            for i, st in enumerate(sets)])).alias("r")).select("r.*")
        q = grouped_quantile(expanded, ["_set", *dims], "_v", 0.5, "value")
        return q.select(*dims, "value")
    # One Expand + one shuffle for all margins (GROUPING SETS).
    g = keyed.groupingSets([list(st) for st in sets], *dims).agg(
        _agg_expr(value, how).alias("value"), *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    return g.select(*[F.when(F.col(f"_g_{d}") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col(d)).alias(d)
                      for d in dims], "value")


def group_summary(df: DataFrame, rows: Sequence[str], value: str, how: str = "sum", digits: int = 2) -> DataFrame:
    """P-05: group-by without columns, values rounded to ``digits``."""
    rows = list(rows)
    keyed = df
    for d in rows:
        keyed = keyed.where(F.col(d).isNotNull())
    if how == "median":
        out = grouped_quantile(keyed, rows, value, 0.5, value)
    else:
        out = keyed.groupBy(*rows).agg(_agg_expr(value, how).alias(value))
    return out.select(*rows, F.round(value, digits).alias(value))

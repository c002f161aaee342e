"""Date selection and time-synchronised cuts (B-05, B-07..B-09, G-01..G-05, E-03..E-05).

Data-dependent parameters (latest date, cut-off time, tie counts) are fetched
with one small aggregate per step and inlined as literals (``params``), so the
date filters reach the Parquet scan and prune ``Date`` partitions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions.exprs import floor_minute, seconds_of_day
from tillpoint.operators.params import date_lit, fetch, ts_lit
from tillpoint.operators.ranking import global_rank


def drop_fully_discounted(df: DataFrame) -> DataFrame:
    """B-05: keep rows whose gross differs from the discount (drops 0/0 too).

    pandas keeps a row when either side is missing (NaN != x is True)."""
    return df.where(F.coalesce(F.col("GrossPrice") != F.col("Discount"), F.lit(True)))


def end_days(df: DataFrame, n: int = 2, latest: bool = True) -> list[dt.date]:
    """The ``n`` latest dates, newest first, or the ``n`` earliest, oldest first.

    On a month-partitioned table the months come from partition values alone,
    and ``Date`` is read from the last (or first) month on, one more month at
    a time until ``n`` dates are found."""
    date, month = F.col("Date"), F.col("Month")

    def first(part: DataFrame) -> list[dt.date]:
        rows = part.select("Date").where(date.isNotNull()).distinct().orderBy(date.desc() if latest else date.asc()).limit(n)
        return [r[0] for r in rows.collect()]
    if "Month" not in df.columns:
        return first(df)
    end = F.max("Month") if latest else F.min("Month")
    found: list[dt.date] = []
    m = fetch(df.select("Month"), m=end)["m"]
    while m is not None and len(found) < n:
        found += first(df.where(month == F.lit(m)))
        m = fetch(df.where(month < F.lit(m) if latest else month > F.lit(m)).select("Month"), m=end)["m"]
    return found[:n]


def latest_days(df: DataFrame, n: int = 2) -> list[dt.date]:
    return end_days(df, n)


def latest_date(df: DataFrame) -> Column:
    days = latest_days(df, 1)
    return date_lit(days[0] if days else None)


def default_date_pair(df: DataFrame, table: DataFrame | None = None) -> tuple[Column, Column]:
    """B-08: (latest − 1 day clamped to the first date, latest).

    With ``table`` (the unfiltered month-partitioned table ``df`` derives
    from), the first and last months come from partition values alone and
    ``Date`` is read only inside those two months; if a bracket month holds
    no qualifying row, the whole column is scanned instead."""
    p = None
    if table is not None and "Month" in table.columns and "Month" in df.columns:
        m = fetch(table.select("Month"), lo=F.min("Month"), hi=F.max("Month"))
        if m["hi"] is not None:
            latest = fetch(df.where(F.col("Month") == m["hi"]), d=F.max("Date"))["d"]
            first = fetch(df.where(F.col("Month") == m["lo"]), d=F.min("Date"))["d"]
            if latest is not None and first is not None:
                p = {"latest": latest, "first": first}
    if p is None:
        p = fetch(df, latest=F.max("Date"), first=F.min("Date"))
    latest = date_lit(p["latest"])
    return F.greatest(F.date_sub(latest, 1), date_lit(p["first"])), latest


def last_two(df: DataFrame) -> dict:
    """Latest date, the latest date before it, and the last instant of the latest date."""
    days = latest_days(df)
    latest, prev = (days + [None, None])[:2]
    max_ts = fetch(on_dates(df, [date_lit(latest)]), t=F.max("ReceivedAt"))["t"] if latest else None
    return {"latest": latest, "prev": prev, "max_ts": max_ts}


def _month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def on_dates(df: DataFrame, dates: Sequence[Column | str]) -> DataFrame:
    """B-07: exactly these dates, not the range between them.

    On a month-partitioned table the matching months are added as a
    predicate too, so the scan prunes partitions."""
    vals = [F.lit(d).cast("date") if isinstance(d, str) else d for d in dates]
    out = df.where(F.col("Date").isin(*vals))
    if "Month" in df.columns:
        out = out.where(F.col("Month").isin(*[_month(v) for v in vals]))
    return out


def between_dates(df: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """B-03: inclusive date range (plus the month range for partition pruning)."""
    s = F.lit(start).cast("date") if isinstance(start, str) else start
    e = F.lit(end).cast("date") if isinstance(end, str) else end
    out = df.where(F.col("Date").between(s, e))
    if "Month" in df.columns:
        out = out.where(F.col("Month").between(_month(s), _month(e)))
    return out


def hour_ceiling(df: DataFrame, max_hour: int) -> DataFrame:
    """B-09."""
    return df.where(F.col("Hour") <= F.lit(max_hour))


def cap_ties(df: DataFrame, limit: Column, order_key: str = "OrderID") -> DataFrame:
    """E-05: keep the first ``limit`` rows in ``order_key`` order.

    Ranked with the distributed global rank, so even a timestamp shared by a
    large share of rows is not funnelled through one task."""
    ranked = global_rank(df, [order_key], "_tie_rank")
    return ranked.where(F.col("_tie_rank") <= limit).drop("_tie_rank")


def exact_sync(df: DataFrame) -> DataFrame:
    """G-02 / G-03: per-date cut so partial days compare like with like.

    Exactly two dates: the newer day is kept whole (up to its own last
    order); the older day up to the same time of day, and at that exact
    instant no more rows than the newer day has at its last instant.
    Any other number of dates: each date up to its last order, floored to
    the minute.
    """
    ts, day = F.col("ReceivedAt"), F.col("Date")
    if len(latest_days(df, 3)) == 2:
        p = last_two(df)
        latest, prev, max_ts = p["latest"], p["prev"], p["max_ts"]
        cutoff = dt.datetime.combine(prev, max_ts.time())
        c = fetch(df.where((ts == ts_lit(max_ts)) | (ts == ts_lit(cutoff))),
                  at_max=F.count_if(ts == ts_lit(max_ts)), at_cut=F.count_if(ts == ts_lit(cutoff)))
        on_prev_at_cut = (day == date_lit(prev)) & (ts == ts_lit(cutoff))
        if c["at_cut"] <= c["at_max"]:
            # No excess rows at the cut-off instant: a plain filter suffices.
            return df.where((day == date_lit(latest)) | ((day == date_lit(prev)) & (ts <= ts_lit(cutoff))))
        kept = df.where((day == date_lit(latest)) | ((day == date_lit(prev)) & (ts < ts_lit(cutoff))))
        return kept.unionByName(cap_ties(df.where(on_prev_at_cut), F.lit(c["at_max"])))
    return single_date_sync(df)


def latest_two_dates(df: DataFrame) -> DataFrame:
    """E-03: the latest and second-latest dates present, with their rank."""
    days = df.select("Date").where(F.col("Date").isNotNull()).distinct()
    w = Window.orderBy(F.col("Date").desc())
    return (days.orderBy(F.col("Date").desc()).limit(2)
                .withColumn("date_rank", F.row_number().over(w).cast("long")))


def time_synced_comparison(df: DataFrame) -> DataFrame:
    """G-01: latest day vs the previous available day up to the same time of day.

    Rows: Orders, net_sale, Calculated_Discount, Profit_Margin (sums);
    Delta = latest − previous; Pct_Change = Delta / previous (0 → 1) · 100.
    """
    p = last_two(df)
    latest, prev = date_lit(p["latest"]), date_lit(p["prev"])
    tod = seconds_of_day(ts_lit(p["max_ts"]))
    day = F.col("Date")
    in_latest = day == latest
    in_prev = (day == prev) & (seconds_of_day("ReceivedAt") <= tod)
    scoped = on_dates(df, [latest, prev]).where(in_latest | in_prev).withColumn("_is_latest", in_latest)
    il = F.col("_is_latest")
    agg = scoped.agg(
        F.count_if(il).cast("double").alias("L_Orders"),
        F.count_if(~il).cast("double").alias("P_Orders"),
        (F.sum(F.when(il, F.col("net_sale_vat"))).cast("double") / 1.05).alias("L_net_sale"),
        (F.sum(F.when(~il, F.col("net_sale_vat"))).cast("double") / 1.05).alias("P_net_sale"),
        (F.sum(F.when(il, F.col("calc_discount_vat"))).cast("double") / 1.05).alias("L_Calculated_Discount"),
        (F.sum(F.when(~il, F.col("calc_discount_vat"))).cast("double") / 1.05).alias("P_Calculated_Discount"),
        F.sum(F.when(il, F.col("Profit_Margin"))).alias("L_Profit_Margin"),
        F.sum(F.when(~il, F.col("Profit_Margin"))).alias("P_Profit_Margin"),
    )
    metrics = ["Orders", "net_sale", "Calculated_Discount", "Profit_Margin"]
    stack = "stack(4, " + ", ".join(
        f"'{m}', coalesce(L_{m}, 0D), coalesce(P_{m}, 0D)" for m in metrics) + ") as (Metric, Latest, Previous_Synced)"
    long = agg.selectExpr(stack)
    delta = F.col("Latest") - F.col("Previous_Synced")
    base = F.when(F.col("Previous_Synced") == 0, F.lit(1.0)).otherwise(F.col("Previous_Synced"))
    return long.select(
        latest.alias("Latest_Date"), prev.alias("Previous_Date"), "Metric", "Latest",
        "Previous_Synced", delta.alias("Delta"), (delta / base * 100).alias("Pct_Change"))


def single_date_sync(df: DataFrame) -> DataFrame:
    """G-03 alone: every date up to its own last order, floored to the minute."""
    day_max = df.groupBy("Date").agg(F.max("ReceivedAt").alias("_day_max"))
    return (df.join(day_max, "Date").where(F.col("ReceivedAt") <= floor_minute("_day_max"))
              .drop("_day_max"))


def same_day_projection(df: DataFrame) -> DataFrame:
    """G-04: previous full day + (today so far − previous day up to the same
    time of day).  The time-of-day comparison is the intended rule."""
    p = last_two(df)
    latest, prev = date_lit(p["latest"]), date_lit(p["prev"])
    tod = seconds_of_day(ts_lit(p["max_ts"]))
    day = F.col("Date")
    v = F.col("net_sale_vat")
    agg = on_dates(df, [latest, prev]).agg(
        F.coalesce(F.sum(F.when(day == prev, v)), F.lit(0)).alias("_prev_full"),
        F.coalesce(F.sum(F.when(day == latest, v)), F.lit(0)).alias("_today"),
        F.coalesce(F.sum(F.when((day == prev) & (seconds_of_day("ReceivedAt") <= tod), v)), F.lit(0))
        .alias("_prev_same"))
    prev_full = F.col("_prev_full").cast("double") / 1.05
    diff = (F.col("_today") - F.col("_prev_same")).cast("double") / 1.05
    # Below two dates there is nothing to project from.
    return agg.where(F.lit(p["prev"] is not None)).select(latest.alias("Latest_Date"), prev.alias("Previous_Date"),
                      (prev_full + diff).alias("Prediction"),
                      prev_full.alias("Previous_Day_Net_Sale"), diff.alias("Net_Sale_Diff"))


def daily_series(df: DataFrame) -> DataFrame:
    """D-02: net sale, order count and calculated discount per date."""
    return (df.where(F.col("Date").isNotNull()).groupBy("Date")
              .agg((F.sum("net_sale_vat").cast("double") / 1.05).alias("net_sale"),
                   F.count("OrderID").alias("orders"),
                   (F.sum("calc_discount_vat").cast("double") / 1.05).alias("discount")))


def trend_prediction(df: DataFrame, min_rows: int = 7) -> DataFrame:
    """G-05 with E-04: mean daily net sale, discount and orders scaled by the
    trend factor (mean of the last 7 days / the 7 before; 1 below 14 days or
    when the earlier mean is not positive).  Empty below ``min_rows`` orders."""
    days = daily_series(df)
    w = Window.orderBy(F.col("Date").desc())
    # The daily series has one row per calendar day: a bounded, small input.
    ranked = days.withColumn("_r", F.row_number().over(w))
    agg = ranked.agg(
        F.avg("net_sale").alias("avg_net_sale"),
        F.avg("discount").alias("avg_discount"),
        F.avg("orders").alias("avg_orders"),
        F.count(F.lit(1)).alias("n_days"),
        F.avg(F.when(F.col("_r") <= 7, F.col("net_sale"))).alias("recent_avg"),
        F.avg(F.when((F.col("_r") > 7) & (F.col("_r") <= 14), F.col("net_sale"))).alias("previous_avg"))
    n_rows = fetch(df, n=F.count(F.lit(1)))["n"]
    factor = (F.when((F.col("n_days") >= 14) & (F.col("previous_avg") > 0),
                     F.col("recent_avg") / F.col("previous_avg")).otherwise(F.lit(1.0)))
    out = agg.where(F.lit(n_rows >= min_rows)).withColumn("trend_factor", factor)
    pn = F.col("avg_net_sale") * F.col("trend_factor")
    pd_ = F.col("avg_discount") * F.col("trend_factor")
    return out.select(
        F.col("n_days"), F.col("trend_factor"),
        pn.alias("predicted_net_sale"), pd_.alias("predicted_discount"),
        (F.col("avg_orders") * F.col("trend_factor")).alias("predicted_orders"),
        F.when(pn + pd_ > 0, pd_ / (pn + pd_) * 100).otherwise(F.lit(0.0)).alias("predicted_discount_pct"))


def last_vs_previous_week(df: DataFrame) -> DataFrame:
    """E-04: mean daily net sale of the last 7 days and of the 7 before."""
    days = daily_series(df)
    w = Window.orderBy(F.col("Date").desc())
    ranked = days.withColumn("_r", F.row_number().over(w))
    return ranked.agg(
        F.avg(F.when(F.col("_r") <= 7, F.col("net_sale"))).alias("recent_avg"),
        F.avg(F.when((F.col("_r") > 7) & (F.col("_r") <= 14), F.col("net_sale"))).alias("previous_avg"))


def month_to_date(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """B-10: from the first of ``as_of``'s month through ``as_of`` (default: latest date)."""
    as_of = latest_date(df) if as_of is None else as_of
    return between_dates(df, F.trunc(as_of, "month"), as_of)

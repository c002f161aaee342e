"""Unit tests on hand-made frames: bin edges, zero gross, null keys, ties, empty input."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fixtures import orders
from tillpoint.functions import discounts as dg
from tillpoint.functions.exprs import elapsed_days, equal_width_bin, fixed_bins, floor_minute, ratio
from tillpoint.operators import customers as cu
from tillpoint.operators import pivot, sync
from tillpoint.operators.enrich import (TIME_PERIOD_EDGES, TIME_PERIOD_LABELS, with_essential_columns,
                                        with_extended_columns)
from tillpoint.operators.ranking import exact_quantile, global_rank, grouped_quantile
from tillpoint.sources import landing
from tillpoint.sources.sink import replace_by_day


def test_order_size_bin_edges(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (75.0,), (150.0,), (150.01,), (-1.0,)], "x double")
    got = [r[0] for r in df.select(fixed_bins("x", [0, 25, 75, 150, float("inf")],
                                              ["Small", "Medium", "Large", "XLarge"])).collect()]
    assert got == [None, "Small", "Medium", "Large", "XLarge", None]


def test_time_period_include_lowest(spark):
    df = spark.createDataFrame([(h,) for h in (0, 6, 7, 12, 18, 23)], "h int")
    got = [r[0] for r in df.select(fixed_bins("h", TIME_PERIOD_EDGES, TIME_PERIOD_LABELS, True)).collect()]
    assert got == ["Night", "Night", "Morning", "Morning", "Afternoon", "Evening"]


def test_guarded_ratio(spark):
    df = spark.createDataFrame([(5.0, 0.0), (1.0, 4.0), (None, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(ratio("a", "b", 100.0)).collect()]
    assert got == [0.0, 25.0, None] or got == [0.0, 25.0, 0.0]


def test_discount_group_lookup(spark):
    df = orders(spark, [{"DiscountCode": " 100% staff meal "}, {"DiscountCode": "Discount"},
                        {"DiscountCode": None}, {"DiscountCode": "ZZZ"}, {"DiscountCode": "talabat 20%"}])
    got = [r[0] for r in dg.with_discount_group(df).orderBy("OrderID").select("Discount_Group").collect()]
    # 'Discount' is listed in both groups: the later group wins.
    assert got == [dg.STAFF_GROUP, dg.AGG_GROUP, "None", "Other", dg.AGG_GROUP]


def test_group_table_counts():
    pairs = dg.group_pairs()
    assert len(pairs) == 758
    groups = [g for _, g in pairs]
    assert groups.count(dg.AGG_GROUP) == 562


def test_prefix_groups(spark):
    df = spark.createDataFrame([("emp10",), ("PROMO5",), (None,), ("xyz",), ("Birthday",)], "DiscountCode string")
    got = [r[0] for r in df.select(dg.prefix_group()).collect()]
    assert got == ["Employee", "Promotion", "None", "Other", "Birthday"]


def test_essential_money_rules(spark):
    df = orders(spark, [
        {"GrossPrice": 80, "Discount": 80, "DiscountCode": "100% Staff Meal"},
        {"GrossPrice": 0, "Discount": 0},
        {"GrossPrice": 0, "Discount": 5},
        {"GrossPrice": 105, "Discount": 21, "Channel": "Talabat", "Brand": "Manoushe Street",
         "DiscountCode": "Disc_20"},
        {"GrossPrice": 105, "Discount": 21, "DiscountCode": "Disc_20"},
    ])
    e = with_essential_columns(df).orderBy(F.col("OrderID").cast("int"))
    rows = e.select("net_sale", "Calculated_Discount", "Profit_Margin", "Discount_Percentage").collect()
    assert rows[0]["net_sale"] == 0.0 and rows[0]["Calculated_Discount"] == 0.0
    assert rows[1]["Profit_Margin"] == 0.0 and rows[1]["Discount_Percentage"] == 0.0
    assert rows[2]["Discount_Percentage"] == 0.0          # zero gross, non-zero discount
    assert rows[3]["Calculated_Discount"] == pytest.approx(21 / 1.05 / 2)
    assert rows[4]["Calculated_Discount"] == pytest.approx(21 / 1.05)
    assert rows[4]["net_sale"] == pytest.approx(100.0)


def test_drop_fully_discounted(spark):
    df = orders(spark, [{"GrossPrice": 80, "Discount": 80}, {"GrossPrice": 0, "Discount": 0},
                        {"GrossPrice": 10, "Discount": 1}])
    assert sync.drop_fully_discounted(df).count() == 1


@pytest.mark.parametrize("values,n", [
    ([1.0, 2.0, 3.0, 10.0, 7.5], 3),
    ([5.0, 5.0, 5.0], 3),
    ([0.0, 0.0], 5),
    ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 5),
    ([-3.0, 0.0, 2.5, 9.0], 4),
])
def test_equal_width_bins_match_pandas(spark, values, n):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    lo, hi = min(values), max(values)
    got = [r[0] for r in df.select(equal_width_bin("x", F.lit(float(lo)), F.lit(float(hi)), n)).collect()]
    want = list(pd.cut(pd.Series(values, dtype=float), bins=n, labels=list(range(1, n + 1))).astype(int))
    assert got == want


def test_exact_quantile_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(100, 30, 1001).round(2)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(7)
    for p in (0.25, 0.5, 0.8):
        got = exact_quantile(df, "v", p).first()[0]
        assert got == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-12)


def test_global_rank_is_row_number(spark):
    df = spark.range(0, 500).select((F.col("id") % 37).alias("k"), F.col("id")).repartition(5)
    r = global_rank(df, ["k", "id"], "rk")
    w = Window.orderBy("k", "id")
    chk = r.withColumn("rn", F.row_number().over(w))
    assert chk.where(F.col("rk") != F.col("rn")).count() == 0


def test_grouped_quantiles_in_a_union(spark):
    """Partition-tagged ranks must stay right when several land in one Union."""
    df = spark.range(0, 600).select((F.col("id") % 3).cast("string").alias("g"),
                                    (F.col("id") % 2).cast("string").alias("h"), F.rand(3).alias("v"))
    a = grouped_quantile(df, ["g", "h"], "v", 0.5, "m")
    b = grouped_quantile(df, ["g"], "v", 0.5, "m").withColumn("h", F.lit("all"))
    u = a.unionByName(b)
    ref = df.groupBy("g", "h").agg(F.median("v").alias("m2")).unionByName(
        df.groupBy("g").agg(F.median("v").alias("m2")).withColumn("h", F.lit("all")))
    j = u.join(ref, ["g", "h"])
    assert j.count() == 9
    assert j.where(F.abs(F.col("m") - F.col("m2")) > 1e-12).count() == 0


def test_sync_caps_ties_at_cutoff(spark):
    cut = "2024-01-01 10:00:00"
    df = orders(spark, [
        {"OrderID": 1, "ReceivedAt": cut}, {"OrderID": 2, "ReceivedAt": cut}, {"OrderID": 3, "ReceivedAt": cut},
        {"OrderID": 4, "ReceivedAt": "2024-01-01 09:00:00"}, {"OrderID": 5, "ReceivedAt": "2024-01-01 11:00:00"},
        {"OrderID": 6, "ReceivedAt": "2024-01-02 10:00:00"}, {"OrderID": 7, "ReceivedAt": "2024-01-02 08:00:00"},
    ])
    e = with_essential_columns(df)
    kept = sorted(int(r[0]) for r in sync.exact_sync(e).select("OrderID").collect())
    # previous day: before the cut-off, plus one of the three at it (latest has one at its max)
    assert kept == [1, 4, 6, 7]


def test_single_date_minute_floor(spark):
    df = orders(spark, [{"ReceivedAt": "2024-01-02 10:15:30"}, {"ReceivedAt": "2024-01-02 10:15:00"},
                        {"ReceivedAt": "2024-01-02 10:14:59"}])
    e = with_essential_columns(df)
    assert sync.exact_sync(e).count() == 2


def test_two_date_pivot_totals_and_deltas(spark):
    df = orders(spark, [
        {"Channel": "A", "ReceivedAt": "2024-01-01 09:00:00", "GrossPrice": 105, "Discount": 10.5,
         "DiscountCode": "Disc_20"},
        {"Channel": "B", "ReceivedAt": "2024-01-01 09:30:00", "GrossPrice": 210},
        {"Channel": "A", "ReceivedAt": "2024-01-02 10:00:00", "GrossPrice": 315},
    ])
    t = pivot.two_date_pivot(with_essential_columns(df), "Channel")
    rows = {r["Channel"]: r for r in t.collect()}
    assert rows["B"]["Latest_Net_Sale"] == 0.0                 # missing cell is 0
    assert rows["Total"]["Previous_Net_Sale"] == pytest.approx(300.0)
    assert rows["Total"]["Previous_Discount_Pct"] == pytest.approx(10.0 / 300.0 * 100)
    assert rows["A"]["Previous_Discount_Pct"] == pytest.approx(10.0 / 105.0 * 100)
    assert rows["Total"]["Net_Sale_Delta"] == pytest.approx(0.0)
    cm = rows["A"]["Latest_CM"]
    assert cm == pytest.approx(300 - 300 * 0.206 - 300 * 0.24)
    # totals equal the sum of the parts
    parts = sum(r["Previous_Net_Sale"] for k, r in rows.items() if k != "Total")
    assert parts == pytest.approx(rows["Total"]["Previous_Net_Sale"])


def test_elapsed_days_floors(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 3, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(elapsed_days("a", "b")).first()[0] == 1


def test_floor_minute_keeps_ntz(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, 11, 12, 500000),)], "t timestamp_ntz")
    r = df.select(floor_minute("t").alias("m"))
    assert str(r.schema["m"].dataType) == "TimestampNTZType()"
    assert r.first()[0] == dt.datetime(2024, 1, 1, 10, 11)


def test_rfm_segment_precedence(spark):
    df = spark.createDataFrame([("155",), ("555",), ("331",), ("999",)], "RFM_Score string")
    got = [r[0] for r in df.select(cu.rfm_segment()).collect()]
    assert got == ["At Risk", "Champions", "Hibernating", "Others"]


def test_clv_equals_revenue(spark):
    df = orders(spark, [{"CustomerName": "a", "ReceivedAt": "2024-01-01 10:00:00", "GrossPrice": 105},
                        {"CustomerName": "a", "ReceivedAt": "2024-03-01 10:00:00", "GrossPrice": 210},
                        {"CustomerName": "b", "ReceivedAt": "2024-02-01 10:00:00", "GrossPrice": 52.5}])
    t = cu.clv(with_essential_columns(df))
    for r in t.collect():
        assert r["clv"] == pytest.approx(r["total_revenue"])


def test_extended_columns_customer_stats(spark):
    df = orders(spark, [{"CustomerName": "a", "GrossPrice": 105}, {"CustomerName": "a", "GrossPrice": 210},
                        {"CustomerName": None, "GrossPrice": 105}])
    x = with_extended_columns(df).orderBy(F.col("OrderID").cast("int")).collect()
    assert x[0]["Customer_Order_Count"] == 2 and x[0]["Customer_Total_Spent"] == pytest.approx(300.0)
    assert x[2]["Customer_Order_Count"] is None and x[2]["Premium_Customer"] is False


def test_replace_by_day(spark):
    old = orders(spark, [{"OrderID": 1, "ReceivedAt": "2024-01-01 10:00:00"},
                         {"OrderID": 2, "ReceivedAt": "2024-01-02 10:00:00"},
                         {"OrderID": 3, "ReceivedAt": "2024-01-02 11:00:00"}])
    batch = orders(spark, [{"OrderID": 9, "ReceivedAt": "2024-01-02 12:00:00"}])
    got = sorted(int(r[0]) for r in replace_by_day(old, batch).select("OrderID").collect())
    assert got == [1, 9]
    again = replace_by_day(replace_by_day(old, batch), batch)
    assert sorted(int(r[0]) for r in again.select("OrderID").collect()) == [1, 9]


def test_landing_clean(spark):
    raw = spark.createDataFrame(
        [("1", " 2024-01-01 10:00:00", "5.5", "x"), ("2", "garbage", "1", "y"), ("3", "2024-01-02 09:00:00", "n/a", "z")],
        ["Unique Order ID", "Received At", "Discount", "Total (Receipt Total)"])
    c = landing.clean_export(raw).orderBy("UniqueOrderID").collect()
    assert [r["UniqueOrderID"] for r in c] == [1, 3]
    assert float(c[1]["Discount"]) == 0.0 and float(c[1]["Total"]) == 0.0
    assert landing.normalize_header("Total (Receipt Total)") == "total_receipt_total"


def test_sync_result_is_subset_and_deltas(spark):
    """Invariants: the sync cut keeps a subset of its input; deltas are newer − older."""
    rows = []
    for i in range(40):
        day = 1 + i % 2
        rows.append({"OrderID": i + 1, "ReceivedAt": f"2024-01-0{day} {8 + i % 12:02d}:{(7 * i) % 60:02d}:00",
                     "Channel": f"C{i % 3}", "GrossPrice": 10 + i, "Discount": i % 4,
                     "DiscountCode": "Disc_20" if i % 4 else None})
    e = with_essential_columns(orders(spark, rows))
    cut = sync.exact_sync(e)
    assert cut.select("OrderID").subtract(e.select("OrderID")).count() == 0
    t = pivot.two_date_pivot(cut, "Channel").collect()
    for r in t:
        for m in ("Net_Sale", "Discount", "Discount_Pct", "CM"):
            assert r[f"{m}_Delta"] == pytest.approx(r[f"Latest_{m}"] - r[f"Previous_{m}"])


def test_general_pivot_margins_from_raw_rows(spark):
    df = orders(spark, [{"Channel": "A", "PaymentMethod": "x", "GrossPrice": 105},
                        {"Channel": "A", "PaymentMethod": "y", "GrossPrice": 210},
                        {"Channel": "B", "PaymentMethod": "x", "GrossPrice": 315},
                        {"Channel": None, "PaymentMethod": "x", "GrossPrice": 999}])
    e = with_essential_columns(df)
    g = {(r["Channel"], r["PaymentMethod"]): r["value"]
         for r in pivot.general_pivot(e, ["Channel"], ["PaymentMethod"], "net_sale", "mean").collect()}
    assert g[("A", "Total")] == pytest.approx(150.0)
    assert g[("Total", "x")] == pytest.approx(200.0)          # null channel dropped
    assert g[("Total", "Total")] == pytest.approx(200.0)
    med = {(r["Channel"], r["PaymentMethod"]): r["value"]
           for r in pivot.general_pivot(e, ["Channel"], ["PaymentMethod"], "net_sale", "median").collect()}
    assert med == pytest.approx(g)


@pytest.mark.parametrize("accuracy", [1, 50, 10000])
def test_exact_quantile_with_ties_any_accuracy(spark, accuracy):
    vals = [5.0] * 300 + [float(i) for i in range(40)] + [100.0] * 7
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(4)
    for p in (0.1, 0.5, 0.8, 0.99):
        got = exact_quantile(df, "v", p, accuracy=accuracy).first()[0]
        assert got == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-12)

"""Daily cells, customer bitmaps, quantiles by stretches, duplicates by digest, the linear model, wide tables, the API's new methods."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import orders
from tillpoint.api import SalesAnalytics
from tillpoint.operators import daily, models, pivot, quality, ranking
from tillpoint.operators.enrich import with_essential_columns
from tillpoint.session import shared_dir


def sales(spark, seed=1, n=400, days=20, names=60):
    r = random.Random(seed)
    return with_essential_columns(orders(spark, [
        {"OrderID": i, "ReceivedAt": f"2024-01-{1 + r.randrange(days):02d} {r.randrange(24):02d}:00:00", "Brand": r.choice(["A", "B", None]), "Channel": r.choice("xyz"),
         "CustomerName": r.choice([None, *[f"c{k}" for k in range(names)]]), "GrossPrice": r.choice([0, 50, 105, 210]), "Discount": r.choice([0, 5, 30]), "Tips": r.randrange(3)} for i in range(n)]))


@pytest.mark.parametrize(("start", "end"), [("2024-01-01", "2024-01-20"), ("2024-01-05", "2024-01-05"), ("2024-01-07", "2024-01-16"), ("2023-01-01", "2023-02-01")])
def test_cells_and_bitmaps_equal_the_orders_of_any_range(spark, start, end):
    from tillpoint.operators import kpis as k
    rows = sales(spark)
    cells = daily.cells(rows)
    bits = daily.customer_bitmaps(rows, daily.customer_numbers(rows))
    some = rows.where(F.col("Date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    want = k.kpis(some).first().asDict()
    assert daily.kpis(cells, bits, start, end).select(*want).first().asDict() == want
    by_brand = {r[0]: r[1] for r in some.where("Brand is not null and CustomerName is not null").groupBy("Brand").agg(F.countDistinct("CustomerName")).collect()}
    assert {r[0]: r[1] for r in daily.distinct_customers(bits, ("Brand",), start, end).collect()} == by_brand
    sums = {r[0]: pytest.approx(r[1]) for r in k.sales_by(some, "Channel").collect()}
    assert {r[0]: r[1] for r in daily.sales_by(cells, "Channel", start, end).collect()} == sums


def test_few_customers_of_many_make_few_bytes(spark):
    rows = sales(spark, n=60, names=50)
    far = daily.customer_numbers(rows).withColumn("number", F.col("number") * 100_003)
    bits = daily.customer_bitmaps(rows, far)
    kept = rows.where("CustomerName is not null")
    assert bits.schema["bits"].dataType.simpleString() == "bigint"  # 8 bytes, no bitmap of 4 KB
    assert bits.count() == kept.select("Date", "Brand", "Channel", "CustomerName").distinct().count()
    for dims in ((), ("Brand",), ("Channel",), ("Brand", "Channel")):
        some = kept.where(" and ".join(f"{d} is not null" for d in dims) or "true")
        want = {tuple(r[:-1]): r[-1] for r in some.groupBy(*dims).agg(F.countDistinct("CustomerName")).collect()}
        assert {tuple(r[:-1]): r[-1] for r in daily.distinct_customers(bits, dims).collect()} == want


def test_customer_numbers_stay_when_new_ones_come(spark):
    first, more = sales(spark, 2, names=30), sales(spark, 3, names=45)
    known = daily.customer_numbers(first)
    both = {r[0]: r[1] for r in daily.customer_numbers(more, known).collect()}
    assert {r[0]: r[1] for r in known.collect()}.items() <= both.items() and sorted(both.values()) == list(range(len(both)))


def test_unknown_cells_are_refused(spark):
    with pytest.raises(ValueError, match="no daily cells"):
        daily.sales_by(daily.cells(sales(spark, n=5)), "Tips")


def test_quantiles_of_continuous_and_hot_values(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 60_000), np.full(45_000, 0.25), rng.exponential(3, 20_000)])
    rows = spark.createDataFrame([("a", float(v)) for v in values] + [("b", float(v)) for v in range(7)] + [("c", 5.0)] * 3, "g string, v double")
    ps = [(0.0, "p0"), (0.1, "p10"), (0.5, "p50"), (0.5003, "p50b"), (0.9, "p90"), (1.0, "p100")]
    got = {r["g"]: r for r in ranking.grouped_quantiles(rows, ["g"], "v", ps, accuracy=1000).collect()}
    for g, vs in (("a", values), ("b", np.arange(7.0)), ("c", np.full(3, 5.0))):
        assert [got[g][name] for _, name in ps] == pytest.approx([np.quantile(vs, p) for p, _ in ps], rel=1e-12)


def test_a_bracket_is_spread_over_stretches(spark):
    rows = spark.range(300_000).select((F.rand(3) * 1000).alias("v"))
    plan = ranking.grouped_quantiles(rows, [], "v", [(0.5, "q")], accuracy=500)
    assert plan.first()["q"] == pytest.approx(float(np.quantile([r[0] for r in rows.collect()], 0.5)), rel=1e-12)
    assert "_q_s" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_duplicates_with_a_planted_collision(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (3, None), (3, None), (4, "c")], "k int, s string")
    assert quality.duplicate_rows(df).first()[0] == 3
    # Every row has one digest: the rows themselves decide.
    assert quality.duplicate_rows(df, digest=F.lit(7)).first()[0] == 3
    assert quality.duplicate_rows(df.limit(0)).first()[0] == 0


def test_linear_fit_is_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (200, 3)) * [1, 1000, 0.01] + [738000, 5, 0]
    y = x @ [2.0, -0.5, 30.0] + rng.normal(0, 0.1, 200)
    rows = spark.createDataFrame([(*map(float, a), 7.0, float(a[0] * 2), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, k double, twice double, y double")
    fit = models.linear_fit(rows, ["a", "b", "c", "k", "twice"], "y")
    want = np.linalg.lstsq(np.column_stack([x - x.mean(axis=0), np.ones(200)]), y, rcond=None)[0]
    assert [fit[c] for c in "abc"] == pytest.approx(list(want[:3]), rel=1e-8)
    assert fit["k"] == 0 and fit["twice"] == 0  # constant, collinear


def test_wide_matrix(spark):
    cells = spark.createDataFrame([("a", "x", 1.0), ("a", "Total", 1.0), ("b", "y", 2.0), ("b", "Total", 2.0), ("Total", "x", 1.0), ("Total", "y", 2.0), ("Total", "Total", 3.0)], "r string, c string, value double")
    out = pivot.wide_matrix(cells, ["r"], ["c"])
    assert out.columns == ["r", "x", "y", "Total"]
    assert sorted(map(tuple, out.collect())) == [("Total", 1.0, 2.0, 3.0), ("a", 1.0, 0.0, 1.0), ("b", 0.0, 2.0, 2.0)]
    with pytest.raises(ValueError, match="more than 2"):
        pivot.wide_matrix(cells, ["r"], ["c"], most=2)
    assert pivot.wide_matrix(cells.limit(0), ["r"], ["c"]).count() == 0


def test_date_profile(spark):
    o = orders(spark, [{"OrderID": i, "ReceivedAt": f"2024-01-{d:02d} 10:00:00"} for i, d in enumerate([1, 1, 2, 5])] + [{"OrderID": 9, "ReceivedAt": None}])
    got = {r["column"]: r for r in quality.date_profile(o, ["ReceivedAt", "Date"]).collect()}
    assert (got["Date"]["count"], got["Date"]["unique"], str(got["Date"]["top"]), got["Date"]["freq"], got["Date"]["dtype"]) == (4, 3, "2024-01-01 00:00:00", 2, "date")
    assert str(got["ReceivedAt"]["last"]) == "2024-01-05 10:00:00"


def test_api_methods(spark):
    rows = [{"OrderID": i, "Channel": "xyz"[i % 3], "Brand": "AB"[i % 2], "ReceivedAt": f"2024-01-{1 + i % 5:02d} 09:00:00", "GrossPrice": 105, "Discount": 5, "DiscountCode": "Disc_20"} for i in range(60)]
    sa = SalesAnalytics.from_orders(orders(spark, rows))
    chosen = {r["Channel"]: r for r in sa.command_centre(first="2024-01-02", second="2024-01-04").collect()}
    assert str(chosen["Total"]["Previous_Date"]) == "2024-01-02" and str(chosen["Total"]["Latest_Date"]) == "2024-01-04"
    assert sa.pivot_table(["Brand"], ["Channel"], "net_sale").columns == ["Brand", "x", "y", "z", "Total"]
    assert sa.discount_insights().count() == 5 and sa.deep_dive(["Channel"], 2).count() == 2 and sa.code_effectiveness().count() == 1
    for t in (sa.pivot_insights(), sa.date_summary("Brand"), sa.top_bottom("Brand"), sa.change_counts(), sa.largest_changes(), sa.period_comparison(), sa.same_day_projection(), sa.scorecard_verdicts(),
              sa.pair_verdicts(), sa.range_verdicts(), sa.tier_actions(), sa.day_fingerprints(), sa.duplicates(), *sa.profile(["GrossPrice"], ["Brand"])):
        assert t.columns and t.count() >= 0
    path = shared_dir(spark, "api-days")
    sa.publish(path)
    assert SalesAnalytics.from_days(spark, path).kpis().first() == sa.kpis().first()

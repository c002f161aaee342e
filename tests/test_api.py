"""The user-facing object runs the same operators."""

from __future__ import annotations

import os

import pytest

from fixtures import orders
from tillpoint.api import SalesAnalytics

SF = os.environ.get("TILLPOINT_TEST_SF", "/root/testdata/sf0.001")


def test_api_on_hand_made_orders(spark):
    df = orders(spark, [{"Channel": "A", "ReceivedAt": "2024-01-01 09:00:00", "GrossPrice": 105},
                        {"Channel": "B", "ReceivedAt": "2024-01-02 08:00:00", "GrossPrice": 210},
                        {"Channel": "A", "ReceivedAt": "2024-01-02 10:00:00", "GrossPrice": 315}])
    sa = SalesAnalytics.from_orders(df)
    rows = {r["Channel"]: r for r in sa.command_centre().collect()}
    assert rows["Total"]["Latest_Net_Sale"] == pytest.approx(500.0)
    assert sa.kpis().first()["total_orders"] == 3
    assert sa.only(channels=["A"]).kpis().first()["total_orders"] == 2


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
def test_api_on_star_schema(spark):
    sa = SalesAnalytics.from_star_schema(spark, SF)
    assert sa.daily().count() > 0
    assert sa.discount_ranges().count() == 5


def test_stored_orders_are_reused_and_follow_the_source(spark, tmp_path):
    """A later session finds the stored table; a changed source file is picked up after a refresh."""
    import shutil

    from pyspark.sql import functions as F

    from tillpoint.plans import frames
    d = str(tmp_path / "tables")
    os.makedirs(d)
    for f in os.listdir("/root/testdata/sf0.001"):  # without the owner's read-only modes
        shutil.copyfile(f"/root/testdata/sf0.001/{f}", f"{d}/{f}")
    first = frames.essential(spark, d)
    n, path = first.count(), frames._TABLES[spark.sparkContext.applicationId, d, "orders_essential"][0]
    frames.refresh(spark, d)  # as a new session: no handle, the same files
    assert frames.essential(spark, d).count() == n
    assert frames._TABLES[spark.sparkContext.applicationId, d, "orders_essential"][0] == path
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    latest = orders.agg(F.max("o_orderdate")).first()[0]
    (tmp_path / "tables" / "orders.parquet").unlink()
    orders.filter(F.col("o_orderdate") < F.lit(latest)).write.parquet(f"{d}/orders.parquet")
    frames.refresh(spark, d)
    assert 0 < frames.essential(spark, d).count() < n

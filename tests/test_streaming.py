"""Streaming: an AvailableNow load equals the batch answer; a late re-sent
day replaces only that day, and re-sending it again changes nothing."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from fixtures import orders
from tillpoint.sources.sink import read_deliveries, write_replace_by_day
from tillpoint.session import shared_dir
from tillpoint.streaming import stream as st


def _rows(n_days=3, per_day=4):
    rows = []
    for d in range(n_days):
        for i in range(per_day):
            rows.append({"OrderID": d * 100 + i + 1, "ReceivedAt": f"2024-01-0{d + 1} {9 + i:02d}:15:00",
                         "GrossPrice": 10 * (i + 1), "Tips": 1})
    return rows


def _by_day(df):
    return {str(r["Date"]): (r["n"], float(r["tips"]))
            for r in df.groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.sum("Tips").alias("tips")).collect()}


def test_stream_load_and_resent_day(spark):
    base = shared_dir(spark, "test-stream")
    src = orders(spark, _rows())
    landing = os.path.join(base, "landing")
    st.stage_landing(src, landing, "0001", files=5)
    table = os.path.join(base, "table")
    q = st.load_incrementally(st.order_stream(spark, landing, src.schema, files_per_batch=1), table,
                              os.path.join(base, "ckpt1"))
    q.awaitTermination()
    assert _by_day(read_deliveries(spark, table)) == _by_day(src)

    resent = orders(spark, [{"OrderID": 900 + i, "ReceivedAt": f"2024-01-02 1{i}:00:00", "Tips": 5}
                            for i in range(2)])
    for k in range(2):       # the same late file twice: idempotent
        late = os.path.join(base, f"late{k}")
        st.stage_landing(resent, late, f"000{k + 2}", files=2)
        q = st.load_incrementally(st.order_stream(spark, late, src.schema, files_per_batch=1), table, os.path.join(base, f"ckpt-late{k}"))
        q.awaitTermination()
        got = _by_day(read_deliveries(spark, table))
        assert got["2024-01-02"] == (2, 10.0)
        assert got["2024-01-01"] == (4, 4.0) and got["2024-01-03"] == (4, 4.0)


def test_replace_by_day_sink_only_touches_batch_days(spark):
    base = shared_dir(spark, "test-sink")
    table = os.path.join(base, "t")
    write_replace_by_day(orders(spark, _rows()), table)
    write_replace_by_day(orders(spark, [{"OrderID": 7, "ReceivedAt": "2024-01-03 12:00:00", "Tips": 9}]), table)
    got = _by_day(spark.read.parquet(table))
    assert got == {"2024-01-01": (4, 4.0), "2024-01-02": (4, 4.0), "2024-01-03": (1, 9.0)}


def test_ntz_instant_round_trip(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 3, 1, 13, 45, 7, 250000),)], "t timestamp_ntz")
    back = df.select(st.instant_to_ntz(st.ntz_to_instant("t")).alias("b")).first()[0]
    assert back == dt.datetime(2024, 3, 1, 13, 45, 7, 250000)


@pytest.mark.parametrize("cap", [1, 7, 16])
def test_a_day_in_many_files_loses_nothing(spark, cap):
    """One day in 40 files, whatever number of them a batch takes; a replay from scratch changes nothing."""
    base = shared_dir(spark, f"test-many-{cap}")
    rows = [{"OrderID": i, "ReceivedAt": f"2024-01-0{1 + i % 2} 09:00:00", "Tips": 1} for i in range(800)]
    src = orders(spark, rows)
    landing, table = os.path.join(base, "landing"), os.path.join(base, "table")
    st.stage_landing(src, landing, "0001", files=40)
    for k in range(2):
        q = st.load_incrementally(st.order_stream(spark, landing, src.schema, files_per_batch=cap), table, os.path.join(base, f"ckpt{k}"))
        q.awaitTermination()
        assert _by_day(read_deliveries(spark, table)) == {"2024-01-01": (400, 400.0), "2024-01-02": (400, 400.0)}


def test_closed_windows_leave_the_state(spark):
    """Days arrive in order; the state keeps the windows that the watermark leaves open, the table keeps all totals."""
    base = shared_dir(spark, "test-totals")
    landing, table = os.path.join(base, "landing"), os.path.join(base, "totals")
    for d in range(1, 8):
        st.stage_landing(orders(spark, [{"OrderID": 10 * d + i, "ReceivedAt": f"2024-01-0{d} {9 + i:02d}:00:00", "GrossPrice": d} for i in range(3)]), landing, f"000{d}")
        s = st.order_stream(spark, landing, orders(spark, []).schema)
        q = st.run_to_table(st.rolling_totals(s, "ReceivedAt", "GrossPrice", "1 hour", "1 day"), table, os.path.join(base, "ckpt"))
        q.awaitTermination()
        state = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None
    got = st.read_totals(spark, table, ["w"])
    assert got.count() == 21 and float(got.agg({"total": "sum"}).first()[0]) == 3 * sum(range(1, 8))
    assert state is not None and state <= 9


def test_landing_rows_are_dealt_without_sorting_them(spark):
    src = orders(spark, [{"OrderID": i, "ReceivedAt": f"2024-01-{1 + i % 28:02d} 09:00:00", "GrossPrice": i} for i in range(300)])
    rows = st.dealt(src, 5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and "RoundRobin" not in plan
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 300 and min(sizes) >= 30

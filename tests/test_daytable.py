"""The day table: versions, whole deliveries, refresh by change, window totals."""

from __future__ import annotations

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from fixtures import orders
from tillpoint.session import shared_dir
from tillpoint.sources import changes, sink
from tillpoint.sources.daytable import DayTable, read_marks
from tillpoint.sources.snapshots import Conflict, Snapshots
from tillpoint.streaming import stream as st


def day(d, n, tips=1, first=0):
    return [{"OrderID": 1000 * d + first + i, "ReceivedAt": f"2024-01-{d:02d} 09:00:00", "Tips": tips} for i in range(n)]


def by_day(df):
    return {str(r["Date"]): (r["n"], float(r["tips"])) for r in df.groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.sum("Tips").alias("tips")).collect()}


def test_readers_see_one_version(spark):
    path = shared_dir(spark, "days")
    t = DayTable(spark, path)
    v1 = t.replace_days(orders(spark, day(1, 3) + day(2, 2)))
    before = t.read()
    t.replace_days(orders(spark, day(2, 5, 7) + day(3, 1)))
    assert by_day(before) == by_day(t.read(v1)) == {"2024-01-01": (3, 3.0), "2024-01-02": (2, 2.0)}
    assert by_day(t.read()) == by_day(sink.read_days(spark, path)) == {"2024-01-01": (3, 3.0), "2024-01-02": (5, 35.0), "2024-01-03": (1, 1.0)}
    t.replace_days(orders(spark, []), also=[dt.date(2024, 1, 1)])
    assert sorted(by_day(t.read())) == ["2024-01-02", "2024-01-03"]
    t.compact()
    t.vacuum(keep=1)
    assert by_day(t.read()) == {"2024-01-02": (5, 35.0), "2024-01-03": (1, 1.0)}
    assert len([n for n in os.listdir(f"{path}/data") if n.startswith("part=")]) == 1


def test_a_failed_write_leaves_the_old_version(spark):
    t = DayTable(spark, shared_dir(spark, "days"))
    t.replace_days(orders(spark, day(1, 3)))
    bad = orders(spark, day(1, 9)).withColumn("Tips", F.when(F.col("UniqueOrderID") % 2 >= 0, F.raise_error(F.lit("broken"))).cast("decimal(18,4)"))
    with pytest.raises(Exception, match="broken"):
        t.replace_days(bad)
    assert by_day(t.read()) == {"2024-01-01": (3, 3.0)}


def test_writers_of_one_day_conflict_and_of_two_do_not(spark, monkeypatch):
    t, other = (DayTable(spark, p) for p in [shared_dir(spark, "days")] * 2)
    t.replace_days(orders(spark, day(1, 1) + day(2, 1)))
    real = Snapshots.commit

    def meanwhile(rows):
        def commit(self, *args):
            monkeypatch.setattr(Snapshots, "commit", real)
            other.replace_days(rows)
            return real(self, *args)
        monkeypatch.setattr(Snapshots, "commit", commit)
    meanwhile(orders(spark, day(2, 4)))
    t.replace_days(orders(spark, day(1, 6)))
    assert by_day(t.read()) == {"2024-01-01": (6, 6.0), "2024-01-02": (4, 4.0)}
    meanwhile(orders(spark, day(1, 2)))
    with pytest.raises(Conflict):
        t.replace_days(orders(spark, day(1, 8)))
    assert by_day(t.read()) == {"2024-01-01": (2, 2.0), "2024-01-02": (4, 4.0)}


def test_rows_without_a_date(spark):
    rows = orders(spark, day(1, 2) + [{"OrderID": 5, "ReceivedAt": None, "Tips": 9}])
    t = DayTable(spark, shared_dir(spark, "days"))
    t.replace_days(rows)
    assert t.read().count() == 2
    u = DayTable(spark, shared_dir(spark, "days"), undated=True)
    u.replace_days(rows)
    u.replace_days(orders(spark, day(1, 4)))
    assert by_day(u.read()) == {"2024-01-01": (4, 4.0), "None": (1, 9.0)}
    u.replace_days(orders(spark, []), also=[None])
    assert by_day(u.read()) == {"2024-01-01": (4, 4.0)}


def load(spark, landing, table, ckpt, schema, cap=1):
    st.load_incrementally(st.order_stream(spark, landing, schema, files_per_batch=cap), table, ckpt).awaitTermination()


def test_a_delivery_counts_when_it_is_whole(spark):
    base = shared_dir(spark, "deliveries")
    landing, table, ckpt = f"{base}/landing", f"{base}/table", f"{base}/ckpt"
    src = orders(spark, day(1, 4) + day(2, 4))
    st.stage_landing(src, landing, "0001", files=3)
    load(spark, landing, table, ckpt, src.schema)
    t = DayTable(spark, table)
    whole = by_day(t.read())
    # Half of the next delivery, then all files but no mark, then the mark: only that changes the days.
    a, b = orders(spark, day(1, 3, 5)), orders(spark, day(2, 2, 5))
    a.write.parquet(f"{landing}/delivery-0002/a")
    load(spark, landing, table, ckpt, src.schema)
    assert by_day(t.read()) == whole
    b.write.parquet(f"{landing}/delivery-0002/b")
    load(spark, landing, table, ckpt, src.schema)
    assert by_day(t.read()) == whole
    st.mark_complete(spark, f"{landing}/delivery-0002", src.schema)
    st.settle(spark, landing, table, src.schema)
    assert by_day(t.read()) == {"2024-01-01": (3, 15.0), "2024-01-02": (2, 10.0)}
    # An older delivery that completes later takes only days that no later one has.
    st.stage_landing(orders(spark, day(1, 1, 9) + day(3, 1, 9)), landing, "0000", files=1)
    load(spark, landing, table, ckpt, src.schema)
    assert by_day(t.read()) == {"2024-01-01": (3, 15.0), "2024-01-02": (2, 10.0), "2024-01-03": (1, 9.0)}
    t.compact()
    t.vacuum(keep=1)
    assert by_day(t.read()) == {"2024-01-01": (3, 15.0), "2024-01-02": (2, 10.0), "2024-01-03": (1, 9.0)}


def test_a_mark_that_names_a_missing_file_waits(spark):
    base = shared_dir(spark, "deliveries")
    src = orders(spark, day(1, 4))
    st.stage_landing(src, f"{base}/landing", "7", files=2)
    t = DayTable(spark, f"{base}/table")
    marks = read_marks(spark, [f"{base}/landing/delivery-7"])
    more = marks.unionByName(spark.createDataFrame([("7", "missing.parquet", 1)], marks.schema))
    rows = spark.read.schema(src.schema).option("pathGlobFilter", "*.parquet").parquet(f"{base}/landing/delivery-7")
    t.stage(rows.select("*", F.lit("7").alias("delivery_id"), F.col("_metadata.file_name").alias("delivery_file")))
    assert t.commit_deliveries(more, src.schema) is None and t.version() is None
    assert t.commit_deliveries(marks, src.schema).number == 1 and t.commit_deliveries(marks, src.schema) is None
    assert by_day(t.read()) == {"2024-01-01": (4, 4.0)}


def test_files_grow_with_batches_not_with_days_times_files(spark):
    base = shared_dir(spark, "deliveries")
    rows = [{"OrderID": 100 * m + i, "ReceivedAt": f"2024-{1 + m:02d}-{1 + i:02d} 09:00:00", "Tips": 1} for m in range(6) for i in range(28)]
    src = orders(spark, rows)
    st.stage_landing(src, f"{base}/landing", "0001", files=12)
    load(spark, f"{base}/landing", f"{base}/table", f"{base}/ckpt", src.schema, cap=4)
    files = sum(f.endswith(".parquet") for _, _, fs in os.walk(f"{base}/table/data") for f in fs)
    assert files <= 3 * 4 and DayTable(spark, f"{base}/table").read().count() == len(rows)


SF = "/root/testdata/sf0.001"


def test_rows_lie_by_day_and_narrow_ones_are_widened_last(spark):
    days = [dt.date(2024, 1, 1 + i * 7 % 28) for i in range(28)]
    narrow = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "Date date, k int")
    for widen in (None, lambda rows, *more: rows.select("Date", F.col("k").cast("string").alias("K"), *more)):
        path = shared_dir(spark, "by-day")
        DayTable(spark, path).replace_days(narrow.repartition(3), widen=widen)
        t = DayTable(spark, path).read()
        assert t.columns == ["Date", "k" if widen is None else "K", "Month"] and t.count() == 28
        at = t.select("Date", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()
        assert [r[0] for r in at] == sorted(days)  # one month is one file here


def test_first_lines_and_sums_of_orders_without_sorting_lines(spark):
    from tillpoint.sources.canonical import order_lines
    big = 2**63 - 1
    rows = [(1, 7, 2, 10.25, 0.05, 0.02), (1, 9, 1, 3.333, 0.5, 0.0), (1, 8, 1, 1.0, None, 0.1), (2, None, 1, 5.0, 0.1, 0.1), (2, 3, 1, 5.0, 0.1, 0.1), (3, big, 1, None, 0.1, 0.1),
            (4, 4, None, 2.0, 0.0, 0.0), (4, -5, 1, 2.0, 0.0, 0.0), (None, -big - 1, -2**31, 2.0, 0.04, 0.0), (None, 6, 2**31 - 1, 2.0, 0.04, 0.0)]
    t = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double")
    price, share = "cast(l_extendedprice as decimal(12,2))", "cast({} as decimal(4,2))"
    want = t.groupBy("l_orderkey").agg(F.expr(f"cast(sum({price}) as decimal(18,4))"), F.expr(f"cast(sum({price} * {share.format('l_discount')}) as decimal(18,4))"),
                                       F.expr(f"cast(sum({price} * {share.format('l_tax')}) as decimal(18,4))"), F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"])
    got = order_lines(t)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
def test_only_changed_days_are_written(spark):
    from tillpoint.sources.canonical import orders_view
    copy, path = shared_dir(spark, "sources"), shared_dir(spark, "followed")
    for name in changes.SOURCE_TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{copy}/{name}.parquet")
    build = lambda days: orders_view(spark, copy, days)
    follow = lambda: changes.follow(spark, copy, path, build)
    assert follow() is None and follow() == []
    same = lambda: changes.days_that_differ(changes.fingerprints(DayTable(spark, path, undated=True).read()), changes.fingerprints(build(None)))
    assert same() == []
    o = spark.read.parquet(f"{SF}/orders.parquet")
    d = o.agg(F.max("o_orderdate")).first()[0].date()
    # A file added: the new file alone says which day.
    o.orderBy("o_orderkey").limit(1).withColumn("o_orderkey", F.lit(10**9)).withColumn("o_orderdate", F.lit(d).cast(o.schema["o_orderdate"].dataType)).write.mode("append").parquet(f"{copy}/orders.parquet")
    assert d in follow() and same() == []
    # A customer renamed: days by fingerprint, those with an order of theirs.
    c = spark.read.parquet(f"{SF}/customer.parquet")
    key = o.agg(F.min("o_custkey")).first()[0]
    c.withColumn("c_name", F.when(F.col("c_custkey") == key, F.lit("New name")).otherwise(F.col("c_name"))).write.mode("overwrite").parquet(f"{copy}/customer.parquet")
    want = {r[0] for r in build(None).where(F.col("CustomerName") == "New name").select("Date").distinct().collect()}
    assert set(follow()) == want and same() == [] and 0 < len(want) < 100


def events(spark, rows):
    return spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), v) for h, v in rows], "t timestamp_ntz, v double")


def test_late_rows_are_folded_into_closed_windows(spark):
    base = shared_dir(spark, "windows")
    totals = st.WindowTotals(spark, f"{base}/t", "1 hour", "6 hours", fold_every=3)
    expect, seen = {}, []
    for batch in range(12):
        # Six new hours a batch, and a row that is two days late from the fifth on; a batch without rows; a null time.
        rows = [] if batch == 7 else [(6 * batch + k + 0.5, 1.0) for k in range(6)] + ([(6 * batch - 48 + 0.25, 10.0)] if batch > 4 else [])
        df = events(spark, rows).unionByName(spark.createDataFrame([(None, 3.0)], "t timestamp_ntz, v double"))
        take = df.select(F.col("t").alias("_ts"), F.col("v").alias("_value"))
        totals.add(take, batch)
        totals.add(take, batch)  # a replay of the batch
        for h, v in rows:
            n, s = expect.get(math.floor(h), (0, 0.0))
            expect[math.floor(h)] = (n + 1, s + v)
        seen.append(totals.open_rows())
    got = {int((r["start"] - dt.datetime(2024, 1, 1)).total_seconds() // 3600): (r["events"], r["total"], r["late"])
           for r in totals.read().select(st.instant_to_ntz(F.col("w.start")).alias("start"), "events", "total", "late").collect()}
    assert {h: x[:2] for h, x in got.items()} == expect
    assert max(seen) <= 40 and seen[-1] <= seen[5] + 8
    assert {h for h, x in got.items() if x[2]} == {6 * b - 48 for b in range(5, 12) if b != 7 and 6 * b - 48 >= 0} | {h for h in got if h < 0}


def test_totals_of_a_stream_with_any_order_of_files(spark):
    base = shared_dir(spark, "windows")
    src = orders(spark, [{"OrderID": i, "ReceivedAt": f"2024-01-{1 + i % 25:02d} {i % 24:02d}:30:00", "GrossPrice": i} for i in range(300)])
    st.stage_landing(src, f"{base}/landing", "1", files=11)
    totals = st.WindowTotals(spark, f"{base}/t", "1 day", "1 day", fold_every=4)
    totals.start(st.order_stream(spark, f"{base}/landing", src.schema, files_per_batch=1), "ReceivedAt", "GrossPrice", f"{base}/ckpt").awaitTermination()
    got = {r["d"]: (r["events"], int(r["total"])) for r in totals.read().select(F.date_format(st.instant_to_ntz(F.col("w.start")), "d").cast("int").alias("d"), "events", "total").collect()}
    assert got == {1 + k: (12, sum(range(k, 300, 25))) for k in range(25)}


def test_epochs_of_running_totals_are_folded(spark):
    base = shared_dir(spark, "running")
    src = orders(spark, [{"OrderID": i, "ReceivedAt": f"2024-01-{1 + i % 9:02d} 10:00:00", "GrossPrice": i} for i in range(90)])
    st.stage_landing(src, f"{base}/landing", "1", files=9)
    agg = st.order_stream(spark, f"{base}/landing", src.schema, files_per_batch=1).groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.sum("GrossPrice").alias("gross"))
    st.run_to_table(agg, f"{base}/t", f"{base}/ckpt", keys=["Date"], fold_every=4, state_partitions=2).awaitTermination()
    got = {r["Date"].day: (r["n"], int(r["gross"])) for r in st.read_totals(spark, f"{base}/t", ["Date"]).collect()}
    assert got == {1 + k: (10, sum(range(k, 90, 9))) for k in range(9)}
    assert len([n for n in os.listdir(f"{base}/t") if n.startswith("epoch=")]) < 4

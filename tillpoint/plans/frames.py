"""Shared frames for the registered queries.

The dashboard loads the order table once per session and derives its
columns once; every tab then works on that frame.  Here the same happens on
Spark: the canonical order table (and its derived columns) is a day table
(by month, sorted by date) under the cluster's shared checkpoint folder that
follows its source files: only days that changed are written again.  That write cuts the lineage (an executor
loss re-reads files instead of re-running the joins), lets date filters prune
partitions, and lets the scalar parameters (latest date, cut-off time) be
answered by cheap scans instead of re-running the joins per subquery.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.functions.discounts import with_discount_group
from tillpoint.operators import daily, sync
from tillpoint.operators.enrich import essential_columns, with_essential_columns, with_extended_columns
from tillpoint.session import shared_dir
from tillpoint.sources import changes
from tillpoint.sources.canonical import ORDER_COLUMNS, discount_code, joined_view, order_columns
from tillpoint.sources.daytable import DayTable
from tillpoint.sources.snapshots import Snapshots

_TABLES: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}
_LOCK = threading.RLock()


def materialize(spark: SparkSession, sf_dir: str, name: str, build, widen=None) -> DataFrame:
    """The day table of ``sf_dir`` in the shared folder, brought up to its source files, and read.

    A later session finds the table and writes only the days that changed
    (``changes.follow``; ``build(days)`` makes them, ``widen`` their columns).  The DataFrame handle is
    kept, so files are listed once a session; ``refresh`` looks at them again."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _LOCK:
        hit = _TABLES.get(key)
        if hit is None:
            tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
            path = f"{shared_dir(spark)}/tillpoint/tables/{name}-{tag}"
            changes.follow(spark, sf_dir, path, build, widen)
            hit = (path, DayTable(spark, path, undated=True).read())
            _TABLES[key] = hit
    return hit[1]


def refresh(spark: SparkSession, sf_dir: str) -> None:
    """Forget the session's handles on tables, frames and models derived from ``sf_dir``: the next query looks at the source files again."""
    with _LOCK:
        for kept in (_TABLES, _DERIVED, _MODELS):
            for key in [k for k in kept if k[:2] == (spark.sparkContext.applicationId, sf_dir)]:
                kept.pop(key)


class Varied(str):
    """A source folder whose orders are reshaped by ``rules`` (column to SQL expression) before anything is derived from them."""

    def __new__(cls, base: str, rules: dict[str, str]):
        out = super().__new__(cls, f"{base}?varied")  # no handle of the folder itself is this one's
        out.base, out.rules = str(base), rules
        return out


def _vary(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    last = sync.latest_days(rows, 1)
    early = (F.col("Date") == F.lit(last[0] if last else None).cast("date")) & (F.col("UniqueOrderID") % 2 == 0)
    return rows.withColumns({c: F.expr(rule) for c, rule in rules.items()}
                            | {"ReceivedAt": F.timestamp_add("SECOND", F.when(early, 39600).otherwise(43200), F.col("Date").cast("timestamp_ntz"))})


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical order table (the ingested sales table): the canonical columns
    of the stored essential table, so the joins run once per session."""
    return essential(spark, sf_dir).select(*ORDER_COLUMNS, "Month")


def essential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical orders with the B-01 columns (the dashboard's working frame)."""
    if isinstance(sf_dir, Varied):
        return _session_frame(spark, sf_dir, "varied", lambda: with_essential_columns(_vary(orders(spark, sf_dir.base), sf_dir.rules)))
    joined = lambda days: with_discount_group(joined_view(spark, sf_dir, days).withColumn("DiscountCode", discount_code())).drop("DiscountCode")
    return materialize(spark, sf_dir, "orders_essential", joined, lambda rows, *more: essential_columns(order_columns(rows, "Discount_Group", *more)))


def _by_day(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A day table made of the stored orders: ``build(rows)`` is run for the days that differ since it was last made."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _LOCK:
        hit = _TABLES.get(key)
        if hit is None:
            rows = essential(spark, sf_dir)
            source = DayTable(spark, _TABLES[(key[0], sf_dir, "orders_essential")][0], undated=True)
            now = source.version()
            path = f"{source.path}-{name}"
            table = DayTable(spark, path, undated=True)
            had = table.version()
            if had is None:
                table.replace_days(build(rows), whole=True, info={"of": now.number})
            elif had.info["of"] != now.number:
                marks = [source.log.read(v, "fingerprints") for v in (source.log.version(had.info["of"]), now)]
                days = changes.days_that_differ(*marks)
                table.replace_days(build(changes.on_days(rows, days)), also=days, info={"of": now.number})
            hit = _TABLES[key] = (path, table.read())
    return hit[1]


def daily_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cells of the orders (``operators.daily``), without fully discounted ones."""
    return _by_day(spark, sf_dir, "cells", lambda rows: daily.cells(sync.drop_fully_discounted(rows)))


def customer_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by day as bits; the numbering of customers is a table of its own, in versions."""
    def build(rows: DataFrame) -> DataFrame:
        kept_rows = sync.drop_fully_discounted(rows)
        log = Snapshots(spark, f"{_TABLES[(spark.sparkContext.applicationId, sf_dir, 'orders_essential')][0]}-customers")
        last = log.latest()
        known = log.read(last) if last else None
        last = log.commit(last, {"rows": daily.customer_numbers(kept_rows, known)}, {})
        return daily.customer_bitmaps(kept_rows, log.read(last))
    return _by_day(spark, sf_dir, "customer-bits", build)


_DERIVED: dict[tuple[str, str, str], DataFrame] = {}


def _session_frame(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived frame's plan kept for the session, so that its data-dependent
    parameters are computed once; its rows are read from the stored table each time."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _LOCK:
        df = _DERIVED.get(key)
        if df is None:
            df = _DERIVED[key] = build()
    return df


def extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-02 column set over the stored orders (quantile cut computed once per session)."""
    return _session_frame(spark, sf_dir, "extended", lambda: with_extended_columns(orders(spark, sf_dir)))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essential frame without fully discounted orders (B-05)."""
    return sync.drop_fully_discounted(essential(spark, sf_dir))


def command_centre(df: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """B-05 → a chosen date pair, else the default one (B-08) → exactly those dates (B-07) → sync cut (G-02/G-03)."""
    d = sync.drop_fully_discounted(df)
    if first is not None and second is not None:
        prev, latest = (F.lit(x).cast("date") for x in sorted((str(first), str(second))))
    else:
        prev, latest = sync.default_date_pair(d, table=df)
    return sync.exact_sync(sync.on_dates(d, [prev, latest]))


def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command-centre slice (two dates, sync cut): its dates and cut-off are found once per session, and each
    query scans its own columns of at most two months."""
    return _session_frame(spark, sf_dir, "synced", lambda: command_centre(essential(spark, sf_dir)))


_MODELS: dict[tuple[str, str, str], tuple] = {}


def fitted(spark: SparkSession, sf_dir: str, name: str, fit):
    """A model result (fit once per session); ``fit()`` returns DataFrames."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _LOCK:
        hit = _MODELS.get(key)
        if hit is None:
            hit = fit()
            _MODELS[key] = hit
    return hit

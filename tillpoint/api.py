"""User-facing entry point: one object per order table, one method per analysis.

    from tillpoint.api import SalesAnalytics
    sa = SalesAnalytics.from_orders(spark.read.parquet("s3://.../orders"))   # canonical columns
    sa.command_centre().show()          # Channel × (previous, latest) pivot with totals and deltas
    sa.discount_by(["Brand"]).show()

Every method returns a lazy DataFrame built from the operators; nothing is
collected except one-row scalar parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tillpoint.operators import customers as cu
from tillpoint.operators import discount_perf as dp
from tillpoint.operators import kpis, models, pivot, quality, sync
from tillpoint.operators.enrich import with_essential_columns, with_extended_columns
from tillpoint.plans import frames
from tillpoint.sources import sink
from tillpoint.sources.canonical import orders_view


class SalesAnalytics:
    """Analyses over one canonical order table (see ``sources.canonical.ORDER_COLUMNS``)."""

    def __init__(self, orders: DataFrame):
        self.orders = orders
        self.frame = with_essential_columns(orders)

    @classmethod
    def from_orders(cls, orders: DataFrame) -> "SalesAnalytics":
        return cls(orders)

    @classmethod
    def from_star_schema(cls, spark: SparkSession, sf_dir: str) -> "SalesAnalytics":
        return cls(orders_view(spark, sf_dir))

    # filters --------------------------------------------------------------
    def between(self, start: str, end: str) -> "SalesAnalytics":
        return SalesAnalytics(sync.between_dates(self.orders, start, end))

    def only(self, channels: Sequence[str] = (), brands: Sequence[str] = ()) -> "SalesAnalytics":
        return SalesAnalytics(kpis.membership(self.orders, channels, brands))

    # overview -------------------------------------------------------------
    def kpis(self, month_to_date: bool = False) -> DataFrame:
        d = sync.drop_fully_discounted(self.frame)
        return kpis.kpis(sync.month_to_date(d) if month_to_date else d)

    def daily(self) -> DataFrame:
        return sync.daily_series(sync.drop_fully_discounted(self.frame))

    def sales_by(self, dim: str) -> DataFrame:
        return kpis.sales_by(sync.drop_fully_discounted(self.frame), dim)

    def summary(self, dims: Sequence[str], metrics: Sequence[str], top_n: int = 20) -> DataFrame:
        return kpis.free_summary(self.frame, dims, metrics, top_n)

    # command centre -------------------------------------------------------
    def synced(self, first: str | None = None, second: str | None = None) -> DataFrame:
        """Orders of two days, cut to the same time of day: two chosen dates, else the latest and the day before."""
        return frames.command_centre(self.frame, first, second)

    def command_centre(self, dim: str = "Channel", first: str | None = None, second: str | None = None) -> DataFrame:
        return pivot.two_date_pivot(self.synced(first, second), dim)

    def pivot_insights(self, dim: str = "Channel", first: str | None = None, second: str | None = None) -> DataFrame:
        return pivot.pivot_insights(self.command_centre(dim, first, second), dim)

    def date_summary(self, dim: str, first: str | None = None, second: str | None = None) -> DataFrame:
        return pivot.dimension_date_summary(self.synced(first, second), dim)

    def top_bottom(self, dim: str, n: int = 10) -> DataFrame:
        return pivot.top_bottom(self.date_summary(dim), n)

    def change_counts(self) -> DataFrame:
        return pivot.change_counts(self.combined_changes())

    def largest_changes(self, kind: str = "declines") -> DataFrame:
        """The combinations with the largest ``declines`` or ``improvements``, or ``absolute`` changes."""
        return pivot.largest_changes(self.combined_changes(), kind)

    def period_comparison(self, first: str | None = None, second: str | None = None) -> DataFrame:
        return kpis.period_comparison(self.frame, first, second)

    def same_day_projection(self) -> DataFrame:
        return sync.same_day_projection(self.frame)

    def combined_changes(self) -> DataFrame:
        return pivot.combined_changes(self.synced())

    def time_synced_comparison(self) -> DataFrame:
        return sync.time_synced_comparison(self.frame)

    def trend_prediction(self) -> DataFrame:
        return sync.trend_prediction(sync.drop_fully_discounted(self.frame))

    def pivot(self, rows: Sequence[str], cols: Sequence[str], value: str, how: str = "sum") -> DataFrame:
        return pivot.general_pivot(sync.drop_fully_discounted(self.frame), rows, cols, value, how)

    def pivot_table(self, rows: Sequence[str], cols: Sequence[str], value: str, how: str = "sum") -> DataFrame:
        """The pivot as a wide table with totals, missing cells 0."""
        return pivot.wide_matrix(self.pivot(rows, cols, value, how), rows, cols)

    # discounts ------------------------------------------------------------
    def discount_by(self, dims: Sequence[str]) -> DataFrame:
        return dp.cm_breakdown(dp.discounted(sync.drop_fully_discounted(self.frame)), dims)

    def discount_ranges(self) -> DataFrame:
        return dp.range_table(dp.discounted(sync.drop_fully_discounted(self.frame)))

    def scorecard(self) -> DataFrame:
        return dp.scorecard(self.frame)

    def scorecard_verdicts(self, n: int = 10) -> DataFrame:
        return dp.scorecard_verdicts(self.scorecard(), n)

    def pair_verdicts(self, n: int = 10) -> DataFrame:
        return dp.pair_verdicts(self.discount_by(["Brand", "Address"]), n)

    def range_verdicts(self) -> DataFrame:
        return dp.range_verdicts(self.discount_ranges())

    def deep_dive(self, dims: Sequence[str], n: int | None = None) -> DataFrame:
        t = dp.deep_dive(self.frame, dims)
        return dp.top_by_discount(t, dims, n) if n else t

    def code_effectiveness(self) -> DataFrame:
        return dp.code_effectiveness(self.frame)

    def discount_insights(self) -> DataFrame:
        return dp.insights(self.frame)

    # customers ------------------------------------------------------------
    def customers(self) -> DataFrame:
        return cu.customer_table(sync.drop_fully_discounted(self.frame))

    def clv(self, key: str = "CustomerName") -> DataFrame:
        return cu.clv(self.frame, key)

    def rfm(self, key: str = "CustomerName") -> DataFrame:
        return cu.rfm(self.frame, key)

    def churn(self, key: str = "CustomerName") -> tuple[DataFrame, DataFrame]:
        return models.churn_model(self.frame, key)

    def forecast(self) -> tuple[DataFrame, DataFrame]:
        return models.forecast(self.frame)

    def value_tiers(self) -> DataFrame:
        return cu.tier_metrics(with_extended_columns(self.orders))

    def tier_actions(self) -> DataFrame:
        return cu.tier_actions(self.value_tiers())

    # stored tables ----------------------------------------------------------
    def publish(self, path: str) -> None:
        """Replace the days of these orders in the day table at ``path``, all in one version."""
        sink.publish_days(self.orders, path)

    @classmethod
    def from_days(cls, spark: SparkSession, path: str) -> "SalesAnalytics":
        """The orders of a day table as of its latest version."""
        return cls(sink.read_days(spark, path))

    # quality --------------------------------------------------------------
    def missing(self) -> DataFrame:
        return quality.missing_by_column(self.orders)

    def profile(self, numeric: Sequence[str] = (), text: Sequence[str] = (), dates: Sequence[str] = ("ReceivedAt", "Date")) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Column profiles of the enriched orders: numeric, text and date columns."""
        return quality.numeric_profile(self.frame, numeric), quality.categorical_profile(self.frame, text), quality.date_profile(self.frame, dates)

    def duplicates(self) -> DataFrame:
        return quality.duplicate_rows(self.orders)

    def day_fingerprints(self) -> DataFrame:
        return quality.day_fingerprints(self.orders)

    def freshness(self) -> DataFrame:
        return kpis.freshness(self.frame)

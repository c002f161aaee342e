"""Model queries (G-06, G-10..G-12, H-08, H-10): the splits have SQL twins, model outputs are rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.operators import models, sync
from tillpoint.plans import frames
from tillpoint.plans.catalog import register
from tillpoint.plans.sqlparts import BASE, with_ctes


@register("g06_sales_forecast", "G-06", note="model output")
def g06_sales_forecast(spark, sf):
    """Next 30 days from linear regression and a 100-tree forest (seed 42)."""
    preds, _ = frames.fitted(spark, sf, "forecast", lambda: models.forecast(frames.essential(spark, sf)))
    return preds


@register("g06_forecast_metrics", "G-06", note="model output")
def g06_forecast_metrics(spark, sf):
    _, metrics = frames.fitted(spark, sf, "forecast", lambda: models.forecast(frames.essential(spark, sf)))
    return metrics


_X = ["date_ordinal", "day_of_week", "month", "orders", "discount"]


def _linear_sql(final: str) -> str:
    """The normal equations in SQL: covariances of the training days, eliminated feature by feature."""
    cols, n = [*_X, "net_sale"], len(_X)
    moments = ", ".join([f"avg({c}) AS m_{i}" for i, c in enumerate(cols)] + [f"covar_pop({cols[j]}, {cols[i]}) AS a_{i}_{j}" for i in range(n) for j in range(n + 1)] + [f"var_pop({c}) AS v_{i}" for i, c in enumerate(_X)])
    keep = ", ".join([f"m_{i}" for i in range(n + 1)] + [f"v_{i}" for i in range(n)])
    ctes = ["""
ds AS (SELECT Date, CAST(SUM(net_sale_vat) AS DOUBLE) / 1.05 AS net_sale, CAST(count(OrderID) AS DOUBLE) AS orders, CAST(SUM(calc_discount_vat) AS DOUBLE) / 1.05 AS discount
       FROM e WHERE Date IS NOT NULL GROUP BY Date)""", """
df AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', Date) + 719163 AS DOUBLE) AS date_ordinal, CAST(isodow(Date) - 1 AS DOUBLE) AS day_of_week, CAST(month(Date) AS DOUBLE) AS month,
              substr(md5(CAST(Date AS VARCHAR)), 1, 2) < 'cd' AS in_train FROM ds)""", f"s0 AS (SELECT {moments} FROM df WHERE in_train)"]
    for k in range(n):
        by = f"CASE WHEN a_{k}_{k} > 1e-7 * v_{k} AND v_{k} > 1e-18 * m_{k} * m_{k} THEN 1 / a_{k}_{k} ELSE 0 END"
        cells = [f"a_{k}_{j} * d AS a_{k}_{j}" if i == k else f"a_{i}_{j} - a_{i}_{k} * (a_{k}_{j} * d) AS a_{i}_{j}" for i in range(n) for j in range(n + 1)]
        ctes += [f"d{k} AS (SELECT *, {by} AS d FROM s{k})", f"s{k + 1} AS (SELECT {keep}, {', '.join(cells)} FROM d{k})"]
    beta = ", ".join(f"a_{i}_{n} AS b_{i}" for i in range(n))
    ctes.append(f"fit AS (SELECT {beta}, m_{n} - ({' + '.join(f'a_{i}_{n} * m_{i}' for i in range(n))}) AS b FROM s{n})")
    return with_ctes(*BASE, *ctes, final=final)


_PREDICTED = "b + " + " + ".join(f"b_{i} * {c}" for i, c in enumerate(_X))


def _linear(spark, sf):
    return frames.fitted(spark, sf, "linear", lambda: models.linear_forecast(frames.essential(spark, sf)))


@register("g06_linear_forecast", "G-06", _linear_sql(f"""
SELECT Date, round({_PREDICTED}, 2) AS lr_prediction FROM fit, (
  SELECT Date, orders, discount, CAST(date_diff('day', DATE '1970-01-01', Date) + 719163 AS DOUBLE) AS date_ordinal, CAST(isodow(Date) - 1 AS DOUBLE) AS day_of_week, CAST(month(Date) AS DOUBLE) AS month
  FROM (SELECT CAST(max(Date) + CAST(unnest(range(1, 31)) AS INTEGER) AS DATE) AS Date, avg(orders) AS orders, avg(discount) AS discount FROM df))"""))
def g06_linear_forecast(spark, sf):
    """The next 30 days from the linear model, to the cent."""
    return _linear(spark, sf)[0].select("Date", F.round("lr_prediction", 2).alias("lr_prediction"))


@register("g06_linear_coefficients", "G-06", _linear_sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(b_{i}, 4) AS coefficient FROM fit" for i, c in enumerate(_X))))
def g06_linear_coefficients(spark, sf):
    """The linear model's coefficients."""
    return _linear(spark, sf)[1].where("feature <> 'intercept'").select("feature", F.round("coefficient", 4).alias("coefficient"))


@register("g06_linear_metrics", "G-06", _linear_sql(f"""
SELECT round(avg(abs(net_sale - p)), 4) AS mae, round(1 - sum((net_sale - p) ** 2) / sum((net_sale - mean) ** 2), 8) AS r2
FROM (SELECT net_sale, {_PREDICTED} AS p, avg(net_sale) OVER () AS mean FROM df, fit WHERE NOT in_train)"""))
def g06_linear_metrics(spark, sf):
    """MAE and R² of the linear model on the days it did not see."""
    return _linear(spark, sf)[2].select(F.round("mae", 4).alias("mae"), F.round("r2", 8).alias("r2"))


@register("g06_split_days", "G-06", with_ctes(*BASE, final="""
SELECT Date, substr(md5(CAST(Date AS VARCHAR)), 1, 2) < 'cd' AS in_train FROM e WHERE Date IS NOT NULL GROUP BY Date"""))
def g06_split_days(spark, sf):
    """The days that the forecast trains on."""
    daily = sync.daily_series(frames.essential(spark, sf))
    return daily.select("Date", models.hash_split(F.col("Date").cast("string"), 0.8).alias("in_train"))


@register("g10_split_customers", "G-10", with_ctes(*BASE, final="""
SELECT CustomerName, substr(md5(CustomerName), 1, 2) < 'b3' AS in_train FROM e WHERE CustomerName IS NOT NULL GROUP BY CustomerName"""))
def g10_split_customers(spark, sf):
    """The customers that the churn model trains on."""
    names = frames.essential(spark, sf).where(F.col("CustomerName").isNotNull()).select("CustomerName").distinct()
    return names.select("CustomerName", models.hash_split(F.col("CustomerName"), 0.7).alias("in_train"))


@register("g10_churn_scores", ("G-10", "G-11"), note="model output")
def g10_churn_scores(spark, sf):
    scored, _ = frames.fitted(spark, sf, "churn", lambda: models.churn_model(frames.essential(spark, sf)))
    return scored.select("CustomerName", "recency", "is_churned", "churn_probability", "churn_risk")


@register("g11_churn_risk_bands", "G-11", note="model output")
def g11_churn_risk_bands(spark, sf):
    scored, _ = frames.fitted(spark, sf, "churn", lambda: models.churn_model(frames.essential(spark, sf)))
    return scored.groupBy("churn_risk").agg(F.count(F.lit(1)).alias("customers"))


@register("g12_churn_summary", "G-12", note="model output")
def g12_churn_summary(spark, sf):
    scored, _ = frames.fitted(spark, sf, "churn", lambda: models.churn_model(frames.essential(spark, sf)))
    return models.churn_summary(scored)


@register("h08_high_risk_customers", "H-08", note="model output")
def h08_high_risk_customers(spark, sf):
    scored, _ = frames.fitted(spark, sf, "churn", lambda: models.churn_model(frames.essential(spark, sf)))
    return models.high_risk(scored)


@register("h10_feature_importance", "H-10", note="model output")
def h10_feature_importance(spark, sf):
    _, imp = frames.fitted(spark, sf, "churn", lambda: models.churn_model(frames.essential(spark, sf)))
    return imp

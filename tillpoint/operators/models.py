"""Sales forecast and churn model on Spark ML (G-06, G-10..G-12, H-08, H-10).

Features are built with DataFrame aggregates (one row per day / customer);
fitting is Spark ML's distributed tree building.  The random forest for
churn is trained on scaled features and scores scaled features (one
pipeline), and recency — which also defines the label — is a feature, as
in the dashboard.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.exprs import ordinal_day
from tillpoint.operators.customers import churn_features
from tillpoint.operators.params import fetch
from tillpoint.operators.sync import daily_series

# Model sizes and seeds of the dashboard.
TREES = 100
SEED = 42
FORECAST_DAYS = 30
MIN_FORECAST_ROWS = 30
MIN_CHURN_CUSTOMERS = 10
RISK_LABELS = [("Low Risk", 0.0, 0.3), ("Medium Risk", 0.3, 0.7), ("High Risk", 0.7, 1.0)]
FORECAST_FEATURES = ["date_ordinal", "day_of_week", "month", "orders", "discount"]
CHURN_FEATURES = ["total_spent", "avg_order_value", "purchase_count", "recency", "lifetime"]


def hash_split(key: Column, share: float) -> Column:
    """Whether a row trains: the first byte of its key's MD5 is below ``share`` of 256.

    The split depends on the key alone, not on partitions or row order."""
    return F.coalesce(F.substring(F.md5(key), 1, 2) < F.lit(f"{round(share * 256):02x}"), F.lit(False))


def _daily_features(daily: DataFrame) -> DataFrame:
    return (daily.withColumn("date_ordinal", ordinal_day("Date").cast("double"))
                 .withColumn("day_of_week", F.weekday("Date").cast("double"))
                 .withColumn("month", F.month("Date").cast("double"))
                 .withColumn("orders", F.col("orders").cast("double")))


#: A feature whose variance, given the features before it, is below this share of its own is left out: others say it already.
COLLINEAR = 1e-7


def linear_fit(rows: DataFrame, features: list[str], label: str) -> dict[str, float]:
    """Least squares by the normal equations: ``{feature: coefficient}``, with the intercept under "".

    One aggregate makes the Gram matrix of the centred columns (covariances),
    whose size the features fix; elimination on the driver solves it.  Features
    are taken in their order; a constant or collinear one gets 0."""
    cols = [*features, label]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = fetch(rows.where(F.col(label).isNotNull()), **{f"m_{i}": F.avg(c) for i, c in enumerate(cols)},
                **{f"c_{cols.index(a)}_{cols.index(b)}": F.covar_pop(F.col(b), F.col(a)) for a, b in pairs})
    n = len(features)
    at = lambda i, j: row[f"c_{min(i, j)}_{max(i, j)}"] or 0.0
    m = [[at(i, j) for j in range(n + 1)] for i in range(n)]
    own = [m[k][k] for k in range(n)]
    for k in range(n):
        # A constant's variance is rounding error of its mean.
        by = 1 / m[k][k] if m[k][k] > COLLINEAR * own[k] and own[k] > 1e-18 * (row[f"m_{k}"] or 0.0) ** 2 else 0.0
        pivot = [x * by for x in m[k]]
        m = [pivot if i == k else [x - r[k] * p for x, p in zip(r, pivot, strict=True)] for i, r in enumerate(m)]
    beta = {f: m[i][n] for i, f in enumerate(features)}
    return beta | {"": (row[f"m_{n}"] or 0.0) - sum(b * (row[f"m_{i}"] or 0.0) for i, b in enumerate(beta.values()))}


def linear_prediction(fit: dict[str, float]) -> Column:
    out = F.lit(fit[""])
    for f, b in fit.items():
        if f:
            out = out + F.lit(b) * F.col(f)
    return out


def _future(daily: DataFrame, horizon: int) -> DataFrame:
    """The ``horizon`` days after the last, with the mean orders and discount."""
    p = fetch(daily, last=F.max("Date"), orders=F.avg("orders"), discount=F.avg("discount"))
    days = daily.sparkSession.range(1, horizon + 1).select(F.date_add(F.lit(p["last"].isoformat()).cast("date"), F.col("id").cast("int")).alias("Date"))
    return _daily_features(days.withColumn("orders", F.lit(float(p["orders"]))).withColumn("discount", F.lit(float(p["discount"]))))


def linear_forecast(df: DataFrame, horizon: int = FORECAST_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G-06, the linear model alone: (future predictions, coefficients, held-out MAE and R²)."""
    daily = _daily_features(daily_series(df)).withColumn("in_train", hash_split(F.col("Date").cast("string"), 0.8))
    fit = linear_fit(daily.where("in_train"), FORECAST_FEATURES, "net_sale")
    scored = daily.where("not in_train").withColumn("p", linear_prediction(fit))
    mean = scored.agg(F.avg("net_sale")).scalar()
    metrics = scored.agg(F.avg(F.abs(F.col("net_sale") - F.col("p"))).alias("mae"),
                         (F.lit(1.0) - F.sum(F.pow(F.col("net_sale") - F.col("p"), F.lit(2))) / F.sum(F.pow(F.col("net_sale") - mean, F.lit(2)))).alias("r2"))
    coefficients = df.sparkSession.createDataFrame([(f or "intercept", b) for f, b in fit.items()], "feature string, coefficient double")
    return _future(daily, horizon).select("Date", linear_prediction(fit).alias("lr_prediction")), coefficients, metrics


def forecast(df: DataFrame, horizon: int = FORECAST_DAYS, trees: int = TREES, seed: int = SEED
             ) -> tuple[DataFrame, DataFrame]:
    """G-06: (future predictions, model metrics).

    Linear regression and a random forest on ordinal day, weekday, month,
    orders and discount per day; 80/20 split; MAE and R² on the held-out
    days; the next ``horizon`` days use the mean orders and discount."""
    spark = df.sparkSession
    n_rows = fetch(df, n=F.count(F.lit(1)))["n"]
    daily = _daily_features(daily_series(df))
    if n_rows < MIN_FORECAST_ROWS:
        empty_f = spark.createDataFrame([], "Date date, lr_prediction double, rf_prediction double")
        empty_m = spark.createDataFrame([], "model string, mae double, r2 double")
        return empty_f, empty_m
    daily = daily.withColumn("in_train", hash_split(F.col("Date").cast("string"), 0.8))
    train, test = daily.where("in_train"), daily.where("not in_train")
    asm = VectorAssembler(inputCols=FORECAST_FEATURES, outputCol="features")
    fit = linear_fit(train, FORECAST_FEATURES, "net_sale")
    rf = Pipeline(stages=[asm, RandomForestRegressor(featuresCol="features", labelCol="net_sale",
                                                     predictionCol="rf_prediction", numTrees=trees,
                                                     seed=seed)]).fit(train)
    metrics = []
    for name, scored, col in (("linear_regression", test.withColumn("lr_prediction", linear_prediction(fit)), "lr_prediction"), ("random_forest", rf.transform(test), "rf_prediction")):
        ev = RegressionEvaluator(labelCol="net_sale", predictionCol=col)
        metrics.append((name, float(ev.setMetricName("mae").evaluate(scored)),
                        float(ev.setMetricName("r2").evaluate(scored))))
    scored = rf.transform(_future(daily, horizon).withColumn("lr_prediction", linear_prediction(fit)))
    preds = scored.select("Date", "lr_prediction", "rf_prediction")
    return preds, spark.createDataFrame(metrics, "model string, mae double, r2 double")


def risk_band(p: str = "churn_probability"):
    """G-11: 0–0.3 Low (0 included), 0.3–0.7 Medium, 0.7–1 High (right-closed)."""
    c = F.col(p)
    return (F.when((c >= 0) & (c <= 0.3), F.lit("Low Risk"))
             .when((c > 0.3) & (c <= 0.7), F.lit("Medium Risk"))
             .when((c > 0.7) & (c <= 1.0), F.lit("High Risk")))


def churn_model(df: DataFrame, key: str = "CustomerName", trees: int = TREES, seed: int = SEED
                ) -> tuple[DataFrame, DataFrame]:
    """G-10: (scored customers, feature importances).

    70/30 split by a hash of the customer, standard scaling and
    a 100-tree random forest in one pipeline; every customer is scored."""
    spark = df.sparkSession
    feats = churn_features(df, key)
    for c in CHURN_FEATURES:
        feats = feats.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    n = fetch(feats, n=F.count(F.lit(1)))["n"]
    if n < MIN_CHURN_CUSTOMERS:
        return (spark.createDataFrame([], f"{key} string, churn_probability double, churn_risk string"),
                spark.createDataFrame([], "feature string, importance double"))
    train = feats.where(hash_split(F.col(key), 0.7))
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=CHURN_FEATURES, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        RandomForestClassifier(featuresCol="features", labelCol="is_churned", numTrees=trees, seed=seed)])
    model = pipe.fit(train)
    scored = model.transform(feats)
    prob = vector_to_array("probability")
    out = (scored.withColumn("churn_probability",
                             F.when(F.size(prob) > 1, prob[1]).otherwise(F.col("is_churned").cast("double")))
                 .withColumn("churn_risk", risk_band()))
    out = out.drop("raw_features", "features", "rawPrediction", "probability", "prediction")
    imp = model.stages[-1].featureImportances.toArray().tolist()
    importances = spark.createDataFrame(list(zip(CHURN_FEATURES, [float(v) for v in imp])),
                                        "feature string, importance double")
    return out, importances.orderBy(F.col("importance").desc())


def churn_summary(scored: DataFrame) -> DataFrame:
    """G-12: band counts, mean probability, churned and high-risk share."""
    n = F.count(F.lit(1))
    high = F.count_if(F.col("churn_risk") == "High Risk")
    return scored.agg(high.alias("high_risk_customers"), F.avg("churn_probability").alias("avg_churn_probability"),
                      F.sum("is_churned").alias("churned_customers"), n.alias("total_customers"),
                      (high / n * 100).alias("high_risk_pct"))


def high_risk(scored: DataFrame, key: str = "CustomerName", n: int = 20) -> DataFrame:
    """H-08: the ``n`` high-risk customers with the largest probability."""
    return (scored.where(F.col("churn_risk") == "High Risk")
                  .orderBy(F.col("churn_probability").desc(), key).limit(n)
                  .select(key, "churn_probability", "total_spent", "recency", "purchase_count"))

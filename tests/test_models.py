"""Model outputs: row counts, probabilities in [0, 1], legal bands, seed reproducibility."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tillpoint.operators import models
from tillpoint.plans import frames

SF = os.environ.get("TILLPOINT_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")


def test_churn_model_outputs(spark):
    e = frames.essential(spark, SF)
    scored, imp = models.churn_model(e)
    n_customers = e.select("CustomerName").where(F.col("CustomerName").isNotNull()).distinct().count()
    assert scored.count() == n_customers
    bad = scored.where((F.col("churn_probability") < 0) | (F.col("churn_probability") > 1)).count()
    assert bad == 0
    bands = {r[0] for r in scored.select("churn_risk").distinct().collect()}
    assert bands <= {"Low Risk", "Medium Risk", "High Risk"}
    assert imp.count() == len(models.CHURN_FEATURES)
    again, _ = models.churn_model(e)
    a = {r[0]: r[1] for r in scored.select("CustomerName", "churn_probability").collect()}
    b = {r[0]: r[1] for r in again.select("CustomerName", "churn_probability").collect()}
    assert a == b


def test_forecast_outputs(spark):
    preds, metrics = models.forecast(frames.essential(spark, SF))
    assert preds.count() == models.FORECAST_DAYS
    assert {r[0] for r in metrics.collect()} == {"linear_regression", "random_forest"}
    assert preds.where(F.col("rf_prediction").isNull()).count() == 0

"""Features of a block of products, and the forecasts that rest on them, against the same as expressions."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_models import MONDAY, panel
from tillgrain.operators import boosting, forecasting


def test_features_of_a_block_equal_the_expressions(spark):
    weeks = [MONDAY + timedelta(weeks=t) for t in range(90)]
    df = panel(spark, 5, 90, seed=4).withColumn("units", F.when(F.col("units") > 25, F.col("units")).otherwise(0.0))
    want = forecasting.add_features(df).orderBy("week_start", "stock_code").toPandas()
    units, orders = (want[c].to_numpy(float).reshape(90, 5) for c in ("units", "orders"))
    got = forecasting.arrays(units, orders, units.sum(1), weeks)
    for c in [*forecasting.FEATURES, "units_next"]:
        x = got[c] if got[c].ndim == 2 else np.repeat(got[c][:, None], 5, 1)
        assert np.allclose(x[13:].ravel(), want[c].to_numpy(float).reshape(90, 5)[13:].ravel(), rtol=1e-12, atol=1e-12, equal_nan=True), c


def test_backtest_never_asks_for_the_features_themselves(spark):
    df = panel(spark, 6, 60, seed=2)
    features = forecasting.add_features(df)
    # of the features only units and orders may be read: they alone are kept
    poisoned = features.withColumns({c: F.raise_error(F.lit(c)).cast("double") for c in forecasting.FEATURES})
    got = forecasting.backtest(poisoned, test_weeks=4, refit_every=2, iterations=2).orderBy("week_start", "stock_code").collect()
    base = forecasting.baselines(features).where(F.col("week_start") >= F.lit(MONDAY + timedelta(weeks=56))).orderBy("week_start", "stock_code").collect()
    assert [(r.stock_code, r.week_start) for r in got] == [(r.stock_code, r.week_start) for r in base] and len(got) == 24
    for c in ("units", "units_next", "last_week", "average4", "last_year", "last_week_next", "average4_next", "last_year_next_forecast"):
        assert [r[c] for r in got] == [pytest.approx(r[c]) if r[c] is not None else None for r in base], c


def test_cuts_see_every_value():
    x = np.random.default_rng(3).permutation(np.arange(1.0, 30001.0))
    held = np.zeros(0), np.zeros(0)
    for part in np.array_split(x, 17):
        held = boosting.summary(*(np.concatenate(p) for p in zip(held, boosting.summary(part, np.ones(len(part))), strict=True)))
    assert held[1].sum() == pytest.approx(30000)
    assert np.allclose(boosting.quantiles(*held)[2:], np.arange(1, 30) * 1000, atol=120)

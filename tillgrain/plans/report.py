"""The whole run: build and check the warehouse, fit the models, keep their tables, and export one JSON of small results."""

from __future__ import annotations

from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.functions import metrics
from tillgrain.operators import analytics, customers, forecasting, inventory, quality, recommender
from tillgrain.session import stored
from tillgrain.sources.files import export, records
from tillgrain.warehouse import Warehouse

PRODUCTS_FORECAST, PRODUCTS_RECOMMENDED, NEIGHBOURS_SHOWN = 40, 150, 6


def model_tables(scores: DataFrame, forecasts: DataFrame, neighbours: DataFrame) -> dict[str, DataFrame]:
    """What lookups and questions read of the models."""
    weekly = forecasts.select("stock_code", F.col("week_start").cast("date").alias("week_start"), F.col("units").alias("actual_units"), F.round("gbm", 1).alias("forecast_units"), F.round("average4", 1).alias("baseline_units"))
    return {"ml_customer_score": scores.select("customer_id", "repeat_probability"), "ml_forecast": weekly, "ml_item_neighbour": neighbours}


def save_models(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def forecast_examples(mart_product: DataFrame, forecasts: DataFrame, panel: DataFrame, top: int = PRODUCTS_FORECAST) -> DataFrame:
    """The best-selling products with a forecast: their weeks, forecasts and errors, a row each."""
    shown = mart_product.join(forecasts.select("stock_code").distinct(), "stock_code", "left_semi").orderBy(F.desc_nulls_last("revenue"), "stock_code").limit(top).select("stock_code", "description", "revenue")

    def ordered(value: str) -> F.Column:
        return F.transform(F.sort_array(F.collect_list(F.struct("week_start", F.col(value).alias("v")))), lambda x: x["v"])

    history = panel.join(F.broadcast(shown.select("stock_code")), "stock_code").groupBy("stock_code").agg(ordered("week_start").alias("weeks"), ordered("units").alias("units"))
    test = (
        forecasts.join(F.broadcast(shown.select("stock_code")), "stock_code")
        .groupBy("stock_code")
        .agg(
            F.min("week_start").alias("test_from"),
            F.transform(ordered("gbm"), lambda v: F.round(v, 1)).alias("forecast"),
            F.transform(ordered("average4"), lambda v: F.round(v, 1)).alias("baseline"),
            metrics.wape(F.col("units"), F.col("gbm")).alias("wape"),
            metrics.wape(F.col("units"), F.col("average4")).alias("baseline_wape"),
        )
    )
    return shown.join(history, "stock_code").join(test, "stock_code")


def recommendation_examples(mart_product: DataFrame, neighbours: DataFrame, dim_product: DataFrame, top: int = PRODUCTS_RECOMMENDED, shown: int = NEIGHBOURS_SHOWN) -> DataFrame:
    """The most ordered products that have neighbours, with the closest few of each, a row a pair."""
    products = mart_product.join(neighbours.select("stock_code").distinct(), "stock_code", "left_semi").orderBy(F.desc("orders"), "stock_code").limit(top).select("stock_code", "description", "orders")
    named = dim_product.select(F.col("stock_code").alias("neighbour"), F.col("description").alias("neighbour_description"))
    return products.join(neighbours.where(F.col("rank") <= shown), "stock_code").join(named, "neighbour").select("stock_code", "description", "orders", "rank", "neighbour", "neighbour_description", "similarity", "orders_together")


def run(spark: SparkSession, warehouse: Warehouse, folder: str, *, overlap: tuple[str, str] = quality.OVERLAP, min_weeks: int = forecasting.MIN_ACTIVE_WEEKS, test_weeks: int = forecasting.TEST_WEEKS, iterations: int = 10, test_from: date | None = None, end: date | None = None) -> dict:
    """Writes tables under ``folder`` and ``data.json`` beside them; returns what the JSON holds."""
    w = warehouse.build(overlap)
    w.save(f"{folder}/tables")
    customer_summary, scores = customers.run(w.fact_sales, end)
    panel = stored(forecasting.weekly_panel(w.mart_product_weekly, w.fact_sales, min_weeks))
    forecasts = stored(forecasting.backtest(stored(forecasting.add_features(panel)), test_weeks, iterations=iterations))
    points = stored(inventory.run(forecasts, panel, w.mart_product))
    frame = recommender.baskets(w.mart_basket)
    neighbours = stored(recommender.neighbours(recommender.similarity(frame)))
    save_models(model_tables(scores, forecasts, neighbours), f"{folder}/models")
    split = test_from or w.fact_sales.agg(F.date_sub(F.max("invoice_date"), 100).alias("d")).first()["d"]
    out = {
        "profile": records(quality.profile(w.raw_lines, w.stg_lines, w.fact_sales), 6)[0] | {"tables": w.row_counts()},
        "overview": {
            "totals": records(analytics.overview_totals(w.fact_sales), 6)[0],
            "monthly": records(w.mart_monthly.orderBy("month")),
            "countries": records(analytics.country_share(w.mart_country), 6),
            "top_products": records(analytics.top_products(w.mart_product)),
            "weekdays": records(analytics.weekdays(w.fact_sales, w.dim_date).orderBy("weekday")),
        },
        "returns": {
            "summary": records(analytics.return_summary(w.fact_sales), 6)[0],
            "monthly": records(analytics.return_monthly(w.mart_monthly).orderBy("month"), 6),
            "products": records(analytics.return_by_product(w.mart_product), 6),
            "countries": records(analytics.return_by_country(w.mart_country).orderBy(F.desc("value_rate")), 6),
            "days_to_return": records(analytics.days_to_return(w.fact_sales).orderBy("first_day")),
        },
        "customers": {
            "summary": records(analytics.customer_summary(w.mart_customer_rfm).crossJoin(analytics.top_share(w.mart_customer_rfm)), 6)[0],
            "segments": records(analytics.segments(w.mart_customer_rfm).orderBy("position"), 6),
            "cohorts": records(analytics.retention_matrix(w.mart_cohort).orderBy("cohort"), 6),
            "later_retention": {k: records(analytics.later_retention(w.mart_cohort, k), 6)[0]["retention"] for k in (1, 3)},
        },
        "customer_model": customer_summary,
        "forecast": {"accuracy": records(forecasting.accuracy(forecasts), 6), "coverage": records(forecasting.coverage(w.mart_product, panel), 6)[0], "weekly_total": records(forecasting.weekly_totals(forecasts).orderBy("week_start")), "examples": records(forecast_examples(w.mart_product, forecasts, panel), 3)},
        "inventory": {"frontier": records(points.orderBy("policy", "z"), 6), "comparison": records(inventory.comparison(points), 6), "same_z": records(inventory.same_z(points).orderBy("z"), 6)},
        "recommender": {"models": records(recommender.evaluate(w.mart_basket, split), 6), "examples": records(recommendation_examples(w.mart_product, neighbours, w.dim_product).orderBy(F.desc("orders"), "stock_code", "rank"), 3)},
    }
    export(out, Path(folder, "data.json"))
    return out

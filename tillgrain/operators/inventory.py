"""Replenishment: a weekly order-up-to policy simulated per product, and what fill rate its stock buys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillgrain.functions.columns import ratio, spread

PROTECTION = 3
LEAD_TIME = PROTECTION - 1
Z_VALUES = [0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0]
POLICIES = {"Gradient boosting forecast": "gbm_next", "Average of last 4 weeks": "average4_next"}
TARGETS = [0.90, 0.95, 0.98]


def demand_sigma(panel: DataFrame, before: Column | None = None) -> DataFrame:
    """Sample deviation of each product's demand over the protection period, over full periods before a day."""
    own = W.partitionBy("stock_code").orderBy("week_start")
    rolling = own.rowsBetween(1 - PROTECTION, 0)
    history = panel if before is None else panel.where(F.col("week_start") < before)
    sums = history.withColumn("period", F.when(F.count("units").over(rolling) == PROTECTION, F.sum("units").over(rolling)))
    return sums.groupBy("stock_code").agg(spread(F.col("period")).alias("sigma"))


def series(forecasts: DataFrame, policies: dict[str, str]) -> DataFrame:
    """A row a product and policy: weeks in order, each with its demand and the policy's forecast. Weeks whose protection period
    isn't known don't count. All policies are gathered in one pass."""
    columns = list(policies.values())
    weeks = forecasts.where("units_next IS NOT NULL").groupBy("stock_code").agg(F.sort_array(F.collect_list(F.struct("week_start", "units", *columns))).alias("weeks"))

    def of(column: str) -> Column:
        return F.transform("weeks", lambda w: F.struct(w["units"].alias("demand"), w[column].alias("forecast"))).alias("weeks")

    own = [F.struct(F.lit(name).alias("policy"), of(column)) for name, column in policies.items()]
    return weeks.select("stock_code", F.explode(F.array(*own)).alias("own")).select("stock_code", "own.policy", "own.weeks")


def simulate(products: DataFrame, z: DataFrame, lead_time: int = LEAD_TIME) -> DataFrame:
    """``products``: stock_code, weeks, sigma, price; ``z``: one column z, a few rows. Per product and z: demand, served, stock.

    A week: receive what is due, look at what is on hand and on order, order up to the level, sell, keep the rest. The state
    (on hand, what is due in the next weeks, totals) folds over the weeks inside one expression.
    """
    if lead_time < 1:
        raise ValueError("an order takes a week at least")

    def level(w: Column) -> Column:
        return F.greatest(w["forecast"] + F.col("z") * F.col("sigma"), F.lit(0.0))

    def week(state: Column, w: Column) -> Column:
        on_hand = state["on_hand"] + F.get(state["due"], F.lit(0))
        later = F.slice(state["due"], 2, lead_time)
        position = on_hand + F.aggregate(later, F.lit(0.0), lambda a, x: a + x)
        order = F.greatest(level(w) - position, F.lit(0.0))
        sold = F.least(on_hand, w["demand"])
        return F.struct(
            (on_hand - sold).alias("on_hand"), F.concat(later, F.array(order)).alias("due"), (state["served"] + sold).alias("served"), (state["stock"] + on_hand - sold).alias("stock"), (state["demand"] + w["demand"]).alias("demand")
        )

    start = F.struct(level(F.get("weeks", F.lit(0))).alias("on_hand"), F.array_repeat(F.lit(0.0), lead_time).alias("due"), *[F.lit(0.0).alias(c) for c in ("served", "stock", "demand")])
    run = products.crossJoin(F.broadcast(z)).withColumn("end", F.aggregate("weeks", start, week))
    return run.select(*[c for c in products.columns if c not in ("weeks", "sigma")], "z", F.size("weeks").alias("n_weeks"), "end.served", "end.stock", "end.demand")


def frontier(simulated: DataFrame, *groups: str) -> DataFrame:
    """By z: the value-weighted fill rate and the average stock value."""
    value = F.col("price")
    return simulated.groupBy(*groups, "z").agg(ratio(F.sum(F.col("served") * value), F.sum(F.col("demand") * value)).alias("fill_rate"), F.sum(F.col("stock") / F.col("n_weeks") * value).alias("average_stock_value"))


def stock_for_fill_rate(points: DataFrame, targets: list[float] = TARGETS, group: str = "policy") -> DataFrame:
    """Stock value at which a policy reaches a fill rate, linear between its points; null outside them."""
    order = W.partitionBy(group).orderBy("fill_rate", "average_stock_value")
    steps = points.select(group, F.col("fill_rate").alias("hi"), F.col("average_stock_value").alias("hi_stock"), F.lag("fill_rate").over(order).alias("lo"), F.lag("average_stock_value").over(order).alias("lo_stock"))
    wanted = points.sparkSession.createDataFrame([(t,) for t in targets], "target double")
    met = steps.crossJoin(F.broadcast(wanted)).where("(target <= hi AND target > lo) OR target = hi")
    at = F.col("lo_stock") + (F.col("target") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * (F.col("hi_stock") - F.col("lo_stock"))
    found = met.groupBy(group, "target").agg(F.min(F.when(F.col("target") == F.col("hi"), F.col("hi_stock")).otherwise(at)).alias("stock"))
    everything = points.select(group).distinct().crossJoin(F.broadcast(wanted))
    return everything.join(found, [group, "target"], "left").select(group, "target", "stock")


def run(forecasts: DataFrame, panel: DataFrame, mart_product: DataFrame, policies: dict[str, str] | None = None, z_values: list[float] = Z_VALUES) -> DataFrame:
    """The frontier of each policy: policy, z, fill_rate, average_stock_value."""
    spark = forecasts.sparkSession
    z = spark.createDataFrame([(float(x),) for x in z_values], "z double")
    first = forecasts.agg(F.min("week_start").alias("first")).first()["first"]
    sigma = demand_sigma(panel, F.lit(first))
    prices = mart_product.select("stock_code", F.col("median_price").alias("price"))
    products = series(forecasts, policies or POLICIES).join(sigma, "stock_code").join(prices, "stock_code")
    return frontier(simulate(products, z), "policy")


def comparison(points: DataFrame, model: str = "Gradient boosting forecast", baseline: str = "Average of last 4 weeks", targets: list[float] = TARGETS) -> DataFrame:
    """Stock of both policies at each target that both reach."""
    stock = stock_for_fill_rate(points, targets)
    pair = stock.groupBy("target").agg(F.max(F.when(F.col("policy") == model, F.col("stock"))).alias("model_stock"), F.max(F.when(F.col("policy") == baseline, F.col("stock"))).alias("baseline_stock"))
    return pair.where("model_stock IS NOT NULL AND baseline_stock IS NOT NULL").withColumn("stock_reduction", 1 - ratio(F.col("model_stock"), F.col("baseline_stock")))


def same_z(points: DataFrame, model: str = "Gradient boosting forecast", baseline: str = "Average of last 4 weeks") -> DataFrame:
    def of(policy: str, c: str) -> Column:
        return F.max(F.when(F.col("policy") == policy, F.col(c)))

    return points.groupBy("z").agg(of(model, "fill_rate").alias("model_fill"), of(baseline, "fill_rate").alias("baseline_fill"), of(model, "average_stock_value").alias("model_stock"), of(baseline, "average_stock_value").alias("baseline_stock"))

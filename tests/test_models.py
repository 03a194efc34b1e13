"""Features that never look ahead, metrics, the stock recurrence, and baskets."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tillgrain.functions import metrics
from tillgrain.operators import customers, forecasting, inventory, recommender

MONDAY = date(2010, 1, 4)


def panel(spark, products=3, weeks=70, seed=1, change=None):
    rng = random.Random(seed)
    rows = [(f"{p:05d}", MONDAY + timedelta(weeks=t), float(rng.randrange(40)), float(rng.randrange(9))) for p in range(products) for t in range(weeks)]
    if change:
        rows = [(c, w, u + (1000 if w >= change else 0), o) for c, w, u, o in rows]
    return spark.createDataFrame(rows, "stock_code string, week_start date, units double, orders double")


def test_features_never_look_ahead(spark):
    day = MONDAY + timedelta(weeks=60)
    past = [forecasting.add_features(panel(spark, change=c)).where(F.col("week_start") <= F.lit(day)).orderBy("stock_code", "week_start").select(*forecasting.FEATURES).collect() for c in (None, day)]
    assert past[0] == past[1]


def test_target_is_the_protection_period(spark):
    rows = forecasting.product_features(panel(spark, 1, 30)).orderBy("week_start").collect()
    assert all(r.units_next == rows[i].units + rows[i + 1].units + rows[i + 2].units for i, r in enumerate(rows[:-2]))
    assert rows[-1].units_next is None and rows[0].median8 is None and rows[0].mean4 is None


def test_median_and_spread_by_brute_force(spark):
    import statistics

    rows = forecasting.product_features(panel(spark, 1, 40)).orderBy("week_start").collect()
    for i, r in enumerate(rows[1:], 1):
        assert r.median8 == statistics.median(x.units for x in rows[max(0, i - 8) : i])
        if i > 1:
            assert r.std8 == pytest.approx(statistics.stdev(x.units for x in rows[max(0, i - 8) : i]), abs=1e-9)


def test_wape_and_bias(spark):
    df = spark.createDataFrame([(10.0, 12.0), (0.0, 4.0), (30.0, 24.0), (None, 5.0)], "a double, f double")
    r = df.agg(metrics.wape(F.col("a"), F.col("f")).alias("w"), metrics.bias(F.col("a"), F.col("f")).alias("b")).first()
    assert (r.w, r.b) == (12 / 40, 0.0)


def test_auc_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(6) / 5, rng.randrange(2)) for i in range(60)]
    got = metrics.ranking(spark.createDataFrame(rows, "k int, s double, y int"), F.col("s"), "y", "k", probability=True).first()
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    assert got.roc_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    assert got.brier == pytest.approx(sum((s - y) ** 2 for _, s, y in rows) / 60)


def simulated(demand, forecast, sigma, z, price=1.0, lead=2):
    on_hand, due, served, stock = max(forecast[0] + z * sigma, 0), [0.0] * lead, 0.0, 0.0
    for d, f in zip(demand, forecast, strict=True):
        on_hand += due.pop(0)
        due.append(max(max(f + z * sigma, 0) - on_hand - sum(due), 0))
        sold = min(on_hand, d)
        on_hand -= sold
        served += sold
        stock += on_hand
    return served, stock


def products(spark, forecast_of):
    rng = random.Random(5)
    rows = []
    for p in range(4):
        demand = [float(rng.randrange(15, 45)) for _ in range(20)]
        rows.append((str(p), [(d, float(f)) for d, f in zip(demand, forecast_of(demand), strict=True)], 9.0, 1.0))
    return rows, spark.createDataFrame(rows, "stock_code string, weeks array<struct<demand:double,forecast:double>>, sigma double, price double")


@pytest.mark.parametrize("share", [0.0, 1.5, 3.2])
def test_stock_recurrence_by_a_plain_loop(spark, share):
    rows, df = products(spark, lambda demand: [share * d for d in demand])
    z = spark.createDataFrame([(0.0,), (2.0,)], "z double")
    got = {(r.stock_code, r.z): (r.served, r.stock) for r in inventory.simulate(df, z).collect()}
    for code, weeks, sigma, _ in rows:
        for k in (0.0, 2.0):
            assert got[code, k] == pytest.approx(simulated([w[0] for w in weeks], [w[1] for w in weeks], sigma, k))


def test_more_safety_more_fill_and_stock(spark):
    _, df = products(spark, lambda demand: [sum(demand) / len(demand) * 1.5] * len(demand))
    points = inventory.frontier(inventory.simulate(df, spark.createDataFrame([(0.0,), (3.0,)], "z double"))).orderBy("z").collect()
    assert points[0].fill_rate < points[1].fill_rate and points[0].average_stock_value < points[1].average_stock_value
    _, none = products(spark, lambda demand: [0.0] * len(demand))
    assert inventory.frontier(inventory.simulate(none, spark.createDataFrame([(0.0,)], "z double"))).first().fill_rate == 0


def test_stock_for_a_fill_rate_lies_between_points(spark):
    points = spark.createDataFrame([("a", 0.8, 100.0), ("a", 0.9, 200.0)], "policy string, fill_rate double, average_stock_value double")
    assert {r.target: r.stock for r in inventory.stock_for_fill_rate(points, [0.8, 0.85, 0.95]).collect()} == {0.8: 100.0, 0.85: pytest.approx(150.0), 0.95: None}


def toy(spark):
    rows = [(f"o{i}", c) for i in range(6) for c in ("TEA", "CUP")] + [(f"o{i}", "SOAP") for i in range(4, 9)] + [(f"o{i}", "TOWEL") for i in range(6, 9)]
    return spark.createDataFrame(rows, "invoice string, stock_code string")


def test_toy_baskets(spark):
    pairs = recommender.similarity(toy(spark), min_orders=1)
    tea = {r.neighbour: r for r in pairs.where("stock_code = 'TEA'").collect()}
    assert tea["CUP"].similarity == 1 and tea["CUP"].orders_together == 6 and "TEA" not in tea
    assert recommender.recommend(pairs, ["TEA"], 1).first().stock_code == "CUP"
    assert recommender.recommend(pairs, ["TOWEL"], 1).first().stock_code == "SOAP"
    assert recommender.recommend(pairs, ["NONE"]).count() == 0
    assert recommender.neighbours(pairs).where("stock_code = neighbour").count() == 0


def test_customer_features_stop_at_the_cutoff(spark, folder):
    from tillgrain.queries import warehouse

    fact = warehouse(spark, folder).fact_sales
    day = date(1999, 1, 1)
    frames = [customers.features_at(f, [day]).drop("will_order").orderBy("customer_id").collect() for f in (fact, fact.where(F.col("invoice_date") < F.lit(day)))]
    assert frames[0] == frames[1] and frames[0]
    assert customers.cutoffs(date(2011, 12, 10))[1] == date(2011, 9, 11)


def test_customer_model_scores_everyone(spark, folder):
    from tillgrain.queries import warehouse

    fact = warehouse(spark, folder).fact_sales
    summary, scores = customers.run(fact, date(2001, 8, 2))
    assert {m["model"] for m in summary["models"]} >= {"Logistic regression", "Gradient boosting"}
    assert scores.where("repeat_probability < 0 OR repeat_probability > 1").count() == 0
    assert sum(d["customers"] for d in summary["deciles"]) > 0


def test_backtest_covers_each_test_week_once(spark):
    features = forecasting.add_features(panel(spark, 4, 40))
    out = forecasting.backtest(features, test_weeks=4, refit_every=2, iterations=2)
    assert out.count() == 16 and out.where("gbm < 0 OR gbm IS NULL").count() == 0
    table = {r.model: r for r in forecasting.accuracy(out).collect()}
    assert set(table) == set(forecasting.MODELS)
    assert forecasting.weekly_totals(out).count() == 4


def test_registered_forecast_is_the_whole_backtest(spark, folder, monkeypatch):
    from tillgrain import queries

    asked = {}

    def cheap(features, test_weeks=forecasting.TEST_WEEKS, refit_every=forecasting.REFIT_EVERY, iterations=forecasting.ITERATIONS):
        asked.update(test_weeks=test_weeks, iterations=iterations)
        weeks = [r.week_start for r in features.select("week_start").distinct().orderBy("week_start").collect()][-test_weeks:]
        out = forecasting.baselines(features.where(F.col("week_start").isin(weeks)))
        return out.withColumns({"gbm": F.col("mean4"), "gbm_next": F.col("average4_next")})

    monkeypatch.setattr(forecasting, "backtest", cheap)
    monkeypatch.setattr(queries, "_MORE", {})
    assert queries.QUERIES["ml_forecast"](spark, folder).select("week_start").distinct().count() == 26
    assert asked["iterations"] >= 10
    policies = {r.policy for r in queries.QUERIES["inventory_frontier"](spark, folder).select("policy").distinct().collect()}
    assert policies == {"Gradient boosting forecast", "Average of last 4 weeks", "Last week"}
    assert {r.policy for r in queries.QUERIES["stock_for_fill_rate"](spark, folder).collect()} == policies

"""Queries that need no line numbers leave them out, and hold no more rows than they need."""

import random
from datetime import date, timedelta

from tillgrain import queries
from tillgrain.operators import customers, recommender
from tillgrain.plans import report
from tillgrain.warehouse import Warehouse

DAY = date(2010, 6, 1)


def lines(spark):
    """Orders over several days, products bought again, null dates, orders and codes."""
    rng = random.Random(4)
    rows = []
    for _ in range(600):
        day = rng.choice([None] + [DAY + timedelta(days=d) for d in range(-130, 60)])
        rows.append((rng.randrange(6), rng.choice([None, *"abcdefgh"]), rng.choice([None, *"pqrst"]), day, rng.choice(["United Kingdom", "France", None]), rng.randrange(1, 9), 1.25, rng.choice(["sale", "sale", "return"])))
    return rows, spark.createDataFrame(rows, "customer_id int, invoice string, stock_code string, invoice_date date, country string, quantity int, amount double, line_type string")


def test_distinct_counts_by_brute_force_without_copies_of_rows(spark):
    rows, fact = lines(spark)
    cutoffs = [DAY, DAY - timedelta(days=60)]
    got = customers.features_at(fact, cutoffs)
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.cutoff, r.customer_id): r for r in got.collect()}
    for cut in cutoffs:
        for who in range(6):
            past = [r for r in rows if r[0] == who and r[3] and r[3] < cut]
            sales = [r for r in past if r[7] == "sale"]
            mine = found[cut, who]
            assert mine.orders == len({r[1] for r in sales} - {None}) and mine.distinct_products == len({r[2] for r in sales} - {None})
            assert mine.orders_last_90d == len({r[1] for r in sales if r[3] >= cut - timedelta(days=90)} - {None})
            assert mine.is_uk == (2 * sum(r[4] == "United Kingdom" for r in past) > len(past)) and mine.units == sum(r[5] for r in sales)


def test_customers_and_baskets_need_no_numbered_lines(spark, folder, monkeypatch):
    monkeypatch.setattr(queries, "_WAREHOUSES", {})
    monkeypatch.setattr(queries, "_MORE", {})
    w = queries.warehouse(spark, folder)
    numbered = Warehouse.of_orders(spark, folder)
    numbered.fact_sales.count()
    for name in ("dim_customer", "mart_customer_rfm", "mart_basket"):
        narrow, full = getattr(w, name), getattr(numbered, name)
        assert narrow.exceptAll(full).isEmpty() and full.exceptAll(narrow).isEmpty()
    assert not {"raw_lines", "stg_lines", "fact_sales"} & set(w.__dict__)


def test_recommendation_examples_pair_only_the_top_products_and_number_no_lines(spark, folder, monkeypatch):
    monkeypatch.setattr(queries, "_WAREHOUSES", {})
    monkeypatch.setattr(queries, "_MORE", {})
    monkeypatch.setattr(recommender.item_counts, "__defaults__", (1,))
    monkeypatch.setattr(report, "PRODUCTS_RECOMMENDED", 40)
    got = queries.QUERIES["recommendation_examples"](spark, folder)
    w = queries.warehouse(spark, folder)
    assert not {"raw_lines", "stg_lines", "fact_sales"} & set(w.__dict__) and not queries._MORE
    whole = Warehouse.of_orders(spark, folder)
    near = recommender.neighbours(recommender.similarity(recommender.baskets(whole.mart_basket), 1))
    want = report.recommendation_examples(whole.mart_product, near, whole.dim_product, 40)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.select("stock_code").distinct().count() == 40

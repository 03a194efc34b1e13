"""The driver's queries over the retail engine, and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from tillgrain.functions.columns import money
from tillgrain.operators import analytics, customers, forecasting, holdout, inventory, lakehouse, quality, recommender
from tillgrain.oracle import over
from tillgrain.plans import report, service
from tillgrain.plans.questions import QUESTIONS
from tillgrain.session import stored
from tillgrain.warehouse import Warehouse

Query = Callable[[SparkSession, str], DataFrame]

#: The adapter's data have fewer lines a product than the thresholds were made for.
MIN_WEEKS, MIN_LINES, OVERLAP = 30, 20, ("1998-05-01", "1998-05-09")
CUTOFF, LATER = date(2000, 6, 1), date(2001, 1, 1)
TEST_FROM = date(2001, 1, 1)
BASKET = ["00001A", "00002BL", "00003"]

_WAREHOUSES: dict[tuple[str, str], Warehouse] = {}
_MORE: dict[tuple[str, str, str], DataFrame] = {}


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    """One for each application and folder, so that queries share what they read."""
    key = spark.sparkContext.applicationId, folder
    if key not in _WAREHOUSES:
        _WAREHOUSES[key] = Warehouse.of_orders(spark, folder)
    return _WAREHOUSES[key]


def _shared(name: str, make: Callable[[Warehouse], DataFrame], keep: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    def get(spark: SparkSession, folder: str) -> DataFrame:
        key = spark.sparkContext.applicationId, folder, name
        if key not in _MORE:
            made = make(warehouse(spark, folder))
            _MORE[key] = made.persist() if keep else made
        return _MORE[key]

    return get


panel = _shared("panel", lambda w: forecasting.weekly_panel(w.demand, w.traded, MIN_WEEKS), keep=False)
pairs = _shared("pairs", lambda w: recommender.similarity(recommender.baskets(w.mart_basket)))


def features(spark: SparkSession, folder: str) -> DataFrame:
    return forecasting.add_features(panel(spark, folder))


def _modelled(spark: SparkSession, folder: str) -> DataFrame:
    """Backtest of the operator's test weeks over all products of the panel."""
    key = spark.sparkContext.applicationId, folder, "backtest"
    if key not in _MORE:
        # the adapter's returns go on for months after the last sale; forecasts are tested on weeks that had sales
        until = warehouse(spark, folder).demand.agg(F.max("week_start").alias("last")).first()["last"]
        grid = panel(spark, folder).where(F.col("week_start") < F.lit(until))
        _MORE[key] = stored(forecasting.backtest(forecasting.add_features(grid)))
    return _MORE[key]


def ml_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return _modelled(spark, folder).select("stock_code", "week_start", F.col("units").alias("actual_units"), F.round("gbm", 1).alias("forecast_units"), F.round("average4", 1).alias("baseline_units"))


def _customer_model(spark: SparkSession, folder: str) -> tuple[dict, DataFrame]:
    key = spark.sparkContext.applicationId, folder, "scores"
    if key not in _MORE:
        fact = warehouse(spark, folder).traded
        last_sale = fact.where("line_type = 'sale'").agg(F.date_add(F.max("invoice_date"), 1).alias("end")).first()["end"]
        summary, scores = customers.run(fact, last_sale)
        _MORE[key] = summary, stored(scores)
    return _MORE[key]


def ml_customer_score(spark: SparkSession, folder: str) -> DataFrame:
    return _customer_model(spark, folder)[1]


def _question(sql: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        w = warehouse(spark, folder)
        for name in Warehouse.TABLES:
            if name in sql:
                getattr(w, name).createOrReplaceTempView(name)
        if "ml_forecast" in sql:
            ml_forecast(spark, folder).createOrReplaceTempView("ml_forecast")
        if "ml_customer_score" in sql:
            ml_customer_score(spark, folder).createOrReplaceTempView("ml_customer_score")
        return spark.sql(sql)

    return run


def _of(make: Callable[[Warehouse], DataFrame]) -> Query:
    return lambda spark, folder: make(warehouse(spark, folder))


def _of_features(*columns: str) -> Query:
    return lambda spark, folder: forecasting.product_features(panel(spark, folder)).select("stock_code", "week_start", *columns)


def _cut(day: date) -> str:
    return f"DATE '{day.isoformat()}'"


_CASH = "CAST(sum({0}) AS DOUBLE)"
_SOLD, _BACK = "FILTER (WHERE line_type = 'sale')", "FILTER (WHERE line_type = 'return')"
_W = "OVER (PARTITION BY stock_code ORDER BY week_start ROWS BETWEEN {0} PRECEDING AND {1} PRECEDING)"
_O = "OVER (PARTITION BY stock_code ORDER BY week_start)"


def _mean(c: str, n: int, until: int = 1) -> str:
    over_ = _W.format(n, until)
    return f"sum({c}) {over_} / nullif(count({c}) {over_}, 0)"


_STD = "CASE WHEN count({0}) {1} >= 2 THEN sqrt((count({0}) {1} * sum({0} * {0}) {1} - sum({0}) {1} * sum({0}) {1}) / (count({0}) {1} * (count({0}) {1} - 1))) END"
_FEATURES_AT = """
SELECT cutoff, customer_id, recency_days, tenure_days, orders, net_spend, net_spend / orders AS average_order_value, distinct_products, units, return_line_share, orders_last_90d, spend_last_90d,
    CASE WHEN orders > 1 THEN CAST(tenure_days - recency_days AS DOUBLE) / (orders - 1) ELSE CAST(tenure_days AS DOUBLE) END AS days_between_orders, is_uk, will_order
FROM (SELECT cutoff, customer_id, date_diff('day', max(invoice_date) FILTER (WHERE past AND line_type = 'sale'), cutoff) AS recency_days, date_diff('day', min(invoice_date) FILTER (WHERE past AND line_type = 'sale'), cutoff) AS tenure_days,
    count(DISTINCT invoice) FILTER (WHERE past AND line_type = 'sale') AS orders, CAST(sum(cash) FILTER (WHERE past) AS DOUBLE) AS net_spend, count(DISTINCT stock_code) FILTER (WHERE past AND line_type = 'sale') AS distinct_products,
    CAST(sum(quantity) FILTER (WHERE past AND line_type = 'sale') AS BIGINT) AS units, CAST(count(*) FILTER (WHERE past AND line_type = 'return') AS DOUBLE) / nullif(count(*) FILTER (WHERE past), 0) AS return_line_share,
    count(DISTINCT invoice) FILTER (WHERE past AND line_type = 'sale' AND invoice_date >= cutoff - 90) AS orders_last_90d, CAST(coalesce(sum(cash) FILTER (WHERE past AND line_type = 'sale' AND invoice_date >= cutoff - 90), 0) AS DOUBLE) AS spend_last_90d,
    CAST(count(*) FILTER (WHERE past AND country = 'United Kingdom') * 2 > count(*) FILTER (WHERE past) AS BIGINT) AS is_uk,
    CAST(count(*) FILTER (WHERE NOT past AND line_type = 'sale' AND invoice_date < cutoff + 90) > 0 AS BIGINT) AS will_order, count(*) FILTER (WHERE past AND line_type = 'sale') AS sales
    FROM (SELECT f.*, cutoff, invoice_date < cutoff AS past FROM fact f CROSS JOIN (VALUES {cutoffs}) c(cutoff) WHERE customer_id IS NOT NULL) GROUP BY cutoff, customer_id) WHERE sales > 0"""
_AT = _FEATURES_AT.replace("{cutoffs}", f"({_cut(LATER)})")
_RANKED = f"""
WITH t AS ({_AT}), s AS (SELECT 'most recent buyers first' AS model, CAST(-recency_days AS DOUBLE) AS s, will_order AS y, customer_id FROM t UNION ALL SELECT 'most frequent buyers first', CAST(orders AS DOUBLE), will_order, customer_id FROM t),
g AS (SELECT model, s, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY model ORDER BY s DESC) AS seen FROM g),
a AS (SELECT model, CAST(sum((n - pos) * (2 * tp - pos)) AS DOUBLE) AS above, sum(CAST(tp AS DOUBLE) / seen * pos) AS precise, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY model),
d AS (SELECT model, CAST(sum(y) AS DOUBLE) / count(*) AS top FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY s DESC, customer_id) AS pos, count(*) OVER (PARTITION BY model) AS n FROM s) WHERE pos <= greatest(1, n // 10) GROUP BY model)
SELECT model, above / (2 * p * (n - p)) AS roc_auc, round(precise / p, 9) AS average_precision, top AS top_decile_rate, top / (p / n) AS top_decile_lift FROM a JOIN d USING (model)"""


def _frontier(spark: SparkSession, folder: str) -> DataFrame:
    """The policies over the backtest's test weeks."""
    w = warehouse(spark, folder)
    return inventory.run(_modelled(spark, folder), panel(spark, folder), w.prices, inventory.POLICIES | {"Last week": "last_week_next"})


def _baseline_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    models = {k: v for k, v in forecasting.MODELS.items() if k != "Gradient boosting"}
    base = forecasting.baselines(forecasting.product_features(panel(spark, folder)))
    return forecasting.accuracy(base, models).withColumn("median_product_wape", F.round("median_product_wape", 9))


TARGETS, BASELINES = [0.5, 0.7, 0.9], {"Average of last 4 weeks": "average4_next", "Last week": "last_week_next"}


def _simple(spark: SparkSession, folder: str) -> DataFrame:
    """The forecasts that need no model, over the backtest's test weeks."""
    until = warehouse(spark, folder).mart_product_weekly.agg(F.max("week_start").alias("last"))
    grid = panel(spark, folder).crossJoin(F.broadcast(until)).where("week_start < last").drop("last")
    first = F.broadcast(grid.agg(F.date_sub(F.max("week_start"), 7 * (forecasting.TEST_WEEKS - 1)).alias("first")))
    return forecasting.baselines(forecasting.product_features(grid)).crossJoin(first).where("week_start >= first").drop("first")


def _simple_frontier(spark: SparkSession, folder: str) -> DataFrame:
    key = spark.sparkContext.applicationId, folder, "frontier"
    if key not in _MORE:
        _MORE[key] = stored(inventory.run(stored(_simple(spark, folder)), panel(spark, folder), warehouse(spark, folder).mart_product, BASELINES))
    return _MORE[key]


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


_Z = ", ".join(f"({z})" for z in inventory.Z_VALUES)
#: The policy week by week: b is what is at hand before sales, d1 and d2 what comes in one and two weeks.
_SIMPLE = """
grid AS (SELECT *, lag(units, 1) {o} AS lag1, lag(units, 52) {o} AS lag52, {m} AS mean4, units + lead(units, 1) {o} + lead(units, 2) {o} AS units_next FROM panel WHERE week_start < (SELECT max(week_start) FROM mart_product_weekly)),
test AS (SELECT * FROM grid WHERE week_start >= (SELECT max(week_start) FROM grid) - {days}),
sigmas AS (SELECT stock_code, CASE WHEN count(x) >= 2 THEN sqrt((count(x) * sum(x * x) - sum(x) * sum(x)) / (count(x) * (count(x) - 1))) END AS sigma FROM (SELECT stock_code, CASE WHEN count(units) OVER w = 3 THEN sum(units) OVER w END AS x FROM panel WHERE week_start < (SELECT min(week_start) FROM test) WINDOW w AS (PARTITION BY stock_code ORDER BY week_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) GROUP BY 1),
plans AS (SELECT 'Average of last 4 weeks' AS policy, stock_code, week_start, units, mean4 * 3 AS f FROM test WHERE units_next IS NOT NULL UNION ALL SELECT 'Last week', stock_code, week_start, units, lag1 * 3 FROM test WHERE units_next IS NOT NULL),
levels AS (SELECT policy, stock_code, z, units, greatest(f + z * sigma, 0.0) AS level, row_number() OVER (PARTITION BY policy, stock_code, z ORDER BY week_start) AS k FROM plans JOIN sigmas USING (stock_code) CROSS JOIN (VALUES {z}) v(z)),
runs AS (SELECT policy, stock_code, z, 1 AS k, CAST(level AS DOUBLE) AS b, 0.0::DOUBLE AS d1, greatest(level - CAST(level AS DOUBLE), 0.0)::DOUBLE AS d2, units FROM levels WHERE k = 1
    UNION ALL SELECT r.policy, r.stock_code, r.z, r.k + 1, r.b - least(r.b, r.units) + r.d1, r.d2, greatest(l.level - (r.b - least(r.b, r.units) + r.d1 + r.d2), 0.0), l.units FROM runs r JOIN levels l ON l.policy = r.policy AND l.stock_code = r.stock_code AND l.z = r.z AND l.k = r.k + 1),
ends AS (SELECT policy, stock_code, z, count(*) AS weeks, sum(least(b, units)) AS served, sum(b - least(b, units)) AS stock, sum(units) AS demand FROM runs GROUP BY ALL),
points AS (SELECT policy, CAST(z AS DOUBLE) AS z, sum(served * median_price) / nullif(sum(demand * median_price), 0) AS fill_rate, sum(stock / weeks * median_price) AS average_stock_value FROM ends JOIN mart_product USING (stock_code) GROUP BY 1, 2)""".format(o=_O, m=_mean("units", 4), days=7 * (forecasting.TEST_WEEKS - 1), z=_Z)
_SIMPLE_STOCK = f"""
steps AS (SELECT policy, fill_rate AS hi, average_stock_value AS hi_stock, lag(fill_rate) OVER w AS lo, lag(average_stock_value) OVER w AS lo_stock FROM points WINDOW w AS (PARTITION BY policy ORDER BY fill_rate, average_stock_value)),
goals AS (SELECT * FROM (SELECT DISTINCT policy FROM points) CROSS JOIN (VALUES {", ".join(f"({t})" for t in TARGETS)}) v(target)),
stocks AS (SELECT g.policy, CAST(g.target AS DOUBLE) AS target, min(CASE WHEN g.target = hi THEN hi_stock ELSE lo_stock + (g.target - lo) / nullif(hi - lo, 0) * (hi_stock - lo_stock) END) AS stock
    FROM goals g LEFT JOIN steps s ON s.policy = g.policy AND (g.target = hi OR (g.target <= hi AND g.target > lo)) GROUP BY 1, 2)"""

_P = "SELECT *, lag(units, 1) {o} AS lag1, lag(units, 52) {o} AS lag52, {m} AS mean4, lag(units, 52) {o} + lag(units, 51) {o} + lag(units, 50) {o} AS lyn, units + lead(units, 1) {o} + lead(units, 2) {o} AS units_next FROM panel".replace("{o}", _O).replace("{m}", _mean("units", 4))


def _err(name: str, one: str, period: str) -> str:
    def rate(num: str, f: str, a: str) -> str:
        return f"sum(CASE WHEN {a} IS NOT NULL AND {f} IS NOT NULL THEN {num} END) / nullif(sum(CASE WHEN {f} IS NOT NULL THEN {a} END), 0)"

    each = f"SELECT round(median(w), 9) FROM (SELECT sum(abs({one} - units)) / greatest(sum(units), 1.0) AS w FROM p WHERE units IS NOT NULL AND {one} IS NOT NULL GROUP BY stock_code)"
    return f"SELECT '{name}' AS model, ({each}) AS median_product_wape, {rate(f'abs({one} - units)', one, 'units')} AS wape, {rate(f'{one} - units', one, 'units')} AS bias, {rate(f'abs({period} - units_next)', period, 'units_next')} AS wape_next, {rate(f'{period} - units_next', period, 'units_next')} AS bias_next FROM p"


_HELD = f"""
WITH tr AS (SELECT * FROM basket_sizes WHERE invoice_date < {_cut(TEST_FROM)}), te AS (SELECT * FROM basket_sizes WHERE invoice_date >= {_cut(TEST_FROM)}),
it AS (SELECT stock_code, count(DISTINCT invoice) AS n FROM tr GROUP BY 1 HAVING count(DISTINCT invoice) >= 20),
sim AS (SELECT a.stock_code, b.stock_code AS neighbour, count(*) / sqrt(any_value(i.n) * any_value(j.n)) AS s FROM tr a JOIN tr b ON a.invoice = b.invoice AND a.stock_code <> b.stock_code JOIN it i ON i.stock_code = a.stock_code JOIN it j ON j.stock_code = b.stock_code GROUP BY 1, 2),
k AS (SELECT invoice, te.stock_code, count(*) OVER (PARTITION BY invoice) AS c, row_number() OVER (PARTITION BY invoice ORDER BY md5(invoice || '|' || te.stock_code), te.stock_code) AS t FROM te JOIN it USING (stock_code)),
h AS (SELECT invoice, stock_code AS hidden FROM k WHERE c >= 2 AND t = 1), sh AS (SELECT invoice, stock_code FROM k WHERE c >= 2 AND t > 1),
sc AS (SELECT sh.invoice, neighbour, round(sum(s), 9) AS score FROM sh JOIN sim USING (stock_code) GROUP BY 1, 2),
op AS (SELECT sc.* FROM sc ANTI JOIN sh ON sh.invoice = sc.invoice AND sh.stock_code = sc.neighbour),
own AS (SELECT h.invoice, hidden, coalesce(op.score, 0) AS own FROM h LEFT JOIN op ON op.invoice = h.invoice AND op.neighbour = hidden),
r1 AS (SELECT own.invoice, hidden, count(*) FILTER (WHERE op.score > own.own) AS by_similarity FROM own LEFT JOIN op ON op.invoice = own.invoice GROUP BY 1, 2),
r2 AS (SELECT r1.invoice, (SELECT count(*) FROM it x WHERE x.n > y.n) - (SELECT count(*) FROM sh JOIN it z USING (stock_code) WHERE sh.invoice = r1.invoice AND z.n > y.n) AS by_popularity FROM r1 JOIN it y ON y.stock_code = hidden)
SELECT invoice, by_similarity, by_popularity FROM r1 JOIN r2 USING (invoice)"""


def _held_ranks(spark: SparkSession, folder: str) -> DataFrame:
    baskets, by = warehouse(spark, folder).sold()
    return holdout.ranks(stored(holdout.gathered(baskets, TEST_FROM, recommender.MAX_BASKET, by)), recommender.MIN_ITEM_ORDERS)


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return recommender.neighbours(pairs(spark, folder))


def _recommended(spark: SparkSession, folder: str) -> DataFrame:
    """Of the most ordered products alone: their pairs, their names and their neighbours' names."""
    w = warehouse(spark, folder)
    frame = recommender.baskets(w.mart_basket)
    lines = recommender.linked(frame, stored(recommender.item_counts(frame)))
    orders = w.mart_basket.select("invoice", "stock_code").distinct().groupBy("stock_code").agg(F.count("invoice").alias("orders"))
    top = stored(orders.join(lines.select("stock_code").distinct(), "stock_code", "left_semi").orderBy(F.desc("orders"), "stock_code").limit(report.PRODUCTS_RECOMMENDED))
    near = stored(recommender.neighbours(recommender.similarity_of(lines, top)))
    named = stored(w.products_of(top.select("stock_code").union(near.select("neighbour")).distinct()).select("stock_code", "description"))
    return report.recommendation_examples(top.join(named, "stock_code"), near, named)


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return ml_customer_score(spark, folder)


def _models(spark: SparkSession, folder: str) -> DataFrame:
    summary, _ = _customer_model(spark, folder)
    names = ["model", "roc_auc", "average_precision", "top_decile_rate", "top_decile_lift", "brier"]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in summary["models"]], "model string, " + ", ".join(f"{n} double" for n in names[1:]))


def _importance(spark: SparkSession, folder: str) -> DataFrame:
    """Of the boosted trees, for customers of the later cut-off."""
    fact = warehouse(spark, folder).fact_sales
    train, test = (stored(customers.prepared(customers.features_at(fact, [day]))) for day in (CUTOFF, LATER))
    return customers.importance(customers.models()["Gradient boosting"].fit(train), test)


_BASKET = ", ".join(f"'{c}'" for c in BASKET)
_LAKE = "SELECT invoice, stock_code, quantity, customer_id, country, invoice_date, amount, line_type, CAST(amount AS DECIMAL(18, 2)) AS cash FROM stg_lines"

#: name: (query, SQL or None)
REGISTRY: dict[str, tuple[Query, str | None]] = {
    # staging, dimensions, facts
    **{t: (_of(lambda w, t=t: getattr(w, t)), f"SELECT * FROM {t}") for t in Warehouse.TABLES},
    "stg_line_types": (_of(lambda w: w.stg_lines.groupBy("line_type").agg(F.count(F.lit(1)).alias("lines"))), "SELECT line_type, count(*) AS lines FROM stg_lines GROUP BY 1"),
    "overlap_removed": (
        _of(lambda w: w.raw_lines.groupBy("sheet").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("raw")).crossJoin(w.stg_lines.agg(F.count(F.lit(1)).alias("staged"))).select((F.col("raw") - F.col("staged")).alias("removed"))),
        "SELECT (SELECT count(*) FROM raw_lines) - (SELECT count(*) FROM stg_lines) AS removed",
    ),
    "reversed_lines": (_of(lambda w: w.fact_sales.where("is_reversed").select("line_id", "invoice", "stock_code", "customer_id", "quantity")), "SELECT line_id, invoice, stock_code, customer_id, quantity FROM fact_sales WHERE is_reversed"),
    # checks and profile
    "quality_checks": (
        _of(lambda w: w.checks(OVERLAP)),
        f"""SELECT 'fact_sales has no missing keys' AS check_name, count(*) AS failures FROM fact_sales WHERE invoice IS NULL OR stock_code IS NULL OR invoice_date IS NULL
        UNION ALL SELECT 'sale lines have positive quantity and amount', count(*) FROM fact_sales WHERE line_type = 'sale' AND (quantity <= 0 OR amount <= 0)
        UNION ALL SELECT 'return lines have negative quantity and amount', count(*) FROM fact_sales WHERE line_type = 'return' AND (quantity >= 0 OR amount >= 0)
        UNION ALL SELECT 'only sale lines are marked as reversed', count(*) FROM fact_sales WHERE is_reversed AND line_type <> 'sale'
        UNION ALL SELECT 'every fact product exists in dim_product', count(*) FROM fact_sales WHERE stock_code NOT IN (SELECT stock_code FROM dim_product)
        UNION ALL SELECT 'every fact customer exists in dim_customer', count(*) FROM fact_sales WHERE customer_id NOT IN (SELECT customer_id FROM dim_customer)
        UNION ALL SELECT 'dim_product has one row per stock code', count(*) - count(DISTINCT stock_code) FROM dim_product
        UNION ALL SELECT 'monthly revenue reconciles with the fact table', CAST(abs((SELECT sum(revenue) FROM mart_monthly) - (SELECT sum(amount) FROM fact_sales WHERE line_type = 'sale')) > 0.01 AS BIGINT)
        UNION ALL SELECT 'product revenue reconciles with the fact table', CAST(abs((SELECT sum(revenue) FROM mart_product) - (SELECT sum(amount) FROM fact_sales WHERE line_type = 'sale')) > 0.01 AS BIGINT)
        UNION ALL SELECT 'no invoice date falls outside dim_date', count(*) FROM fact_sales WHERE invoice_date NOT IN (SELECT date FROM dim_date)
        UNION ALL SELECT 'the overlapping week is counted exactly once', CAST(abs((SELECT sum(amount) FROM stg_lines WHERE invoice_date BETWEEN '{OVERLAP[0]}' AND '{OVERLAP[1]}') - (SELECT sum(quantity * price) FROM raw_lines WHERE sheet = 2 AND CAST(invoice_ts AS DATE) BETWEEN '{OVERLAP[0]}' AND '{OVERLAP[1]}')) > 0.01 AS BIGINT)
        UNION ALL SELECT 'fact_sales has one row per staged sale or return line', abs((SELECT count(*) FROM fact_sales) - (SELECT count(*) FROM traded))""",
    ),
    "profile_counts": (
        _of(lambda w: quality.profile(w.raw_lines, w.stg_lines, w.fact_sales)),
        f"""SELECT (SELECT count(*) FROM raw_lines) AS raw_rows, (SELECT count(*) FROM stg_lines) AS staged_rows, (SELECT count(*) FROM raw_lines) - (SELECT count(*) FROM stg_lines) AS overlap_rows_removed,
        (SELECT count(*) FROM stg_lines WHERE line_type = 'adjustment') AS adjustment_rows, (SELECT count(*) FROM stg_lines WHERE line_type = 'non_product') AS non_product_rows,
        (SELECT count(*) FROM stg_lines WHERE line_type = 'return') AS return_rows, (SELECT count(*) FROM stg_lines WHERE line_type = 'sale') AS sale_rows,
        count(*) AS fact_rows, count(*) FILTER (WHERE customer_id IS NULL) AS lines_without_customer, CAST(sum(cash) FILTER (WHERE customer_id IS NULL AND line_type = 'sale') AS DOUBLE) / CAST(sum(cash) {_SOLD} AS DOUBLE) AS revenue_share_without_customer,
        count(*) FILTER (WHERE is_reversed) AS reversed_sale_lines, CAST(coalesce(sum(quantity) FILTER (WHERE is_reversed), 0) AS BIGINT) AS reversed_units, min(invoice_date) AS first_date, max(invoice_date) AS last_date,
        (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM fact GROUP BY invoice, stock_code, quantity, unit_price, invoice_ts, customer_id)) AS repeated FROM fact""",
    ),
    "repeated_lines": (_of(lambda w: quality.repeated_lines(w.fact_sales)), "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS repeated FROM (SELECT count(*) AS n FROM fact GROUP BY invoice, stock_code, quantity, unit_price, invoice_ts, customer_id)"),
    # analytics
    "overview_totals": (
        _of(lambda w: analytics.overview_totals(w.fact_sales)),
        f"""SELECT *, gross_sales / orders AS average_order_value FROM (SELECT CAST(sum(cash) {_SOLD} AS DOUBLE) AS gross_sales, CAST(-sum(cash) {_BACK} AS DOUBLE) AS returned_value, CAST(sum(cash) AS DOUBLE) AS net_sales, count(DISTINCT invoice) {_SOLD} AS orders,
        count(DISTINCT customer_id) AS customers, count(DISTINCT stock_code) {_SOLD} AS products, CAST(sum(quantity) {_SOLD} AS BIGINT) AS units, count(DISTINCT country) AS countries,
        CAST(sum(cash) FILTER (WHERE line_type = 'sale' AND country <> 'United Kingdom') AS DOUBLE) / CAST(sum(cash) {_SOLD} AS DOUBLE) AS export_share FROM fact)""",
    ),
    "country_share": (_of(lambda w: analytics.country_share(w.mart_country)), "SELECT country, revenue, orders, customers, revenue / (SELECT CAST(sum(CAST(revenue AS DECIMAL(18, 2))) AS DOUBLE) FROM mart_country) AS share FROM mart_country ORDER BY revenue DESC, country LIMIT 10"),
    "top_products": (_of(lambda w: analytics.top_products(w.mart_product)), "SELECT stock_code, description, revenue, units_sold, orders FROM mart_product WHERE units_reversed < 0.5 * units_sold ORDER BY revenue DESC NULLS LAST, stock_code LIMIT 10"),
    "top_markets": (_of(lambda w: analytics.top_markets(w.mart_country)), "SELECT country, revenue FROM mart_country WHERE country <> 'United Kingdom' ORDER BY revenue DESC, country LIMIT 8"),
    "weekday_sales": (_of(lambda w: analytics.weekdays(w.fact_sales, w.dim_date)), "SELECT weekday, CAST(sum(cash) AS DOUBLE) AS revenue, count(DISTINCT invoice) AS orders FROM fact JOIN dim_date ON date = invoice_date WHERE line_type = 'sale' GROUP BY 1"),
    "return_summary": (
        _of(lambda w: analytics.return_summary(w.fact_sales)),
        f"""SELECT CAST(-sum(cash) {_BACK} AS DOUBLE) / CAST(sum(cash) {_SOLD} AS DOUBLE) AS value_rate, CAST(-sum(quantity) {_BACK} AS DOUBLE) / CAST(sum(quantity) {_SOLD} AS DOUBLE) AS unit_rate, count(*) {_BACK} AS return_lines, count(DISTINCT invoice) {_BACK} AS return_orders,
        CAST(count(*) {_BACK} AS DOUBLE) / count(*) {_SOLD} AS line_rate, count(*) FILTER (WHERE is_reversed) AS reversed_lines, CAST(count(*) FILTER (WHERE is_reversed) AS DOUBLE) / count(*) {_BACK} AS full_reversal_share FROM fact""",
    ),
    "return_monthly": (_of(lambda w: analytics.return_monthly(w.mart_monthly)), "SELECT month, returned_value, returned_value / nullif(revenue, 0) AS value_rate FROM mart_monthly"),
    "return_by_product": (_of(lambda w: analytics.return_by_product(w.mart_product, MIN_LINES)), f"SELECT stock_code, description, sale_lines, return_lines, CAST(return_lines AS DOUBLE) / sale_lines AS line_rate, returned_value FROM mart_product WHERE sale_lines >= {MIN_LINES} ORDER BY line_rate DESC, stock_code LIMIT 12"),
    "return_by_country": (_of(lambda w: analytics.return_by_country(w.mart_country)), "SELECT country, orders, revenue, returned_value, returned_value / revenue AS value_rate FROM mart_country WHERE orders >= 80"),
    "days_to_return": (
        _of(lambda w: analytics.days_to_return(w.fact_sales)),
        """WITH p AS (SELECT date_diff('day', s.invoice_date, min(r.invoice_date)) AS days FROM fact s JOIN fact r ON r.line_type = 'return' AND r.customer_id = s.customer_id AND r.stock_code = s.stock_code AND r.quantity = -s.quantity AND r.invoice_ts >= s.invoice_ts WHERE s.is_reversed GROUP BY s.line_id, s.invoice_date)
        SELECT CASE WHEN days = 0 THEN 'Same day' WHEN days <= 7 THEN '1-7 days' WHEN days <= 30 THEN '8-30 days' WHEN days <= 90 THEN '31-90 days' ELSE 'Over 90 days' END AS bucket, min(days) AS first_day, count(*) AS lines FROM p GROUP BY 1""",
    ),
    "segments": (
        _of(lambda w: analytics.segments(w.mart_customer_rfm)),
        """SELECT segment, CAST(list_position(['Champions', 'Loyal', 'Promising', 'New', 'At risk', 'Lost'], segment) AS BIGINT) AS position, customers, revenue, CAST(days AS DOUBLE) / customers AS recency_days, CAST(n AS DOUBLE) / customers AS orders, revenue / customers AS value,
        CAST(customers AS DOUBLE) / CAST(sum(customers) OVER () AS DOUBLE) AS customer_share, revenue / CAST(sum(CAST(revenue AS DECIMAL(28, 2))) OVER () AS DOUBLE) AS revenue_share
        FROM (SELECT segment, count(*) AS customers, CAST(sum(CAST(monetary AS DECIMAL(18, 2))) AS DOUBLE) AS revenue, sum(recency_days) AS days, sum(frequency) AS n FROM mart_customer_rfm GROUP BY 1)""",
    ),
    "cohort_retention": (_of(lambda w: analytics.retention(w.mart_cohort)), "SELECT c.cohort, month_offset, c.customers, size, CAST(c.customers AS DOUBLE) / size AS retention FROM mart_cohort c JOIN (SELECT cohort, customers AS size FROM mart_cohort WHERE month_offset = 0) USING (cohort)"),
    "cohort_matrix": (
        _of(lambda w: analytics.retention_matrix(w.mart_cohort)),
        "SELECT c.cohort, size, " + ", ".join(f"max(CAST(customers AS DOUBLE) / size) FILTER (WHERE month_offset = {i}) AS m{i}" for i in range(13)) + " FROM mart_cohort c JOIN (SELECT cohort, customers AS size FROM mart_cohort WHERE month_offset = 0) USING (cohort) GROUP BY 1, 2",
    ),
    "customer_summary": (_of(lambda w: analytics.customer_summary(w.mart_customer_rfm)), "SELECT count(*) AS customers, CAST(count(*) FILTER (WHERE frequency >= 2) AS DOUBLE) / count(*) AS repeat_rate, median(monetary) AS median_value, CAST(median(frequency) AS DOUBLE) AS median_orders FROM mart_customer_rfm"),
    "top20_share": (
        _of(lambda w: analytics.top_share(w.mart_customer_rfm)),
        "SELECT CAST(sum(v) FILTER (WHERE pr < 0.2) AS DOUBLE) / CAST(sum(v) AS DOUBLE) AS top_share FROM (SELECT CAST(monetary AS DECIMAL(18, 2)) AS v, percent_rank() OVER (ORDER BY monetary DESC) AS pr FROM mart_customer_rfm)",
    ),
    "later_retention": (
        _of(lambda w: _rounded(analytics.later_retention(w.mart_cohort, 1), retention=12)),
        "SELECT round(avg(CAST(c.customers AS DOUBLE) / size), 12) AS retention, count(*) AS cohorts FROM mart_cohort c JOIN (SELECT cohort, customers AS size FROM mart_cohort WHERE month_offset = 0) USING (cohort) WHERE month_offset = 1 AND cohort > (SELECT min(cohort) FROM mart_cohort)",
    ),
    # customer features and rankings
    "customer_features": (_of(lambda w: customers.features_at(w.fact_sales, [CUTOFF, LATER])), _FEATURES_AT.replace("{cutoffs}", f"({_cut(CUTOFF)}), ({_cut(LATER)})")),
    "customer_labels": (_of(lambda w: customers.features_at(w.fact_sales, [LATER]).groupBy("cutoff", "will_order").agg(F.count(F.lit(1)).alias("customers"))), f"SELECT cutoff, will_order, count(*) AS customers FROM ({_AT}) GROUP BY 1, 2"),
    "recency_frequency_baseline_auc": (_of(lambda w: _rounded(customers.baseline_metrics(customers.features_at(w.fact_sales, [LATER])), average_precision=9)), _RANKED),
    "customer_models": (_models, None),
    "customer_importance": (_importance, None),
    "customer_scores": (_scores, None),
    # weekly demand
    "weekly_panel": (panel, "SELECT * FROM panel"),
    "panel_lags": (_of_features(*[f"lag{k}" for k in forecasting.LAGS]), "SELECT stock_code, week_start, " + ", ".join(f"lag(units, {k}) {_O} AS lag{k}" for k in forecasting.LAGS) + " FROM panel"),
    "rolling_means": (
        _of_features("mean4", "mean8", "mean13", "mean26", "trend", "history_mean", "orders_lag1", "orders_mean4", "orders_mean13", "units_per_order13"),
        "SELECT stock_code, week_start, mean4, mean8, mean13, mean26, mean4 / (mean13 + 1.0) AS trend, history_mean, orders_lag1, orders_mean4, orders_mean13, mean13 / (orders_mean13 + 0.1) AS units_per_order13 FROM (SELECT stock_code, week_start, "
        + ", ".join([f"{_mean('units', n)} AS mean{n}" for n in (4, 8, 13, 26)] + [f"{_mean('orders', n)} AS orders_mean{n}" for n in (4, 13)])
        + f", lag(orders) {_O} AS orders_lag1, {_mean('units', 0).replace('0 PRECEDING', 'UNBOUNDED PRECEDING')} AS history_mean FROM panel)",
    ),
    "rolling_medians": (_of_features("median8", "median13"), f"SELECT stock_code, week_start, median(units) {_W.format(8, 1)} AS median8, median(units) {_W.format(13, 1)} AS median13 FROM panel"),
    "rolling_std_max_zero": (
        _of_features("std8", "max13", "zero_share13"),
        f"SELECT stock_code, week_start, {_STD.format('units', _W.format(8, 1))} AS std8, max(units) {_W.format(13, 1)} AS max13, {_mean('z', 13)} AS zero_share13 FROM (SELECT *, CAST(units = 0 AS DOUBLE) AS z FROM panel)",
    ),
    "year_ago_features": (
        _of_features("last_year_next", "last_year_lift", "week_of_year", "weeks_of_history"),
        f"SELECT stock_code, week_start, n AS last_year_next, (n / 3) / (CASE WHEN c >= 4 THEN b END + 1.0) AS last_year_lift, CAST(weekofyear(week_start) AS BIGINT) AS week_of_year, row_number() {_O} - 1 AS weeks_of_history FROM (SELECT *, lag(units, 52) {_O} + lag(units, 51) {_O} + lag(units, 50) {_O} AS n, count(units) {_W.format(65, 53)} AS c, {_mean('units', 65, 53)} AS b FROM panel)",
    ),
    "store_features": (
        lambda spark, folder: forecasting.store_features(panel(spark, folder)),
        f"""SELECT week_start, lag(s) {_O} AS store_lag1, {_mean('s', 4)} AS store_mean4, lag(s, 52) {_O} / (CASE WHEN count(s) {_W.format(65, 53)} >= 4 THEN {_mean('s', 65, 53)} END + 1.0) AS store_last_year_lift
        FROM (SELECT 1 AS stock_code, week_start, sum(units) AS s FROM panel GROUP BY 2)""",
    ),
    "protection_target": (_of_features("units_next"), f"SELECT stock_code, week_start, units + lead(units, 1) {_O} + lead(units, 2) {_O} AS units_next FROM panel"),
    "baseline_forecasts": (
        lambda spark, folder: forecasting.baselines(forecasting.product_features(panel(spark, folder))).select("stock_code", "week_start", "last_week", "average4", "last_year", "last_week_next", "average4_next", "last_year_next_forecast"),
        f"SELECT stock_code, week_start, lag1 AS last_week, mean4 AS average4, lag52 AS last_year, lag1 * 3 AS last_week_next, mean4 * 3 AS average4_next, lyn AS last_year_next_forecast FROM ({_P})",
    ),
    "forecast_accuracy_baselines": (_baseline_accuracy, f"WITH p AS ({_P}) " + " UNION ALL ".join([_err("Last week", "lag1", "lag1 * 3"), _err("Average of last 4 weeks", "mean4", "mean4 * 3"), _err("Same week last year", "lag52", "lyn")])),
    "forecast_coverage": (
        lambda spark, folder: forecasting.coverage(warehouse(spark, folder).mart_product, panel(spark, folder)),
        "SELECT covered, total, covered / total AS share FROM (SELECT CAST(sum(v) FILTER (WHERE stock_code IN (SELECT stock_code FROM active)) AS DOUBLE) AS covered, CAST(sum(v) AS DOUBLE) AS total FROM (SELECT stock_code, CAST(revenue AS DECIMAL(18, 2)) AS v FROM mart_product))",
    ),
    "gbm_backtest": (lambda spark, folder: _modelled(spark, folder), None),
    "gbm_accuracy": (lambda spark, folder: forecasting.accuracy(_modelled(spark, folder)), None),
    # stock
    "demand_sigma": (
        lambda spark, folder: inventory.demand_sigma(panel(spark, folder)),
        "SELECT stock_code, CASE WHEN count(x) >= 2 THEN sqrt((count(x) * sum(x * x) - sum(x) * sum(x)) / (count(x) * (count(x) - 1))) END AS sigma FROM (SELECT stock_code, CASE WHEN count(units) OVER w = 3 THEN sum(units) OVER w END AS x FROM panel WINDOW w AS (PARTITION BY stock_code ORDER BY week_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) GROUP BY 1",
    ),
    "inventory_frontier": (_frontier, None),
    "stock_for_fill_rate": (lambda spark, folder: inventory.stock_for_fill_rate(_frontier(spark, folder), [0.5, 0.9, 0.95]), None),
    "baseline_frontier": (lambda spark, folder: _rounded(_simple_frontier(spark, folder), fill_rate=9, average_stock_value=4), f"WITH RECURSIVE {_SIMPLE} SELECT policy, z, round(fill_rate, 9) AS fill_rate, round(average_stock_value, 4) AS average_stock_value FROM points"),
    "baseline_stock_for_fill_rate": (lambda spark, folder: _rounded(inventory.stock_for_fill_rate(_simple_frontier(spark, folder), TARGETS), stock=3), f"WITH RECURSIVE {_SIMPLE}, {_SIMPLE_STOCK} SELECT policy, target, round(stock, 3) AS stock FROM stocks"),
    "baseline_same_z": (
        lambda spark, folder: _rounded(inventory.same_z(_simple_frontier(spark, folder), "Last week"), model_fill=9, baseline_fill=9, model_stock=4, baseline_stock=4),
        f"""WITH RECURSIVE {_SIMPLE} SELECT z, round(m.fill_rate, 9) AS model_fill, round(b.fill_rate, 9) AS baseline_fill, round(m.average_stock_value, 4) AS model_stock, round(b.average_stock_value, 4) AS baseline_stock
        FROM (SELECT * FROM points WHERE policy = 'Last week') m JOIN (SELECT * FROM points WHERE policy <> 'Last week') b USING (z)""",
    ),
    "baseline_comparison": (
        lambda spark, folder: _rounded(inventory.comparison(_simple_frontier(spark, folder), "Last week", targets=TARGETS), model_stock=3, baseline_stock=3, stock_reduction=6),
        f"""WITH RECURSIVE {_SIMPLE}, {_SIMPLE_STOCK} SELECT target, round(m.stock, 3) AS model_stock, round(b.stock, 3) AS baseline_stock, round(1 - m.stock / nullif(b.stock, 0), 6) AS stock_reduction
        FROM (SELECT * FROM stocks WHERE policy = 'Last week') m JOIN (SELECT * FROM stocks WHERE policy <> 'Last week') b USING (target) WHERE m.stock IS NOT NULL AND b.stock IS NOT NULL""",
    ),
    "same_z": (lambda spark, folder: inventory.same_z(_frontier(spark, folder)), None),
    "stock_comparison": (lambda spark, folder: inventory.comparison(_frontier(spark, folder)), None),
    "weekly_totals": (lambda spark, folder: forecasting.weekly_totals(_modelled(spark, folder)), None),
    "baseline_weekly_totals": (
        lambda spark, folder: forecasting.weekly_totals(_simple(spark, folder), ("units", "average4", "last_year")),
        f"WITH {_SIMPLE[: _SIMPLE.index(',' + chr(10) + 'sigmas')]} SELECT week_start, round(sum(units)) AS units, round(sum(mean4)) AS average4, round(sum(lag52)) AS last_year FROM test GROUP BY 1",
    ),
    # baskets
    "basket_sizes": (_of(lambda w: recommender.baskets(w.mart_basket)), "SELECT * FROM basket_sizes"),
    "item_similarity": (lambda spark, folder: pairs(spark, folder), "SELECT * FROM pairs"),
    "item_neighbours": (_neighbours, "SELECT * FROM neighbours"),
    "recommend_for_basket": (
        lambda spark, folder: recommender.recommend(pairs(spark, folder), BASKET).withColumn("score", F.round("score", 9)),
        f"SELECT neighbour AS stock_code, round(sum(similarity), 9) AS score FROM pairs WHERE stock_code IN ({_BASKET}) AND neighbour NOT IN ({_BASKET}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "holdout_ranks": (_held_ranks, _HELD),
    "holdout_hit_rate": (
        lambda spark, folder: _rounded(recommender.hit_rates(_held_ranks(spark, folder)), mean_reciprocal_rank=9),
        f"WITH r AS ({_HELD}) "
        + " UNION ALL ".join(f"SELECT '{m}' AS model, count(*) AS test_baskets, CAST(count(*) FILTER (WHERE {c} < 5) AS DOUBLE) / count(*) AS hit_rate_at_5, CAST(count(*) FILTER (WHERE {c} < 10) AS DOUBLE) / count(*) AS hit_rate_at_10, round(avg(1.0 / ({c} + 1)), 9) AS mean_reciprocal_rank FROM r" for m, c in (("item similarity", "by_similarity"), ("best sellers", "by_popularity"))),
    ),
    # layers
    "bronze_batches": (_of(lambda w: lakehouse.batches(w.raw_lines)), "SELECT sheet AS batch, count(*) AS rows FROM raw_lines GROUP BY 1"),
    "silver_line_types": (_of(lambda w: lakehouse.silver(w.raw_lines).groupBy("line_type").agg(F.count(F.lit(1)).alias("lines"), money(F.col("amount")).alias("amount"))), "SELECT line_type, count(*) AS lines, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS amount FROM stg_lines GROUP BY 1"),
    "gold_monthly_sales": (_of(lambda w: lakehouse.monthly_sales(lakehouse.silver(w.raw_lines))), "SELECT month, revenue, orders, returned_value FROM mart_monthly"),
    "gold_product_weekly": (_of(lambda w: lakehouse.product_weekly(lakehouse.silver(w.raw_lines))), f"WITH s AS ({_LAKE}) SELECT CAST(date_trunc('week', invoice_date) AS DATE) AS week_start, stock_code, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(cash) AS DOUBLE) AS revenue, count(DISTINCT invoice) AS orders FROM s WHERE line_type = 'sale' GROUP BY 1, 2"),
    "gold_customer_value": (
        _of(lambda w: lakehouse.customer_value(lakehouse.silver(w.raw_lines))),
        f"WITH s AS ({_LAKE}) SELECT customer_id, count(DISTINCT invoice) {_SOLD} AS orders, max(invoice_date) {_SOLD} AS last_order_date, CAST(sum(cash) {_SOLD} AS DOUBLE) AS gross_spend, CAST(sum(cash) FILTER (WHERE line_type IN ('sale', 'return')) AS DOUBLE) AS net_spend FROM s WHERE customer_id IS NOT NULL GROUP BY 1 HAVING count(*) {_SOLD} > 0",
    ),
    # service
    "kpis": (
        _of(lambda w: service.kpis(w.mart_monthly, w.mart_customer_rfm)),
        "SELECT CAST(sum(r) AS DOUBLE) AS gross_sales, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(v) AS DOUBLE) AS returned_value, CAST(sum(v) AS DOUBLE) / CAST(sum(r) AS DOUBLE) AS return_rate, (SELECT count(*) FROM mart_customer_rfm) AS customers FROM (SELECT *, CAST(revenue AS DECIMAL(18, 2)) AS r, CAST(returned_value AS DECIMAL(18, 2)) AS v FROM mart_monthly)",
    ),
    "product_search": (_of(lambda w: service.product_search(w.mart_product, "0001", 20)), "SELECT stock_code, description, revenue, orders FROM mart_product WHERE description ILIKE '%0001%' OR stock_code ILIKE '0001%' ORDER BY revenue DESC NULLS LAST, stock_code LIMIT 20"),
    "product_detail": (_of(lambda w: service.product_detail(w.mart_product, "00010a")), "SELECT stock_code, description, revenue, units_sold, orders, CAST(return_lines AS DOUBLE) / sale_lines AS return_line_rate, median_price FROM mart_product WHERE stock_code = '00010A'"),
    "product_bought_together": (
        lambda spark, folder: service.bought_together(_neighbours(spark, folder), warehouse(spark, folder).dim_product, "00010a"),
        "SELECT neighbour AS stock_code, rank, similarity, orders_together, p.description FROM neighbours n JOIN dim_product p ON p.stock_code = n.neighbour WHERE n.stock_code = '00010A' ORDER BY rank LIMIT 5",
    ),
    "customer_detail": (_of(lambda w: service.customer_detail(w.mart_customer_rfm, None, 101)), "SELECT customer_id, segment, recency_days, frequency AS orders, monetary AS net_spend, r, f, m FROM mart_customer_rfm WHERE customer_id = 101"),
    "basket_recommendations": (
        lambda spark, folder: service.basket_recommendations(_neighbours(spark, folder), warehouse(spark, folder).dim_product, [c.lower() for c in BASKET]),
        f"SELECT neighbour AS stock_code, p.description, CAST(sum(CAST(similarity AS DECIMAL(12, 4))) AS DOUBLE) AS score FROM neighbours n JOIN dim_product p ON p.stock_code = n.neighbour WHERE n.stock_code IN ({_BASKET}) AND neighbour NOT IN ({_BASKET}) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10",
    ),
    "ml_forecast": (ml_forecast, None),
    "forecast_examples": (lambda spark, folder: report.forecast_examples(warehouse(spark, folder).mart_product, _modelled(spark, folder), panel(spark, folder)), None),
    "recommendation_examples": (
        _recommended,
        """WITH s AS (SELECT stock_code, description, orders FROM mart_product WHERE stock_code IN (SELECT stock_code FROM neighbours) ORDER BY orders DESC, stock_code LIMIT 150)
        SELECT s.stock_code, s.description, s.orders, n.rank, n.neighbour, p.description AS neighbour_description, n.similarity, n.orders_together FROM s JOIN neighbours n USING (stock_code) JOIN dim_product p ON p.stock_code = n.neighbour WHERE n.rank <= 6""",
    ),
}
for _i, (_kind, _, _sql) in enumerate(QUESTIONS, 1):
    REGISTRY[f"q_{_kind}_{_i:02d}"] = _question(_sql), None if "ml_" in _sql else _sql

QUERIES: dict[str, Query] = {name: query for name, (query, _) in REGISTRY.items()}
ORACLES: dict[str, str] = {name: over(sql) for name, (_, sql) in REGISTRY.items() if sql}


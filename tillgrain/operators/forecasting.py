"""Weekly demand: a dense panel, features that never look ahead, rolling-origin forecasts and their accuracy."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillgrain.functions import metrics
from tillgrain.functions.columns import last_complete_monday, middle, ratio, spread
from tillgrain.operators import boosting
from tillgrain.operators.boosting import CHUNK, bins_of, block_schema, grown, summary
from tillgrain.operators.boosting import block as block_of
from tillgrain.session import batches_of, released, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEST_WEEKS = 26
REFIT_EVERY = 4
PROTECTION = 3
MIN_ACTIVE_WEEKS = 80
ITERATIONS = 10
STEP = 0.1
COLD_START = 13
LAGS = [1, 2, 3, 4, 8, 13, 26, 50, 51, 52, 53]
FEATURES = [
    *[f"lag{k}" for k in LAGS],
    *["mean4", "mean8", "mean13", "mean26", "median8", "median13", "std8", "max13", "zero_share13", "trend"],
    *["last_year_next", "last_year_lift", "history_mean", "orders_lag1", "orders_mean4", "orders_mean13", "units_per_order13"],
    *["store_lag1", "store_mean4", "store_last_year_lift", "week_of_year", "weeks_of_history"],
]


def weekly_panel(weekly: DataFrame, fact: DataFrame, min_active_weeks: int = MIN_ACTIVE_WEEKS) -> DataFrame:
    """Products by complete weeks, zero where nothing sold. Products need sales in so many weeks; weeks start with the first sale
    of any product. A product's weeks with sales are gathered (as many as there are weeks) and stored; the grid, many times their
    size, is laid out anew by whoever reads it, without another shuffle."""
    last = fact.agg(last_complete_monday(F.max("invoice_date")).alias("last"))
    first = weekly.agg(F.min("week_start").alias("first"))
    kept = weekly.crossJoin(F.broadcast(last)).where("week_start <= last AND stock_code IS NOT NULL")
    sold = F.map_from_entries(F.collect_list(F.struct("week_start", F.struct(F.col("units").cast("double").alias("units"), F.col("orders").cast("double").alias("orders")))))
    active = kept.groupBy("stock_code").agg(sold.alias("sold")).where(F.size("sold") >= min_active_weeks)
    grid = stored(active).crossJoin(F.broadcast(first.crossJoin(last))).select("stock_code", "sold", F.explode(F.expr("sequence(first, last, INTERVAL 7 DAYS)")).alias("week_start"))
    own = F.element_at("sold", F.col("week_start"))
    return grid.select("stock_code", "week_start", F.coalesce(own["units"], F.lit(0.0)).alias("units"), F.coalesce(own["orders"], F.lit(0.0)).alias("orders"))


def _past(n: int):
    return W.partitionBy("stock_code").orderBy("week_start").rowsBetween(-n, -1)


def _mean(c: str | Column, over) -> Column:
    """Sum over count, so that equal sums give equal means in any engine."""
    return F.sum(c).over(over) / F.nullif(F.count(c).over(over), F.lit(0))


def product_features(panel: DataFrame) -> DataFrame:
    """Features of week t from the product's weeks before t, and the target units_next from t on. One window order, one sort."""
    own = W.partitionBy("stock_code").orderBy("week_start")
    x = F.col("units")
    before = own.rowsBetween(W.unboundedPreceding, -1)
    year_ago = own.rowsBetween(-65, -53)
    out = panel.withColumns(
        {f"lag{k}": F.lag("units", k).over(own) for k in LAGS}
        | {f"mean{n}": _mean("units", _past(n)) for n in (4, 8, 13, 26)}
        | {f"window{n}": F.collect_list("units").over(_past(n)) for n in (8, 13)}
        | {
            "zero_share13": F.sum((x == 0).cast("double")).over(_past(13)) / F.nullif(F.count(x).over(_past(13)), F.lit(0)),
            "std8": spread(x, _past(8)),
            "max13": F.max("units").over(_past(13)),
            "last_year_next": sum((F.lag("units", 52 - k).over(own) for k in range(1, PROTECTION)), F.lag("units", 52).over(own)),
            "base": F.when(F.count(x).over(year_ago) >= 4, _mean("units", year_ago)),
            "history_mean": _mean("units", before),
            "orders_lag1": F.lag("orders", 1).over(own),
            "orders_mean4": _mean("orders", _past(4)),
            "orders_mean13": _mean("orders", _past(13)),
            "weeks_of_history": (F.row_number().over(own) - 1).cast("long"),
            "week_of_year": F.weekofyear("week_start").cast("long"),
            "units_next": sum((F.lead("units", k).over(own) for k in range(1, PROTECTION)), x),
        }
    )
    return out.withColumns(
        {
            "median8": middle(F.col("window8")),
            "median13": middle(F.col("window13")),
            "trend": F.col("mean4") / (F.col("mean13") + 1.0),
            "last_year_lift": (F.col("last_year_next") / PROTECTION) / (F.col("base") + 1.0),
            "units_per_order13": F.col("mean13") / (F.col("orders_mean13") + 0.1),
        }
    ).drop("window8", "window13", "base")


def store_features(panel: DataFrame) -> DataFrame:
    """By week, over all products of the panel: one row a week."""
    weeks = panel.groupBy("week_start").agg(F.sum("units").alias("store"))
    order = W.orderBy("week_start")
    year_ago = order.rowsBetween(-65, -53)
    base = F.when(F.count("store").over(year_ago) >= 4, _mean("store", year_ago))
    return weeks.select("week_start", F.lag("store", 1).over(order).alias("store_lag1"), _mean("store", order.rowsBetween(-4, -1)).alias("store_mean4"), (F.lag("store", 52).over(order) / (base + 1.0)).alias("store_last_year_lift"))


def add_features(panel: DataFrame) -> DataFrame:
    return product_features(panel).join(F.broadcast(store_features(panel)), "week_start")


def baselines(features: DataFrame) -> DataFrame:
    return features.withColumns(
        {
            "last_week": F.col("lag1"),
            "average4": F.col("mean4"),
            "last_year": F.col("lag52"),
            "last_week_next": F.col("lag1") * PROTECTION,
            "average4_next": F.col("mean4") * PROTECTION,
            "last_year_next_forecast": F.col("last_year_next"),
        }
    )


def _day(day: date) -> int:
    return (day - date(1970, 1, 1)).days


def blocks(weeks: list[date], test_weeks: int = TEST_WEEKS, refit_every: int = REFIT_EVERY) -> list[list[date]]:
    test = weeks[-test_weeks:]
    return [test[i : i + refit_every] for i in range(0, len(test), refit_every)]


def _series(panel: DataFrame) -> tuple[DataFrame, list[date]]:
    """A row a product, its weeks that aren't empty: places in the list of weeks, units, orders. The list is that of a full grid."""
    weeks = [r.week_start for r in panel.select("week_start").distinct().orderBy("week_start").collect()]
    place = F.datediff("week_start", F.lit(weeks[0])).cast("int") / 7
    # the first week stays, so that no product goes
    some = panel.where((F.col("units") != 0) | (F.col("orders") != 0) | (F.col("week_start") == F.lit(weeks[0])))
    gathered = some.groupBy("stock_code").agg(F.sort_array(F.collect_list(F.struct(place.cast("int").alias("week"), "units", "orders"))).alias("own"))
    return gathered.select("stock_code", F.col("own.week").alias("week"), F.col("own.units").alias("units"), F.col("own.orders").alias("orders")), weeks


def _laid_out(batches: Iterator[pa.RecordBatch], n_weeks: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Codes, and (week, product) of units and orders, of so many products as make a block."""
    size = max(1, CHUNK // n_weeks)
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            b = batch.slice(at, size)
            week, of = b.column(1).flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            out = [np.zeros((n_weeks, b.num_rows)) for _ in range(2)]
            for x, c in zip(out, b.columns[2:], strict=True):
                x[week, of] = c.flatten().to_numpy()
            yield b.column(0), *out


def _lag(x: np.ndarray, k: int) -> np.ndarray:
    out = np.full(x.shape, np.nan)
    out[k:] = x[: max(0, len(x) - k)]
    return out


def _window(x: np.ndarray, early: int, late: int = 1, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the weeks from ``early`` to ``late`` before each."""
    until, at = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)]), np.arange(len(x))
    hi, lo = np.maximum(0, at - late + 1), np.maximum(0, at - early)
    n = (hi - lo).astype(float)
    n[n < least] = np.nan
    return until[hi] - until[lo], n.reshape(-1, *[1] * (x.ndim - 1))


def _average(x: np.ndarray, *window: int) -> np.ndarray:
    total, n = _window(x, *window)
    return total / n


def _last(x: np.ndarray, n: int) -> np.ndarray:
    """(week, product, n): the weeks before each, for weeks with so many."""
    return np.lib.stride_tricks.sliding_window_view(x, n, axis=0)[: len(x) - n]


def arrays(units: np.ndarray, orders: np.ndarray, store: np.ndarray, weeks: list[date]) -> dict[str, np.ndarray]:
    """``add_features`` for a block (week, product) of a full grid; right from week ``COLD_START`` on. Some are by week alone."""
    early = lambda x: np.concatenate([np.full((len(units) - len(x), *units.shape[1:]), np.nan), x])
    with np.errstate(invalid="ignore", divide="ignore"):
        out = {f"lag{k}": _lag(units, k) for k in LAGS} | {f"mean{n}": _average(units, n) for n in (4, 8, 13, 26)}
        out |= {f"median{n}": early(np.median(_last(units, n), 2)) for n in (8, 13)}
        total, n = _window(units, 8)
        out["std8"] = np.sqrt((n * _window(units * units, 8)[0] - total * total) / np.where(n > 1, n * (n - 1), np.nan))
        out["max13"] = early(_last(units, 13).max(2))
        out["zero_share13"] = _average((units == 0).astype(float), 13)
        out["trend"] = out["mean4"] / (out["mean13"] + 1.0)
        out["last_year_next"] = sum((_lag(units, 52 - k) for k in range(1, PROTECTION)), out["lag52"])
        out["last_year_lift"] = (out["last_year_next"] / PROTECTION) / (_average(units, 65, 53, 4) + 1.0)
        out["history_mean"] = _average(units, len(units))
        out |= {"orders_lag1": _lag(orders, 1), "orders_mean4": _average(orders, 4), "orders_mean13": _average(orders, 13)}
        out["units_per_order13"] = out["mean13"] / (out["orders_mean13"] + 0.1)
        out |= {"store_lag1": _lag(store, 1), "store_mean4": _average(store, 4), "store_last_year_lift": _lag(store, 52) / (_average(store, 65, 53, 4) + 1.0)}
        out |= {"week_of_year": np.array([float(w.isocalendar().week) for w in weeks]), "weeks_of_history": np.arange(len(weeks), dtype=float)}
    ahead = np.full(units.shape, np.nan)
    reach = max(0, len(units) - PROTECTION + 1)
    ahead[:reach] = sum(units[k : k + reach] for k in range(PROTECTION))
    return out | {"units_next": ahead}


def _rows(found: dict[str, np.ndarray], weeks: slice, n: int) -> np.ndarray:
    """(feature, row), week after week."""
    parts = [found[c][weeks] for c in FEATURES]
    return np.stack([(np.broadcast_to(x[:, None], (len(x), n)) if x.ndim == 1 else x).ravel() for x in parts])


def _cuts(products: DataFrame, store: np.ndarray, weeks: list[date], until: int) -> list[np.ndarray]:
    """Of each feature's positive values in the weeks before a place: each task sums up its own, all values count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0)) for _ in FEATURES]
        for _, units, orders in _laid_out(batches, len(weeks)):
            found = arrays(units, orders, store, weeks)
            for f, c in enumerate(FEATURES):
                x = found[c][COLD_START:until]
                own = x[x > 0]
                weights = np.full(len(own), units.shape[1] if x.ndim == 1 else 1.0)
                held[f] = summary(*(np.concatenate(p) for p in zip(held[f], summary(own, weights), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(FEATURES)), pa.int32()), *(pa.array([h[i] for h in held], pa.list_(pa.float64())) for i in range(2))], names=["f", "v", "w"])

    got = products.mapInArrow(run, "f int, v array<double>, w array<double>").orderBy("f", "v").toArrow()
    f = got.column("f").to_numpy()
    each = [[np.concatenate([np.zeros(0), *(np.asarray(got.column(c)[int(i)].values) for i in np.flatnonzero(f == k))]) for c in ("v", "w")] for k in range(len(FEATURES))]
    return [boosting.quantiles(v, w) for v, w in each]


def _blocks(products: DataFrame, store: np.ndarray, weeks: list[date], until: int, edges: list[np.ndarray]) -> DataFrame:
    days = [_day(w) for w in weeks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, units, orders in _laid_out(batches, len(weeks)):
            found, use = arrays(units, orders, store, weeks), slice(COLD_START, until)
            yield block_of(np.repeat(np.array(days)[use], units.shape[1]), bins_of(_rows(found, use, units.shape[1]), edges), [units[use].ravel(), found["units_next"][use].ravel()])

    return products.mapInArrow(run, block_schema(2))


def _forecasts(products: DataFrame, store: np.ndarray, weeks: list[date], edges: list[np.ndarray], tested: list[list[date]], models: list[list[boosting.Model]]) -> DataFrame:
    days, trees = [_day(w) for w in weeks], [[m.trees for m in pair] for pair in models]
    columns = {"last_week": "lag1", "average4": "mean4", "last_year": "lag52", "last_year_next_forecast": "last_year_next"}
    sent = products.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, units, orders in _laid_out(batches, len(weeks)):
            found = arrays(units, orders, store, weeks) | {"units": units}
            for block, own in zip(tested, sent.value, strict=True):
                use = slice(weeks.index(block[0]), weeks.index(block[-1]) + 1)
                bins = bins_of(_rows(found, use, units.shape[1]), edges)
                out = {c: found[c][use].ravel() for c in ("units", "units_next")} | {name: found[c][use].ravel() for name, c in columns.items()}
                out |= {f"{c}_next": PROTECTION * out[c] for c in ("last_week", "average4")} | {name: np.maximum(grown(bins, t, STEP), 0) for name, t in zip(("gbm", "gbm_next"), own, strict=True)}
                names = pa.concat_arrays([codes] * len(block))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.repeat(np.array(days[use], np.int32), units.shape[1])).cast(pa.date32()), *(pa.array(out[c], from_pandas=True) for c in BACKTEST[2:])], names=BACKTEST)

    return products.mapInArrow(run, "stock_code string, week_start date, " + ", ".join(f"{c} double" for c in BACKTEST[2:]))


BACKTEST = ["stock_code", "week_start", "units", "units_next", "gbm", "last_week", "average4", "last_year", "gbm_next", "last_week_next", "average4_next", "last_year_next_forecast"]
#: Products by weeks of one file of blocks.
DEALT = 1 << 19
#: Blocks of a file, so that tasks get like numbers of them.
FILE = 8


def backtest(features: DataFrame, test_weeks: int = TEST_WEEKS, refit_every: int = REFIT_EVERY, iterations: int = ITERATIONS) -> DataFrame:
    """Forecasts of the last weeks, from models refit every few weeks on what was fully observed before their origin: weeks before it
    for one week ahead, weeks whose protection period ended before it for the period. All models grow together.

    ``features`` is what ``add_features`` makes of a panel. They aren't read but computed from its units and orders, block by block
    (``arrays``): kept as rows they are many times the size of the sales."""
    found, weeks = _series(features.select("stock_code", "week_start", "units", "orders"))
    products = stored(found)
    weekly = products.select(F.explode(F.arrays_zip("week", "units")).alias("x")).groupBy("x.week").agg(F.sum("x.units").alias("units")).collect()
    store = np.zeros(len(weeks))
    store[[r.week for r in weekly]] = [r.units for r in weekly]
    dealt = stored(products.repartition(max(2, products.count() * len(weeks) // DEALT), "stock_code"))
    released(products)
    tested, models = blocks(weeks, test_weeks, refit_every), []
    for block in tested:
        origin = block[0]
        models.append([boosting.Model(0, _day(origin)), boosting.Model(1, _day(origin - timedelta(weeks=PROTECTION - 1)))])
    edges = _cuts(dealt, store, weeks, weeks.index(tested[0][0]))
    frame = stored(_blocks(dealt, store, weeks, weeks.index(tested[-1][0]), edges), FILE)
    with batches_of(frame.sparkSession, "8m"):
        boosting.fit(frame, [m for pair in models for m in pair], len(FEATURES), iterations, STEP)
    released(frame)
    return _forecasts(dealt, store, weeks, edges, tested, models)


MODELS = {"Last week": ("last_week", "last_week_next"), "Average of last 4 weeks": ("average4", "average4_next"), "Same week last year": ("last_year", "last_year_next_forecast"), "Gradient boosting": ("gbm", "gbm_next")}


def accuracy(forecasts: DataFrame, models: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """By model: WAPE and bias for one week and for the protection period, and the median of the products' WAPE."""
    models = models or MODELS
    stack = ", ".join(f"'{name}', {one}, {period}" for name, (one, period) in models.items())
    long = forecasts.selectExpr("stock_code", "units", "units_next", f"stack({len(models)}, {stack}) AS (model, one, period)")
    total = long.groupBy("model").agg(
        metrics.wape(F.col("units"), F.col("one")).alias("wape"),
        metrics.bias(F.col("units"), F.col("one")).alias("bias"),
        metrics.wape(F.col("units_next"), F.col("period")).alias("wape_next"),
        metrics.bias(F.col("units_next"), F.col("period")).alias("bias_next"),
    )
    known = long.where("units IS NOT NULL AND one IS NOT NULL")
    each = known.groupBy("model", "stock_code").agg((F.sum(F.abs(F.col("one") - F.col("units"))) / F.greatest(F.sum("units"), F.lit(1.0))).alias("w"))
    return total.join(each.groupBy("model").agg(F.median("w").alias("median_product_wape")), "model", "left").select("model", "wape", "bias", "median_product_wape", "wape_next", "bias_next")


def coverage(mart_product: DataFrame, panel: DataFrame) -> DataFrame:
    """Share of revenue of the products in the panel."""
    covered = mart_product.join(panel.select("stock_code").distinct(), "stock_code", "left_semi").agg(F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("covered"))
    total = mart_product.agg(F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("total"))
    return covered.crossJoin(total).select("covered", "total", ratio(F.col("covered"), F.col("total")).alias("share"))


def weekly_totals(forecasts: DataFrame, columns: tuple[str, ...] = ("units", "gbm", "average4", "last_year")) -> DataFrame:
    return forecasts.groupBy("week_start").agg(*[F.round(F.sum(c)).alias(c) for c in columns])

"""Models grown together against Spark's own trees, one by one."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tillgrain.operators import boosting

X = ["a", "b", "c"]


def rows(spark, parts):
    rng = random.Random(8)
    out = []
    for i in range(1500):
        a, b, c = rng.randrange(13), rng.randrange(13), rng.randrange(-1, 12)
        out.append((i, date(2010, 1, 1) + timedelta(days=i % 40), float(a), float(b), float(c), 3.0 * a + (20.0 if b > 6 else 0.0) * (c > 3) + rng.random(), float(a * c) + rng.random()))
    return spark.createDataFrame(out, "i int, day date, a double, b double, c double, u double, v double").repartition(parts, "i")


def together(spark, parts):
    df, days = rows(spark, parts), [date(2010, 1, 25), date(2010, 2, 5)]
    edges = boosting.cuts(df, X)
    models = [[boosting.Model(t, (d - date(1970, 1, 1)).days) for t in (0, 1)] for d in days]
    frame = boosting.stored(boosting.binned(df, X, F.unix_date("day"), ["u", "v"], edges))
    boosting.fit(frame, [m for pair in models for m in pair], len(X), 3, 0.1)
    out = [boosting.predicted(df, X, edges, F.lit(k), models, ["p", "q"], 0.1).orderBy("i").collect() for k in range(2)]
    return days, out


def test_models_grown_together_equal_sparks_grown_alone(spark):
    days, out = together(spark, 3)
    df = VectorAssembler(inputCols=X, outputCol="x").transform(rows(spark, 3))
    for day, got in zip(days, out, strict=True):
        for target, name in (("u", "p"), ("v", "q")):
            model = GBTRegressor(featuresCol="x", labelCol=target, maxIter=3, maxDepth=5, stepSize=0.1, minInstancesPerNode=30, seed=1).fit(df.where(F.col("day") < F.lit(day)))
            want = [max(r.prediction, 0) for r in model.transform(df).orderBy("i").collect()]
            assert np.allclose([r[name] for r in got], want, atol=0.02)


def test_sums_do_not_hang_on_how_rows_are_dealt(spark):
    assert together(spark, 1)[1] == together(spark, 7)[1]


def test_missing_targets_and_later_days_are_not_learnt(spark):
    df = spark.createDataFrame([(date(2010, 1, 1), 1.0, 5.0)] * 80 + [(date(2010, 1, 1), 1.0, None)] * 80 + [(date(2010, 3, 1), 1.0, 900.0)] * 80, "day date, a double, u double")
    edges, model = boosting.cuts(df, ["a"]), boosting.Model(0, 14640)
    boosting.fit(boosting.stored(boosting.binned(df, ["a"], F.unix_date("day"), ["u"], edges)), [model], 1, 2, 0.1)
    assert all(r.p == pytest.approx(5.0, abs=0.02) for r in boosting.predicted(df, ["a"], edges, F.lit(0), [[model]], ["p"], 0.1).collect())


def test_residuals_are_taken_once_a_tree_and_never_written(spark, monkeypatch):
    df = rows(spark, 3)
    edges = boosting.cuts(df, X)
    taken, passes, held = spark.sparkContext.accumulator(0), [], []
    counted, left = boosting._histograms, boosting._residuals

    def of_blocks(frame, *more):
        def seen(batches):
            for b in batches:
                taken.add(b.num_rows)
                yield b

        own = [c for c in frame.columns if not c.startswith("top")]
        held.append(left(frame.select(own).mapInArrow(seen, ", ".join(f"{c} binary" for c in own)), *more))
        return held[-1]

    monkeypatch.setattr(boosting, "_residuals", of_blocks)
    monkeypatch.setattr(boosting, "_histograms", lambda frame, *more: passes.append((frame.storageLevel.useMemory, frame.storageLevel.useDisk)) or counted(frame, *more))
    frame = boosting.stored(boosting.binned(df, X, F.unix_date("day"), ["u", "v"], edges))
    boosting.fit(frame, [boosting.Model(0, 20000), boosting.Model(1, 20000)], len(X), 2, 0.1)
    assert len(passes) == 10 and set(passes) == {(True, False)}
    assert taken.value == 2 * frame.count() and not any(f.is_cached for f in held)

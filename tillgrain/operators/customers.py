"""Will a customer order again? Features as of a cut-off day, models, and how well they rank."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillgrain.functions import metrics
from tillgrain.functions.columns import money, ratio, signed_log
from tillgrain.functions.ordering import numbered
from tillgrain.operators.star import is_return, is_sale
from tillgrain.session import stored

HORIZON_DAYS = 90
TRAIN_CUTOFFS = 4
SEED = 42
REPEATS = 10
FEATURES = ["recency_days", "tenure_days", "orders", "net_spend", "average_order_value", "distinct_products", "units", "return_line_share", "orders_last_90d", "spend_last_90d", "days_between_orders", "is_uk"]


def features_at(fact: DataFrame, cutoffs: list[date], horizon: int = HORIZON_DAYS) -> DataFrame:
    """A row for each cut-off and customer with a sale before it: what was known that day, and whether a sale follows within the
    horizon. All cut-offs are aggregated in one pass over the facts, which are dealt by customer once: distinct orders and products
    are counted by marked lines (the last of an order before the cut-off, the first of a product), which needs no copies of rows."""
    spark = fact.sparkSession
    days = spark.createDataFrame([(d,) for d in cutoffs], "cutoff date")
    columns = ["customer_id", "invoice", "stock_code", "invoice_date", "quantity", F.col("amount").cast("decimal(18,2)").alias("amount"), F.coalesce(F.col("country") == "United Kingdom", F.lit(False)).alias("uk")]
    own = fact.where("customer_id IS NOT NULL").select(*columns, F.coalesce(is_sale(), F.lit(False)).alias("sold"), F.coalesce(is_return(), F.lit(False)).alias("given")).repartition("customer_id")
    by_day = F.asc_nulls_last("invoice_date")
    again = F.lead("invoice_date").over(W.partitionBy("customer_id", "invoice", "sold").orderBy(by_day))
    nth = F.row_number().over(W.partitionBy("customer_id", "stock_code", "sold").orderBy(by_day))
    known = own.select("*", again.alias("again"), ((nth == 1) & F.col("stock_code").isNotNull()).alias("new")).drop("stock_code").crossJoin(F.broadcast(days))  # a handful of days
    past, day = F.col("invoice_date") < F.col("cutoff"), F.col("invoice_date")
    sale, back = past & F.col("sold"), past & F.col("given")
    late = sale & (day >= F.date_sub("cutoff", 90))
    last = F.col("invoice").isNotNull() & (F.col("again").isNull() | (F.col("again") >= F.col("cutoff")))

    def count(c: Column) -> Column:
        return F.count(F.when(c, 1))

    per = known.groupBy("cutoff", "customer_id").agg(
        F.datediff(F.first("cutoff"), F.max(F.when(sale, day))).cast("long").alias("recency_days"),
        F.datediff(F.first("cutoff"), F.min(F.when(sale, day))).cast("long").alias("tenure_days"),
        count(sale & last).alias("orders"),
        money(F.when(past, F.col("amount"))).alias("net_spend"),
        count(sale & F.col("new")).alias("distinct_products"),
        F.sum(F.when(sale, F.col("quantity"))).alias("units"),
        ratio(count(back), count(past)).alias("return_line_share"),
        count(late & last).alias("orders_last_90d"),
        F.coalesce(money(F.when(late, F.col("amount"))), F.lit(0.0)).alias("spend_last_90d"),
        (count(past & F.col("uk")) * 2 > count(past)).cast("long").alias("is_uk"),
        (count(F.col("sold") & ~past & (day < F.date_add("cutoff", horizon))) > 0).cast("long").alias("will_order"),
        count(sale).alias("sales"),
    )
    gap = F.when(F.col("orders") > 1, ratio(F.col("tenure_days") - F.col("recency_days"), F.col("orders") - 1)).otherwise(F.col("tenure_days").cast("double"))
    return per.where("sales > 0").withColumns({"average_order_value": ratio(F.col("net_spend"), F.col("orders")), "days_between_orders": gap}).select("cutoff", "customer_id", *FEATURES, "will_order")


def cutoffs(end: date, horizon: int = HORIZON_DAYS, train: int = TRAIN_CUTOFFS) -> tuple[list[date], date]:
    """Training cut-offs and the test cut-off, the last from which the whole horizon is known."""
    test = end - timedelta(days=horizon)
    return [test - timedelta(days=horizon * k) for k in range(1, train + 1)], test


def models() -> dict[str, Pipeline]:
    """Logistic regression on standardised signed logs; gradient-boosted trees on the features as they are. The trees grow by
    depth; Spark has neither leaf-wise growth nor an L2 penalty on leaves."""
    assembled = VectorAssembler(inputCols=[f"log_{c}" for c in FEATURES], outputCol="logs")
    scaled = StandardScaler(inputCol="logs", outputCol="scaled", withMean=True)
    return {
        "Logistic regression": Pipeline(stages=[assembled, scaled, LogisticRegression(featuresCol="scaled", labelCol="will_order", standardization=False, maxIter=1000, regParam=1e-4)]),
        "Gradient boosting": Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="plain"), GBTClassifier(featuresCol="plain", labelCol="will_order", maxIter=20, maxDepth=4, stepSize=0.1, minInstancesPerNode=40, seed=SEED)]),
    }


def prepared(features: DataFrame) -> DataFrame:
    """Doubles without nulls, and their signed logs."""
    filled = features.select("cutoff", "customer_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES], F.col("will_order").cast("double").alias("will_order"))
    return filled.withColumns({f"log_{c}": signed_log(F.col(c)) for c in FEATURES})


def scored(model, frame: DataFrame) -> DataFrame:
    return model.transform(frame).withColumn("p", vector_to_array("probability")[1])


def baseline_metrics(test: DataFrame) -> DataFrame:
    """Ranking by the most recent and by the most frequent buyers."""
    recent = metrics.ranking(test, (-F.col("recency_days")).cast("double"), "will_order", "customer_id").withColumn("model", F.lit("most recent buyers first"))
    frequent = metrics.ranking(test, F.col("orders").cast("double"), "will_order", "customer_id").withColumn("model", F.lit("most frequent buyers first"))
    return recent.unionByName(frequent)


def deciles(scores: DataFrame) -> DataFrame:
    """Ten groups by descending score, cut at the quantiles of the rank."""
    n = scores.agg(F.count(F.lit(1)).alias("n"))
    ranked = numbered(scores, [F.desc("p"), "customer_id"], "rn").crossJoin(F.broadcast(n))
    decile = F.greatest(F.lit(1), F.ceil((F.col("rn") - 1) * 10 / F.greatest(F.col("n") - 1, F.lit(1)))).cast("long")
    return ranked.groupBy(decile.alias("decile")).agg(F.count(F.lit(1)).alias("customers"), F.avg("p").alias("predicted"), F.avg("will_order").alias("actual"))


def importance(model, test: DataFrame, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """Mean loss of AUC when a feature's values are exchanged among customers in a seeded random order: feature, importance.

    All features and repeats are one pass: customers are numbered by key and by a hash, once for each repeat, the k-th of
    one order gets the values of the k-th of the other, and every row is scored with one feature exchanged at a time.
    """
    spark = test.sparkSession
    base = metrics.ranking(scored(model, test), F.col("p"), "will_order", "customer_id").first()["roc_auc"]
    turns = test.select("customer_id", *FEATURES, "will_order").crossJoin(F.broadcast(spark.range(repeats).withColumnRenamed("id", "turn")))
    own = numbered(turns, ["turn", "customer_id"], "at")
    lot = F.xxhash64("customer_id", F.col("turn") + seed)
    other = numbered(turns.select("turn", "customer_id", F.struct(*FEATURES).alias("theirs")).withColumn("lot", lot), ["turn", "lot", "customer_id"], "at").select("at", "theirs")
    dealt = own.join(other, "at").withColumn("feature", F.explode(F.array(*map(F.lit, FEATURES))))
    moved = dealt.withColumns({c: F.when(F.col("feature") == c, F.col(f"theirs.{c}")).otherwise(F.col(c)) for c in FEATURES})
    filled = moved.select("feature", "turn", "will_order", *FEATURES).withColumns({f"log_{c}": signed_log(F.col(c)) for c in FEATURES})
    aucs = metrics.grouped_auc(scored(model, filled), ["feature", "turn"], "p", "will_order")
    return aucs.groupBy("feature").agg((F.lit(base) - F.avg("roc_auc")).alias("importance"))


def run(fact: DataFrame, end: date | None = None, with_importance: bool = False) -> tuple[dict, DataFrame]:
    """Evaluate on the last horizon, refit the better model on everything, and score today's customers. ``end``: today, else the
    day after the last invoice."""
    end = end or fact.agg(F.date_add(F.max("invoice_date"), 1).alias("end")).first()["end"]
    train_days, test_day = cutoffs(end)
    # one pass for all days; what is stored are the features, their logs are made when read
    frames = stored(features_at(fact, [*train_days, test_day, end]))
    train, test, today = (prepared(frames.where(F.col("cutoff").isin(days))) for days in (train_days, [test_day], [end]))
    results = [r.asDict() for r in baseline_metrics(test).collect()]
    fitted = {}
    for name, model in models().items():
        fitted[name] = model.fit(train)
        results.append(metrics.ranking(scored(fitted[name], test), F.col("p"), "will_order", "customer_id", probability=True).first().asDict() | {"model": name})
    best = max(fitted, key=lambda n: next(r["roc_auc"] for r in results if r["model"] == n))
    final = models()[best].fit(train.unionByName(test))
    scores = scored(final, today).select("customer_id", F.round("p", 4).alias("repeat_probability"))
    summary = {"horizon_days": HORIZON_DAYS, "test_cutoff": str(test_day), "train_cutoffs": sorted(map(str, train_days)), "models": results, "best_model": best, "deciles": [r.asDict() for r in deciles(scored(fitted[best], test)).orderBy("decile").collect()]}
    if with_importance:
        summary["importance"] = {r.feature: r.importance for r in importance(fitted[best], test).orderBy(F.desc("importance"), "feature").collect()}
    return summary, scores

"""Read-only lookups over the warehouse and model tables; each returns plain dicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.functions.columns import money, ratio
from tillgrain.plans import assistant


class NotFound(KeyError):
    """No such product or customer."""


def kpis(mart_monthly: DataFrame, rfm: DataFrame) -> DataFrame:
    sums = mart_monthly.agg(money(F.col("revenue")).alias("gross_sales"), F.sum("orders").alias("orders"), money(F.col("returned_value")).alias("returned_value"), ratio(money(F.col("returned_value")), money(F.col("revenue"))).alias("return_rate"))
    return sums.crossJoin(rfm.agg(F.count(F.lit(1)).alias("customers")))


def product_search(mart_product: DataFrame, search: str = "", limit: int = 20) -> DataFrame:
    """The text is looked for anywhere in descriptions and at the start of codes; % and _ in it are wildcards."""
    if len(search) > 60 or not 1 <= limit <= 100:
        raise ValueError("a search has 60 characters at most, a limit is 1 to 100")
    hit = F.col("description").ilike(f"%{search}%") | F.col("stock_code").ilike(f"{search}%")
    return mart_product.where(hit).orderBy(F.desc_nulls_last("revenue"), "stock_code").limit(limit).select("stock_code", "description", "revenue", "orders")


def product_detail(mart_product: DataFrame, code: str) -> DataFrame:
    rate = ratio(F.col("return_lines"), F.col("sale_lines")).alias("return_line_rate")
    return mart_product.where(F.col("stock_code") == code.upper()).select("stock_code", "description", "revenue", "units_sold", "orders", rate, "median_price")


def bought_together(neighbours: DataFrame, dim_product: DataFrame, code: str, top: int = 5) -> DataFrame:
    near = neighbours.where(F.col("stock_code") == code.upper()).select(F.col("neighbour").alias("stock_code"), "rank", "similarity", "orders_together")
    return near.join(dim_product.select("stock_code", "description"), "stock_code").orderBy("rank").limit(top)


def customer_detail(rfm: DataFrame, scores: DataFrame | None, customer: int) -> DataFrame:
    found = rfm.where(F.col("customer_id") == customer).select("customer_id", "segment", "recency_days", F.col("frequency").alias("orders"), F.col("monetary").alias("net_spend"), "r", "f", "m")
    return found if scores is None else found.join(scores.where(F.col("customer_id") == customer), "customer_id", "left")


def basket_recommendations(neighbours: DataFrame, dim_product: DataFrame, items: list[str], k: int = 10) -> DataFrame:
    if not 1 <= len(items) <= 50 or not 1 <= k <= 50:
        raise ValueError("a basket has 1 to 50 items, k is 1 to 50")
    codes = sorted({i.upper() for i in items})
    near = neighbours.where(F.col("stock_code").isin(codes) & ~F.col("neighbour").isin(codes))
    score = F.sum(F.col("similarity").cast("decimal(12,4)")).cast("double").alias("score")
    named = near.groupBy(F.col("neighbour").alias("stock_code")).agg(score).join(dim_product.select("stock_code", "description"), "stock_code")
    return named.orderBy(F.desc("score"), "stock_code").limit(k).select("stock_code", "description", "score")


class Service:
    def __init__(self, spark: SparkSession, warehouse, scores: DataFrame | None = None, forecasts: DataFrame | None = None, neighbours: DataFrame | None = None, model: assistant.ChatModel | None = None):
        self.spark, self.w, self.scores, self.forecasts, self.neighbours, self.model = spark, warehouse, scores, forecasts, neighbours, model

    def health(self) -> dict:
        r = self.w.fact_sales.agg(F.count(F.lit(1)).alias("n"), F.max("invoice_date").alias("last")).first()
        return {"status": "ok", "fact_rows": r.n, "last_date": str(r["last"])}

    def kpis(self) -> dict:
        return kpis(self.w.mart_monthly, self.w.mart_customer_rfm).first().asDict()

    def products(self, search: str = "", limit: int = 20) -> list[dict]:
        return [r.asDict() for r in product_search(self.w.mart_product, search, limit).collect()]

    def product(self, code: str) -> dict:
        found = product_detail(self.w.mart_product, code).first()
        if found is None:
            raise NotFound(f"unknown product {code.upper()}")
        near = bought_together(self.neighbours, self.w.dim_product, code).collect() if self.neighbours is not None else []
        weeks = self.forecasts.where(F.col("stock_code") == code.upper()).orderBy(F.desc("week_start")).limit(8).withColumn("week_start", F.col("week_start").cast("string")).drop("stock_code").collect() if self.forecasts is not None else []
        return found.asDict() | {"bought_together": [r.asDict() for r in near], "forecast": [r.asDict() for r in weeks]}

    def customer(self, customer: int) -> dict:
        found = customer_detail(self.w.mart_customer_rfm, self.scores, customer).first()
        if found is None:
            raise NotFound(f"unknown customer {customer}")
        return found.asDict()

    def recommendations(self, items: list[str], k: int = 10) -> dict:
        rows = basket_recommendations(self.neighbours, self.w.dim_product, items, k).collect()
        return {"basket": sorted({i.upper() for i in items}), "recommendations": [r.asDict() for r in rows]}

    def ask(self, question: str) -> dict:
        if not 3 <= len(question) <= 300:
            raise ValueError("a question has 3 to 300 characters")
        if self.model is None:
            return self._reply(question, "unavailable", message="no language model is set")
        try:
            found = assistant.ask(self.spark, question, self.model)
        except OSError as e:
            return self._reply(question, "unavailable", message=f"the language model can't be reached: {e}")
        table = {"columns": found.columns, "rows": [list(r) for r in found.rows]} if found.answered else None
        message = found.problem or ("the tables don't hold the answer" if found.outcome == "declined" else None)
        return self._reply(question, found.outcome, message, table, {"sql": found.sql, "drafts": found.drafts})

    @staticmethod
    def _reply(question: str, status: str, message: str | None = None, table: dict | None = None, query: dict | None = None) -> dict:
        """One shape for all outcomes: status is answered, declined, failed or unavailable."""
        return {"question": question, "status": status, "message": message, "table": table, "query": query}

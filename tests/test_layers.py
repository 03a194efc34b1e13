"""Layers against the marts, and the streaming forms."""

from pyspark.sql import functions as F

from tillgrain.operators import lakehouse
from tillgrain.queries import warehouse
from tillgrain.sources import invoices
from tillgrain.streaming import bronze


def test_layers_reconcile_with_the_marts(spark, folder, tmp_path):
    w = warehouse(spark, folder)
    out = lakehouse.build(w.raw_lines, str(tmp_path))
    rows = w.raw_lines.count()
    assert sum(v["rows"] for v in out["layers"]["bronze"]) == rows and out["lines"] == w.stg_lines.count()
    assert [(v["version"], v["operation"]) for v in out["layers"]["bronze"]] == [(0, "replace"), (1, "append")]
    again = lakehouse.load_bronze(w.raw_lines.where("sheet = 1"), str(tmp_path))
    assert [(r.version, r.load, r.operation) for r in again.orderBy("version").collect()] == [(0, 0, "replace"), (1, 0, "append"), (2, 1, "replace")]
    assert [lakehouse.read_bronze(spark, str(tmp_path), v).count() for v in (1, 2, 0)] == [rows] + 2 * [w.raw_lines.where("sheet = 1").count()]
    assert abs(out["revenue"] - w.mart_monthly.agg(F.sum("revenue")).first()[0]) < 0.01
    gold = spark.read.parquet(str(tmp_path / "gold" / "customer_value"))
    both = gold.join(w.mart_customer_rfm, "customer_id").where("abs(net_spend - monetary) > 0.01")
    assert gold.count() == w.mart_customer_rfm.count() and both.count() == 0
    plan = spark.read.parquet(str(tmp_path / "silver" / "invoice_lines")).where("line_type = 'sale'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(line_type" in plan


def test_streamed_bronze_loads_each_file_once(spark, folder, tmp_path):
    raw = warehouse(spark, folder).raw_lines
    arrive, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    raw.where("sheet = 1").write.parquet(arrive)
    bronze.load(bronze.source(spark, arrive), out, mark).awaitTermination()
    raw.where("sheet = 2").write.mode("append").parquet(arrive)
    bronze.load(bronze.source(spark, arrive), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == raw.count()
    weekly = bronze.weekly_units(spark.read.schema(invoices.RAW).parquet(arrive))
    assert weekly.where(F.weekday("week_start") != 0).count() == 0
    assert weekly.agg(F.sum("units")).first()[0] == raw.agg(F.sum("quantity")).first()[0]


def test_whole_run(spark, folder, tmp_path):
    import json
    from datetime import date

    from tillgrain.plans import report

    out = report.run(spark, warehouse(spark, folder), str(tmp_path), overlap=("1998-05-01", "1998-05-09"), min_weeks=36, test_weeks=4, iterations=2, test_from=date(2001, 1, 1), end=date(2001, 8, 2))
    assert set(json.loads((tmp_path / "data.json").read_text())) == set(out)
    assert out["profile"]["tables"]["fact_sales"] == out["profile"]["fact_rows"]
    assert spark.read.parquet(str(tmp_path / "models" / "ml_forecast")).count() > 0

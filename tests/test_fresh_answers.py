"""Operators that start many branches from one rollup read the table anew each time, and read it seldom."""

import datetime as dt

from tallyspark.operators import alerts, insights


def sales(spark, rows):
    return spark.createDataFrame(rows, "date timestamp_ntz, product string, sales double, quantity double, profit double, current_stock double")


def rows_of(product, amount, days=60):
    return [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), product, float(amount), 1.0, 1.0, 5.0) for i in range(days)]


def scans(df):
    """Table reads of the plan as it was executed."""
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name.startswith("Reused"):
            return 0
        below = [seq.apply(i) for seq in (node.children(), node.subqueries()) for i in range(seq.size())]
        return (name == "FileSourceScanExec") + sum(map(walk, below))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_new_files_give_new_answers(spark, tmp_path):
    folder = str(tmp_path / "sales")
    stock = spark.createDataFrame([("p0", "zero", 4.0), ("p9", "nine", 500.0)], "product_id string, product_name string, current_stock double")

    def answers():
        table = spark.read.parquet(folder)
        top = [r.title for r in insights.generate_insights(table).collect() if "Top Performer" in r.title]
        centre = {r["product"] for r in alerts.alert_centre(table, slow_threshold=5).collect()}
        module = {(r.product_id, r.alert_type) for r in alerts.module_alerts(table, stock, slow_threshold=5).collect()}
        return top, centre, module

    sales(spark, rows_of("p0", 42) + rows_of("p1", 1)).write.parquet(folder)
    top, centre, module = answers()
    assert "p0" in top[0] and "p9" not in centre and not any(p == "p9" and t == "Stockout Risk" for p, t in module)
    sales(spark, rows_of("p9", 9000, 90) + rows_of("p8", 2, 90)).write.mode("append").parquet(folder)
    top, later, module_later = answers()
    assert "p9" in top[0] and "p8" in later and module_later != module
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_raw_sales_are_read_twice_at_most(spark, tmp_path):
    folder = str(tmp_path / "sales")
    sales(spark, rows_of("p0", 42) + rows_of("p1", 1)).write.parquet(folder)
    table = spark.read.parquet(folder)
    stock = spark.createDataFrame([("p0", "zero", 4.0)], "product_id string, product_name string, current_stock double")
    assert scans(insights.generate_insights(table)) <= 2
    assert scans(alerts.alert_centre(table)) <= 2
    assert scans(alerts.module_alerts(table, stock)) <= 2

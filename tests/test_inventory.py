import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import by
from tallyspark.functions.numeric import normal_quantile
from tallyspark.operators import inventory as inv


def test_risk_levels(spark):
    stock = spark.createDataFrame([("P1", "A", 100), ("P2", "B", 50), ("P3", "C", 10), ("P4", "D", -10), ("P5", "E", 0), ("P6", "F", 9)],
                                  "product_id string, product_name string, current_stock long")
    sales = spark.createDataFrame([("P1", 10.0), ("P2", 5.0), ("P3", 2.0), ("P4", 5.0), ("P5", 0.0)], "product_id string, avg_daily_sales double")
    rows = by(inv.inventory_risk_levels(stock, sales), "product_id")
    assert set(rows) == {"P1", "P2", "P3", "P4", "P5"}
    assert [rows[p]["days_until_stockout"] for p in ("P1", "P2", "P3", "P4", "P5")] == [10.0, 10.0, 5.0, -2.0, None]
    assert [rows[p]["stockout_risk"] for p in ("P1", "P3", "P4", "P5")] == ["Medium", "High", "Critical", "Low"]
    assert rows["P4"]["alert_required"] and not rows["P5"]["alert_required"]
    with pytest.raises(ValueError, match="Missing required columns"):
        inv.inventory_risk_levels(stock.select("product_id"), sales)


def test_status_labels(spark):
    stock = spark.createDataFrame([("good", 100.0), ("low", 10.0), ("out", 0.0), ("idle", 5.0), ("gone", 0.0)], "product string, current_stock double")
    avg = spark.createDataFrame([("good", 4.0), ("low", 4.0), ("out", 4.0), ("gone", 0.0)], "product string, avg_daily_sales double")
    rows = by(inv.inventory_status_labels(stock, avg), "product")
    assert {p: r["status_label"] for p, r in rows.items()} == {
        "good": "Good Stock", "low": "Critical Low Stock", "out": "Out of Stock", "idle": "No Sales", "gone": "Out of Stock",
    }
    assert {p for p, r in rows.items() if r["is_critical"]} == {"low", "out"}
    assert rows["low"]["stockout_risk_days"] == 2.5 and rows["idle"]["stockout_risk_days"] is None and rows["out"]["stockout_risk_days"] == 0.0


def sales_rows(spark, rows):
    return spark.createDataFrame(
        [(p, dt.datetime.fromisoformat(d), float(s), float(q), st) for p, d, s, q, st in rows],
        "product string, date timestamp_ntz, sales double, quantity double, current_stock double",
    )


def test_stock_snapshot(spark):
    df = sales_rows(spark, [
        ("a", "2024-01-01", 1, 1, 9.0), ("a", "2024-01-02", 1, 1, 5.0), ("a", "2024-01-03", 1, 1, None),
        ("b", "2024-01-01", 1, 1, None), ("c", "2024-01-02", 1, 1, 3.0), ("c", "2024-01-02", 1, 1, 4.0),
    ])
    assert {r["product"]: r["current_stock"] for r in inv.stock_snapshot(df).collect()} == {"a": 5.0, "c": 4.0}
    none = df.withColumn("current_stock", F.lit(None).cast("double"))
    assert {r["product"]: r["current_stock"] for r in inv.stock_snapshot(none).collect()} == {"a": 7.0, "b": 7.0, "c": 14.0}
    idle = none.withColumn("quantity", F.lit(0.0))
    assert {r["current_stock"] for r in inv.stock_snapshot(idle).collect()} == {0.0}


def test_slow_movers(spark):
    df = spark.createDataFrame(
        [("P1", dt.date(2024, 1, 21), 10.0, 1.0), ("P1", dt.date(2024, 1, 30), 10.0, 2.0), ("P2", dt.date(2024, 1, 30), 50.0, 5.0),
         ("P3", dt.date(2023, 1, 1), 1.0, 1.0), ("P1", dt.date(2024, 1, 25), None, 1.0)],
        "product_id string, date date, sales double, quantity double",
    )
    rows = by(inv.slow_movers(df, "sales_rate", 3.0, as_of="2024-01-30"), "product_id")
    assert set(rows) == {"P1"}
    r = rows["P1"]
    assert (r["days_active"], r["avg_daily_sales"], r["total_quantity"], r["days_since_last_sale"], r["severity"]) == (2, 2.0, 3, 0, "Low")
    assert inv.slow_movers(df, "quantity_rate", 0.3, as_of="2024-01-30").count() == 0
    late = by(inv.slow_movers(df, "days_since_sale", 3.0, as_of="2024-02-09"), "product_id")
    assert late["P2"]["days_since_last_sale"] == 10 and late["P2"]["severity"] == "Medium"
    for bad in ({"window_days": 0}, {"threshold": -1}, {"method": "x"}):
        with pytest.raises(ValueError):
            inv.slow_movers(df, **bad)


def test_zero_velocity_and_stagnant(spark):
    df = spark.createDataFrame(
        [("A", dt.date(2024, 3, 1), 9.0), ("B", dt.date(2024, 1, 1), 1.0), ("C", dt.date(2024, 2, 20), 5.0)],
        "product_id string, date date, quantity double",
    )
    assert [r["product_id"] for r in inv.zero_velocity_products(df).collect()] == ["B"]
    assert {r["product_id"] for r in inv.stagnant_inventory(df).collect()} == {"C", "B"}
    assert inv.stagnant_inventory(df, window_days=30).first()["total_quantity_sold"] == 5


def test_page_slow_movers(spark):
    df = sales_rows(spark, [("a", "2024-01-01", 1, 1, None), ("a", "2024-01-01", 2, 1, None), ("a", "2024-01-05", 1, 1, None), ("b", "2024-01-01", 9, 1, None)])
    assert [tuple(r) for r in inv.slow_movers_page(df, 5.0).collect()] == [("a", 2.0)]


def test_planning(spark):
    df = spark.createDataFrame([(10.0, 4.0, 0.95), (10.0, 0.0, 0.95), (-1.0, 4.0, 1.5)], "avg double, sd double, level double")
    z = 1.6448536269514715
    safe = [r[0] for r in df.select(inv.safety_stock(F.col("sd"), 4, 0.95)).collect()]
    assert safe == [z * 4 * 2, 0.0, z * 4 * 2]
    per_row = [r[0] for r in df.select(inv.safety_stock(F.col("sd"), 4, F.col("level"))).collect()]
    assert math.isclose(per_row[0], z * 8, rel_tol=1e-8) and per_row[1:] == [0.0, 0.0]
    assert df.select(inv.safety_stock(F.col("sd"), 4, 1.0)).first()[0] == 0.0
    assert [r[0] for r in df.select(inv.reorder_point(F.col("avg"), 5, F.lit(3.0))).collect()] == [53.0, 53.0, 0.0]
    assert [r[0] for r in df.select(inv.order_quantity(F.col("avg"), 30, 5.0)).collect()] == [305.0, 305.0, 0.0]
    assert df.select(inv.order_quantity(F.col("avg"), 30, 5.0, 100.0, net_of_stock=True)).first()[0] == 205.0


def test_normal_quantile(spark):
    from statistics import NormalDist

    levels = [0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 0.9999]
    df = spark.createDataFrame([(p,) for p in levels], "p double")
    for p, (q,) in zip(levels, df.select(normal_quantile(F.col("p"))).collect(), strict=True):
        assert math.isclose(q, NormalDist().inv_cdf(p), rel_tol=1e-7, abs_tol=1e-8)


def test_reorder_panel(days, spark):
    series = days([1000] + [10] * 30, product="a")
    row = inv.reorder_panel(series).first()
    assert (row["daily_sales"], row["safety_stock"], row["order_now"], row["stock_days"]) == (10.0, 15.0, 30.0, 1.5)
    assert math.isclose(row["reorder_at"], 18.0) and row["status"].startswith("Critical")
    stock = spark.createDataFrame([("a", 50.0)], "product string, current_stock double")
    assert inv.reorder_panel(series, stock=stock).first()["status"].startswith("Low")

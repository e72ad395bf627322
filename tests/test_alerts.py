import datetime as dt

import pytest

from conftest import by
from tallyspark.operators import alerts as al
from tallyspark.operators import insights as ins
from tallyspark.schemas import INSIGHT_SCHEMA, PAGE_ALERT_SCHEMA


@pytest.fixture(scope="module")
def stock(spark):
    return spark.createDataFrame(
        [("P001", "Widget A", "5"), ("P002", "Widget B", "15"), ("P003", "Gadget", None)],
        "product_id string, product_name string, current_stock string",
    )


@pytest.fixture(scope="module")
def status(spark):
    return spark.createDataFrame(
        [("P001", "A", 10, 5.0, 2.0, "Critical", True), ("P002", "B", 50, 10.0, None, "High", True), ("P003", "C", 100, 10.0, 10.0, "Medium", False)],
        "product_id string, product_name string, current_stock long, avg_daily_sales double, days_until_stockout double, "
        "stockout_risk string, alert_required boolean",
    )


def test_low_stock(stock):
    rows = al.low_stock_alerts(stock, 10).collect()
    assert [(r["product_id"], r["current_stock"], r["severity"], r["threshold"]) for r in rows] == [("P001", 5, "Warning", 10.0)]
    with pytest.raises(ValueError, match="must be non-negative"):
        al.low_stock_alerts(stock, -5)
    with pytest.raises(ValueError, match="Missing required columns"):
        al.low_stock_alerts(stock.select("product_id"), 10)


def test_stockout_and_combination(stock, status):
    out = al.stockout_alerts(status)
    rows = by(out, "product_id")
    assert {k: (v["risk_level"], v["severity"], v["days_until_stockout"]) for k, v in rows.items()} == {
        "P001": ("Critical", "Critical", 2.0), "P002": ("High", "Warning", 0.0),
    }
    both = al.combine_inventory_alerts(al.low_stock_alerts(stock, 10), out).collect()
    assert [(r["severity"], r["alert_type"]) for r in both] == [("Critical", "Stockout Risk"), ("Warning", "Low Stock"), ("Warning", "Stockout Risk")]
    with pytest.raises(ValueError, match="Missing required columns"):
        al.stockout_alerts(stock)


@pytest.fixture(scope="module")
def module_alerts(spark):
    rows = [
        ("Low Stock", "Medium", "P1", "Blue Widget", None, dt.date(2024, 1, 1)), ("Stockout Risk", "Critical", "widget-2", "Bolt", "Resolved", dt.date(2024, 3, 1)),
        ("Low Stock", "High", "P3", "Nut", "Active", dt.date(2024, 3, 20)), (None, "Low", "P4", None, None, None),
    ]
    return spark.createDataFrame(rows, "alert_type string, severity string, product_id string, product_name string, status string, date date")


def test_module_filter(module_alerts):
    assert al.filter_alerts_module(module_alerts, alert_type="Low Stock").count() == 2
    assert al.filter_alerts_module(module_alerts, severity="Critical").count() == 1
    assert al.filter_alerts_module(module_alerts, status="Active").count() == 3
    assert al.filter_alerts_module(module_alerts, search="WIDGET").count() == 2
    assert al.filter_alerts_module(module_alerts, time_range="7d").count() == 4
    assert al.filter_alerts_module(module_alerts, time_range="30d", as_of="2024-03-30").count() == 2
    assert al.filter_alerts_module(module_alerts.drop("status"), status="Active").count() == 4
    assert al.valid_alerts(module_alerts).count() == 3


def test_module_sort_and_merge(module_alerts, stock):
    assert [r["severity"] for r in al.sort_alerts_module(module_alerts).collect()] == ["Critical", "High", "Medium", "Low"]
    assert [r["severity"] for r in al.sort_alerts_module(module_alerts, ascending=True).collect()][0] == "Low"
    assert [r["product_id"] for r in al.sort_alerts_module(module_alerts, "date").collect()][:2] == ["P3", "widget-2"]
    merged = al.merge_alerts(module_alerts, al.low_stock_alerts(stock, 10), None)
    assert merged.count() == 5 and merged.filter("threshold is not null").count() == 1


def test_rollup_and_summary(module_alerts):
    rows = {(r["level"], r["alert_type"], r["severity"]): r["alerts"] for r in al.alert_rollup(module_alerts).collect()}
    assert rows[("total", None, None)] == 4 and rows[("by_type", "Low Stock", None)] == 2 and rows[("by_severity", None, "High")] == 1
    assert rows[("by_type_severity", "Low Stock", "Medium")] == 1 and rows[("by_type", None, None)] == 1
    row = al.alert_summary(module_alerts, k=2).first()
    assert row["summary_text"] == "Found 4 alerts including 1 critical"
    assert (row["critical_count"], row["high_count"], row["medium_count"], row["low_count"]) == (1, 1, 1, 1)
    assert [a["severity"] for a in row["top_alerts"]] == ["Critical", "High"]
    empty = al.alert_summary(module_alerts.limit(0)).first()
    assert empty["summary_text"] == "No alerts found" and empty["total_alerts"] == 0
    assert [r["alerts"] for r in al.alert_rollup(module_alerts.limit(0)).collect()] == [0]


@pytest.fixture(scope="module")
def sales(spark):
    rows = []
    for i in range(30):
        day = dt.datetime(2024, 1, 1) + dt.timedelta(i)
        rows.append(("slow", day, 0.5, 1.0, 100.0))
        rows.append(("fast", day, 500.0 if i == 20 else 100.0, 10.0, 20.0 - i if i < 29 else None))
    return spark.createDataFrame(rows, "product string, date timestamp_ntz, sales double, quantity double, current_stock double")


def test_alert_centre(sales):
    out = al.alert_centre(sales)
    assert out.schema.fieldNames() == PAGE_ALERT_SCHEMA.fieldNames()
    rows = {(r["type"], r["product"]): r for r in out.collect()}
    assert set(rows) == {
        ("Stockout Risk", "fast"), ("Low Stock", "fast"), ("High Sales Anomaly", "All Products"), ("Slow-Moving Item", "slow"),
    }
    stockout = rows[("Stockout Risk", "fast")]
    assert stockout["alert_date"] == dt.datetime(2024, 1, 30) and stockout["severity"] == "Critical"
    assert stockout["message"] == "**fast**: Critical stock! Estimated **0 days** of stock remaining. Current: -8, Avg Daily Sales: 10.0."
    assert stockout["details"]["status_label"] == "Out of Stock"
    spike = rows[("High Sales Anomaly", "All Products")]
    assert spike["alert_date"] == dt.datetime(2024, 1, 21) and "₹500 were significantly higher" in spike["message"]


def test_alert_centre_parts_add_up(sales):
    out = al.alert_centre(sales)
    assert sum(r["alerts"] for r in al.alert_groups(out).collect()) == out.count()
    assert {r["value"] for r in al.alert_facets(out).filter("facet = 'severity'").collect()} == {"Critical", "High", "Medium", "Low"}
    groups = {r["group_key"] for r in al.alert_groups(out).collect()}
    assert "High Sales Anomaly - Medium" in groups and "Low Stock - High (Product: fast)" in groups


def test_page_filters(sales):
    out = al.alert_centre(sales)
    assert al.filter_alerts_page(out, time_range="Daily").count() == 3
    assert al.filter_alerts_page(out, time_range="Weekly").count() == 3
    assert al.filter_alerts_page(out, time_range="Monthly").count() == 4
    assert al.filter_alerts_page(out, alert_type="All", severity="High", status="New").count() == 1
    assert al.filter_alerts_page(out, search="critical STOCK|higher").count() == 2
    assert al.filter_alerts_page(out, start="2024-01-21", end="2024-01-21").count() == 1
    assert al.filter_alerts_page(out, time_range="Monthly", latest="2023-01-15").count() == 4
    assert al.filter_alerts_page(out, time_range="Monthly", latest="2023-01-15", same_year=True).count() == 0
    with pytest.raises(ValueError):
        al.filter_alerts_page(out, time_range="Hourly")
    assert [r["severity"] for r in al.sort_alerts_page(out).collect()] == ["Critical", "High", "Medium", "Low"]


def test_given_stock_table(sales, spark):
    given = spark.createDataFrame([("fast", 1000.0), ("new", 3.0)], "product string, current_stock double")
    kinds = {(r["type"], r["product"]) for r in al.alert_centre(sales, stock=given).collect()}
    assert ("Low Stock", "new") in kinds and not any(k == "Stockout Risk" for k, _ in kinds)


def test_insights(sales):
    found = ins.generate_insights(sales, currency="$")
    assert found.schema.fieldNames() == INSIGHT_SCHEMA.fieldNames()
    rows = by(found, "title")
    assert rows["🚀 Top Performer: fast"]["priority"] == 3 and "🐢 Slow-Moving Stock Alert" not in rows
    spike = rows["🚨 Unusual Sales Day Detected: Jan 21, 2024"]
    assert spike["type"] == "anomaly" and "$500" in spike["description"]
    assert rows["Republic Day Opportunity"]["impact"] == 20.0 and rows["Peak Sales Hour Identified"]["impact"] == 100.0
    ranked = ins.rank_insights(found).collect()
    assert [(r["priority"], -r["impact"]) for r in ranked] == sorted((r["priority"], -r["impact"]) for r in ranked)
    sections = {r["title"]: r["section"] for r in ins.insight_sections(found).collect()}
    assert sections["🚨 Unusual Sales Day Detected: Jan 21, 2024"] == "urgent" and sections["Republic Day Opportunity"] == "timing_seasonal"
    answers = {r["question"]: r["title"] for r in ins.insight_answers(found).collect()}
    assert answers["What are my top-selling products?"] == "🚀 Top Performer: fast"
    assert "What are my lowest-profit items?" not in answers


def test_insights_need_columns(spark):
    with pytest.raises(ValueError):
        ins.generate_insights(spark.range(1))


def test_trend_section_keeps_three(spark):
    rows = [(f"t{i}", "d", "r", 2, float(i), "trend") for i in range(5)]
    kept = ins.insight_sections(spark.createDataFrame(rows, INSIGHT_SCHEMA)).collect()
    assert sorted(r["title"] for r in kept) == ["t2", "t3", "t4"]


def test_merging_nothing_gives_an_empty_table(spark):
    assert al.merge_alerts().count() == 0


def test_summary_keeps_whole_alerts(module_alerts):
    top = al.alert_summary(module_alerts, k=2).first()["top_alerts"]
    assert len(top) == 2 and set(top[0].asDict()) == set(module_alerts.columns)

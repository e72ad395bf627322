"""Insight assembly: measured rows become ranked findings with advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import AsOf, as_of_moment
from tallyspark.functions.numeric import fixed, grouped
from tallyspark.operators import kpis
from tallyspark.operators.anomalies import rolling_band
from tallyspark.operators.rollups import daily_sales, fill_days, hourly_sales, product_totals, shared

# Month -> (title, priority, impact) of the seasonal opportunities.
SEASONS: dict[int, tuple[str, int, float]] = {
    1: ("Republic Day Opportunity", 2, 20.0),
    3: ("Holi Festival Preparations", 2, 25.0),
    4: ("Summer Essentials Demand", 2, 30.0),
    7: ("Monsoon Preparedness", 2, 15.0),
    8: ("Independence Day & Festivals", 2, 20.0),
    10: ("Diwali & Festive Season Boom", 1, 40.0),
    12: ("Year-End Holiday Rush", 2, 35.0),
}

# Question -> (insight type, title fragment).
QUESTIONS: dict[str, tuple[str, str]] = {
    "What are my top-selling products?": ("product", "Top Performer"),
    "What are my lowest-profit items?": ("profit", "Low Profit"),
    "When are my peak sales hours?": ("timing", "Peak Sales Hour"),
    "Are there any sales anomalies recently?": ("anomaly", ""),
    "Which items are moving slowly?": ("inventory", "Slow-Moving"),
    "Are there any current seasonal opportunities?": ("seasonal", ""),
}


def _insight(
    rows: DataFrame, title: Column, description: Column, advice: Column | str, priority: Column | int, impact: Column, kind: str,
) -> DataFrame:
    return rows.select(
        title.alias("title"), description.alias("description"),
        (advice if isinstance(advice, Column) else F.lit(advice)).alias("recommendation"),
        (priority if isinstance(priority, Column) else F.lit(priority)).cast("int").alias("priority"),
        impact.cast("double").alias("impact"), F.lit(kind).alias("type"),
    )


def trend_insights(sales: DataFrame, as_of: AsOf = None) -> list[DataFrame]:
    week = kpis.week_over_week(sales, as_of).filter("significant")
    change, started = F.col("change_pct"), F.col("initiated")
    weekly = _insight(
        week,
        F.when(started, "Sales Activity Initiated").when(change > 0, "Sales Surge Detected").otherwise("Sales Dip Detected"),
        F.when(started, F.lit("The last 7 days have sales; the 7 days before had none."))
        .otherwise(F.concat(F.lit("Sales changed by "), fixed(F.abs(change), 1), F.lit("% against the previous 7 days."))),
        F.when(started, "Watch the trend and keep stock available.")
        .when(change > 0, "Support the growth: plan staff and promote popular items.")
        .otherwise("Look for the cause: promotions, competitors, missing stock."),
        F.when(started, 3).when(change > 0, 2).otherwise(1),
        F.when(started, F.col("recent_sales")).otherwise(F.abs(change)),
        "trend",
    )
    month = kpis.month_over_month(sales, as_of).filter("significant")
    monthly = _insight(
        month, F.lit("Monthly Sales Shift"),
        F.concat(F.lit("Sales are "), F.when(change > 0, "up").otherwise("down"), F.lit(" by "), fixed(F.abs(change), 1),
                 F.lit("% against the previous month.")),
        "Review marketing, launches and outside events of the month.", 3, F.abs(change), "trend",
    )
    return [weekly, monthly]


def product_insights(totals: DataFrame, currency: str) -> list[DataFrame]:
    """Best and worst sellers, thin profits and stock movers, from per-product totals."""
    share, found = F.col("share_pct"), []
    name = F.col("product")
    if "sales" in totals.columns:
        money = F.concat(F.lit(currency), grouped(F.col("sales")))
        found.append(_insight(
            kpis.product_top(totals), F.concat(F.lit("🚀 Top Performer: "), name),
            F.concat(F.lit("Sold for "), money, F.lit(", "), fixed(share, 1), F.lit("% of all sales.")),
            "Keep it in stock and in sight.", 3, share, "product",
        ))
        found.append(_insight(
            kpis.product_bottom(totals), F.concat(F.lit("📉 Low Performer: "), name),
            F.concat(F.lit("Sold for only "), money, F.lit(", "), fixed(share, 1), F.lit("% of all sales.")),
            "Bundle it, discount it or phase it out.", 2, F.lit(100.0) - share, "product",
        ))
    if "profit" in totals.columns:
        found.append(_insight(
            kpis.low_profit_items(totals), F.concat(F.lit("💸 Low Profit Item: "), name),
            F.concat(F.lit("Earned only "), F.lit(currency), grouped(F.col("profit")), F.lit(" in profit.")),
            "Check supplier cost and price.", 1, F.col("impact"), "profit",
        ))
    if "quantity" in totals.columns:
        fast = F.col("kind") == "fast"
        found.append(_insight(
            kpis.inventory_movers(totals),
            F.when(fast, "⚡️ High Demand Items").otherwise("🐢 Slow-Moving Stock Alert"),
            F.concat(F.when(fast, "Fastest items by quantity: ").otherwise("Slowest items by quantity: "), F.col("products"), F.lit(".")),
            F.when(fast, "Hold enough stock of these items.").otherwise("Promote or mark down to free capital."),
            F.when(fast, 2).otherwise(1), F.col("impact"), "inventory",
        ))
    return found


def timing_insights(hourly: DataFrame, peak_share_pct: float = 20.0) -> list[DataFrame]:
    """Weekend effect and peak hour, from (day, hour) totals."""
    effect = kpis.weekend_effect(hourly).filter(F.col("effect") != "none")
    surge = F.col("effect") == "surge"
    weekend = _insight(
        effect, F.when(surge, "Weekend Sales Surge").otherwise("Weekend Sales Lag"),
        F.concat(F.lit("Weekend sales are "), fixed(F.col("ratio"), 1), F.lit("x weekday sales.")),
        F.when(surge, "Staff the weekend and promote on it.").otherwise("Try weekend offers or longer hours."),
        2, F.col("impact"), "timing",
    )
    by_hour = hourly.withColumn("moment", F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour")))
    peak = kpis.peak_hour(by_hour.select("moment", "sales"), "moment", share_pct=peak_share_pct).filter("significant")
    hour = F.col("peak_hour")
    busiest = _insight(
        peak, F.lit("Peak Sales Hour Identified"),
        F.concat(F.lit("Most sales fall between "), hour.cast("string"), F.lit(":00 and "), (hour + 1).cast("string"),
                 F.lit(":00, "), fixed(F.col("share_pct"), 1), F.lit("% of the total.")),
        "Staff this hour and speed up checkout.", 3, F.col("share_pct"), "timing",
    )
    return [weekend, busiest]


def seasonal_opportunities(sales: DataFrame, as_of: AsOf = None, date: str = "date") -> DataFrame:
    """The opportunity of the month of ``as_of``, if that month has one."""
    month = F.month(as_of_moment(sales, date, as_of))
    lookup = F.array(*[
        F.struct(F.lit(m).alias("month"), F.lit(t).alias("title"), F.lit(p).alias("priority"), F.lit(i).alias("impact"))
        for m, (t, p, i) in SEASONS.items()
    ])
    rows = sales.sparkSession.range(1).select(F.inline(lookup)).filter(F.col("month") == month)
    return _insight(
        rows, F.col("title"), F.concat(F.lit("Seasonal demand of month "), F.col("month").cast("string"), F.lit(".")),
        "Prepare stock and offers for the season.", F.col("priority"), F.col("impact"), "seasonal",
    )


def anomaly_insights(daily: DataFrame, currency: str) -> DataFrame:
    found = rolling_band(fill_days(daily))
    return _insight(
        found, F.concat(F.lit("🚨 Unusual Sales Day Detected: "), F.date_format("date", "MMM dd, yyyy")),
        F.concat(F.lit("Sales of "), F.lit(currency), grouped(F.col("sales")), F.lit(" were unusually "), F.col("direction"),
                 F.lit("; about "), F.lit(currency), grouped(F.col("rolling_mean")), F.lit(" was expected.")),
        F.when(F.col("direction") == "high", "Find out what drove the sales and repeat it.")
        .otherwise("Find out what held the sales back."),
        1, F.col("impact"), "anomaly",
    )


def generate_insights(sales: DataFrame, as_of: AsOf = None, currency: str = "₹", peak_share_pct: float = 20.0) -> DataFrame:
    """Every insight the present columns allow (unranked).

    All generators start from two rollups of the raw table: (day, hour) totals,
    bounded by the calendar, and per-product totals.  All branches share the
    exchange of each, so the raw table is read twice however many insights are drawn.
    """
    columns, found = set(sales.columns), []
    dated = {"date", "sales"} <= columns
    hourly = shared(hourly_sales(sales).select("date", "hour", "sales")) if dated else None
    if dated:
        found += trend_insights(hourly, as_of)
    if "product" in columns and columns & {"sales", "quantity"}:
        totals = shared(product_totals(sales))
        if "sales" not in columns:
            totals = totals.drop("profit")
        found += product_insights(totals, currency)
    if dated:
        found += timing_insights(hourly, peak_share_pct)
    if "date" in columns or as_of is not None:
        found.append(seasonal_opportunities(hourly if dated else sales, as_of))
    if dated:
        found.append(anomaly_insights(daily_sales(hourly), currency))
    if not found:
        raise ValueError("Missing required columns: nothing to derive insights from")
    return reduce(DataFrame.unionByName, found)


def rank_insights(insights: DataFrame, k: int | None = None) -> DataFrame:
    """Priority first, then impact, then title; optionally the first k."""
    ordered = insights.orderBy(F.coalesce("priority", F.lit(99)), F.desc(F.coalesce("impact", F.lit(0.0))), "title")
    return ordered.limit(k) if k else ordered


def insight_sections(insights: DataFrame, trends_shown: int = 3) -> DataFrame:
    """Page section of each insight; the trend section keeps its first rows only."""
    urgent = F.col("priority") == 1
    kind = F.col("type")
    section = (
        F.when(urgent, "urgent").when(kind == "trend", "trends")
        .when(kind.isin("product", "profit", "inventory"), "product_stock")
        .when(kind.isin("timing", "seasonal"), "timing_seasonal")
    )
    placed = insights.withColumn("section", section).filter(F.col("section").isNotNull())
    trends = rank_insights(placed.filter(F.col("section") == "trends"), trends_shown)
    return placed.filter(F.col("section") != "trends").unionByName(trends)


def insight_answers(insights: DataFrame) -> DataFrame:
    """First matching insight of each canned question; questions without a match are left out.

    The rules are an array of constants unfolded on each insight, so no join is needed.
    """
    rules = F.array(*[
        F.struct(F.lit(q).alias("question"), F.lit(t).alias("kind"), F.lit(f).alias("fragment")) for q, (t, f) in QUESTIONS.items()
    ])
    matched = insights.select("*", F.inline(F.filter(
        rules, lambda r: (r["kind"] == F.col("type")) & F.col("title").contains(r["fragment"])
    )))
    order = F.struct("priority", -F.col("impact"), "title")
    first = F.min_by(F.struct("title", "description", "recommendation"), order)
    return matched.groupBy("question").agg(first.alias("a")).select("question", "a.*")

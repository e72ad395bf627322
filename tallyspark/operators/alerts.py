"""Alert generation, filtering, ranking and roll-ups.

Two flavours exist side by side and are never merged: *page* alerts
(``type``, ``alert_date``, ``message`` ...) and *module* alerts (``alert_type``
plus the measures of each kind).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.dates import AsOf, as_of_moment
from tallyspark.functions.numeric import fixed
from tallyspark.operators.anomalies import rolling_zscore
from tallyspark.operators.inventory import (
    inventory_risk_levels, slow_movers, stagnant_inventory, status_columns, stock_profile, with_current_stock, zero_velocity_products,
)
from tallyspark.operators.rollups import avg_daily_by_product, product_days, shared
from tallyspark.schemas import MODULE_ALERT_CORE, require_columns, with_missing_columns

# Severity ranks of the two flavours, and of combined inventory alerts.
PAGE_SEVERITY_RANK = {"Critical": 5, "High": 4, "Medium": 3, "Low": 2, "Informational": 1}
MODULE_SEVERITY_RANK = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
INVENTORY_SEVERITY_RANK = {"Critical": 0, "Warning": 1}

TIME_RANGES = ("Daily", "Weekly", "Monthly", "Quarterly", "Yearly")


def _rank(col: Column, ranks: dict[str, int], other: int) -> Column:
    expr = F
    for name, value in ranks.items():
        expr = expr.when(col == name, value)
    return expr.otherwise(other)


def _text_map(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])


def _page_alert(
    kind: str, severity: str, when: Column, product: Column, message: Column, summary: Column, details: dict[str, Column],
) -> Column:
    return F.struct(
        when.cast("timestamp_ntz").alias("alert_date"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
        F.lit("New").alias("status"), product.alias("product"), message.alias("message"), summary.alias("summary"),
        _text_map(details).alias("details"),
    )


# --- page flavour: one struct per alert kind ------------------------------------------------------
# The message texts below are searched by users, so their wording is part of the result.

def _stockout_struct(as_of: Column) -> Column:
    p = F.col("product")
    message = F.concat(
        F.lit("**"), p, F.lit("**: Critical stock! Estimated **"), fixed(F.col("stockout_risk_days"), 0),
        F.lit(" days** of stock remaining. Current: "), fixed(F.col("current_stock"), 0),
        F.lit(", Avg Daily Sales: "), fixed(F.col("avg_daily_sales"), 1), F.lit("."),
    )
    return _page_alert(
        "Stockout Risk", "Critical", as_of, p, message,
        F.concat(F.lit("Product '"), p, F.lit("' is at critical low stock.")),
        {c: F.col(c) for c in ("current_stock", "avg_daily_sales", "stockout_risk_days", "status_label")},
    )


def _low_stock_struct(as_of: Column) -> Column:
    p = F.col("product")
    message = F.concat(
        F.lit("**"), p, F.lit("**: Low stock! Only **"), fixed(F.col("current_stock"), 0), F.lit(" units** remaining."),
    )
    return _page_alert(
        "Low Stock", "High", as_of, p, message,
        F.concat(F.lit("Product '"), p, F.lit("' has dropped to low inventory levels.")),
        {"current_stock": F.col("current_stock")},
    )


def _slow_struct(as_of: Column) -> Column:
    p = F.col("product")
    message = F.concat(
        F.lit("**"), p, F.lit("**: Average daily sales of only **"), fixed(F.col("avg_daily_sales"), 1), F.lit("**."),
    )
    return _page_alert(
        "Slow-Moving Item", "Low", as_of, p, message,
        F.concat(F.lit("Product '"), p, F.lit("' is selling very slowly.")),
        {"avg_daily_sales": F.col("avg_daily_sales")},
    )


def _anomaly_struct(high: bool, currency: str) -> Column:
    label = F.date_format("date", "yyyy-MM-dd")
    message = F.concat(
        F.lit("**"), label, F.lit(f"**: Sales of {currency}"), fixed(F.col("sales"), 0),
        F.lit(f" were significantly {'higher' if high else 'lower'} than expected (Z-score: "),
        fixed(F.col("z_score"), 1), F.lit(")."),
    )
    summary = F.concat(
        F.lit("Unusually high sales detected on " if high else "Significant drop in sales detected on "), label, F.lit("."),
    )
    return _page_alert(
        "High Sales Anomaly" if high else "Low Sales Anomaly", "Medium" if high else "High", F.col("date"),
        F.lit("All Products"), message, summary, {c: F.col(c) for c in ("sales", "mean_sales", "std_dev_sales", "z_score")},
    )


def stockout_alerts_page(status: DataFrame, as_of: AsOf) -> DataFrame:
    """Critical products of an inventory status table."""
    require_columns(status, ["product", "current_stock", "avg_daily_sales", "stockout_risk_days", "is_critical"])
    when = as_of if isinstance(as_of, Column) else F.lit(str(as_of))
    return status.filter("is_critical").select(F.inline(F.array(_stockout_struct(when))))


def low_stock_alerts_page(stock: DataFrame, as_of: AsOf, quantity: float = 10) -> DataFrame:
    """Products at or under an absolute quantity."""
    require_columns(stock, ["product", "current_stock"])
    when = as_of if isinstance(as_of, Column) else F.lit(str(as_of))
    return stock.filter(F.col("current_stock") <= quantity).select(F.inline(F.array(_low_stock_struct(when))))


def anomaly_alerts_page(flagged: DataFrame, currency: str = "₹") -> DataFrame:
    """High and low days of a z-score table; one pass emits both kinds."""
    kinds = F.array_compact(F.array(
        F.when(F.col("is_anomaly_high"), _anomaly_struct(True, currency)),
        F.when(F.col("is_anomaly_low"), _anomaly_struct(False, currency)),
    ))
    return flagged.filter(F.col("is_anomaly_high") | F.col("is_anomaly_low")).select(F.inline(kinds))


def slow_moving_alerts_page(movers: DataFrame, as_of: AsOf) -> DataFrame:
    require_columns(movers, ["product", "avg_daily_sales"])
    when = as_of if isinstance(as_of, Column) else F.lit(str(as_of))
    return movers.select(F.inline(F.array(_slow_struct(when))))


def alert_centre(
    sales: DataFrame, stock: DataFrame | None = None, as_of: AsOf = None, critical_days: float = 5,
    low_stock_quantity: float = 10, z_threshold: float = 2.0, slow_threshold: float = 1.0, currency: str = "₹",
) -> DataFrame:
    """All page alerts of a canonical sales table.

    Every product is profiled once and fans out into its stockout, low-stock and
    slow-mover alerts; the daily totals add the sales anomalies.  The raw table
    is read for those two rollups only: the daily one, bounded by the calendar,
    is one exchange that all branches share, as the latest date and the stock
    facts also come from it.  Stock readings come from ``stock`` (``product,
    current_stock``) or else from the sales rows.
    """
    require_columns(sales, ["date", "product", "sales", "quantity"])
    readings = [F.count("current_stock").alias("known")] if "current_stock" in sales.columns else [F.lit(0).alias("known")]
    daily = shared(sales.groupBy(F.to_date("date").alias("date")).agg(
        F.sum("sales").alias("sales"), F.sum("quantity").alias("quantity"), F.max("date").alias("latest"), *readings,
    ))
    when = as_of_moment(daily, "latest", as_of)
    profile = stock_profile(sales)
    if stock is not None:
        known = stock.select("product", F.col("current_stock").cast("double").alias("current_stock"))
        products = profile.drop("last_stock").join(known, "product", "full")
    else:
        products = with_current_stock(profile, daily.agg(F.sum("known").alias("known"), F.sum("quantity").alias("moved")))
    on_hand, demand = F.col("current_stock"), F.coalesce(F.col("avg_daily_quantity"), F.lit(0.0))
    status = status_columns(on_hand, demand, critical_days)
    # Demand in units judges the stock; average sales judge the slow movers.
    measured = products.select(
        "product", "current_stock", demand.alias("_demand"), F.col("avg_daily_sales").alias("_avg_sales"),
        *[c.alias(n) for n, c in status.items()],
    )
    by_stock = measured.withColumnRenamed("_demand", "avg_daily_sales").select(
        "_avg_sales", "product",
        F.when(F.col("is_critical"), _stockout_struct(when)).alias("_stockout"),
        F.when(on_hand <= low_stock_quantity, _low_stock_struct(when)).alias("_low"),
    )
    by_sales = by_stock.withColumnRenamed("_avg_sales", "avg_daily_sales").select(
        "_stockout", "_low", F.when(F.col("avg_daily_sales") < slow_threshold, _slow_struct(when)).alias("_slow"),
    )
    per_product = by_sales.select(F.inline(F.array_compact(F.array("_stockout", "_low", "_slow"))))
    flagged = rolling_zscore(daily, threshold=z_threshold)
    return per_product.unionByName(anomaly_alerts_page(flagged, currency))


# --- page flavour: filter, sort, group --------------------------------------------------------------

def filter_alerts_page(
    alerts: DataFrame, time_range: str | None = None, alert_type: str | None = None, severity: str | None = None,
    status: str | None = None, search: str | None = None, start: AsOf = None, end: AsOf = None,
    latest: AsOf = None, same_year: bool = False,
) -> DataFrame:
    """All given criteria together.

    ``time_range`` is relative to the latest alert (or ``latest``); Monthly and
    Quarterly compare the month or quarter number of any year unless
    ``same_year``.  ``start`` / ``end`` bound the calendar date, both inclusive.
    ``search`` is a case-insensitive regular expression on the message.
    """
    out = alerts.filter(F.col("alert_date").isNotNull()) if "alert_date" in alerts.columns else alerts
    if time_range and time_range not in ("All Time", "Custom Range"):
        if time_range not in TIME_RANGES:
            raise ValueError(f"time_range must be one of {TIME_RANGES}")
        moment, date = as_of_moment(out, "alert_date", latest), F.col("alert_date")
        year = F.year(date) == F.year(moment)
        tests = {
            "Daily": F.to_date(date) == F.to_date(moment),
            "Weekly": date >= moment - F.make_dt_interval(F.lit(7)),
            "Monthly": (F.month(date) == F.month(moment)) & (year if same_year else F.lit(True)),
            "Quarterly": (F.quarter(date) == F.quarter(moment)) & (year if same_year else F.lit(True)),
            "Yearly": year,
        }
        out = out.filter(tests[time_range])
    for name, wanted in (("type", alert_type), ("severity", severity), ("status", status)):
        if wanted and wanted != "All":
            out = out.filter(F.col(name) == wanted)
    if search:
        out = out.filter(F.coalesce(F.col("message").rlike(f"(?i){search}"), F.lit(False)))
    if start is not None:
        out = out.filter(F.to_date("alert_date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        out = out.filter(F.to_date("alert_date") <= F.lit(str(end)).cast("date"))
    return out


def sort_alerts_page(alerts: DataFrame) -> DataFrame:
    """Most severe first, then latest first.

    Type and product break ties, which also spreads the sort: severity and date
    alone would send most alerts of a day to one range.
    """
    return alerts.orderBy(F.desc(_rank(F.col("severity"), PAGE_SEVERITY_RANK, 0)), F.desc("alert_date"), "type", "product")


def alert_groups(alerts: DataFrame) -> DataFrame:
    """Alerts per heading: type and severity, and the product unless it stands for all."""
    named = F.col("product").isNotNull() & (F.col("product") != "") & (F.col("product") != "All Products")
    heading = F.concat(
        F.col("type"), F.lit(" - "), F.col("severity"),
        F.when(named, F.concat(F.lit(" (Product: "), F.col("product"), F.lit(")"))).otherwise(F.lit("")),
    )
    return alerts.groupBy(heading.alias("group_key")).agg(F.count(F.lit(1)).alias("alerts"))


def alert_facets(alerts: DataFrame, columns: Sequence[str] = ("type", "severity", "status")) -> DataFrame:
    """Distinct values of each filter column.

    The column combinations are counted first, so only those few rows are unfolded.
    """
    combos = alerts.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    facets = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value"), F.col("n").alias("n")) for c in columns])
    return combos.select(F.inline(facets)).groupBy("facet", "value").agg(F.sum("n").alias("alerts"))


def distinct_products(sales: DataFrame, product: str = "product") -> DataFrame:
    """The product list."""
    return sales.select(product).distinct()


# --- module flavour -----------------------------------------------------------------------------------

def low_stock_alerts(stock: DataFrame, quantity: float) -> DataFrame:
    """Module low-stock alerts; unreadable stock never alerts."""
    from tallyspark.functions.numeric import to_number

    require_columns(stock, ["product_id", "product_name", "current_stock"], "the stock table")
    if quantity < 0:
        raise ValueError("low_stock_qty must be non-negative")
    level = to_number(stock, "current_stock")
    return stock.filter(level <= quantity).select(
        F.col("product_id").cast("string").alias("product_id"), F.col("product_name").cast("string").alias("product_name"),
        level.cast("bigint").alias("current_stock"), F.lit("Low Stock").alias("alert_type"),
        F.lit(float(quantity)).alias("threshold"), F.lit("Warning").alias("severity"),
    )


def stockout_alerts(status: DataFrame) -> DataFrame:
    """Module stockout alerts from an inventory risk table."""
    require_columns(status, [
        "product_id", "product_name", "current_stock", "avg_daily_sales", "days_until_stockout", "stockout_risk",
    ], "the inventory status table")
    risk = F.col("stockout_risk")
    return status.filter("alert_required").select(
        F.col("product_id").cast("string").alias("product_id"), F.col("product_name").cast("string").alias("product_name"),
        F.col("current_stock").cast("bigint").alias("current_stock"), F.col("avg_daily_sales").cast("double").alias("avg_daily_sales"),
        F.coalesce(F.col("days_until_stockout").cast("double"), F.lit(0.0)).alias("days_until_stockout"),
        F.lit("Stockout Risk").alias("alert_type"), risk.alias("risk_level"),
        F.when(risk == "High", "Warning").when(risk == "Critical", "Critical").otherwise("Unknown").alias("severity"),
    )


def merge_alerts(*tables: DataFrame) -> DataFrame:
    """Concatenation by name; duplicates stay, absent columns read null.  No table gives an empty one."""
    frames = [t for t in tables if isinstance(t, DataFrame)]
    if not frames:
        return SparkSession.active().createDataFrame([], ", ".join(f"{c} string" for c in ("alert_type", "severity", "product_id", "product_name")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def module_alerts(
    sales: DataFrame, stock: DataFrame, low_stock_quantity: float = 10, slow_threshold: float = 10.0, product: str = "product", date: str = "date",
    as_of: AsOf = None,
) -> DataFrame:
    """All module alerts of a sales and a stock table: low stock, stockout, slow movers, zero velocity, stagnant stock.

    The raw sales are summed once per product and day; all alerts start from that one rollup.
    """
    days = shared(product_days(sales, product, date)).withColumnRenamed("product", "product_id")
    averages = avg_daily_by_product(days.select("product_id", "date", "quantity"), "product_id")
    averages = averages.select(F.col("product").alias("product_id"), F.col("avg_daily_quantity").alias("avg_daily_sales"))
    return merge_alerts(
        low_stock_alerts(stock, low_stock_quantity),
        stockout_alerts(inventory_risk_levels(stock, averages)),
        slow_movers(days, "sales_rate", slow_threshold, as_of=as_of, n_rows="n_rows"),
        zero_velocity_products(days, as_of=as_of),
        stagnant_inventory(days, as_of=as_of),
    )


def combine_inventory_alerts(low_stock: DataFrame, stockout: DataFrame) -> DataFrame:
    """Low-stock and stockout alerts, critical ones first, low-stock before stockout among equals."""
    both = low_stock.withColumn("_source", F.lit(0)).unionByName(stockout.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    rank = _rank(F.coalesce(F.col("severity"), F.lit("Warning")), INVENTORY_SEVERITY_RANK, 2)
    return both.orderBy(rank, "_source", "product_id").drop("_source")


def filter_alerts_module(
    alerts: DataFrame, time_range: str = "30d", alert_type: str = "all", severity: str = "all", status: str = "all",
    search: str = "", as_of: AsOf = None,
) -> DataFrame:
    """Equality on type, severity and status (absent status is Active); substring on product id or name.

    ``time_range`` (``7d``, ``30d``, ``90d``, ``all``) only applies when ``as_of`` is given.
    """
    out = with_missing_columns(alerts, MODULE_ALERT_CORE)
    if alert_type != "all":
        out = out.filter(F.col("alert_type") == alert_type)
    if severity != "all":
        out = out.filter(F.col("severity") == severity)
    if status != "all":
        out = out.filter(F.coalesce(F.col("status"), F.lit("Active")) == status)
    if search:
        needle = search.lower()
        hit = [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in ("product_id", "product_name")]
        out = out.filter(hit[0] | hit[1])
    if as_of is not None and time_range != "all":
        days = int(time_range.rstrip("d"))
        end = as_of if isinstance(as_of, Column) else F.lit(str(as_of))
        out = out.filter(F.to_date("date") >= F.date_sub(F.to_date(end), days))
    return out.select(alerts.columns)


def valid_alerts(alerts: DataFrame) -> DataFrame:
    """Rows carrying both an alert type and a severity."""
    require_columns(alerts, ["alert_type", "severity"])
    return alerts.filter(F.col("alert_type").isNotNull() & F.col("severity").isNotNull())


def sort_alerts_module(alerts: DataFrame, sort_by: str = "severity", ascending: bool = False) -> DataFrame:
    """By severity (most severe first unless ``ascending``) or by any field, largest first by default."""
    ties = [c for c in ("alert_type", "product_id") if c in alerts.columns and c != sort_by]
    if sort_by == "severity":
        rank = _rank(F.coalesce(F.col("severity"), F.lit("Low")), MODULE_SEVERITY_RANK, 4)
        return alerts.orderBy(F.desc(rank) if ascending else F.asc(rank), *ties)
    key = F.col(sort_by) if sort_by in alerts.columns else F.lit("")
    return alerts.orderBy(F.asc_nulls_first(key) if ascending else F.desc_nulls_last(key), *ties)


def alert_rollup(alerts: DataFrame) -> DataFrame:
    """Counts in total, by type, by severity and by both.

    Alerts are counted per (type, severity) first; the grouping sets then run over that handful of rows.
    """
    require_columns(alerts, ["alert_type", "severity"])
    pairs = alerts.groupBy("alert_type", "severity").agg(F.count(F.lit(1)).alias("n"))
    t, s = F.col("alert_type"), F.col("severity")
    level = F.grouping_id()
    detail = pairs.groupingSets([[t, s], [t], [s]], t, s).agg(
        F.when(level == 1, "by_type").when(level == 2, "by_severity").otherwise("by_type_severity").alias("level"),
        F.sum("n").alias("alerts"),
    )
    # The total is a plain aggregate, which has its row of 0 even without alerts.
    grand = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("alerts")).withColumn("level", F.lit("total"))
    return detail.unionByName(grand, allowMissingColumns=True).select("level", "alert_type", "severity", "alerts")


def alert_summary(alerts: DataFrame, k: int = 5) -> DataFrame:
    """Summary text, counts per severity, and the k most severe alerts, whole, as an array of structs."""
    severity = F.col("severity")
    counts = alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[F.count_if(severity == s).alias(f"{s.lower()}_count") for s in MODULE_SEVERITY_RANK],
    )
    ties = [c for c in ("alert_type", "product_id") if c in alerts.columns]
    rank = _rank(F.coalesce(severity, F.lit("Low")), MODULE_SEVERITY_RANK, 4)
    best = alerts.select(F.struct(*[F.col(c) for c in alerts.columns]).alias("alert"), F.struct(rank.alias("rank"), *ties).alias("place")).orderBy("place").limit(k)
    # At most k rows meet here, in order; only their places are compared, so fields may be of any type.
    in_order = F.array_sort("t", lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0))
    top = best.agg(F.collect_list(F.struct("place", "alert")).alias("t")).select(F.transform(in_order, lambda x: x["alert"])).scalar()
    text = F.when(F.col("total_alerts") == 0, "No alerts found").otherwise(F.concat(
        F.lit("Found "), F.col("total_alerts").cast("string"), F.lit(" alerts"),
        F.when(F.col("critical_count") > 0, F.concat(F.lit(" including "), F.col("critical_count").cast("string"), F.lit(" critical")))
        .otherwise(F.lit("")),
    ))
    return counts.select(
        text.alias("summary_text"), "*", top.alias("top_alerts"),
    )

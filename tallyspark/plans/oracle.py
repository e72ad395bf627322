"""SQL counterparts of the registered queries, for DuckDB on the same Parquet tables."""

from __future__ import annotations

from tallyspark.operators.boosting import BINS, GAIN_DIGITS, LEAF_ROWS, VALUE_DIGITS, feature_columns
from tallyspark.operators.fourier import CHANGE_PENALTY, CHANGES, REACH, SIZE, WAVE_PENALTY, WEEK_WAVES, YEAR_WAVES
from tallyspark.plans.queries import FESTIVALS, PEAK_SHARE, SLOW_RATE, SLOW_SALES

ORACLE: dict[str, str] = {}

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

SALES = """sales AS (
  SELECT l_shipdate AS date, CAST(l_extendedprice AS DECIMAL(12,2)) AS sales, CAST(l_quantity AS DECIMAL(12,2)) AS quantity,
         CAST(l_partkey AS VARCHAR) AS product
  FROM lineitem)"""

BRAND_SALES = """sales AS (
  SELECT l_shipdate AS date, CAST(l_extendedprice AS DECIMAL(12,2)) AS sales, CAST(l_quantity AS DECIMAL(12,2)) AS quantity,
         p_brand AS product
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

PROFIT_SALES = """sales AS (
  SELECT l_shipdate AS date, CAST(l_extendedprice AS DECIMAL(12,2)) AS sales, CAST(l_quantity AS DECIMAL(8,2)) AS quantity,
         CAST(l_partkey AS VARCHAR) AS product,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(4,2)))
              - CAST(1.4 AS DECIMAL(2,1)) * CAST(l_quantity AS DECIMAL(8,2)) * CAST(p_retailprice AS DECIMAL(10,2))
              AS DECIMAL(18,5)) AS profit
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

STOCK_SALES = """sales AS (
  SELECT l_shipdate AS date, CAST(l_extendedprice AS DECIMAL(12,2)) AS sales, CAST(l_quantity AS DECIMAL(12,2)) AS quantity,
         CAST(l_partkey AS VARCHAR) AS product,
         CASE WHEN l_returnflag <> 'N' THEN CAST((l_linenumber - 2) * 15 AS DOUBLE) END AS current_stock
  FROM lineitem)"""

STOCK = """stock AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, CAST((p_size - 1) * 10 AS DOUBLE) AS current_stock
  FROM part)"""

DAILY = """daily AS (
  SELECT CAST(date AS DATE) AS date, CAST(sum(sales) AS DOUBLE) AS sales FROM sales GROUP BY 1)"""

BRAND_DAILY = """daily AS (
  SELECT product, CAST(date AS DATE) AS date, CAST(sum(sales) AS DOUBLE) AS sales FROM sales GROUP BY 1, 2)"""

PRODUCT_DAYS = """days AS (
  SELECT product, CAST(date AS DATE) AS date, sum(sales) AS sales, sum(quantity) AS quantity FROM sales GROUP BY 1, 2)"""

AVERAGES = """averages AS (
  SELECT product, count(*) AS active_days, CAST(sum(sales) AS DOUBLE) / count(*) AS avg_daily_sales,
         CAST(sum(quantity) AS DOUBLE) / count(*) AS avg_daily_quantity
  FROM days GROUP BY 1)"""

LATEST = "latest AS (SELECT max(date) AS d FROM sales)"

# The upload as it was meant: dates are taken from the table and not read back from text.
RAW = """raw AS (
  SELECT CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN NULL ELSE date_trunc('day', l_shipdate) END AS moment,
         l_linenumber, CAST(l_suppkey AS VARCHAR) AS item_price, 'P' || l_partkey AS item_code,
         CASE WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN 'n/a' WHEN l_linenumber = 1 AND l_orderkey % 1000 = 1 THEN '12345678901.557'
              ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END AS sale_amount,
         CASE WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN '12d' WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN NULL
              ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS qty,
         CASE WHEN l_linenumber <> 3 THEN CAST(l_suppkey % 50 AS VARCHAR) END AS stock_level
  FROM lineitem)"""

# Lines 1, 2, 3 and 6 write day before month; with the month first only days up to 12 can be read.
PARSED = f"""parsed AS (
  SELECT moment, CASE WHEN l_linenumber NOT IN (1, 2, 3, 6) OR day(moment) <= 12 THEN moment END AS month_first, item_price, item_code,
         CASE WHEN regexp_matches(sale_amount, '{NUMBER}') THEN TRY_CAST(sale_amount AS DECIMAL(38,6)) END AS sale_amount,
         CASE WHEN regexp_matches(qty, '{NUMBER}') THEN TRY_CAST(qty AS DECIMAL(12,2)) END AS qty,
         CASE WHEN regexp_matches(stock_level, '{NUMBER}') THEN TRY_CAST(stock_level AS DOUBLE) END AS stock_level
  FROM raw)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def day_text(col: str = "date") -> str:
    return f"strftime({col}, '%Y-%m-%d')"


# --- ingest ---------------------------------------------------------------------------------------------

ORACLE["distinct_rates"] = with_(RAW) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values, count(DISTINCT {c}) > 2 AND count(DISTINCT {c}) < 0.8 * count(*) AS suits FROM raw"
    for c in ("item_price", "item_code", "sale_amount", "qty", "stock_level")
)

ORACLE["profile_columns"] = with_(RAW, PARSED, """facts AS (
  SELECT count(*) AS n, count(moment) AS date_ok, count(item_code) AS item_ok, count(DISTINCT item_code) AS items,
         count(DISTINCT item_price) AS prices, count(*) FILTER (CAST(item_price AS DOUBLE) > 0) AS price_pos, count(sale_amount) AS sale_ok, count(*) FILTER (sale_amount > 0) AS sale_pos,
         count(qty) AS qty_ok, count(*) FILTER (qty >= 0) AS qty_pos,
         count(stock_level) AS stock_ok, count(*) FILTER (stock_level >= 0) AS stock_pos
  FROM parsed)""", """profile AS (
  SELECT 'order_date' AS column_name, 'date' AS role, 0 AS position, n AS n_rows, date_ok AS n_parsed, CAST(NULL AS BIGINT) AS n_signed,
         CAST(NULL AS BIGINT) AS n_distinct, date_ok AS n_day_first, CAST(NULL AS BIGINT) AS n_numeric, date_ok > 0.7 * n AS passes FROM facts
  UNION ALL SELECT 'item_price', 'sales', 1, n, n, price_pos, NULL, NULL, NULL, price_pos > 0.5 * n FROM facts
  UNION ALL SELECT 'item_price', 'product', 1, n, n, NULL, prices, NULL, n, FALSE FROM facts
  UNION ALL SELECT 'item_code', 'product', 2, n, item_ok, NULL, items, NULL, 0, items > 2 AND items < 0.8 * n FROM facts
  UNION ALL SELECT 'sale_amount', 'sales', 3, n, sale_ok, sale_pos, NULL, NULL, NULL, sale_ok > 0.7 * n AND sale_pos > 0.5 * n FROM facts
  UNION ALL SELECT 'qty', 'quantity', 4, n, qty_ok, qty_pos, NULL, NULL, NULL, qty_ok > 0.7 * n AND qty_pos > 0.5 * n FROM facts
  UNION ALL SELECT 'stock_level', 'current_stock', 5, n, stock_ok, stock_pos, NULL, NULL, NULL, stock_ok > 0.7 * n AND stock_pos > 0.5 * n
  FROM facts)""") + """
SELECT *, passes AND position = min(CASE WHEN passes THEN position END) OVER (PARTITION BY role) AS selected FROM profile"""

ORACLE["clean_sales"] = with_(RAW, PARSED) + f"""
SELECT {day_text('moment')} AS date, CAST(coalesce(sale_amount, 0) AS DOUBLE) AS sales, CAST(coalesce(qty, 0) AS DOUBLE) AS quantity,
       coalesce(item_code, 'Unknown') AS product, stock_level AS current_stock
FROM parsed WHERE moment IS NOT NULL"""

ORACLE["validated_sales"] = with_(RAW, PARSED) + f"""
SELECT {day_text('moment')} AS date, CAST(coalesce(sale_amount, 0) AS DOUBLE) AS sales, CAST(coalesce(sale_amount, 0) AS DOUBLE) AS quantity,
       'All Products' AS product, CAST(NULL AS DOUBLE) AS current_stock
FROM parsed WHERE moment IS NOT NULL"""

ORACLE["ingest_issues"] = with_(RAW, PARSED, """facts AS (
  SELECT count(*) AS n, count(*) FILTER (moment IS NULL) AS bad_dates,
         count(*) FILTER (moment IS NOT NULL AND sale_amount IS NULL) AS bad_sales,
         count(*) FILTER (moment IS NOT NULL AND qty IS NULL) AS bad_qty,
         count(*) FILTER (moment IS NOT NULL AND sale_amount >= 10000000000) AS large,
         count(month_first) AS month_first, count(moment) AS day_first
  FROM parsed)""") + """
SELECT 'error' AS severity, 'order_date' AS column_name, 'No value could be read as a date' AS message, bad_dates AS n_failed
FROM facts WHERE bad_dates = n
UNION ALL SELECT 'warning', 'order_date', 'Rows without a readable date are dropped', bad_dates FROM facts WHERE bad_dates BETWEEN 1 AND n - 1
UNION ALL SELECT 'warning', 'sale_amount', 'Unreadable sales values are treated as 0', bad_sales FROM facts WHERE bad_sales > 0
UNION ALL SELECT 'warning', 'qty', 'Unreadable quantity values are treated as 0', bad_qty FROM facts WHERE bad_qty > 0
UNION ALL SELECT 'warning', 'sale_amount', 'Values too large for the number type are treated as 0', large FROM facts WHERE large > 0
UNION ALL SELECT 'info', 'order_date', 'Dates that read with the month first', month_first FROM facts WHERE month_first <> day_first
UNION ALL SELECT 'info', 'order_date', 'Dates that read with the day first', day_first FROM facts WHERE month_first <> day_first"""

ORACLE["calendar_features"] = """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, value, dayname(ts) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour,
       CAST(month(ts) AS INTEGER) AS month, CAST(weekofyear(ts) AS INTEGER) AS week_of_year, CAST(year(ts) AS INTEGER) AS year
FROM events"""

ORACLE["export_projection"] = f"""
SELECT o_orderkey, {day_text('o_orderdate')} AS o_orderdate, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100"""

ORACLE["audit_log"] = with_(RAW, PARSED) + """
SELECT 'lineitem.parquet' AS filename, '2024-01-01' AS timestamp, count(*) AS rows_processed,
       'order_date,item_price,item_code,sale_amount,qty,stock_level' AS original_columns, 'sale_amount' AS mapped_sales
FROM parsed WHERE moment IS NOT NULL"""

# --- aggregates -----------------------------------------------------------------------------------------

ORACLE["kpi_totals"] = with_(PROFIT_SALES) + """
SELECT CAST(sum(sales) AS DOUBLE) AS total_sales, CAST(sum(profit) AS DOUBLE) AS total_profit, count(*) AS transactions FROM sales"""

ORACLE["daily_sales"] = with_(SALES, DAILY) + f"SELECT {day_text()} AS date, sales FROM daily"

FILLED = """spans AS (SELECT product, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM daily GROUP BY product),
filled AS (
  SELECT s.product, CAST(s.d AS DATE) AS date, coalesce(x.sales, 0) AS sales
  FROM spans s LEFT JOIN daily x ON x.product = s.product AND x.date = CAST(s.d AS DATE))"""

TOTAL_FILLED = """spans AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM daily),
filled AS (
  SELECT CAST(s.d AS DATE) AS date, coalesce(x.sales, 0) AS sales FROM spans s LEFT JOIN daily x ON x.date = CAST(s.d AS DATE))"""

ORACLE["daily_sales_filled"] = with_(BRAND_SALES, BRAND_DAILY, FILLED) + f"SELECT product, {day_text()} AS date, sales FROM filled"

ORACLE["product_daily_series"] = with_(SALES, BRAND_DAILY) + f"SELECT product, {day_text()} AS date, sales FROM daily"

ORACLE["avg_daily_by_product"] = with_(SALES, PRODUCT_DAYS, AVERAGES) + "SELECT * FROM averages"

TOTALS = """totals AS (
  SELECT product, CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(quantity) AS DOUBLE) AS quantity FROM sales GROUP BY 1)"""
PROFIT_TOTALS = """totals AS (
  SELECT product, CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(quantity) AS DOUBLE) AS quantity,
         CAST(sum(profit) AS DOUBLE) AS profit
  FROM sales GROUP BY 1)"""
GRAND = """grand AS (
  SELECT CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(quantity) AS DOUBLE) AS quantity, count(DISTINCT product) AS n FROM sales)"""
PROFIT_GRAND = """grand AS (
  SELECT CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(quantity) AS DOUBLE) AS quantity, CAST(sum(profit) AS DOUBLE) AS profit,
         count(DISTINCT product) AS n
  FROM sales)"""

TOP = """top AS (
  SELECT CAST(row_number() OVER (ORDER BY t.sales DESC, product) AS INTEGER) AS rank, product, t.sales, t.sales / g.sales * 100 AS share_pct
  FROM totals t, grand g QUALIFY rank <= 3)"""
BOTTOM = """worst AS (
  SELECT CAST(row_number() OVER (ORDER BY t.sales, product DESC) AS INTEGER) AS rank, product, t.sales, t.sales / g.sales * 100 AS share_pct,
         g.n, g.sales AS everything
  FROM totals t, grand g QUALIFY rank <= 3),
bottom AS (
  SELECT rank, product, sales, share_pct FROM worst WHERE n > 3 AND (SELECT sum(sales) FROM worst) < everything * 0.05)"""
LOW_PROFIT = """thin AS (
  SELECT * FROM (
    SELECT CAST(row_number() OVER (ORDER BY t.profit, product) AS INTEGER) AS rank, product, t.profit,
           abs(t.profit) / g.profit * 100 AS impact, g.profit / g.n AS mean
    FROM totals t, grand g QUALIFY rank <= 3)
  WHERE profit < mean * 0.1)"""
MOVERS = """ranked AS (
  SELECT product, t.quantity, g.quantity AS everything, g.n,
         row_number() OVER (ORDER BY t.quantity DESC, product) AS fast, row_number() OVER (ORDER BY t.quantity, product DESC) AS slow
  FROM totals t, grand g),
movers AS (
  SELECT 'fast' AS kind, string_agg(product, ', ' ORDER BY fast) AS products, sum(quantity) AS group_quantity,
         sum(quantity) / any_value(everything) * 100 AS impact
  FROM ranked WHERE fast <= 3
  UNION ALL
  SELECT 'slow', string_agg(product, ', ' ORDER BY slow DESC), sum(quantity), 100 - sum(quantity) / any_value(everything) * 100
  FROM ranked WHERE slow <= 3 AND n > 3)"""

ORACLE["product_top"] = with_(SALES, TOTALS, GRAND, TOP) + "SELECT * FROM top"
ORACLE["product_bottom"] = with_(SALES, TOTALS, GRAND, BOTTOM) + "SELECT * FROM bottom"
ORACLE["low_profit_items"] = with_(PROFIT_SALES, PROFIT_TOTALS, PROFIT_GRAND, LOW_PROFIT) + "SELECT rank, product, profit, impact FROM thin"
ORACLE["inventory_movers"] = with_(SALES, TOTALS, GRAND, MOVERS) + "SELECT * FROM movers"

WEEKEND = """sides AS (
  SELECT CAST(sum(sales) FILTER (isodow(date) >= 6) AS DOUBLE) AS weekend_sales,
         CAST(sum(sales) FILTER (isodow(date) < 6) AS DOUBLE) AS weekday_sales
  FROM sales),
weekend AS (
  SELECT weekend_sales, weekday_sales, weekend_sales / weekday_sales AS ratio,
         CASE WHEN weekday_sales > 0 AND weekend_sales > weekday_sales * 1.2 THEN 'surge'
              WHEN weekend_sales < weekday_sales * 0.8 THEN 'lag' ELSE 'none' END AS effect,
         (weekend_sales - weekday_sales) / weekday_sales * 100 AS change
  FROM sides WHERE weekend_sales IS NOT NULL AND weekday_sales IS NOT NULL)"""
ORACLE["weekend_effect"] = with_(SALES, WEEKEND) + """
SELECT weekend_sales, weekday_sales, ratio, effect, CASE WHEN effect = 'lag' THEN abs(change) ELSE change END AS impact FROM weekend"""

ORACLE["peak_hour"] = f"""
WITH hours AS (
  SELECT CAST(hour(ts) AS INTEGER) AS hour, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS sales
  FROM events WHERE event_type = 'purchase' GROUP BY 1),
everything AS (SELECT CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS t FROM events WHERE event_type = 'purchase')
SELECT hour AS peak_hour, sales AS peak_sales, sales / t * 100 AS share_pct, sales / t * 100 > {PEAK_SHARE} AS significant
FROM hours, everything ORDER BY sales DESC, hour LIMIT 1"""

WEEKLY = """week_sums AS (
  SELECT count(DISTINCT CAST(date AS DATE)) AS days,
         CAST(sum(sales) FILTER (date > d - INTERVAL 7 DAY) AS DOUBLE) AS recent_sales,
         CAST(sum(sales) FILTER (date <= d - INTERVAL 7 DAY AND date > d - INTERVAL 14 DAY) AS DOUBLE) AS previous_sales
  FROM sales, latest),
week_over AS (
  SELECT recent_sales, previous_sales,
         CASE WHEN previous_sales > 0 THEN (recent_sales - previous_sales) / previous_sales * 100 END AS change_pct,
         previous_sales <= 0 AND recent_sales > 0 AS initiated
  FROM week_sums WHERE days >= 14 AND recent_sales IS NOT NULL AND previous_sales IS NOT NULL)"""
MONTHLY = """month_sums AS (
  SELECT count(DISTINCT CAST(date AS DATE)) AS days,
         coalesce(CAST(sum(sales) FILTER (date_trunc('month', date) = date_trunc('month', d)) AS DOUBLE), 0) AS current_sales,
         coalesce(CAST(sum(sales) FILTER (date_trunc('month', date) = date_trunc('month', d) - INTERVAL 1 MONTH) AS DOUBLE), 0) AS previous_sales
  FROM sales, latest),
month_over AS (
  SELECT current_sales, previous_sales,
         CASE WHEN previous_sales > 0 THEN (current_sales - previous_sales) / previous_sales * 100 END AS change_pct
  FROM month_sums WHERE days >= 14)"""
ORACLE["week_over_week"] = with_(SALES, LATEST, WEEKLY) + """
SELECT *, coalesce(abs(change_pct) > 10, false) OR initiated AS significant FROM week_over"""
ORACLE["month_over_month"] = with_(SALES, LATEST, MONTHLY) + """
SELECT *, coalesce(abs(change_pct) > 15, false) AS significant FROM month_over"""

ORACLE["iso_week_trend"] = with_(SALES, """weeks AS (
  SELECT CAST(weekofyear(date) AS INTEGER) AS week, CAST(sum(sales) AS DOUBLE) AS sales FROM sales GROUP BY 1)""") + """
SELECT a.week AS latest_week, a.sales AS sales_latest, coalesce(b.sales, 0) AS sales_previous, a.sales - coalesce(b.sales, 0) AS delta,
       CASE WHEN coalesce(b.sales, 0) = 0 THEN 0 ELSE (a.sales - b.sales) / b.sales * 100 END AS change_pct
FROM weeks a LEFT JOIN weeks b ON b.week = a.week - 1 WHERE a.week = (SELECT max(week) FROM weeks)"""

ORACLE["top_product"] = with_(BRAND_SALES, TOTALS) + "SELECT product, sales FROM totals ORDER BY sales DESC, product LIMIT 1"
ORACLE["low_sales_alert"] = with_(BRAND_SALES, TOTALS, GRAND) + """
SELECT * FROM (SELECT product, t.sales, g.sales AS total_sales FROM totals t, grand g ORDER BY t.sales, product LIMIT 1)
WHERE sales < 0.05 * total_sales"""

# --- anomalies ------------------------------------------------------------------------------------------

BAND = """band AS (
  SELECT date, sales, avg(sales) OVER w AS m, stddev_samp(sales) OVER w AS s, count(*) OVER w AS n
  FROM filled WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
outside AS (
  SELECT date, sales, m, s, CASE WHEN sales > m THEN 'high' ELSE 'low' END AS direction, abs(sales - m) AS impact
  FROM band WHERE n = 7 AND (sales > m + 2 * s OR sales < m - 2 * s))"""
ORACLE["rolling_band_anomalies"] = with_(SALES, DAILY, TOTAL_FILLED, BAND) + f"""
SELECT {day_text()} AS date, sales, round(m, 4) AS rolling_mean, round(s, 4) AS rolling_std, direction, round(impact, 4) AS impact
FROM outside"""

ZSCORE = """framed AS (
  SELECT date, sales, avg(sales) OVER w AS m, nullif(stddev_samp(sales) OVER w, 0) AS s, count(*) OVER () AS n
  FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
scored AS (SELECT date, sales, m, s, coalesce((sales - m) / s, 0) AS z FROM framed WHERE n >= 2)"""
ORACLE["zscore_alerts_page"] = with_(SALES, DAILY, ZSCORE) + f"""
SELECT {day_text()} AS date, sales, round(m, 4) AS mean_sales, round(s, 4) AS std_dev_sales, round(z, 4) AS z_score,
       z > 2 AS is_anomaly_high, z < -2 AS is_anomaly_low
FROM scored"""


def record(source: str, method: str, key: str = "") -> str:
    return f"""
SELECT {key}{day_text()} AS date, sales, round(e, 4) AS expected_sales, round(sales - e, 4) AS deviation,
       round((sales - e) / nullif(e, 0) * 100, 4) AS deviation_pct,
       CASE WHEN sales > e THEN 'High Sales' ELSE 'Low Sales' END AS anomaly_type,
       CASE WHEN e = 0 OR abs((sales - e) / e * 100) > 100 THEN 'Critical' WHEN abs((sales - e) / e * 100) > 50 THEN 'High'
            WHEN abs((sales - e) / e * 100) > 25 THEN 'Medium' ELSE 'Low' END AS severity,
       '{method}' AS method
FROM {source}"""


GLOBAL = "stats AS (SELECT count(*) AS n, avg(sales) AS m, stddev_samp(sales) AS s, stddev_pop(sales) AS sp, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.5) AS q2, quantile_cont(sales, 0.75) AS q3 FROM daily)"
IQR_RULE = "(sales < q1 - 1.5 * (q3 - q1) OR sales > q3 + 1.5 * (q3 - q1))"

ORACLE["anomalies_zscore"] = with_(SALES, DAILY, GLOBAL, "hits AS (SELECT date, sales, m AS e FROM daily, stats WHERE n >= 7 AND abs((sales - m) / s) > 2.5)") + record("hits", "zscore")
ORACLE["anomalies_iqr"] = with_(SALES, DAILY, GLOBAL, f"hits AS (SELECT date, sales, q2 AS e FROM daily, stats WHERE n >= 7 AND {IQR_RULE})") + record("hits", "iqr")
ORACLE["anomalies_mad"] = with_(SALES, DAILY, GLOBAL, "spread AS (SELECT quantile_cont(abs(sales - q2), 0.5) AS mad FROM daily, stats)", """hits AS (
  SELECT date, sales, q2 AS e FROM daily, stats, spread
  WHERE n >= 7 AND CASE WHEN mad = 0 THEN sales <> q2 ELSE abs(0.6745 * (sales - q2) / mad) > 2.5 END)""") + record("hits", "mad")
ORACLE["anomalies_by_product"] = with_(BRAND_SALES, BRAND_DAILY, """stats AS (
  SELECT product, count(*) AS n, avg(sales) AS m, stddev_samp(sales) AS s FROM daily GROUP BY 1)""", """hits AS (
  SELECT product, date, sales, m AS e FROM daily JOIN stats USING (product) WHERE n >= 7 AND abs((sales - m) / nullif(s, 0)) > 2)""") + record("hits", "zscore", "product, ")

ORACLE["seasonal_adjusted_anomalies"] = with_(SALES, DAILY, """centred AS (
  SELECT date, sales, avg(sales) OVER w AS m, count(*) OVER w AS n
  FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))""") + f"""
SELECT {day_text()} AS date, sales, round(m, 4) AS moving_avg, round(sales - m, 4) AS deviation,
       round(abs((sales - m) / m * 100), 4) AS deviation_pct
FROM centred WHERE n = 7 AND abs((sales - m) / m * 100) > 50"""

CLASSES = """CASE WHEN sales > q2 THEN 'High Sales Spike' ELSE 'Low Sales Drop' END AS anomaly_type,
       CASE WHEN abs(sales - q2) > 2 * s THEN 'Critical' ELSE 'Moderate' END AS severity"""
ORACLE["detector_iqr"] = with_(SALES, DAILY, GLOBAL) + f"SELECT {day_text()} AS date, sales, {CLASSES} FROM daily, stats WHERE {IQR_RULE}"
ORACLE["detector_zscore"] = with_(SALES, DAILY, GLOBAL) + f"SELECT {day_text()} AS date, sales, {CLASSES} FROM daily, stats WHERE abs((sales - m) / sp) > 2.5"
ORACLE["detector_rolling"] = with_(SALES, DAILY, GLOBAL, """numbered AS (
  SELECT date, sales, row_number() OVER (ORDER BY date) AS r FROM daily)""", """framed AS (
  SELECT a.date, any_value(a.sales) AS sales, avg(b.sales) AS fm, stddev_samp(b.sales) AS fs, count(*) AS k, any_value(least(30, n // 4)) AS w
  FROM numbered a, stats, numbered b WHERE b.r BETWEEN a.r - least(30, n // 4) + 1 AND a.r GROUP BY 1)""") + f"""
SELECT {day_text()} AS date, framed.sales, {CLASSES} FROM framed, stats WHERE k = w AND abs((framed.sales - fm) / fs) > 2"""
ORACLE["anomaly_digest"] = with_(SALES, DAILY, GLOBAL, f"found AS (SELECT date, sales > q2 AS spike FROM daily, stats WHERE {IQR_RULE})") + """
SELECT count(*) FILTER (spike) AS spikes, count(*) FILTER (NOT spike) AS drops,
       count(*) FILTER (date >= (SELECT max(date) FROM found) - 7) AS recent
FROM found"""
ORACLE["anomaly_context"] = with_(SALES, DAILY, GLOBAL, f"found AS (SELECT date AS a FROM daily, stats WHERE n >= 7 AND {IQR_RULE})") + f"""
SELECT {day_text('a')} AS anomaly_date, {day_text()} AS date, sales, date = a AS is_anomaly
FROM found JOIN daily ON date BETWEEN a - 14 AND a + 7"""

CALENDAR = "calendar AS (SELECT CAST(d AS DATE) AS f, name FROM (VALUES " + ", ".join(f"('{d}', '{n}')" for d, n in FESTIVALS) + ") v(d, name))"
ORACLE["festival_windows"] = with_(SALES, DAILY, CALENDAR) + f"""
SELECT name AS festival, {day_text('f')} AS festival_date, {day_text()} AS date, sales, CAST(date - f AS INTEGER) AS offset_days
FROM calendar JOIN daily ON date BETWEEN f - 3 AND f + 3"""
ORACLE["upcoming_festivals"] = with_(CALENDAR, "latest AS (SELECT CAST(max(o_orderdate) AS DATE) AS d FROM orders)") + f"""
SELECT {day_text('f')} AS date, name, CAST(f - d AS INTEGER) AS days_away FROM calendar, latest WHERE f >= d ORDER BY f, name LIMIT 5"""

# --- features -------------------------------------------------------------------------------------------

TIME = """CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
       CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(day(date) >= 25 AS INTEGER) AS is_month_end"""
LAG = ", ".join(f"lag(sales, {k}) OVER (PARTITION BY product ORDER BY date) AS sales_lag_{k}" for k in (1, 7, 14, 30))
ROLL = ", ".join(
    f"CASE WHEN count(*) OVER w{n} = {n} THEN round(avg(sales) OVER w{n}, 4) END AS sales_rolling_mean_{n}, "
    f"CASE WHEN count(*) OVER w{n} = {n} THEN round(stddev_samp(sales) OVER w{n}, 4) END AS sales_rolling_std_{n}"
    for n in (7, 14, 30)
)
FRAMES = "WINDOW " + ", ".join(
    f"w{n} AS (PARTITION BY product ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (7, 14, 30)
)
ORACLE["time_features"] = with_(SALES, DAILY) + f"SELECT {day_text()} AS date, sales, {TIME} FROM daily"
ORACLE["lag_features"] = with_(BRAND_SALES, BRAND_DAILY) + f"SELECT product, {day_text()} AS date, sales, {LAG} FROM daily"
ORACLE["rolling_features"] = with_(BRAND_SALES, BRAND_DAILY) + f"SELECT product, {day_text()} AS date, sales, {ROLL} FROM daily {FRAMES}"
ORACLE["ml_features"] = with_(BRAND_SALES, BRAND_DAILY) + f"SELECT product, {day_text()} AS date, sales, {TIME}, {LAG}, {ROLL} FROM daily {FRAMES}"

RECENT = """newest AS (SELECT product, sales, row_number() OVER (PARTITION BY product ORDER BY date DESC) AS r FROM daily),
recent AS (SELECT product, avg(sales) AS a FROM newest WHERE r <= 30 GROUP BY 1)"""
ORACLE["recent_avg_sales"] = with_(BRAND_SALES, BRAND_DAILY, RECENT) + "SELECT product, round(a, 4) AS recent_avg FROM recent"

# --- inventory ------------------------------------------------------------------------------------------

SNAPSHOT = """snapshot AS (
  SELECT product, current_stock FROM (
    SELECT product, current_stock, row_number() OVER (PARTITION BY product ORDER BY date DESC, current_stock DESC) AS r
    FROM sales WHERE current_stock IS NOT NULL) WHERE r = 1)"""
ORACLE["stock_snapshot"] = with_(STOCK_SALES, SNAPSHOT) + "SELECT * FROM snapshot"

STATUS = """judged AS (
  SELECT s.product_id AS product, current_stock, coalesce(avg_daily_quantity, 0) AS demand,
         CASE WHEN current_stock <= 0 AND coalesce(avg_daily_quantity, 0) > 0 THEN 0
              WHEN avg_daily_quantity > 0 THEN current_stock / avg_daily_quantity END AS days
  FROM stock s LEFT JOIN averages a ON a.product = s.product_id),
status AS (
  SELECT product, current_stock, demand AS avg_daily_sales, round_even(days * 10, 0) / 10 AS stockout_risk_days,
         coalesce(days <= 5 AND days >= 0, false) AS is_critical,
         CASE WHEN current_stock > 0 AND demand = 0 THEN 'No Sales' WHEN current_stock <= 0 THEN 'Out of Stock'
              WHEN days <= 5 THEN 'Critical Low Stock' ELSE 'Good Stock' END AS status_label
  FROM judged)"""
ORACLE["inventory_status_labels"] = with_(SALES, PRODUCT_DAYS, AVERAGES, STOCK, STATUS) + "SELECT * FROM status"

RISK = """risk AS (
  SELECT s.product_id, product_name, current_stock, avg_daily_quantity AS avg_daily_sales,
         round_even(current_stock / nullif(avg_daily_quantity, 0) * 100, 0) / 100 AS days_until_stockout,
         CASE WHEN avg_daily_quantity = 0 THEN 'Low' WHEN current_stock / avg_daily_quantity <= 0 THEN 'Critical'
              WHEN current_stock / avg_daily_quantity <= 7 THEN 'High' WHEN current_stock / avg_daily_quantity <= 14 THEN 'Medium'
              ELSE 'Low' END AS stockout_risk
  FROM stock s JOIN averages a ON a.product = s.product_id),
inventory AS (SELECT *, stockout_risk IN ('High', 'Critical') AS alert_required FROM risk)"""
RISK_PARTS = (SALES, PRODUCT_DAYS, AVERAGES, STOCK, RISK)
ORACLE["inventory_risk_levels"] = with_(*RISK_PARTS) + "SELECT * FROM inventory"

STOCKOUT = """stockout AS (
  SELECT product_id, product_name, CAST(current_stock AS BIGINT) AS current_stock, avg_daily_sales,
         coalesce(days_until_stockout, 0) AS days_until_stockout, 'Stockout Risk' AS alert_type, stockout_risk AS risk_level,
         CASE stockout_risk WHEN 'High' THEN 'Warning' ELSE 'Critical' END AS severity
  FROM inventory WHERE alert_required)"""
LOW_STOCK = """low_stock AS (
  SELECT product_id, product_name, CAST(current_stock AS BIGINT) AS current_stock, 'Low Stock' AS alert_type,
         CAST(30 AS DOUBLE) AS threshold, 'Warning' AS severity
  FROM stock WHERE current_stock <= 30)"""
ORACLE["stockout_alerts"] = with_(*RISK_PARTS, STOCKOUT) + "SELECT * FROM stockout"
ORACLE["low_stock_alerts"] = with_(STOCK, LOW_STOCK) + "SELECT * FROM low_stock"
ORACLE["combined_inventory_alerts"] = with_(*RISK_PARTS, STOCKOUT, LOW_STOCK) + """
SELECT * FROM low_stock UNION ALL BY NAME SELECT * FROM stockout"""

STOCKOUT_TEXT = """'**' || product || '**: Critical stock! Estimated **' || format('{:.0f}', stockout_risk_days)
  || ' days** of stock remaining. Current: ' || format('{:.0f}', current_stock) || ', Avg Daily Sales: '
  || format('{:.1f}', avg_daily_sales) || '.' AS message, 'Product ''' || product || ''' is at critical low stock.' AS summary"""
LOW_TEXT = """'**' || product || '**: Low stock! Only **' || format('{:.0f}', current_stock) || ' units** remaining.' AS message,
  'Product ''' || product || ''' has dropped to low inventory levels.' AS summary"""
ORACLE["stockout_alerts_page"] = with_(SALES, PRODUCT_DAYS, AVERAGES, STOCK, STATUS, LATEST) + f"""
SELECT {day_text('d')} AS alert_date, 'Stockout Risk' AS type, 'Critical' AS severity, 'New' AS status, product, {STOCKOUT_TEXT}
FROM status, latest WHERE is_critical"""
ORACLE["low_stock_alerts_page"] = with_(STOCK_SALES, SNAPSHOT, LATEST) + f"""
SELECT {day_text('d')} AS alert_date, 'Low Stock' AS type, 'High' AS severity, 'New' AS status, product, {LOW_TEXT}
FROM snapshot, latest WHERE current_stock <= 10"""

ORACLE["slow_movers_page"] = with_(SALES, PRODUCT_DAYS, AVERAGES) + f"SELECT product, avg_daily_sales FROM averages WHERE avg_daily_sales < {SLOW_SALES}"

SLOW = """rates AS (
  SELECT product AS product_id, CAST(sum(sales) AS DOUBLE) AS total_sales, CAST(sum(quantity) AS DOUBLE) AS q, count(*) AS days_active,
         CAST(any_value(d) AS DATE) - CAST(max(date) AS DATE) AS since, CAST(any_value(d) AS DATE) - CAST(min(date) AS DATE) + 1 AS span
  FROM sales, latest WHERE date >= d - INTERVAL 30 DAY GROUP BY 1),
rated AS (
  SELECT product_id, total_sales, CAST(q AS BIGINT) AS total_quantity, days_active, total_sales / span AS avg_daily_sales,
         q / span AS avg_daily_quantity, CAST(since AS INTEGER) AS days_since_last_sale
  FROM rates)"""


def slow(method: str, score: str, keep: str, limit: float) -> str:
    return f"""slow AS (
  SELECT *, 'Slow Moving' AS alert_type,
         CASE WHEN {score} < 0.1 THEN 'Critical' WHEN {score} < 0.3 THEN 'High' WHEN {score} < 0.6 THEN 'Medium' ELSE 'Low' END AS severity,
         CAST({limit} AS DOUBLE) AS threshold_used, '{method}' AS method
  FROM rated WHERE {keep})"""


SLOW_BY_RATE = slow("sales_rate", f"avg_daily_sales / {SLOW_RATE}", f"avg_daily_sales < {SLOW_RATE}", SLOW_RATE)
ORACLE["slow_movers_sales_rate"] = with_(SALES, LATEST, SLOW, SLOW_BY_RATE) + "SELECT * FROM slow"
ORACLE["slow_movers_quantity_rate"] = with_(SALES, LATEST, SLOW, slow("quantity_rate", "avg_daily_quantity / 10.0", "avg_daily_quantity < 10", 10.0)) + "SELECT * FROM slow"
ORACLE["slow_movers_days_since_sale"] = with_(SALES, LATEST, SLOW, slow("days_since_sale", "10.0 / days_since_last_sale", "days_since_last_sale > 10", 10.0)) + "SELECT * FROM slow"

ZERO = """zero AS (
  SELECT product AS product_id, 'Zero Velocity' AS alert_type, 'Critical' AS severity, 30 AS days_without_sale, 30 AS threshold_used
  FROM (SELECT DISTINCT product FROM sales
        EXCEPT SELECT DISTINCT product FROM sales, latest WHERE date >= d - INTERVAL 30 DAY))"""
STAGNANT = """stagnant AS (
  SELECT product AS product_id, CAST(sum(quantity) AS BIGINT) AS total_quantity_sold, 'Stagnant Inventory' AS alert_type,
         'High' AS severity, 60 AS days_analyzed, CAST(5 AS DOUBLE) AS max_quantity_threshold
  FROM sales, latest WHERE date >= d - INTERVAL 60 DAY GROUP BY product HAVING sum(quantity) <= 5)"""
ORACLE["zero_velocity_products"] = with_(SALES, LATEST, ZERO) + "SELECT * FROM zero"
ORACLE["stagnant_inventory"] = with_(SALES, LATEST, STAGNANT) + "SELECT * FROM stagnant"

Z95 = "1.6448536269514715"
DEMAND = f"""demand AS (
  SELECT product, CAST(sum(quantity) AS DOUBLE) / count(*) AS avg_daily, stddev_samp(CAST(quantity AS DOUBLE)) AS std_daily
  FROM days GROUP BY 1),
planned AS (
  SELECT *, CASE WHEN std_daily > 0 THEN {Z95} * std_daily * sqrt(5) ELSE 0 END AS safety FROM demand)"""
ORACLE["safety_stock"] = with_(SALES, PRODUCT_DAYS, DEMAND) + "SELECT product, avg_daily, round(std_daily, 4) AS std_daily, round(safety, 4) AS safety_stock FROM planned"
ORACLE["reorder_point"] = with_(SALES, PRODUCT_DAYS, DEMAND) + "SELECT product, round(avg_daily * 5 + safety, 4) AS reorder_point FROM planned"
ORACLE["order_quantity"] = with_(SALES, PRODUCT_DAYS, DEMAND) + "SELECT product, round(avg_daily * 30 + safety, 4) AS order_quantity FROM planned"
ORACLE["reorder_panel"] = with_(BRAND_SALES, BRAND_DAILY, RECENT) + """
SELECT product, round(a, 4) AS daily_sales, round(a * 1.5, 4) AS safety_stock, round(a * 1.5 * 1.2, 4) AS reorder_at,
       round(a * 1.5 * 2, 4) AS order_now, CAST(CASE WHEN a > 0 THEN 1.5 ELSE 0 END AS DOUBLE) AS stock_days, 'Critical (<3 days)' AS status
FROM recent"""

# --- alerts ---------------------------------------------------------------------------------------------

CENTRE = f"""centre_status AS (
  SELECT a.product, current_stock, avg_daily_quantity AS avg_daily_sales, a.avg_daily_sales AS money,
         CASE WHEN current_stock <= 0 AND avg_daily_quantity > 0 THEN 0 WHEN avg_daily_quantity > 0 THEN current_stock / avg_daily_quantity END AS days
  FROM averages a LEFT JOIN snapshot s ON s.product = a.product),
critical AS (SELECT *, round_even(days * 10, 0) / 10 AS stockout_risk_days FROM centre_status WHERE days <= 1 AND days >= 0),
centre AS (
  SELECT CAST(d AS DATE) AS alert_date, 'Stockout Risk' AS type, 'Critical' AS severity, 'New' AS status, product, {STOCKOUT_TEXT}
  FROM critical, latest
  UNION ALL
  SELECT CAST(d AS DATE), 'Low Stock', 'High', 'New', product, {LOW_TEXT} FROM snapshot, latest WHERE current_stock <= 10
  UNION ALL
  SELECT CAST(d AS DATE), 'Slow-Moving Item', 'Low', 'New', product,
         '**' || product || '**: Average daily sales of only **' || format('{{:.1f}}', money) || '**.',
         'Product ''' || product || ''' is selling very slowly.'
  FROM centre_status, latest WHERE money < {SLOW_SALES}
  UNION ALL
  SELECT date, 'High Sales Anomaly', 'Medium', 'New', 'All Products',
         '**' || {day_text()} || '**: Sales of ₹' || format('{{:.0f}}', sales) || ' were significantly higher than expected (Z-score: ' || format('{{:.1f}}', z) || ').',
         'Unusually high sales detected on ' || {day_text()} || '.'
  FROM scored WHERE z > 2
  UNION ALL
  SELECT date, 'Low Sales Anomaly', 'High', 'New', 'All Products',
         '**' || {day_text()} || '**: Sales of ₹' || format('{{:.0f}}', sales) || ' were significantly lower than expected (Z-score: ' || format('{{:.1f}}', z) || ').',
         'Significant drop in sales detected on ' || {day_text()} || '.'
  FROM scored WHERE z < -2)"""
CENTRE_PARTS = (STOCK_SALES, PRODUCT_DAYS, AVERAGES, SNAPSHOT, LATEST, DAILY, ZSCORE, CENTRE)
PAGE = f"SELECT {day_text('alert_date')} AS alert_date, type, severity, status, product, message, summary FROM centre"
ORACLE["alert_centre"] = with_(*CENTRE_PARTS) + PAGE
ORACLE["sorted_alerts_page"] = ORACLE["alert_centre"]
ORACLE["filter_alerts_page"] = with_(*CENTRE_PARTS) + PAGE + """
WHERE quarter(alert_date) = (SELECT quarter(max(alert_date)) FROM centre) AND severity = 'High' AND status = 'New'
  AND regexp_matches(message, 'sales of .* lower', 'i')"""
ORACLE["filter_alerts_page_dates"] = with_(*CENTRE_PARTS) + PAGE + " WHERE centre.alert_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"
ORACLE["alert_groups"] = with_(*CENTRE_PARTS) + """
SELECT type || ' - ' || severity || CASE WHEN product <> 'All Products' THEN ' (Product: ' || product || ')' ELSE '' END AS group_key,
       count(*) AS alerts
FROM centre GROUP BY 1"""
ORACLE["alert_facets"] = with_(*CENTRE_PARTS) + """
SELECT 'type' AS facet, type AS value, count(*) AS alerts FROM centre GROUP BY type
UNION ALL SELECT 'severity', severity, count(*) FROM centre GROUP BY severity
UNION ALL SELECT 'status', status, count(*) FROM centre GROUP BY status"""
ORACLE["product_list"] = "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS product FROM lineitem"

MODULE = """module AS (
  SELECT * FROM low_stock UNION ALL BY NAME SELECT * FROM stockout UNION ALL BY NAME SELECT * FROM slow
  UNION ALL BY NAME SELECT * FROM zero UNION ALL BY NAME SELECT * FROM stagnant)"""
MODULE_PARTS = (*RISK_PARTS, STOCKOUT, LOW_STOCK, LATEST, SLOW, SLOW_BY_RATE, ZERO, STAGNANT, MODULE)
CORE = "product_id, product_name, alert_type, severity"
ORACLE["merged_alerts"] = with_(*MODULE_PARTS) + f"SELECT {CORE}, current_stock, total_sales, days_without_sale FROM module"
ORACLE["filter_alerts_module"] = with_(*MODULE_PARTS) + f"""
SELECT {CORE} FROM module WHERE severity = 'Warning' AND (contains(lower(product_id), 'widget') OR contains(lower(product_name), 'widget'))"""
ORACLE["valid_alerts"] = with_(*MODULE_PARTS) + f"SELECT {CORE} FROM module WHERE alert_type IS NOT NULL AND severity IS NOT NULL"
ORACLE["sorted_alerts_module"] = with_(*MODULE_PARTS) + f"SELECT {CORE} FROM module"
ORACLE["alert_rollup"] = with_(*MODULE_PARTS) + """
SELECT 'total' AS level, CAST(NULL AS VARCHAR) AS alert_type, CAST(NULL AS VARCHAR) AS severity, count(*) AS alerts FROM module
UNION ALL SELECT 'by_type', alert_type, NULL, count(*) FROM module GROUP BY alert_type
UNION ALL SELECT 'by_severity', NULL, severity, count(*) FROM module GROUP BY severity
UNION ALL SELECT 'by_type_severity', alert_type, severity, count(*) FROM module GROUP BY alert_type, severity"""
ORACLE["alert_summary"] = with_(*MODULE_PARTS, """counts AS (
  SELECT count(*) AS total_alerts, count(*) FILTER (severity = 'Critical') AS critical_count,
         count(*) FILTER (severity = 'High') AS high_count, count(*) FILTER (severity = 'Medium') AS medium_count,
         count(*) FILTER (severity = 'Low') AS low_count
  FROM module)""", """best AS (
  SELECT concat_ws('/', alert_type, severity, product_id, product_name, CAST(CAST(current_stock AS INTEGER) AS VARCHAR), CAST(days_without_sale AS VARCHAR)) AS t,
         row_number() OVER (ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END,
                            alert_type, product_id) AS r
  FROM module QUALIFY r <= 5)""") + """
SELECT 'Found ' || total_alerts || ' alerts' || CASE WHEN critical_count > 0 THEN ' including ' || critical_count || ' critical' ELSE '' END AS summary_text,
       counts.*, (SELECT string_agg(t, '; ' ORDER BY r) FROM best) AS top_alerts
FROM counts"""

# --- insights -------------------------------------------------------------------------------------------

SEASON_ROWS = """seasons AS (
  SELECT * FROM (VALUES (1, 'Republic Day Opportunity', 2, 20), (3, 'Holi Festival Preparations', 2, 25), (4, 'Summer Essentials Demand', 2, 30),
    (7, 'Monsoon Preparedness', 2, 15), (8, 'Independence Day & Festivals', 2, 20), (10, 'Diwali & Festive Season Boom', 1, 40),
    (12, 'Year-End Holiday Rush', 2, 35)) v(m, title, priority, impact))"""
INSIGHTS = """found AS (
  SELECT CASE WHEN initiated THEN 'Sales Activity Initiated' WHEN change_pct > 0 THEN 'Sales Surge Detected' ELSE 'Sales Dip Detected' END AS title,
         CASE WHEN initiated THEN 3 WHEN change_pct > 0 THEN 2 ELSE 1 END AS priority,
         CASE WHEN initiated THEN recent_sales ELSE abs(change_pct) END AS impact, 'trend' AS type
  FROM week_over WHERE coalesce(abs(change_pct) > 10, false) OR initiated
  UNION ALL SELECT 'Monthly Sales Shift', 3, abs(change_pct), 'trend' FROM month_over WHERE abs(change_pct) > 15
  UNION ALL SELECT '🚀 Top Performer: ' || product, 3, share_pct, 'product' FROM top
  UNION ALL SELECT '📉 Low Performer: ' || product, 2, 100 - share_pct, 'product' FROM bottom
  UNION ALL SELECT '💸 Low Profit Item: ' || product, 1, impact, 'profit' FROM thin
  UNION ALL SELECT CASE kind WHEN 'fast' THEN '⚡️ High Demand Items' ELSE '🐢 Slow-Moving Stock Alert' END,
                   CASE kind WHEN 'fast' THEN 2 ELSE 1 END, impact, 'inventory' FROM movers
  UNION ALL SELECT CASE effect WHEN 'surge' THEN 'Weekend Sales Surge' ELSE 'Weekend Sales Lag' END, 2,
                   CASE WHEN effect = 'lag' THEN abs(change) ELSE change END, 'timing' FROM weekend WHERE effect <> 'none'
  UNION ALL SELECT 'Peak Sales Hour Identified', 3, max(share), 'timing'
            FROM (SELECT hour(date), CAST(sum(sales) AS DOUBLE) / (SELECT sales FROM grand) * 100 AS share FROM sales GROUP BY 1) HAVING max(share) > 20
  UNION ALL SELECT title, priority, CAST(impact AS DOUBLE), 'seasonal' FROM seasons, latest WHERE m = month(d)
  UNION ALL SELECT '🚨 Unusual Sales Day Detected: ' || strftime(date, '%b %d, %Y'), 1, impact, 'anomaly' FROM outside)"""
INSIGHT_PARTS = (
    PROFIT_SALES, LATEST, DAILY, TOTAL_FILLED, BAND, WEEKLY, MONTHLY, PROFIT_TOTALS, PROFIT_GRAND, TOP, BOTTOM, LOW_PROFIT, MOVERS,
    WEEKEND, SEASON_ROWS, INSIGHTS,
)
SHOWN = "title, priority, round(impact, 4) AS impact, type"
ORACLE["generated_insights"] = with_(*INSIGHT_PARTS) + f"SELECT {SHOWN} FROM found"
ORACLE["ranked_insights"] = with_(*INSIGHT_PARTS) + f"SELECT {SHOWN} FROM (SELECT * FROM found ORDER BY priority, impact DESC, title)"
ORACLE["insight_sections"] = with_(*INSIGHT_PARTS, """placed AS (
  SELECT *, CASE WHEN priority = 1 THEN 'urgent' WHEN type = 'trend' THEN 'trends' WHEN type IN ('product', 'profit', 'inventory') THEN 'product_stock'
                 WHEN type IN ('timing', 'seasonal') THEN 'timing_seasonal' END AS section
  FROM found)""") + f"""
SELECT section, {SHOWN} FROM placed
WHERE section IS NOT NULL
QUALIFY section <> 'trends' OR row_number() OVER (PARTITION BY section ORDER BY priority, placed.impact DESC, title) <= 3"""
ORACLE["insight_answers"] = with_(*INSIGHT_PARTS, """rules AS (
  SELECT * FROM (VALUES ('What are my top-selling products?', 'product', 'Top Performer'), ('What are my lowest-profit items?', 'profit', 'Low Profit'),
    ('When are my peak sales hours?', 'timing', 'Peak Sales Hour'), ('Are there any sales anomalies recently?', 'anomaly', ''),
    ('Which items are moving slowly?', 'inventory', 'Slow-Moving'), ('Are there any current seasonal opportunities?', 'seasonal', '')) v(question, kind, fragment))""") + """
SELECT question, title FROM rules JOIN found ON type = kind AND contains(title, fragment)
QUALIFY row_number() OVER (PARTITION BY question ORDER BY priority, impact DESC, title) = 1"""
ORACLE["seasonal_opportunities"] = with_(SEASON_ROWS) + """
SELECT title, priority, CAST(impact AS DOUBLE) AS impact, 'seasonal' AS type FROM seasons WHERE m = (SELECT month(max(o_orderdate)) FROM orders)"""

# --- forecasts ------------------------------------------------------------------------------------------

FIT = """numbered AS (
  SELECT {key}, date, y, CAST(date - min(date) OVER (PARTITION BY {key}) AS DOUBLE) AS t FROM known),
line AS (
  SELECT {key}, avg(y) AS mean, coalesce(regr_slope(y, t), 0) AS slope, avg(t) FILTER (y IS NOT NULL) AS tbar,
         greatest(0.05 * abs(avg(y)), 1e-8) AS floor
  FROM numbered GROUP BY {key} HAVING count(y) >= 2),
trended AS (
  SELECT n.*, greatest(mean + slope * (t - tbar), floor) AS trend FROM numbered n JOIN line USING ({key})),
weekly AS (
  SELECT {key}, isodow(date) AS wd, sum(y) / sum(trend) AS week FROM trended WHERE y IS NOT NULL GROUP BY ALL),
based AS (
  SELECT t.*, coalesce(week, 1) AS week, trend * greatest(coalesce(week, 1), 0.05) AS base
  FROM trended t LEFT JOIN weekly w ON {match_w} AND w.wd = isodow(t.date)),
monthly AS (
  SELECT {key}, month(date) AS mo, sum(y) / sum(base) AS month FROM based WHERE y IS NOT NULL GROUP BY ALL),
predicted AS (
  SELECT b.*, trend * week * coalesce(m.month, 1) AS yhat
  FROM based b LEFT JOIN monthly m ON {match_m} AND m.mo = month(b.date)),
fitted AS (
  SELECT *, coalesce(stddev_samp(y - yhat) OVER (PARTITION BY {key}), 0) * 1.96 AS spread FROM predicted)"""
ONE_SERIES = {"key": "product", "match_w": "w.product = t.product", "match_m": "m.product = b.product"}
KNOWN = """known AS (
  SELECT product, date, sales AS y FROM daily
  UNION ALL
  SELECT product, CAST(last + CAST(i AS INTEGER) AS DATE), NULL
  FROM (SELECT product, max(date) AS last FROM daily GROUP BY 1), range(1, 31) r(i))"""
TREND_PARTS = (BRAND_SALES, BRAND_DAILY, KNOWN, FIT.format(**ONE_SERIES))
ORACLE["forecast_trend_seasonal"] = with_(*TREND_PARTS) + f"""
SELECT product, {day_text()} AS date, y, round(yhat, 2) AS yhat, round(yhat - spread, 2) AS yhat_lower,
       round(yhat + spread, 2) AS yhat_upper, y IS NULL AS is_future
FROM fitted"""
ORACLE["forecast_direction"] = with_(*TREND_PARTS) + """
SELECT product, arg_max(y, date) FILTER (y IS NOT NULL) AS last_actual, round(arg_min(yhat, date) FILTER (y IS NULL), 2) AS first_forecast,
       CASE WHEN arg_min(yhat, date) FILTER (y IS NULL) > arg_max(y, date) FILTER (y IS NOT NULL) * 1.2 THEN 'UP'
            WHEN arg_min(yhat, date) FILTER (y IS NULL) < arg_max(y, date) FILTER (y IS NOT NULL) * 0.8 THEN 'DOWN' ELSE 'FLAT' END AS direction
FROM fitted GROUP BY product"""
METRICS = "count(*) AS n, round(avg(abs(y - yhat)), 2) AS mae, round(avg(abs((y - yhat) / greatest(y, 1e-8))) * 100, 2) AS mape"
ORACLE["accuracy_metrics"] = with_(*TREND_PARTS) + f"SELECT product, {METRICS} FROM fitted WHERE y IS NOT NULL GROUP BY product"

BACKTEST_KEYS = {
    "key": "product, origin", "match_w": "w.product = t.product AND w.origin = t.origin",
    "match_m": "m.product = b.product AND m.origin = b.origin",
}
ORACLE["backtest_accuracy"] = with_(BRAND_SALES, BRAND_DAILY, """placed AS (
  SELECT product, date, sales, row_number() OVER (PARTITION BY product ORDER BY date) - 1 AS r, count(*) OVER (PARTITION BY product) AS n
  FROM daily)""", """origins AS (
  SELECT product, r AS origin FROM placed WHERE r <= n - 67)""", """train AS (
  SELECT o.product, o.origin, p.date, p.sales FROM origins o JOIN placed p ON p.product = o.product AND p.r BETWEEN o.origin AND o.origin + 59)""", """ends AS (
  SELECT product, origin, max(date) AS last FROM train GROUP BY ALL)""", """known AS (
  SELECT product, origin, date, sales AS y, CAST(NULL AS DOUBLE) AS actual FROM train
  UNION ALL
  SELECT e.product, e.origin, d.date, NULL, d.sales FROM ends e JOIN daily d ON d.product = e.product AND d.date BETWEEN e.last + 1 AND e.last + 7)""",
    FIT.format(**BACKTEST_KEYS), """scored AS (
  SELECT f.product, d.sales AS y, f.yhat FROM fitted f JOIN daily d USING (product, date) WHERE f.y IS NULL)""") + f"""
SELECT product, {METRICS}, 'scored' AS status FROM scored GROUP BY product
UNION ALL SELECT product, 0, NULL, NULL, 'too_short' FROM daily GROUP BY product HAVING count(*) < 67"""
ORACLE["forecast_parts"] = with_(SALES, BRAND_DAILY, KNOWN, FIT.format(**ONE_SERIES).replace("HAVING count(y) >= 2", "HAVING count(y) >= 1")) + f"""
SELECT product, {day_text()} AS date, round(yhat, 2) AS yhat, round(yhat - spread, 2) AS yhat_lower, round(yhat + spread, 2) AS yhat_upper
FROM fitted WHERE y IS NULL"""

AR_LAGS = ", ".join(f"lag(sales, {k}) OVER w AS l{k}" for k in range(1, 9))
MOMENTS = ", ".join(
    f"avg({z}) AS z{d}, avg({a}) AS a{d}, avg({b}) AS b{d}, var_pop({z}) AS szz{d}, var_pop({a}) AS saa{d}, var_pop({b}) AS sbb{d}, "
    f"covar_pop({a}, {b}) AS sab{d}, covar_pop({z}, {a}) AS sza{d}, covar_pop({z}, {b}) AS szb{d}"
    for d, z, a, b in ((0, "sales", "l1", "l7"), (1, "sales - l1", "l1 - l2", "l7 - l8"))
)


def ar_form(d: int, lag7: bool) -> str:
    det = f"(saa{d} * sbb{d} - sab{d} * sab{d})"
    phi1 = f"(sza{d} * sbb{d} - szb{d} * sab{d}) / {det}" if lag7 else f"sza{d} / saa{d}"
    phi7 = f"(szb{d} * saa{d} - sza{d} * sab{d}) / {det}" if lag7 else "CAST(0 AS DOUBLE)"
    usable = f"{det} > 1e-9 * saa{d} * sbb{d} AND m >= 5" if lag7 else f"saa{d} > 0 AND m >= 4"
    terms = 3 if lag7 else 2
    return f"""SELECT product, m * ln(greatest(szz{d} - phi1 * sza{d} - phi7 * szb{d}, 1e-12)) + {2 * terms} AS aic,
         'd{d}_lag1{"_7" if lag7 else ""}' AS form, {d} AS d, z{d} - phi1 * a{d} - phi7 * b{d} AS c, phi1, phi7
  FROM (SELECT *, {phi1} AS phi1, {phi7} AS phi7 FROM moments WHERE {usable})"""


AR_PARTS = (BRAND_SALES, BRAND_DAILY, FILLED, f"lagged AS (SELECT product, date, sales, {AR_LAGS} FROM filled WINDOW w AS (PARTITION BY product ORDER BY date))",
    f"moments AS (SELECT product, CAST(count(*) AS DOUBLE) AS m, {MOMENTS} FROM lagged WHERE l8 IS NOT NULL GROUP BY product)",
    "forms AS (" + " UNION ALL ".join(ar_form(d, lag7) for d in (0, 1) for lag7 in (False, True)) + """
  UNION ALL SELECT product, m * ln(greatest(szz0, 1e-12)) + 2, 'mean', 0, z0, 0, 0 FROM moments WHERE m >= 3)""",
    "chosen AS (SELECT * FROM forms QUALIFY row_number() OVER (PARTITION BY product ORDER BY aic, form) = 1)")
ORACLE["ar_coefficients"] = with_(*AR_PARTS) + """
SELECT product, form, round(aic, 4) AS aic, round(c, 4) AS c, round(phi1, 4) AS phi1, round(phi7, 4) AS phi7 FROM chosen"""
ORACLE["forecast_autoregressive"] = with_(*AR_PARTS, """newest AS (
  SELECT * FROM lagged QUALIFY row_number() OVER (PARTITION BY product ORDER BY date DESC) = 1)""").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ahead AS (
  SELECT product, 0 AS i, date, sales AS level, d, c, phi1, phi7,
         CASE d WHEN 1 THEN [l6 - l7, l5 - l6, l4 - l5, l3 - l4, l2 - l3, l1 - l2, sales - l1] ELSE [l6, l5, l4, l3, l2, l1, sales] END AS w
  FROM newest JOIN chosen USING (product)
  UNION ALL
  SELECT product, i + 1, CAST(date + 1 AS DATE), CASE d WHEN 1 THEN level + z ELSE z END, d, c, phi1, phi7, list_append(w[2:7], z)
  FROM (SELECT *, c + phi1 * w[7] + phi7 * w[1] AS z FROM ahead WHERE i < 30))
SELECT product, {day_text()} AS date, round(level, 2) AS yhat, 'fitted' AS status FROM ahead WHERE i > 0
UNION ALL SELECT product, NULL, NULL, 'too_short' FROM daily GROUP BY product HAVING count(*) < 5"""

ORACLE["forecast_holt_winters"] = with_(BRAND_SALES, BRAND_DAILY, FILLED, """placed AS (
  SELECT product, date, sales AS y, row_number() OVER (PARTITION BY product ORDER BY date) AS r FROM filled)""", """seeds AS (
  SELECT product, max(r) AS n, max(date) AS last, greatest(0.05 * abs(avg(y)), 1e-8) AS floor,
         greatest(avg(y) FILTER (r <= 7), greatest(0.05 * abs(avg(y)), 1e-8)) AS level,
         (avg(y) FILTER (r BETWEEN 8 AND 14) - avg(y) FILTER (r <= 7)) / 7 AS trend
  FROM placed GROUP BY product HAVING max(r) >= 14)""", """seasons AS (
  SELECT s.*, (SELECT list(greatest(p.y / s.level, 0.05) ORDER BY p.r) FROM placed p WHERE p.product = s.product AND p.r <= 7) AS season
  FROM seeds s)""", """points AS (
  SELECT * FROM (VALUES (0.1), (0.3)) a(alpha), (VALUES (0.01), (0.1)) b(beta), (VALUES (0.05), (0.2)) g(gamma))""").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
run AS (
  SELECT product, n, last, floor, CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, CAST(gamma AS DOUBLE) AS gamma,
         7 AS r, CAST(0 AS DOUBLE) AS sse, level, trend, season
  FROM seasons, points
  UNION ALL
  SELECT product, n, last, floor, alpha, beta, gamma, r + 1, sse + (y - (level + trend) * season[1]) * (y - (level + trend) * season[1]),
         l2, beta * (l2 - level) + (1 - beta) * trend,
         list_append(season[2:7], greatest(gamma * (y / l2) + (1 - gamma) * season[1], 0.05))
  FROM (SELECT run.*, p.y, greatest(alpha * (p.y / season[1]) + (1 - alpha) * (level + trend), floor) AS l2
        FROM run JOIN placed p ON p.product = run.product AND p.r = run.r + 1)),
best AS (SELECT * FROM run WHERE r = n QUALIFY row_number() OVER (PARTITION BY product ORDER BY sse, alpha, beta, gamma) = 1)
SELECT product, strftime(CAST(last + CAST(i AS INTEGER) AS DATE), '%Y-%m-%d') AS date,
       round((level + i * trend) * season[(i - 1) % 7 + 1], 2) AS yhat
FROM best, range(1, 31) h(i)"""


# --- seasonal autoregression -----------------------------------------------------------------------------
# Moment matrices by sums of products, solved by elimination: one step of the recursion clears one column.

SARIMA_LAGS = (1, 2, 3, 4, 5, 7)


def eliminated(name: str, keys: str, source: str) -> str:
    """Rows ``keys, x, v`` solving the systems of ``source`` (keys, size, i, j, v; column size + 1 is the right side)."""
    return f"""{name}_steps AS (
  SELECT 0 AS step, * FROM {source}
  UNION ALL
  SELECT step, {keys}, size, i, j, CASE WHEN i = step THEN row_v / lead_v ELSE v - column_v * row_v / lead_v END AS v
  FROM (SELECT step + 1 AS step, {keys}, size, i, j, v,
               max(v) FILTER (i = step + 1 AND j = step + 1) OVER (PARTITION BY {keys}) AS lead_v,
               max(v) FILTER (i = step + 1) OVER (PARTITION BY {keys}, j) AS row_v,
               max(v) FILTER (j = step + 1) OVER (PARTITION BY {keys}, i) AS column_v
        FROM {name}_steps WHERE step < size)),
{name} AS (SELECT {keys}, i AS x, v FROM {name}_steps WHERE step = size AND j = size + 1)"""


def root_test(d: int, z: str, x: str, v: str) -> str:
    return f"""root{d} AS (
  SELECT product, CASE WHEN n > 6 AND det > 1e-9 * xx * vv AND error > 1e-12 * zz THEN rho / sqrt(error * vv / (det * n)) END AS t,
         -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n) AS point
  FROM (SELECT *, (zz - rho * zx - gamma * zv) * n / (n - 3) AS error FROM (
    SELECT *, (zx * vv - zv * xv) / det AS rho, (zv * xx - zx * xv) / det AS gamma FROM (
      SELECT *, xx * vv - xv * xv AS det FROM (
        SELECT product, CAST(count(*) AS DOUBLE) AS n, var_pop({z}) AS zz, var_pop({x}) AS xx, var_pop({v}) AS vv,
               covar_pop({z}, {x}) AS zx, covar_pop({z}, {v}) AS zv, covar_pop({x}, {v}) AS xv
        FROM lagged WHERE l{2 + d} IS NOT NULL GROUP BY product)))))"""


SARIMA_PARTS = (
    BRAND_SALES, BRAND_DAILY, FILLED,
    "lagged AS (SELECT product, date, sales, lag(sales, 1) OVER w AS l1, lag(sales, 2) OVER w AS l2, lag(sales, 3) OVER w AS l3 FROM filled WINDOW w AS (PARTITION BY product ORDER BY date))",
    root_test(0, "sales - l1", "l1", "l1 - l2"), root_test(1, "sales - 2 * l1 + l2", "l1 - l2", "l1 - 2 * l2 + l3"),
    """chosen_d AS (
  SELECT root0.product, root0.t AS adf, root1.t AS adf_changes,
         CASE WHEN coalesce(root0.t > root0.point, false) THEN (CASE WHEN coalesce(root1.t > root1.point, false) THEN 2 ELSE 1 END) ELSE 0 END AS d
  FROM root0 LEFT JOIN root1 USING (product))""",
    """centred AS (
  SELECT product, date, raw - avg(raw) OVER (PARTITION BY product) AS w
  FROM (SELECT product, date, CASE d WHEN 0 THEN sales WHEN 1 THEN sales - l1 ELSE sales - 2 * l1 + l2 END AS raw FROM lagged JOIN chosen_d USING (product)))""",
    "stepped AS (SELECT product, date, [w, " + ", ".join(f"lag(w, {k}) OVER o" for k in range(1, 9)) + "] AS x, lag(w, 8) OVER o IS NOT NULL AS complete FROM centred WINDOW o AS (PARTITION BY product ORDER BY date))",
    """long_gram AS (
  SELECT product, i, j, sum(x[i + 1] * x[j + 1]) AS v FROM stepped, range(0, 9) a(i), range(0, 9) b(j) WHERE complete GROUP BY ALL)""",
    """long_system AS (
  SELECT product, CAST(8 AS BIGINT) AS size, i, j, CASE WHEN i = j THEN v * (1 + 1e-9) + 1e-9 ELSE v END AS v FROM long_gram WHERE i > 0 AND j > 0
  UNION ALL SELECT product, 8, i, 9, v FROM long_gram WHERE i > 0 AND j = 0)""",
    eliminated("long_fit", "product", "long_system"),
    "phi AS (SELECT product, list(v ORDER BY x) AS f FROM long_fit GROUP BY 1)",
    "shocked AS (SELECT s.product, s.date, s.x, CASE WHEN s.complete THEN s.x[1] - list_dot_product(p.f, CAST(s.x[2:9] AS DOUBLE[])) END AS e FROM stepped s JOIN phi p USING (product))",
    "paired AS (SELECT product, [x[1], " + ", ".join(f"x[{k + 1}]" for k in SARIMA_LAGS) + ", " + ", ".join(f"lag(e, {k}) OVER o" for k in SARIMA_LAGS)
    + "] AS x, lag(e, 7) OVER o IS NOT NULL AS complete FROM shocked WINDOW o AS (PARTITION BY product ORDER BY date))",
    "used AS (SELECT product, CAST(count(*) AS DOUBLE) AS n FROM paired WHERE complete GROUP BY 1)",
    """gram AS (
  SELECT product, i, j, sum(x[i + 1] * x[j + 1]) AS v FROM paired, range(0, 13) a(i), range(0, 13) b(j) WHERE complete GROUP BY ALL)""",
    """orders AS (
  SELECT ((p * 6 + q) * 2 + sp) * 2 + sq AS number, p, q, sp, sq,
         list_concat(list_concat(range(1, p + 1), CASE sp WHEN 1 THEN [6] ELSE [] END), list_concat(range(7, 7 + q), CASE sq WHEN 1 THEN [12] ELSE [] END)) AS places
  FROM range(0, 6) a(p), range(0, 6) b(q), range(0, 2) c(sp), range(0, 2) e(sq))""",
    "spread AS (SELECT number, len(places) AS size, unnest(places) AS place, unnest(range(1, len(places) + 1)) AS i FROM orders)",
    """systems AS (
  SELECT g.product, a.number, a.size, a.i, b.i AS j, CASE WHEN a.i = b.i THEN g.v * (1 + 1e-9) + 1e-9 ELSE g.v END AS v
  FROM spread a JOIN spread b USING (number) JOIN gram g ON g.i = a.place AND g.j = b.place
  UNION ALL SELECT g.product, a.number, a.size, a.i, a.size + 1, g.v FROM spread a JOIN gram g ON g.i = a.place AND g.j = 0)""",
    eliminated("fits", "product, number", "systems"),
    "weights AS (SELECT f.product, f.number, s.place, f.v FROM fits f JOIN spread s ON s.number = f.number AND s.i = f.x)",
    """errors AS (
  SELECT w.product, w.number, -2 * sum(w.v * g.v) AS change FROM weights w JOIN gram g ON g.product = w.product AND g.i = w.place AND g.j = 0 GROUP BY ALL)""",
    """squares AS (
  SELECT a.product, a.number, sum(a.v * b.v * g.v) AS change
  FROM weights a JOIN weights b USING (product, number) JOIN gram g ON g.product = a.product AND g.i = a.place AND g.j = b.place GROUP BY ALL)""",
    """judged AS (
  SELECT u.product, o.*, u.n * ln(greatest((z.v + coalesce(e.change, 0) + coalesce(s.change, 0)) / u.n, 1e-12)) + 2 * (len(o.places) + 1) AS aic
  FROM used u CROSS JOIN orders o JOIN gram z ON z.product = u.product AND z.i = 0 AND z.j = 0
  LEFT JOIN errors e ON e.product = u.product AND e.number = o.number LEFT JOIN squares s ON s.product = u.product AND s.number = o.number
  WHERE u.n >= 3 * (len(o.places) + 1))""",
    "best AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY product ORDER BY aic, number) = 1)",
    "days AS (SELECT product, count(*) AS n_days FROM filled GROUP BY 1)", "known_days AS (SELECT product, count(*) AS n_known FROM daily GROUP BY 1)",
)
WEIGHT_NAMES = [f"weight_{side}{k}" for side in "we" for k in SARIMA_LAGS]
ORACLE["sarima_orders"] = with_(*SARIMA_PARTS).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT d.product, n_days, round(adf, 3) AS adf, round(adf_changes, 3) AS adf_changes, d, coalesce(p, 0) AS p, coalesce(q, 0) AS q,
       coalesce(sp, 0) AS seasonal_p, coalesce(sq, 0) AS seasonal_q, round(aic, 3) AS aic, """ + ", ".join(
    f"round(coalesce((SELECT v FROM weights w WHERE w.product = d.product AND w.number = b.number AND w.place = {i}), 0), 3) AS {n}" for i, n in enumerate(WEIGHT_NAMES, 1)
) + """,
       CASE WHEN n_known < 5 THEN 'too_short' WHEN aic IS NULL THEN 'mean' ELSE 'fitted' END AS status
FROM days d JOIN known_days USING (product) JOIN chosen_d USING (product) LEFT JOIN best b ON b.product = d.product"""


# --- piecewise trend with Fourier seasons ----------------------------------------------------------------

WAVES = ", ".join(
    f"line * {f}((date - DATE '1970-01-01') * 2 * pi() * {k} / {period})"
    for period, waves in ((7, WEEK_WAVES), (365.25, YEAR_WAVES)) for k in range(1, waves + 1) for f in ("cos", "sin")
)
RAMPS = ", ".join(f"greatest(u - {REACH * (k + 1) / (CHANGES + 1)!r}, 0)" for k in range(CHANGES))
FOURIER_PARTS = (
    BRAND_SALES, BRAND_DAILY, KNOWN,
    """spans AS (
  SELECT product, min(date) AS first, CAST(greatest(max(date) FILTER (y IS NOT NULL) - min(date), 1) AS DOUBLE) AS span,
         CASE WHEN abs(avg(y)) > 1e-8 THEN abs(avg(y)) ELSE 1 END AS unit
  FROM known GROUP BY 1)""",
    "scaled AS (SELECT k.*, (k.date - s.first) / s.span AS u, k.y / s.unit AS v FROM known k JOIN spans s USING (product))",
    "lines AS (SELECT product, coalesce(regr_slope(v, u), 0) AS slope, avg(u) FILTER (y IS NOT NULL) AS mid, avg(v) AS base FROM scaled GROUP BY 1)",
    "lined AS (SELECT s.*, greatest(base + slope * (u - mid), 0.05) AS line FROM scaled s JOIN lines USING (product))",
    f"featured AS (SELECT product, date, y, u, CAST([1, u, {RAMPS}, {WAVES}] AS DOUBLE[]) AS x, v FROM lined)",
    f"""wide_gram AS (
  SELECT product, i, j, sum(CAST(x[i] AS DOUBLE) * (CASE WHEN j > {SIZE} THEN v ELSE x[j] END)) AS v, count(*) AS n
  FROM featured, range(1, {SIZE + 1}) a(i), range(1, {SIZE + 2}) b(j) WHERE y IS NOT NULL GROUP BY ALL)""",
    f"""wide_system AS (
  SELECT product, CAST({SIZE} AS BIGINT) AS size, i, j,
         v + CASE WHEN i <> j THEN 0 WHEN i <= 2 THEN 1e-9 * n WHEN i <= {2 + CHANGES} THEN {CHANGE_PENALTY} * n ELSE {WAVE_PENALTY} * n END AS v
  FROM wide_gram)""",
    eliminated("ridge", "product", "wide_system"),
    f"ridged AS (SELECT product, list(v ORDER BY x) AS f, avg(abs(v)) FILTER (x BETWEEN 3 AND {2 + CHANGES}) AS change FROM ridge GROUP BY 1)",
    "valued AS (SELECT f.*, list_dot_product(f.x, r.f) AS fit, r.change FROM featured f JOIN ridged r USING (product))",
    "noises AS (SELECT product, sqrt(sum((v - fit) * (v - fit)) / greatest(count(*) - 1, 1)) AS noise FROM valued WHERE y IS NOT NULL GROUP BY 1)",
    f"""banded AS (
  SELECT product, date, y, fit * unit AS yhat, unit * 1.96 * sqrt(noise * noise + {CHANGES / REACH * 2 / 3!r} * change * change * greatest(u - 1, 0) ** 3) AS spread
  FROM valued JOIN noises USING (product) JOIN spans USING (product))""",
)
ORACLE["forecast_fourier"] = with_(*FOURIER_PARTS).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT product, {day_text()} AS date, y, round(yhat, 2) AS yhat, round(yhat - spread, 2) AS yhat_lower, round(yhat + spread, 2) AS yhat_upper, y IS NULL AS is_future
FROM banded"""
ORACLE["trend_changes"] = with_(*FOURIER_PARTS).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT product, strftime(CAST(first + CAST(ceil({REACH} * (x - 2) / {CHANGES + 1} * span) AS INTEGER) AS DATE), '%Y-%m-%d') AS date, round(v * unit / span, 4) AS slope_change
FROM ridge JOIN spans USING (product) WHERE x BETWEEN 3 AND {2 + CHANGES}"""


# --- boosted trees, one model for each series -----------------------------------------------------------

BOOST_NAMES = feature_columns(False)
BOOST_USABLE = f"""features AS (SELECT product, date, sales, {TIME}, {LAG}, {ROLL} FROM daily {FRAMES}),
usable AS (
  SELECT *, count(*) OVER (PARTITION BY product) AS n, row_number() OVER (PARTITION BY product ORDER BY date) AS r
  FROM features WHERE {" AND ".join(f"{c} IS NOT NULL" for c in feature_columns(True))}),
training AS (SELECT * EXCLUDE (n, r), r > floor(n * CAST(0.8 AS DOUBLE)) AS is_validation FROM usable WHERE n >= 50)"""
ORACLE["boosted_training_rows"] = with_(BRAND_SALES, BRAND_DAILY, BOOST_USABLE) + f"SELECT * REPLACE ({day_text()} AS date) FROM training"
ORACLE["boosted_future_rows"] = with_(BRAND_SALES, BRAND_DAILY, """newest AS (
  SELECT *, row_number() OVER (PARTITION BY product ORDER BY date DESC) AS r FROM daily),
ends AS (
  SELECT product, max(date) AS last, round(avg(sales), 4) AS m, round(stddev_samp(sales) FILTER (r <= 7), 4) AS s7,
         round(stddev_samp(sales) FILTER (r <= 14), 4) AS s14, round(stddev_samp(sales), 4) AS s30
  FROM newest WHERE r <= 30 GROUP BY 1),
coming AS (SELECT *, last + CAST(i AS INTEGER) AS date FROM ends, range(1, 31) t(i))""") + f"""
SELECT product, {day_text()} AS date, {", ".join(f"m AS sales_rolling_mean_{n}, s{n} AS sales_rolling_std_{n}" for n in (7, 14, 30))}, {TIME} FROM coming"""
# The same features, at the precision that splits are judged at.
BOOST_EXACT = BOOST_USABLE.replace(", 4) END", f", {VALUE_DIGITS}) END")
ORACLE["boosted_first_splits"] = with_(BRAND_SALES, BRAND_DAILY, BOOST_EXACT, f"""centred AS (
  SELECT *, count(*) OVER (PARTITION BY product) AS n, sales - avg(sales) OVER (PARTITION BY product) AS g FROM training WHERE NOT is_validation),
long AS ({" UNION ALL ".join(f"SELECT product, n, g, {i} AS place, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM centred" for i, c in enumerate(BOOST_NAMES))}),
binned AS (SELECT *, ((rank() OVER (PARTITION BY product, place ORDER BY x) - 1) * {BINS}) // n AS bin FROM long),
sums AS (SELECT product, place, feature, bin, count(*) AS c, sum(g) AS s, sum(g * g) AS q, max(x) AS threshold FROM binned GROUP BY ALL),
sides AS (
  SELECT *, sum(c) OVER upto AS n_left, sum(s) OVER upto AS l, sum(c) OVER f AS n, sum(s) OVER f AS a, sum(q) OVER f AS v FROM sums
  WINDOW f AS (PARTITION BY product, place), upto AS (PARTITION BY product, place ORDER BY bin ROWS UNBOUNDED PRECEDING)),
judged AS (
  SELECT *, n - n_left AS n_right, round((l * l / n_left + (a - l) * (a - l) / (n - n_left) - a * a / n) / v, {GAIN_DIGITS}) AS gain
  FROM sides WHERE n_left >= {LEAF_ROWS} AND n - n_left >= {LEAF_ROWS} AND v > 0)""") + """
SELECT product, feature, round(threshold, 4) AS threshold, CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right, round(gain, 4) AS gain
FROM judged WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY product ORDER BY judged.gain DESC, place, bin) = 1"""


# --- quantiles of raw rows ------------------------------------------------------------------------------

ORACLE["raw_sales_quantiles"] = with_(SALES) + """
SELECT CAST(s AS DOUBLE) AS share, round(q, 4) AS quantile FROM (
  SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99]) AS s, unnest(quantile_cont(CAST(sales AS DOUBLE), [0.01, 0.25, 0.5, 0.75, 0.99])) AS q FROM sales)"""
ORACLE["raw_sales_outliers"] = with_(SALES, """fences AS (
  SELECT quantile_cont(CAST(sales AS DOUBLE), 0.25) AS a, quantile_cont(CAST(sales AS DOUBLE), 0.75) AS b FROM sales)""") + """
SELECT product, count(*) AS n_outliers FROM sales, fences WHERE sales < a - 0.4 * (b - a) OR sales > b + 0.4 * (b - a) GROUP BY 1"""

import datetime as dt

from tallyspark.streaming.daily_alerts import daily_totals, start_daily_alerts


def test_stream_raises_the_batch_alerts(spark, tmp_path):
    source, totals, alerts, checkpoint = (str(tmp_path / n) for n in ("in", "totals", "alerts", "cp"))
    schema = "date timestamp, sales double"
    for part, span in enumerate((range(0, 10), range(10, 20))):
        rows = [(dt.datetime(2024, 1, 1, 12) + dt.timedelta(i), 500.0 if i == 8 else 100.0) for i in span for _ in range(2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = start_daily_alerts(spark.readStream.schema(schema).parquet(source), totals, alerts, checkpoint, once=True)
        query.awaitTermination()
        assert query.exception() is None, part
    days = spark.read.parquet(totals)
    # The last days stay open until the watermark passes them.
    assert days.count() == days.select("date").distinct().count() >= 17
    assert {r["sales"] for r in days.collect()} == {200.0, 1000.0}
    found = spark.read.parquet(alerts).collect()
    assert [(r["type"], r["alert_date"]) for r in found] == [("High Sales Anomaly", dt.datetime(2024, 1, 9))]


def test_days_follow_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        rows = spark.sql("SELECT timestamp'2024-01-02 01:00:00' AS date, 5.0D AS sales UNION ALL SELECT timestamp'2024-01-02 23:00:00', 7.0D")
        assert [(str(r["date"]), r["sales"]) for r in daily_totals(rows).collect()] == [("2024-01-02", 12.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)

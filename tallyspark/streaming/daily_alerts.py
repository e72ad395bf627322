"""Daily sales alerts over an unbounded sales stream.

Closed days leave the windowed aggregate once the watermark passes them.  Each
micro-batch stores its days under its own batch folder and judges them against
the days stored before, with the same z-score rule as the batch alerts; a
repeated batch overwrites its own folders, so retries do not duplicate rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.operators.alerts import anomaly_alerts_page
from tallyspark.operators.anomalies import rolling_zscore
from tallyspark.schemas import require_columns

# Days before a day that the z-score rule reads.
LOOK_BACK = 7


def daily_totals(stream: DataFrame, date: str = "date", sales: str = "sales", lateness: str = "1 day") -> DataFrame:
    """Total per calendar day of the session's time zone; rows later than ``lateness`` are dropped by the watermark.

    Windows are cut in UTC, so moments are first moved to the UTC moment that shows the local time.
    """
    require_columns(stream, [date, sales])
    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    local = F.from_utc_timestamp(F.col(date).cast("timestamp"), zone)
    moments = stream.select(local.alias("moment"), F.col(sales).cast("double").alias("sales"))
    return (
        moments.withWatermark("moment", lateness)
        .groupBy(F.window("moment", "1 day").alias("w"))
        .agg(F.sum("sales").alias("sales"))
        .select(F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86400).cast("int")).alias("date"), "sales")
    )


def start_daily_alerts(
    stream: DataFrame, totals_path: str, alerts_path: str, checkpoint: str, date: str = "date", sales: str = "sales",
    lateness: str = "1 day", z_threshold: float = 2.0, once: bool = False,
) -> StreamingQuery:
    """Run the stream; all three paths must be reachable by every executor.

    ``once`` processes what is available and stops.
    """
    def judge(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():  # no day closed: nothing to store or judge
            return
        batch.write.mode("overwrite").parquet(f"{totals_path}/batch_id={batch_id}")
        history = batch.sparkSession.read.parquet(totals_path)
        days = history.filter(F.col("batch_id") == batch_id).select("date", "sales")
        # The rule looks back a week, so the last stored days before the batch are all it needs.
        first = days.agg(F.min("date").alias("first")).scalar()
        before = history.filter((F.col("batch_id") < batch_id) & (F.col("date") < first)).select("date", "sales")
        series = before.orderBy(F.desc("date")).limit(LOOK_BACK).unionByName(days)
        flagged = rolling_zscore(series, threshold=z_threshold).join(days.select("date"), "date", "left_semi")
        anomaly_alerts_page(flagged).write.mode("overwrite").parquet(f"{alerts_path}/batch_id={batch_id}")

    writer = (
        daily_totals(stream, date, sales, lateness).writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint).foreachBatch(judge)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()

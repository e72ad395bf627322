"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "tallyspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; every setting can be overridden."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Call-site capture costs several driver round trips per column expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


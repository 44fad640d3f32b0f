"""The Spark session with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tessera", **conf: object) -> SparkSession:
    """An active session, or a new one; a cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",  # dates are UTC in the dialect
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.cbo.enabled": "true",
        "spark.sql.cbo.joinReorder.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
    } | {k: str(v) for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()

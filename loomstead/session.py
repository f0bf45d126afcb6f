"""A Spark session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution splits hot joins and merges small partitions; days and hours are computed in UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "loomstead", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()

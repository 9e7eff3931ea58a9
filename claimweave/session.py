"""Session settings that these jobs profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Projections of many fields make long generated methods, and the JVM never compiles a
    # method of more than 8000 bytes. With this limit Spark splits such projections instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder

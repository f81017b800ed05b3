"""Session defaults for local runs; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "scriptorium", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow transfer."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

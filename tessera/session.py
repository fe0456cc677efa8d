"""A session with the settings this library is tuned for; every one of them can be overridden."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """local[n] only where no master is set by the environment that submits the job."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    if "spark.master" not in conf and not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", conf.get("spark.sql.shuffle.partitions", "8"))
    return builder.getOrCreate()

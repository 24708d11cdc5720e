"""The Spark session that the engine is used with."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import SparkSession

#: Settings that hold unless the caller or the cluster sets them otherwise.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "tessel", master: str | None = None, settings: Mapping[str, str] | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `settings`, and `conf`, which names settings with _ for ., win over them."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    for k, v in (DEFAULTS | dict(settings or {}) | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()

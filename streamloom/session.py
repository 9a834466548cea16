"""Session factory: UTC, ANSI and adaptive execution on; everything else is left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "streamloom", **conf: str) -> SparkSession:
    """A SparkSession with the settings that results depend on.

    ``master`` is only given in tests and benchmarks; ``conf`` uses ``__`` for ``.``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()

"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "gustline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings override."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()

"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, hive: bool = False, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI SQL and adaptive execution; a cluster's own settings win where master is None. hive adds
    the metastore that hive-site.xml or conf names."""
    builder = SparkSession.builder.appName("tidewater")
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return (builder.enableHiveSupport() if hive else builder).getOrCreate()

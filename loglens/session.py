"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; 64 MB input splits unless told otherwise."""
    builder = SparkSession.builder.appName("loglens").config(map={"spark.sql.files.maxPartitionBytes": "64m"} | SETTINGS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """Sets what charset decoding needs on a session made elsewhere."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark

"""The session that the library expects: UTC, adaptive execution, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", partitions: int | None = None, **more: str) -> SparkSession:
    """A session with the library's settings; ``partitions`` sets the shuffle partitions."""
    conf = SETTINGS | more
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    spark = SparkSession.builder.master(master).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

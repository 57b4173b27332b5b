"""Session settings that the library's operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; master and partitions only for local runs."""
    make = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        make = make.master(master).config("spark.ui.enabled", "false")
    if partitions:
        make = make.config("spark.sql.shuffle.partitions", str(partitions))
    return make.getOrCreate()

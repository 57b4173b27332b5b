"""Stored lookup answers: one file an ISBN, as fetched from a catalogue service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """isbn, http_code and body of every file below path: the input of metadata.lookup.

    A file is named by its ISBN, and by the code of its answer if that is not 200: 9780306406157.json, 0306406152.503.json. An
    empty file is an answer without a body.
    """
    name = r"^(.*?)(?:\.(\d{3}))?\.json$"
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(path)
    at = F.url_decode(F.col("_metadata.file_name"))
    code = F.nullif(F.regexp_extract(at, name, 2), F.lit(""))
    return files.select(F.regexp_extract(at, name, 1).alias("isbn"), F.coalesce(code.cast("int"), F.lit(200)).alias("http_code"), F.nullif("value", F.lit("")).alias("body"))

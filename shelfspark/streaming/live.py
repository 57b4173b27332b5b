"""Live catalogue queries: whenever new books arrive, the whole result of a query is delivered again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.schemas import BOOKS


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """A stream of book rows that are written to a folder as Parquet."""
    return spark.readStream.schema(BOOKS).parquet(path)


def observe(stream: DataFrame, query: Callable[[DataFrame], DataFrame], deliver: Callable[[DataFrame, int], None], state: str, checkpoint: str) -> StreamingQuery:
    """Keep the books that arrived below state and call deliver(query(all books), batch) after each batch.

    Books whose identifier is known are ignored. State is a table with a folder for each batch, so a batch that runs again replaces its own
    part and nothing else, and earlier ones are read as one table; all that is available is taken, then the query ends. Results that follow updates
    and deletes as well, at the cost of the change, are in changes.py.
    """

    def batch(new: DataFrame, number: int) -> None:
        stored = new.sparkSession.read.schema(T.StructType([*BOOKS.fields, T.StructField("batch", T.IntegerType())])).parquet(state)
        known = stored.where(F.col("batch") < number).drop("batch")
        fresh = new.dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti").select(BOOKS.names)
        fresh.write.mode("overwrite").parquet(f"{state}/batch={number}")
        deliver(query(known.unionByName(new.sparkSession.read.schema(BOOKS).parquet(f"{state}/batch={number}"))), number)

    stream.sparkSession.createDataFrame([], BOOKS).write.mode("overwrite").parquet(f"{state}/batch=-1")
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events (ts, event_type) of a stream or table counted by window and type; rows later than late are dropped from a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")



"""Written tables in the folder that driver and executors share: lineage ends there, and they survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a slim side that is broadcast, and most bytes that Spark reckons it has as stored: some 64 MB and 256 MB in memory.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
_made = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local (tests) a folder of our own is made and announced
    as checkpoint folder; it is removed when the process ends. On a cluster the setting is needed.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="shelfspark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.paths = [*getattr(_made, "paths", []), path]
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: what is read later survives the loss of any executor.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """materialize(build()); whatever else build has put below the shared folder is deleted then."""
    before = set(getattr(_made, "paths", []))
    out = materialize(build(), name)
    *passed, kept = [p for p in _made.paths if p not in before]
    for path in passed:
        remove(spark, path)
    _made.paths = [*(p for p in _made.paths if p in before), kept]
    return out


def small_side(stored: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """stored, a written table of slim rows, to be broadcast if it has no more than most rows and BROADCAST_BYTES.

    Beyond that the join is left to Spark.
    """
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(stored) if size <= BROADCAST_BYTES and stored.count() <= most else stored

"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, start + i * step. Shards take turns, each
claiming the next slot of its preference order that is still free, until the table is full. Slots are thus shared evenly (the
counts differ by one at most), and a shard that leaves or joins moves few other slots. A document's shard is the
table's entry at its hashed identifier: one broadcast lookup, constant time, no shuffle.

The table has SLOTS entries whatever the data, so its size in a broadcast is fixed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime, and more than a hundred times the usual number of shards.
SLOTS = 10_007
SHARDS = 64


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The lookup table: for each slot the place in shards of the one that claimed it. slots must be prime."""
    if not shards or len(shards) > slots or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("there must be shards, no more of them than slots, and a prime number of slots")
    at = [_number(f"start|{s}") % slots for s in shards]
    step = [_number(f"step|{s}") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:03d}" for k in range(n)]


def table_of(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard_no and shard of every slot."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    one = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return one.select("slot", F.col("owner").cast("int").alias("shard_no"), F.element_at(F.array(*map(F.lit, shards)), F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of an identifier: 48 bits of the MD5 of its text, modulo the table's size; null hashes as the word null."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """docs with slot, shard_no and shard.

    Every row is placed: rows with one identifier together, null identifiers as one more identifier. Columns of docs
    with these names are replaced; an empty table stays empty.
    """
    lookup = table_of(docs.sparkSession, shards or names(), slots)
    rows = docs.drop("slot", "shard_no", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(lookup), "slot").select(*[c for c in docs.columns if c not in ("slot", "shard_no", "shard")], "slot", "shard_no", "shard")


def write(placed: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Write placed rows as Parquet, a folder a shard, no file larger than rows_per_file.

    Rows are spread by slot within a shard, so that a shard is written by many tasks.
    """
    keys = [F.col("shard_no"), F.col("slot")]
    placed.repartition(*keys).sortWithinPartitions("shard_no").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)

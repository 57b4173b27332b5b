"""Observed catalogue queries kept up by changes: a feed of inserts, updates and deletes is applied to the stored result.

The result (books with their author's name) and the authors are stored in BUCKETS folders each, by identifier. A batch of changes
reads and writes anew only the folders that it touches; a manifest, written last, names the version of each folder, so that a
batch that fails or runs again changes nothing else. A new name of an author reaches the author's books through a stored list of books by
author, in folders as well. What a batch costs thus grows with the change, not with the catalogue.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.stores import filesystem

BUCKETS = 32
INSERT, UPDATE, DELETE = "insert", "update", "delete"
BOOK = "id long, title string, author_id long, isbn string"
SCHEMAS = {"authors": "id long, name string", "books": BOOK + ", author_name string", "by_author": "author_id long, id long"}
KEYS = {"authors": "id", "books": "id", "by_author": "author_id"}
#: One change: table (books or authors), kind, seq (later ones win), id, and the row's columns; those of the other table are null.
CHANGE = "table string, kind string, seq long, id long, title string, author_id long, isbn string, name string"


class Stored:
    """Tables in folders by key, each folder in a version of its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.manifest = self._read()

    def _read(self) -> dict:
        from pyarrow import fs

        store, base = filesystem(self.path)
        if store.get_file_info(f"{base}/manifest.json").type != fs.FileType.File:
            return {"batch": -1, **{t: {} for t in SCHEMAS}}
        with store.open_input_stream(f"{base}/manifest.json") as file:
            return json.loads(file.read())

    def bucket(self, key):
        return F.pmod(F.xxhash64(key.cast("long")), F.lit(self.buckets)).cast("int")

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or those of its folders that are asked for."""
        have = self.manifest[name]
        paths = [f"{self.path}/{name}/{v}/bucket={b}" for b, v in have.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def touched(self, keys: DataFrame) -> list[int]:
        """Folders of keys; BUCKETS numbers at most."""
        return [r.b for r in keys.select(self.bucket(keys[keys.columns[0]]).alias("b")).distinct().collect() if r.b is not None]

    def replace(self, name: str, rows: DataFrame, buckets: list[int], batch: int) -> None:
        """Write the rows of some folders as a new version; folders without rows are gone."""
        at = f"{self.path}/{name}/{batch}"
        rows.withColumn("bucket", self.bucket(F.col(KEYS[name]))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        from pyarrow import fs

        store, base = filesystem(at)
        there = {f.base_name.partition("=")[2] for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("bucket=")}
        have = self.manifest[name]
        for b in map(str, buckets):
            have.pop(b, None)
            if b in there:
                have[b] = str(batch)

    def publish(self, batch: int) -> None:
        """The manifest is written under another name and moved into place."""
        self.manifest["batch"] = batch
        store, base = filesystem(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/manifest.part", compression=None) as file:
            file.write(json.dumps(self.manifest).encode())
        store.move(f"{base}/manifest.part", f"{base}/manifest.json")


def latest(changes: DataFrame, table: str) -> DataFrame:
    """The last change of each identifier of one table."""
    rows = changes.where(F.col("table") == table)
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "seq").alias("r"))
    return last.select("id", "r.*")


def apply(stored: Stored, changes: DataFrame, batch: int) -> None:
    """Apply a batch of changes (see CHANGE); a batch that was applied before is passed over.

    An insert of a known identifier and an update of an unknown one put the row in either way; a delete of an unknown one does
    nothing. Books keep an author_id whose author is gone or unknown, with a null name.
    """
    if batch <= stored.manifest["batch"]:
        return
    spark, before = stored.spark, stored.manifest["batch"]
    changes = changes.select("table", "kind", "seq", "id", "title", "author_id", "isbn", "name").persist()
    try:
        authors, books = latest(changes, "authors"), latest(changes, "books")
        a_buckets = stored.touched(authors.select("id"))
        if a_buckets:
            kept = stored.table("authors", a_buckets).join(authors.select("id"), "id", "left_anti")
            stored.replace("authors", kept.unionByName(authors.where(F.col("kind") != DELETE).select("id", "name")), a_buckets, batch)
        # books that an author's change reaches: those stored under it
        of = stored.table("by_author", a_buckets).join(authors.select(F.col("id").alias("author_id")), "author_id", "left_semi").select("id") if a_buckets else spark.createDataFrame([], "id long")
        ids = books.select("id").union(of).distinct().persist()
        buckets = stored.touched(ids)
        if buckets:
            old = stored.table("books", buckets).persist()
            again = old.join(ids, "id", "left_semi").join(books.select("id"), "id", "left_anti").select("id", "title", "author_id", "isbn")
            fresh = again.unionByName(books.where(F.col("kind") != DELETE).select("id", "title", "author_id", "isbn"))
            named = stored.touched(fresh.select("author_id"))
            names = stored.table("authors", named).select(F.col("id").alias("_a"), F.col("name").alias("author_name"))
            fresh = fresh.join(names, F.col("author_id") == F.col("_a"), "left").drop("_a")
            # the list by author follows: the old places of the books go, the new ones come
            moved = old.join(ids, "id", "left_semi").select("author_id").union(fresh.select("author_id")).where("author_id is not null").distinct().persist()
            places = stored.touched(moved)
            if places:
                left = stored.table("by_author", places).join(ids, "id", "left_anti")
                stored.replace("by_author", left.unionByName(fresh.where("author_id is not null").select("author_id", "id")), places, batch)
            stored.replace("books", old.join(ids, "id", "left_anti").unionByName(fresh), buckets, batch)
            for df in (old, moved):
                df.unpersist()
        ids.unpersist()
        stored.publish(batch)
    except Exception:
        stored.manifest = stored._read() if before >= 0 else {"batch": -1, **{t: {} for t in SCHEMAS}}
        raise
    finally:
        changes.unpersist()


def observe(changes: DataFrame, path: str, checkpoint: str, deliver: Callable[[DataFrame, int], None] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the result below path up with a stream of changes; deliver(books with authors, batch) is called after each batch."""

    def batch(rows: DataFrame, number: int) -> None:
        stored = Stored(rows.sparkSession, path, buckets)
        apply(stored, rows, number)
        if deliver:
            deliver(stored.table("books"), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

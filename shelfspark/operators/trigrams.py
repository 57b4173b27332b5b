"""Substring search by a stored index of trigrams.

Every column's lower-cased text is cut into its distinct runs of three characters; postings (gram, key) are stored in folders by
a checksum of the gram, sorted by gram. A needle's trigrams select their folders and row groups, the keys that have all of them are candidates,
and these are checked by the same LIKE as a scan. Needles under three characters, with wildcards, or with characters whose case
changes their number, are left to the scan, so that the rows never differ from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import contains_like
from ..sources.catalogue import Catalogue
from ..storage import scratch
from .catalogue import with_author

BUCKETS = 64
SIZE = 3


def grams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text; empty for shorter texts and null."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - SIZE + 1, F.lit(1)))
    return F.when(F.length(low) >= SIZE, F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(SIZE))))).otherwise(F.array().cast("array<string>"))


def build(rows: DataFrame, columns: list[str], path: str | None = None, key: str = "id") -> DataFrame:
    """Write the postings of some text columns: gram, key and field, in BUCKETS folders, and read them back."""
    spark = rows.sparkSession
    path = path or scratch(spark, "trigrams")
    each = reduce(DataFrame.unionByName, [rows.select(F.col(key).alias("key"), F.lit(c).alias("field"), F.explode(grams(F.col(c))).alias("gram")) for c in columns])
    dealt = each.withColumn("bucket", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(BUCKETS)).cast("int"))
    # a gram's postings may be many: they spread over tasks by key, and each folder has files sorted by gram
    dealt.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)
    return spark.read.schema("key long, field string, gram string, bucket int").parquet(path)


def indexable(needle: str) -> bool:
    return len(needle) >= SIZE and not {"%", "_", "\\"} & set(needle) and len(needle.lower()) == len(needle) == len(needle.upper())


def candidates(index: DataFrame, needle: str, fields: list[str]) -> DataFrame:
    """Keys of rows of which one of the fields has all trigrams of an indexable needle."""
    import zlib

    low = needle.lower()
    wanted = sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})
    folders = sorted({zlib.crc32(g.encode()) % BUCKETS for g in wanted})
    hits = index.where(F.col("bucket").isin(folders) & F.col("gram").isin(wanted) & F.col("field").isin(fields))
    full = hits.groupBy("key", "field").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    return full.select("key").distinct()


def matching(rows: DataFrame, index: DataFrame, needle: str, fields: list[str], key: str = "id") -> DataFrame:
    """The rows of which a field contains needle, found by index where it can be."""
    hit = reduce(lambda a, b: a | b, [contains_like(F.col(f), needle) for f in fields])
    if not indexable(needle):
        return rows.where(hit)
    return rows.join(candidates(index, needle, fields).withColumnRenamed("key", key), key, "left_semi").where(hit)


def search_all(c: Catalogue, books: DataFrame, authors: DataFrame, needle: str) -> DataFrame:
    """As catalogue.search_all, by the indexes of books (title, isbn) and of authors (name)."""
    own = matching(c.books, books, needle, ["title", "isbn"]).select("id")
    named = matching(c.authors, authors, needle, ["name"]).select(F.col("id").alias("author_id"))
    theirs = c.books.join(named, "author_id", "left_semi").select("id")
    return with_author(c.books.join(own.union(theirs).distinct(), "id", "left_semi"), c.authors).orderBy("title")


def search_title(c: Catalogue, books: DataFrame, needle: str) -> DataFrame:
    return with_author(matching(c.books, books, needle, ["title"]), c.authors).orderBy("title")


def search_isbn(c: Catalogue, books: DataFrame, needle: str) -> DataFrame:
    return with_author(matching(c.books, books, needle, ["isbn"]), c.authors).orderBy("title")


def search_author(c: Catalogue, authors: DataFrame, needle: str) -> DataFrame:
    named = matching(c.authors, authors, needle, ["name"])
    return with_author(c.books.join(named.select(F.col("id").alias("author_id")), "author_id", "left_semi"), named).orderBy("title")

"""Catalogue tables: read from Parquet, or derived from the driver's star schema.

Each derived table has its definition twice: as a DataFrame here, and as DuckDB SQL in VIEWS for the oracles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .schemas import BOOK_TYPES


@dataclass(frozen=True)
class Catalogue:
    books: DataFrame
    authors: DataFrame
    publishers: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew over all cores if it is read in fewer tasks; for slim tables of which each row makes much work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, path: str) -> Catalogue:
    """Books, authors and publishers stored as Parquet below path."""
    return Catalogue(*(spark.read.parquet(f"{path}/{n}") for n in ("books", "authors", "publishers")))


def isbn_of(key: Column) -> Column:
    """978, the key in nine digits, and the check digit."""
    digits = F.lpad(key.cast("string"), 9, "0")
    total = F.lit(38)
    for i in range(9):
        total = total + F.substring(digits, i + 1, 1).cast("int") * (3 if i % 2 == 0 else 1)
    return F.concat(F.lit("978"), digits, ((10 - total % 10) % 10).cast("string"))


def derived(spark: SparkSession, sf_dir: str) -> Catalogue:
    """A catalogue over the star schema: parts are books, suppliers authors, brands publishers."""
    part = table(spark, sf_dir, "part")
    authors = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).cast("bigint").alias("id"), F.col("s_name").alias("name"))
    names = part.select(F.col("p_brand").alias("name")).distinct()
    publishers = names.select(F.row_number().over(Window.orderBy("name")).cast("bigint").alias("id"), "name")  # some 25 brands
    key = F.col("p_partkey")
    given = {
        "id": key + 1, "title": F.col("p_name"), "author_id": F.when(key % 7 != 0, key % 10 + 1), "publisher_id": F.col("_publisher"),
        "isbn": F.when(key % 11 != 0, isbn_of(key)), "page_count": F.col("p_size") * 10, "publication_year": F.when(key % 5 != 0, 1950 + key % 70),
        "cover_image_uri": F.when(key % 4 == 0, F.concat(F.lit("file:/covers/"), key.cast("string"))).when(key % 4 == 1, ""),
        "genres": F.col("p_type"), "signed": F.when(key % 13 == 0, True), "purchase_price": F.col("p_retailprice"), "rating": F.when(key % 3 == 0, key % 5 + 1),
    }
    rows = part.join(F.broadcast(publishers.select(F.col("id").alias("_publisher"), F.col("name").alias("_brand"))), F.col("p_brand") == F.col("_brand"), "left")
    books = rows.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in BOOK_TYPES.items()])
    return Catalogue(books, authors, publishers)


def _duck(kind: str) -> str:
    return {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT"}.get(kind, kind.upper())


_CHECK = "38 + " + " + ".join(f"substr(lpad(p_partkey::VARCHAR, 9, '0'), {i + 1}, 1)::INT * {3 if i % 2 == 0 else 1}" for i in range(9))
_GIVEN = {
    "id": "p_partkey + 1", "title": "p_name", "author_id": "CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 10 + 1 END", "publisher_id": "publishers.id",
    "isbn": f"CASE WHEN p_partkey % 11 <> 0 THEN '978' || lpad(p_partkey::VARCHAR, 9, '0') || ((10 - ({_CHECK}) % 10) % 10)::VARCHAR END", "page_count": "p_size * 10",
    "publication_year": "CASE WHEN p_partkey % 5 <> 0 THEN 1950 + p_partkey % 70 END",
    "cover_image_uri": "CASE p_partkey % 4 WHEN 0 THEN 'file:/covers/' || p_partkey::VARCHAR WHEN 1 THEN '' END",
    "genres": "p_type", "signed": "CASE WHEN p_partkey % 13 = 0 THEN TRUE END", "purchase_price": "p_retailprice", "rating": "CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 5 + 1 END",
}
#: DuckDB definitions of the derived tables, in the order in which they build on each other.
VIEWS = {
    "authors": "SELECT (s_suppkey + 1)::BIGINT AS id, s_name AS name FROM supplier",
    "publishers": "SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT p_brand AS name FROM part)",
    "books": "SELECT " + ", ".join(f"({_GIVEN.get(n, 'NULL')})::{_duck(t)} AS {n}" for n, t in BOOK_TYPES.items()) + " FROM part LEFT JOIN publishers ON p_brand = publishers.name",
}


def with_views(sql: str, **more: str) -> str:
    """sql below common table expressions of the derived tables and of more."""
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in (VIEWS | more).items()) + "\n" + sql

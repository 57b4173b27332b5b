"""Lookups, searches and joins of the catalogue. Every function maps DataFrames to a lazy DataFrame.

Dimensions (authors, publishers) are joined without a hint: Spark broadcasts them while their size allows and shuffles
beyond that. Orders are binary with nulls first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import contains_like, present
from ..sources.catalogue import Catalogue
from ..sources.schemas import DETAIL_TYPES


def all_books(c: Catalogue) -> DataFrame:
    return c.books.orderBy("title")


def all_authors(c: Catalogue) -> DataFrame:
    return c.authors.orderBy("name")


def all_publishers(c: Catalogue) -> DataFrame:
    return c.publishers.orderBy("name")


def by_id(rows: DataFrame, key: int) -> DataFrame:
    """The row with an identifier; none or one."""
    return rows.where(F.col("id") == key).limit(1)


def by_name(rows: DataFrame, name: str) -> DataFrame:
    """A row with exactly this name, case included."""
    return rows.where(F.col("name") == name).limit(1)


def books_of_publisher(c: Catalogue, publisher: int) -> DataFrame:
    return c.books.where(F.col("publisher_id") == publisher).orderBy("title")


def search_books(c: Catalogue, needle: str) -> DataFrame:
    return c.books.where(contains_like(F.col("title"), needle) | contains_like(F.col("isbn"), needle)).orderBy("title")


def search_names(rows: DataFrame, needle: str) -> DataFrame:
    return rows.where(contains_like(F.col("name"), needle))


def isbn_conflicts(c: Catalogue, isbn: str, current: int) -> DataFrame:
    """n: how many other books have an ISBN, compared as stored."""
    return c.books.where((F.col("isbn") == isbn) & (F.col("id") != current)).agg(F.count("id").alias("n"))


def with_author(books: DataFrame, authors: DataFrame) -> DataFrame:
    """books with author, a struct of id and name; null where there is none."""
    a = authors.select(F.col("id").alias("_a"), F.struct("id", "name").alias("author"))
    return books.join(a, F.col("author_id") == F.col("_a"), "left").drop("_a")


def books_with_author(c: Catalogue) -> DataFrame:
    return with_author(c.books, c.authors).orderBy("title")


def search_all(c: Catalogue, needle: str) -> DataFrame:
    """Books whose title, ISBN or author's name contains needle; books without author may match by the others."""
    rows = with_author(c.books, c.authors)
    hit = contains_like(F.col("title"), needle) | contains_like(F.col("isbn"), needle) | contains_like(F.col("author.name"), needle)
    return rows.where(hit).orderBy("title")


def search_title(c: Catalogue, needle: str) -> DataFrame:
    return with_author(c.books.where(contains_like(F.col("title"), needle)), c.authors).orderBy("title")


def search_isbn(c: Catalogue, needle: str) -> DataFrame:
    return with_author(c.books.where(contains_like(F.col("isbn"), needle)), c.authors).orderBy("title")


def search_author(c: Catalogue, needle: str) -> DataFrame:
    named = c.authors.where(contains_like(F.col("name"), needle))
    return with_author(c.books.join(named.select(F.col("id").alias("author_id")), "author_id", "left_semi"), named).orderBy("title")


#: Search modes of search().
ALL, TITLE, AUTHOR, ISBN = range(4)


def search(c: Catalogue, mode: int, needle: str) -> DataFrame:
    """The search that a mode stands for; a blank needle lists all books."""
    needle = needle.strip("".join(map(chr, range(33))))
    if not needle:
        return books_with_author(c)
    return {TITLE: search_title, AUTHOR: search_author, ISBN: search_isbn}.get(mode, search_all)(c, needle)


def edit_form(c: Catalogue) -> DataFrame:
    """Every book with author_name and publisher_name, each null where there is none."""
    a = c.authors.select(F.col("id").alias("_a"), F.col("name").alias("author_name"))
    p = c.publishers.select(F.col("id").alias("_p"), F.col("name").alias("publisher_name"))
    return c.books.join(a, F.col("author_id") == F.col("_a"), "left").join(p, F.col("publisher_id") == F.col("_p"), "left").drop("_a", "_p")


def shown_isbn(isbn: Column) -> Column:
    """The ISBN unless it is blank or a placeholder (TEMP-, in this case); else null."""
    return F.when(present(isbn) & ~isbn.startswith("TEMP-"), isbn)


def display_rows(c: Catalogue, unknown: str = "Unknown author", cover: str = "placeholder") -> DataFrame:
    """id, title and what a list shows of author, ISBN, pages and cover."""
    rows = with_author(c.books, c.authors)
    pages = F.when(F.col("page_count") > 0, F.concat(F.col("page_count").cast("string"), F.lit(" pages")))
    uri = F.coalesce(F.nullif(F.col("cover_image_uri"), F.lit("")), F.lit(cover))
    return rows.select("id", "title", F.coalesce("author.name", F.lit(unknown)).alias("author_name"), shown_isbn(F.col("isbn")).alias("isbn"), pages.alias("pages"), uri.alias("cover"))


def has_details(columns: dict[str, str] = DETAIL_TYPES) -> Column:
    """Whether any of the optional columns is given: not blank for text, not null for others."""
    given = [present(F.col(n)) if t == "string" else F.col(n).isNotNull() for n, t in columns.items()]
    return reduce(lambda a, b: a | b, given)

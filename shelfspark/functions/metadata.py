"""Metadata documents: JSON to flat records, and the status of a lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import METADATA_JSON
from .identifiers import normalise
from .strings import present, trimmed

#: Most subjects that are joined to genres.
MAX_SUBJECTS = 8


def year(text: Column) -> Column:
    """The last 19dd or 20dd in a free date, wherever it stands; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"((?:19|20)[0-9]{2})"), 1), F.lit(-1)).cast("int")


def genres(subjects: Column) -> Column:
    """Up to eight non-blank subject names joined by a comma and a space; null without any."""
    names = F.filter(F.transform(subjects, lambda s: trimmed(s["name"])), lambda n: F.length(n) > 0)
    return F.nullif(F.array_join(F.slice(names, 1, MAX_SUBJECTS), ", "), F.lit(""))


def first_name(people: Column) -> Column:
    return F.try_element_at(people, F.lit(1))["name"]


def record(book: Column, isbn: Column) -> Column:
    """The flat metadata record of a parsed book."""
    cover = F.coalesce(book["cover"]["large"], book["cover"]["medium"], book["cover"]["small"])
    fields = {"title": trimmed(book["title"]), "author": trimmed(first_name(book["authors"])), "publisher": trimmed(first_name(book["publishers"])), "page_count": book["number_of_pages"], "publication_year": year(book["publish_date"]), "genres": genres(book["subjects"]), "cover_url": cover, "isbn": isbn}
    return F.struct(*[v.alias(n) for n, v in fields.items()])


def lookup(responses: DataFrame, isbn: str = "isbn", code: str = "http_code", body: str = "body") -> DataFrame:
    """responses with status and metadata.

    Status is NOT_FOUND for a blank ISBN or an empty document, NETWORK_ERROR for a code outside 200..299, a missing or
    a broken body, else SUCCESS, with the first entry of the document as the record.
    """
    key = normalise(F.col(isbn))
    rows = responses.withColumn("_parsed", F.from_json(F.col(body), METADATA_JSON))
    failed = F.col(body).isNull() | F.col("_parsed").isNull() | ~F.coalesce(F.col(code).between(200, 299), F.lit(False))
    book = F.get(F.map_values("_parsed"), 0)
    status = F.when(key == "", "NOT_FOUND").when(failed, "NETWORK_ERROR").when(F.size("_parsed") == 0, "NOT_FOUND").otherwise("SUCCESS")
    rows = rows.withColumn("status", status)
    return rows.withColumn("metadata", F.when(F.col("status") == "SUCCESS", record(book, key))).drop("_parsed")


def has_details(metadata: Column) -> Column:
    return present(metadata["publisher"]) | present(metadata["genres"]) | metadata["publication_year"].isNotNull()

"""Schemas of the catalogue tables, and the columns of each version."""

from __future__ import annotations

from pyspark.sql import types as T

AUTHORS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), False)])
PUBLISHERS = AUTHORS

#: Columns that version 3 of books added, in order.
DETAIL_TYPES = {
    "asin": "string", "lccn": "string", "oclc": "string", "subtitle": "string", "original_title": "string", "series_name": "string",
    "series_number": "string", "secondary_contributors": "string", "imprint": "string", "publication_year": "int", "edition": "string",
    "printing": "string", "language": "string", "original_language": "string", "format": "string", "dimensions": "string", "weight": "string",
    "dust_jacket": "string", "genres": "string", "tags": "string", "dewey": "string", "lcc": "string", "description": "string",
    "location": "string", "condition": "string", "signed": "boolean", "date_acquired": "string", "purchase_price": "double",
    "acquired_from": "string", "reading_status": "string", "rating": "float", "personal_notes": "string",
}
BASE_TYPES = {"id": "bigint", "title": "string", "author_id": "bigint", "publisher_id": "bigint", "isbn": "string", "page_count": "int", "cover_image_uri": "string"}
BOOK_TYPES = BASE_TYPES | DETAIL_TYPES
_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "float": T.FloatType()}
BOOKS = T.StructType([T.StructField(n, _KINDS[t], n not in ("id", "title")) for n, t in BOOK_TYPES.items()])
BOOKS_V1 = T.StructType([T.StructField(n, _KINDS[t]) for n, t in BASE_TYPES.items()])

#: One document of the metadata service: a map with one entry for each requested identifier.
NAMED = "ARRAY<STRUCT<name: STRING>>"
METADATA_JSON = f"MAP<STRING, STRUCT<title: STRING, authors: {NAMED}, publishers: {NAMED}, number_of_pages: INT, publish_date: STRING, subjects: {NAMED}, cover: STRUCT<small: STRING, medium: STRING, large: STRING>>>"

"""Queries of the catalogue: scans, lookups, searches, joins, display rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as ops
from ..operators import trigrams
from ..sources.catalogue import derived, with_views
from ..sources.schemas import DETAIL_TYPES
from ..storage import settled
from .registry import query

_BOOK = "id, title, author_id, publisher_id, isbn, page_count, cover_image_uri, publication_year, genres, signed, purchase_price, rating"
_SHOWN = _BOOK.split(", ")
_WITH_AUTHOR = f"{', '.join('b.' + c for c in _SHOWN)}, a.name AS author_name"


def _flat(df):
    return df.select(*_SHOWN, F.col("author.name").alias("author_name"))


def _joined(where: str, kind: str = "LEFT") -> str:
    return with_views(f"SELECT {_WITH_AUTHOR} FROM books b {kind} JOIN authors a ON b.author_id = a.id WHERE {where}")


@query(with_views(f"SELECT {_BOOK} FROM books"))
def all_books(spark, sf_dir):
    return ops.all_books(derived(spark, sf_dir)).select(_SHOWN)


@query(with_views("SELECT id, name FROM authors"))
def all_authors(spark, sf_dir):
    return ops.all_authors(derived(spark, sf_dir))


@query(with_views("SELECT id, name FROM publishers"))
def all_publishers(spark, sf_dir):
    return ops.all_publishers(derived(spark, sf_dir))


@query(with_views(f"SELECT {_BOOK} FROM books WHERE id = 43"))
def book_by_id(spark, sf_dir):
    return ops.by_id(derived(spark, sf_dir).books, 43).select(_SHOWN)


@query(with_views("SELECT id, name FROM authors WHERE id = 7"))
def author_by_id(spark, sf_dir):
    return ops.by_id(derived(spark, sf_dir).authors, 7)


@query(with_views("SELECT id, name FROM publishers WHERE id = 3"))
def publisher_by_id(spark, sf_dir):
    return ops.by_id(derived(spark, sf_dir).publishers, 3)



@query(with_views("SELECT id, name FROM authors WHERE name = 'Supplier#000000003'"))
def author_by_name(spark, sf_dir):
    return ops.by_name(derived(spark, sf_dir).authors, "Supplier#000000003")


@query(with_views("SELECT id, name FROM publishers WHERE name = 'Brand#23'"))
def publisher_by_name(spark, sf_dir):
    return ops.by_name(derived(spark, sf_dir).publishers, "Brand#23")


@query(with_views(f"SELECT {_BOOK} FROM books WHERE publisher_id = 5"))
def books_by_publisher(spark, sf_dir):
    return ops.books_of_publisher(derived(spark, sf_dir), 5).select(_SHOWN)


@query(with_views(f"SELECT {_BOOK} FROM books WHERE title ILIKE '%R%D%' OR isbn ILIKE '%R%D%'"))
def search_books(spark, sf_dir):
    return ops.search_books(derived(spark, sf_dir), "R%D").select(_SHOWN)


@query(with_views("SELECT id, name FROM authors WHERE name ILIKE '%ER#%2%'"))
def search_authors(spark, sf_dir):
    return ops.search_names(derived(spark, sf_dir).authors, "ER#%2").orderBy("name")


@query(with_views("SELECT id, name FROM publishers WHERE name ILIKE '%brand#_1%'"))
def search_publishers(spark, sf_dir):
    return ops.search_names(derived(spark, sf_dir).publishers, "brand#_1")


@query(with_views("SELECT count(id) AS n FROM books WHERE isbn = (SELECT isbn FROM books WHERE id = 43) AND id <> 1"))
def isbn_conflict(spark, sf_dir):
    from ..sources.catalogue import isbn_of

    c = derived(spark, sf_dir)
    wanted = spark.range(1).select(isbn_of(F.lit(42)).alias("isbn")).first()[0]
    return ops.isbn_conflicts(c, wanted, 1)


@query(_joined("TRUE"))
def books_with_author(spark, sf_dir):
    return _flat(ops.books_with_author(derived(spark, sf_dir)))


@query(_joined("b.title ILIKE '%1_3%' OR b.isbn ILIKE '%1_3%' OR a.name ILIKE '%1_3%'"))
def search_all(spark, sf_dir):
    return _flat(ops.search_all(derived(spark, sf_dir), "1_3"))


@query(_joined("b.title ILIKE '%o%e%'"))
def search_title(spark, sf_dir):
    return _flat(ops.search_title(derived(spark, sf_dir), "o%e"))


@query(_joined("a.name ILIKE '%#%5%'", "INNER"))
def search_author(spark, sf_dir):
    return _flat(ops.search_author(derived(spark, sf_dir), "#%5"))


@query(_joined("b.isbn ILIKE '%77%'"))
def search_isbn(spark, sf_dir):
    return _flat(ops.search_isbn(derived(spark, sf_dir), "77"))


@query(_joined("TRUE"))
def search_blank(spark, sf_dir):
    return _flat(ops.search(derived(spark, sf_dir), ops.AUTHOR, " \t "))


@query(_joined("b.title ILIKE '%e%'"))
def search_dispatch(spark, sf_dir):
    return _flat(ops.search(derived(spark, sf_dir), ops.TITLE, " e "))


@query(with_views(f"SELECT {', '.join('b.' + c for c in _SHOWN)}, a.name AS author_name, p.name AS publisher_name FROM books b LEFT JOIN authors a ON b.author_id = a.id LEFT JOIN publishers p ON b.publisher_id = p.id"))
def book_form(spark, sf_dir):
    return ops.edit_form(derived(spark, sf_dir)).select(*_SHOWN, "author_name", "publisher_name")


_MARKED = "SELECT * REPLACE (CASE id % 5 WHEN 0 THEN 'TEMP-' || id::VARCHAR WHEN 1 THEN '  ' WHEN 2 THEN 'temp-' || id::VARCHAR ELSE isbn END AS isbn, (CASE id % 6 WHEN 0 THEN 0 ELSE page_count END)::INT AS page_count) FROM books"


def _marked(c):
    from ..sources.catalogue import Catalogue

    code = F.when(F.col("id") % 5 == 0, F.concat(F.lit("TEMP-"), F.col("id").cast("string"))).when(F.col("id") % 5 == 1, "  ").when(F.col("id") % 5 == 2, F.concat(F.lit("temp-"), F.col("id").cast("string"))).otherwise(F.col("isbn"))
    books = c.books.withColumns({"isbn": code, "page_count": F.when(F.col("id") % 6 == 0, 0).otherwise(F.col("page_count"))})
    return Catalogue(books, c.authors, c.publishers)


@query(with_views("""SELECT m.id, m.title, coalesce(a.name, 'Unknown author') AS author_name,
    CASE WHEN regexp_matches(m.isbn, '[^\\x00-\\x20]') AND NOT starts_with(m.isbn, 'TEMP-') THEN m.isbn END AS isbn,
    CASE WHEN m.page_count > 0 THEN m.page_count::VARCHAR || ' pages' END AS pages, coalesce(nullif(m.cover_image_uri, ''), 'placeholder') AS cover
    FROM marked m LEFT JOIN authors a ON m.author_id = a.id""", marked=_MARKED))
def display_rows(spark, sf_dir):
    return ops.display_rows(_marked(derived(spark, sf_dir)))


_GIVEN = " OR ".join(f"regexp_matches(coalesce({n}, ''), '[^\\x00-\\x20]')" if t == "string" else f"{n} IS NOT NULL" for n, t in DETAIL_TYPES.items())


@query(with_views(f"SELECT id, {_GIVEN} AS detailed FROM sparse", sparse="SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN genres END AS genres, CASE WHEN id % 3 = 0 THEN purchase_price END AS purchase_price) FROM books"))
def detailed_flag(spark, sf_dir):
    books = derived(spark, sf_dir).books.withColumns({"genres": F.when(F.col("id") % 2 == 0, F.col("genres")), "purchase_price": F.when(F.col("id") % 3 == 0, F.col("purchase_price"))})
    return books.select("id", ops.has_details().alias("detailed"))


_LABELLED = "SELECT d.doc_id, d.lang, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)"


@query(_LABELLED)
def nullable_relation(spark, sf_dir):
    """A relation fetch whose parent is missing for most rows."""
    from ..sources.catalogue import table

    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, d["doc_id"] == l["doc_id"], "left").select(d["doc_id"], "lang", "quality", "toxic", l["doc_id"].isNotNull().alias("labelled"))




def _by_index(spark, sf_dir, search):
    """A search by freshly built indexes, with its result written out, and the indexes deleted."""
    c = derived(spark, sf_dir)
    books = lambda: trigrams.build(c.books, ["title", "isbn"])
    authors = lambda: trigrams.build(c.authors, ["name"])
    return settled(spark, lambda: _flat(search(c, books, authors)), "found")


@query(_joined("b.title ILIKE '%red gizmo%' OR b.isbn ILIKE '%red gizmo%' OR a.name ILIKE '%red gizmo%'"))
def indexed_search_title(spark, sf_dir):
    """All fields by trigrams, of a needle that titles have."""
    return _by_index(spark, sf_dir, lambda c, books, authors: trigrams.search_all(c, books(), authors(), "RED Gizmo"))


@query(_joined("b.isbn ILIKE '%97800000%'"))
def indexed_search_isbn(spark, sf_dir):
    return _by_index(spark, sf_dir, lambda c, books, authors: trigrams.search_isbn(c, books(), "97800000"))


@query(_joined("a.name ILIKE '%r#000000003%'", "INNER"))
def indexed_search_author(spark, sf_dir):
    return _by_index(spark, sf_dir, lambda c, books, authors: trigrams.search_author(c, authors(), "R#000000003"))

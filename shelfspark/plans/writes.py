"""Queries of writes: merges, migrations and forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import writes as ops
from ..sources.catalogue import derived, with_views
from ..sources.schemas import BASE_TYPES, DETAIL_TYPES
from ..storage import settled
from .registry import query

#: New names for authors: known ones, new ones, and repetitions, in the order of ord.
_NEW = "SELECT id - 1 AS ordinal, CASE WHEN id % 3 = 0 THEN 'Supplier#' || lpad((id % 40)::VARCHAR, 9, '0') ELSE 'New author ' || (id % 17)::VARCHAR END AS name FROM books"


def _new(c):
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad((F.col("id") % 40).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("New author "), (F.col("id") % 17).cast("string")))
    return c.books.select((F.col("id") - 1).alias("ordinal"), name.alias("name"))


_FRESH = "SELECT name, min(ordinal) AS o FROM new WHERE name NOT IN (SELECT name FROM authors) GROUP BY name"
_NUMBERED = "SELECT (SELECT max(id) FROM authors) + row_number() OVER (ORDER BY o) AS id, name FROM fresh"


@query(with_views("SELECT id, name FROM authors UNION ALL SELECT id, name FROM numbered", new=_NEW, fresh=_FRESH, numbered=_NUMBERED))
def insert_ignore(spark, sf_dir):
    c = derived(spark, sf_dir)
    return ops.insert_ignore(c.authors, _new(c), "name")


@query(with_views("SELECT id, CASE WHEN page_count > 250 THEN 'Changed ' || id ELSE title END AS title, CASE WHEN NOT page_count > 250 THEN isbn END AS isbn, CASE WHEN page_count > 250 THEN 1 ELSE page_count END AS page_count, genres FROM books"))
def update_full_row(spark, sf_dir):
    books = derived(spark, sf_dir).books
    changed = books.where("page_count > 250").withColumns({"title": F.concat(F.lit("Changed "), F.col("id").cast("string")), "isbn": F.lit(None).cast("string"), "page_count": F.lit(1)})
    return ops.update_rows(books, changed).select("id", "title", "isbn", "page_count", "genres")


@query(with_views("SELECT id, title, author_id, publisher_id FROM books WHERE (author_id IS NULL OR author_id NOT IN (2, 3)) AND (publisher_id IS NULL OR publisher_id <> 4)"))
def delete_cascade(spark, sf_dir):
    c = derived(spark, sf_dir)
    gone = ops.delete_parents(c, c.authors.where("id in (2, 3)").select("id"), c.publishers.where("id = 4").select("id"))
    return gone.books.select("id", "title", "author_id", "publisher_id")


@query(with_views("SELECT id, name FROM authors WHERE NOT ends_with(name, '7')"))
def delete_rows(spark, sf_dir):
    c = derived(spark, sf_dir)
    return ops.delete_rows(c.authors, c.authors.where(F.col("name").endswith("7")))


#: A batch of forms: every fifth updates its own book; others are new, some with a stored or a repeated ISBN.
_FORMS = """SELECT id AS ordinal, CASE WHEN id % 5 = 0 THEN id END AS own, 'Form ' || id AS title, CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN isbn WHEN 2 THEN 'X' || (id // 14)::VARCHAR WHEN 3 THEN ' ' ELSE 'N' || id END AS isbn,
    CASE id % 4 WHEN 0 THEN '  ' WHEN 1 THEN ' New author ' || (id % 6)::VARCHAR || ' ' WHEN 2 THEN 'Supplier#' || lpad((id % 50)::VARCHAR, 9, '0') END AS author_name,
    CASE WHEN id % 3 = 0 THEN 'Brand#' || (id % 60)::VARCHAR END AS publisher_name FROM books"""


def _forms(c):
    i = F.col("id")
    s = lambda e: e.cast("string")
    isbn = F.when(i % 7 == 0, None).when(i % 7 == 1, F.col("isbn")).when(i % 7 == 2, F.concat(F.lit("X"), s(F.expr("id div 14")))).when(i % 7 == 3, " ").otherwise(F.concat(F.lit("N"), s(i)))
    author = F.when(i % 4 == 0, "  ").when(i % 4 == 1, F.concat(F.lit(" New author "), s(i % 6), F.lit(" "))).when(i % 4 == 2, F.concat(F.lit("Supplier#"), F.lpad(s(i % 50), 9, "0")))
    publisher = F.when(i % 3 == 0, F.concat(F.lit("Brand#"), s(i % 60)))
    return c.books.withColumns({"ordinal": i, "title": F.concat(F.lit("Form "), s(i)), "isbn": isbn, "author_name": author, "publisher_name": publisher, "id": F.when(i % 5 == 0, i)})


_SAVED = {
    "forms": _FORMS,
    "held": "SELECT f.*, b.id AS holder FROM forms f LEFT JOIN books b ON f.isbn = b.isbn AND trim(f.isbn) <> ''",
    "open": "SELECT *, (holder IS NOT NULL AND holder IS DISTINCT FROM own) AS clash FROM held",
    "turn": "SELECT *, CASE WHEN NOT clash AND trim(isbn) <> '' THEN row_number() OVER (PARTITION BY isbn, clash ORDER BY ordinal) ELSE 1 END AS k FROM open",
    "good": "SELECT *, nullif(trim(author_name), '') AS an, nullif(trim(publisher_name), '') AS pn FROM turn WHERE NOT clash AND k = 1",
    "na": "SELECT an AS name, min(ordinal) AS o FROM good WHERE an IS NOT NULL AND an NOT IN (SELECT name FROM authors) GROUP BY an",
    "aa": "SELECT id, name FROM authors UNION ALL SELECT (SELECT max(id) FROM authors) + row_number() OVER (ORDER BY o), name FROM na",
    "np": "SELECT pn AS name, min(ordinal) AS o FROM good WHERE pn IS NOT NULL AND pn NOT IN (SELECT name FROM publishers) GROUP BY pn",
    "pp": "SELECT id, name FROM publishers UNION ALL SELECT (SELECT max(id) FROM publishers) + row_number() OVER (ORDER BY o), name FROM np",
    "linked": "SELECT g.*, aa.id AS author_id, pp.id AS publisher_id FROM good g LEFT JOIN aa ON aa.name = an LEFT JOIN pp ON pp.name = pn",
}


@query(with_views("""SELECT b.id, coalesce(l.title, b.title) AS title, CASE WHEN l.own IS NOT NULL THEN l.isbn ELSE b.isbn END AS isbn, CASE WHEN l.own IS NOT NULL THEN l.author_id ELSE b.author_id END AS author_id, CASE WHEN l.own IS NOT NULL THEN l.publisher_id ELSE b.publisher_id END AS publisher_id
    FROM books b LEFT JOIN linked l ON l.own = b.id UNION ALL SELECT (SELECT max(id) FROM books) + row_number() OVER (ORDER BY ordinal), title, isbn, author_id, publisher_id FROM linked WHERE own IS NULL""", **_SAVED))
def upsert_books(spark, sf_dir):
    c = derived(spark, sf_dir)
    return settled(spark, lambda: ops.save_books(c, _forms(c))[0].books.select("id", "title", "isbn", "author_id", "publisher_id"), "saved")


@query(with_views("SELECT ordinal, CASE WHEN clash OR k > 1 THEN 'isbn_conflict' ELSE 'saved' END AS status FROM turn", **_SAVED))
def upsert_status(spark, sf_dir):
    c = derived(spark, sf_dir)
    return settled(spark, lambda: ops.save_books(c, _forms(c))[1], "saved")


@query(with_views("SELECT id, name FROM aa", **_SAVED))
def get_or_create(spark, sf_dir):
    c = derived(spark, sf_dir)
    return ops.save_books(c, _forms(c))[0].authors


_V1 = "SELECT id, title, author_id, publisher_id, CASE id % 3 WHEN 0 THEN 'TEMP-' || id WHEN 1 THEN 'temp-' || id ELSE isbn END AS isbn, page_count, cover_image_uri FROM books"


def _v1(c):
    i = F.col("id")
    code = F.when(i % 3 == 0, F.concat(F.lit("TEMP-"), i.cast("string"))).when(i % 3 == 1, F.concat(F.lit("temp-"), i.cast("string"))).otherwise(F.col("isbn"))
    return c.books.withColumn("isbn", code).select(list(BASE_TYPES))


@query(with_views("SELECT * REPLACE (CASE WHEN isbn ILIKE 'TEMP-%' THEN NULL ELSE isbn END AS isbn) FROM v1", v1=_V1))
def migrate_1_2(spark, sf_dir):
    return ops.migrate_1_2(_v1(derived(spark, sf_dir)))


@query(with_views("SELECT v1.*, " + ", ".join(f"NULL::{ {'string': 'VARCHAR', 'int': 'INT'}.get(t, t.upper()) } AS {n}" for n, t in DETAIL_TYPES.items()) + " FROM v1", v1=_V1))
def migrate_2_3(spark, sf_dir):
    return ops.migrate_2_3(_v1(derived(spark, sf_dir)))


#: Forms as text: blanks, numbers with and without mistakes; every third form is a short one.
_TEXT = """SELECT id, CASE id % 11 WHEN 0 THEN ' ' ELSE ' ' || title || ' ' END AS title, CASE id % 13 WHEN 0 THEN '12x' WHEN 1 THEN '  ' ELSE page_count::VARCHAR END AS page_count, CASE id % 17 WHEN 0 THEN 'year' WHEN 1 THEN NULL ELSE publication_year::VARCHAR END AS publication_year,
    CASE id % 19 WHEN 0 THEN '1,5' ELSE ' ' || id || '.25 ' END AS purchase_price, CASE id % 23 WHEN 0 THEN '4 stars' WHEN 1 THEN '' ELSE '3.5' END AS rating, CASE id % 2 WHEN 0 THEN genres ELSE ' ' END AS genres, id % 7 = 0 AS signed, id % 3 <> 0 AS detailed,
    CASE id % 5 WHEN 0 THEN ' Typed publisher ' END AS publisher_name, 'A' AS author_name FROM books"""


def _text(c):
    i, s = F.col("id"), lambda e: e.cast("string")
    return c.books.select(
        "id",
        F.when(i % 11 == 0, " ").otherwise(F.concat(F.lit(" "), "title", F.lit(" "))).alias("title"),
        F.when(i % 13 == 0, "12x").when(i % 13 == 1, "  ").otherwise(s(F.col("page_count"))).alias("page_count"),
        F.when(i % 17 == 0, "year").when(i % 17 == 1, None).otherwise(s(F.col("publication_year"))).alias("publication_year"),
        F.when(i % 19 == 0, "1,5").otherwise(F.concat(F.lit(" "), s(i), F.lit(".25 "))).alias("purchase_price"),
        F.when(i % 23 == 0, "4 stars").when(i % 23 == 1, "").otherwise("3.5").alias("rating"),
        F.when(i % 2 == 0, F.col("genres")).otherwise(" ").alias("genres"),
        (i % 7 == 0).alias("signed"), (i % 3 != 0).alias("detailed"), F.when(i % 5 == 0, " Typed publisher ").alias("publisher_name"), F.lit("A").alias("author_name"),
    )


_PARSED = """SELECT id, nullif(trim(title), '') AS title, try_cast(nullif(trim(page_count), '') AS INT) AS page_count, try_cast(nullif(trim(publication_year), '') AS INT) AS publication_year, try_cast(nullif(trim(purchase_price), '') AS DOUBLE) AS purchase_price,
    try_cast(nullif(trim(rating), '') AS FLOAT) AS rating, nullif(trim(genres), '') AS genres, CASE WHEN signed THEN TRUE END AS signed, detailed, nullif(trim(publisher_name), '') AS publisher_name, author_name,
    CASE WHEN trim(title) = '' THEN 'title_required' WHEN id % 13 = 0 THEN 'pages_must_be_number' WHEN detailed AND id % 17 = 0 THEN 'year_must_be_number' WHEN detailed AND id % 19 = 0 THEN 'price_must_be_number' WHEN detailed AND id % 23 = 0 THEN 'rating_must_be_number' END AS error FROM typed"""


@query(with_views("SELECT * FROM parsed", typed=_TEXT, parsed=_PARSED))
def form_parse(spark, sf_dir):
    return ops.parse_form(_text(derived(spark, sf_dir)))


_OLD = "SELECT b.id, b.publication_year AS oy, b.purchase_price AS op, b.rating AS ra, b.genres AS og, b.signed AS os, p.name AS pn FROM books b JOIN publishers p ON b.publisher_id = p.id WHERE b.publication_year IS NOT NULL"


@query(with_views("""SELECT p.id, title, CASE WHEN k THEN coalesce(publication_year, oy) ELSE publication_year END AS publication_year, CASE WHEN k THEN op ELSE purchase_price END AS purchase_price, CASE WHEN k THEN ra ELSE rating END AS rating,
    CASE WHEN k THEN coalesce(genres, og) ELSE genres END AS genres, CASE WHEN k THEN os ELSE signed END AS signed, CASE WHEN k THEN coalesce(publisher_name, pn) ELSE publisher_name END AS publisher_name
    FROM (SELECT p.*, o.* EXCLUDE (id), NOT p.detailed AND o.id IS NOT NULL AS k FROM parsed p LEFT JOIN old o ON o.id = p.id) p""", typed=_TEXT, parsed=_PARSED, old=_OLD))
def save_mode(spark, sf_dir):
    c = derived(spark, sf_dir)
    old = c.books.where("publication_year is not null").join(c.publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher_name")), "publisher_id")
    out = ops.save_mode(ops.parse_form(_text(c)), old)
    return out.select("id", "title", "publication_year", "purchase_price", "rating", "genres", "signed", "publisher_name")


@query(with_views("""SELECT p_partkey AS id, CASE WHEN t AND ok THEN trim(p_name) WHEN NOT t THEN 'Typed' ELSE ' ' END AS title, CASE WHEN ok THEN 'Author ' || (p_partkey % 9) END AS author_name, CASE WHEN ok AND p_partkey % 2 = 0 THEN p_brand END AS publisher_name,
    CASE WHEN ok THEN p_type || ', ' || p_brand END AS genres, CASE WHEN t AND ok AND p_size > 0 THEN (p_size * 10)::VARCHAR WHEN NOT t THEN '7' ELSE '' END AS page_count, CASE WHEN ok THEN (CASE WHEN p_partkey % 3 = 0 THEN 2004 ELSE 1950 + p_partkey % 70 END)::VARCHAR END AS publication_year
    FROM (SELECT *, p_partkey % 4 < 2 AS t, p_partkey % 10 IN (0, 6, 7, 8, 9) AS ok FROM part)"""))
def fill_if_empty(spark, sf_dir):
    from ..functions.metadata import lookup
    from .codes import answers

    found = lookup(answers(spark, sf_dir))
    empty = F.col("p_partkey") % 4 < 2
    no = F.lit(None).cast("string")
    forms = found.select(F.col("p_partkey").alias("id"), F.concat(F.lit("978"), F.col("p_partkey").cast("string")).alias("isbn"), F.when(empty, " ").otherwise("Typed").alias("title"), no.alias("author_name"), no.alias("publisher_name"), no.alias("genres"), F.when(empty, "").otherwise("7").alias("page_count"), no.alias("publication_year"))
    return ops.fill_if_empty(forms, found.where("status = 'SUCCESS'").select("metadata.*")).drop("isbn")


@query(with_views("""SELECT id, title, CASE WHEN isbn ILIKE 'TEMP-%' AND starts_with(isbn, 'TEMP-') THEN '' ELSE coalesce(isbn, '') END AS isbn, CASE WHEN page_count > 0 THEN page_count::VARCHAR ELSE '' END AS page_count, coalesce(genres, '') AS genres, coalesce(publication_year::VARCHAR, '') AS publication_year, coalesce(signed, FALSE) AS signed
    FROM (SELECT b.* REPLACE (v1.isbn AS isbn) FROM books b JOIN v1 ON v1.id = b.id)""", v1=_V1))
def row_to_form(spark, sf_dir):
    c = derived(spark, sf_dir)
    books = c.books.drop("isbn").join(_v1(c).select("id", "isbn"), "id")
    return ops.to_form(books).select("id", "title", "isbn", "page_count", "genres", "publication_year", "signed")


@query(with_views("SELECT n.ordinal, CASE WHEN k = 1 AND f.id IS NOT NULL THEN f.id ELSE -1 END::BIGINT AS id, (SELECT count(*) FROM fresh)::BIGINT AS inserted FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ordinal) AS k FROM new) n LEFT JOIN numbered f ON f.name = n.name", new=_NEW, fresh=_FRESH, numbered=_NUMBERED))
def inserted_ids(spark, sf_dir):
    """What an insert of many rows returns: the identifier of each, -1 for ignored ones, and how many went in."""
    def build():
        c = derived(spark, sf_dir)
        done = ops.inserted(c.authors, _new(c), "name")
        return done.ids.withColumn("inserted", F.lit(done.inserted).cast("long"))

    return settled(spark, build, "ids")


@query(with_views("SELECT (SELECT count(*) FROM books WHERE page_count > 250)::BIGINT AS updated, (SELECT count(*) FROM books WHERE page_count <= 100)::BIGINT AS deleted, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids FROM books WHERE page_count > 100"))
def affected_counts(spark, sf_dir):
    """How many rows an update and a delete affect, and what is left."""
    def build():
        books = derived(spark, sf_dir).books
        changed = ops.updated(books, books.where("page_count > 250").withColumn("title", F.upper("title")))
        gone = ops.deleted(changed.table, changed.table.where("page_count <= 100").select("id"))
        counts = F.lit(changed.updated).cast("long").alias("updated"), F.lit(gone.deleted).cast("long").alias("deleted")
        return gone.table.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")).select(*counts, "n", "ids")

    return settled(spark, build, "counts")

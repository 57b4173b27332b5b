"""Writes of the catalogue as merges of DataFrames: the state goes in, the new state comes out.

Nothing is collected; save_books writes out what several of its results need. New identifiers continue after the largest one in the order of the input's ordinal, and are
dealt in blocks of ordinals, so that numbering does not pass through one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.strings import blank_to_null, present
from ..sources.catalogue import Catalogue
from ..sources.schemas import BASE_TYPES, BOOK_TYPES, DETAIL_TYPES
from ..storage import materialize

#: Ordinals that are numbered together.
BLOCK = 1 << 16


def number(rows: DataFrame, existing: DataFrame, ordinal: str) -> DataFrame:
    """rows with id: the largest of existing's, and then 1, 2, ... in the order of ordinal.

    ordinal is a whole number, unique in rows. Blocks of ordinals are counted, the counts added up, and rows numbered
    within their block.
    """
    block = F.floor(F.col(ordinal) / BLOCK)
    counts = rows.groupBy(block.alias("_block")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    counts = counts.select("_block", before.alias("_before")).crossJoin(F.broadcast(top))  # top is one row
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(ordinal))
    placed = rows.withColumn("_block", block).join(counts, "_block")
    return placed.withColumn("id", (F.col("_top") + F.col("_before") + inside).cast("bigint")).drop("_block", "_before", "_top")


def first_of(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Of rows with one key the one with the least ordinal; rows with a null key all stay."""
    rank = F.row_number().over(Window.partitionBy(key, F.when(F.col(key).isNull(), F.col(ordinal))).orderBy(ordinal))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def insert_ignore(table: DataFrame, new: DataFrame, unique: str, ordinal: str = "ordinal") -> DataFrame:
    """table and those rows of new whose unique key is neither there nor earlier in new; null keys never conflict."""
    return _with_fresh(table, first_of(new, unique, ordinal), unique, ordinal)


def _with_fresh(table: DataFrame, new: DataFrame, unique: str, ordinal: str) -> DataFrame:
    fresh = new.join(table.select(unique), unique, "left_anti")
    return table.unionByName(number(fresh, table, ordinal).select(table.columns))


def update_rows(table: DataFrame, changed: DataFrame) -> DataFrame:
    """table with whole rows replaced by those of changed with the same id, nulls included; other rows of changed are ignored."""
    other = [c for c in table.columns if c != "id"]
    right = changed.select(F.col("id"), F.struct(*other).alias("_new"))
    rows = table.join(right, "id", "left")
    return rows.select("id", *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in other]).select(table.columns)


def delete_rows(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti")


@dataclass(frozen=True)
class Written:
    """What a write returns: the new state as a written table, how many rows it inserted, updated and deleted, and the inserted rows' identifiers.

    ids: ordinal and id, -1 for rows that were ignored; None where nothing is inserted.
    """

    table: DataFrame
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    ids: DataFrame | None = None


def _written(rows: DataFrame, name: str, **counted: Column) -> tuple[DataFrame, dict[str, int]]:
    """rows without the columns that begin with an underscore, written out, and counts that were observed on the way: no second pass."""
    seen = Observation()
    marked = rows.observe(seen, *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in counted.items()])
    out = materialize(marked.select([c for c in rows.columns if not c.startswith("_")]), name)
    return out, seen.get


def inserted(table: DataFrame, new: DataFrame, unique: str, ordinal: str = "ordinal") -> Written:
    """insert_ignore() carried out, with the new identifier of each row of new, or -1."""
    fresh = materialize(number(first_of(new, unique, ordinal).join(table.select(unique), unique, "left_anti"), table, ordinal), "fresh")
    both = table.withColumn("_new", F.lit(False)).unionByName(fresh.select(table.columns).withColumn("_new", F.lit(True)))
    out, counts = _written(both, "inserted", inserted=F.col("_new"))
    ids = new.select(ordinal).join(fresh.select(ordinal, "id"), ordinal, "left").select(F.col(ordinal).alias("ordinal"), F.coalesce("id", F.lit(-1)).cast("long").alias("id"))
    return Written(out, inserted=counts["inserted"], ids=ids)


def updated(table: DataFrame, changed: DataFrame) -> Written:
    """update_rows() carried out, with the number of rows that changed has and table as well, whether their values differ or not."""
    other = [c for c in table.columns if c != "id"]
    rows = table.join(changed.select(F.col("id"), F.struct(*other).alias("_new")), "id", "left")
    rows = rows.select("id", *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in other], F.col("_new").isNotNull().alias("_hit")).select(*table.columns, "_hit")
    out, counts = _written(rows, "updated", updated=F.col("_hit"))
    return Written(out, updated=counts["updated"])


def deleted(table: DataFrame, ids: DataFrame) -> Written:
    """delete_rows() carried out, with the number of rows that went; both are counted on the rows as they are written."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    rows = table.join(gone, F.col("id") == F.col("_id"), "left")
    seen = Observation()
    out = materialize(rows.observe(seen, F.count("_id").alias("n")).where("_id is null").select(table.columns), "deleted")
    return Written(out, deleted=seen.get["n"])


def delete_parents(c: Catalogue, authors: DataFrame | None = None, publishers: DataFrame | None = None) -> Catalogue:
    """The catalogue without some authors and publishers (tables of id) and without the books that refer to them."""
    books, kept_a, kept_p = c.books, c.authors, c.publishers
    if authors is not None:
        kept_a, books = delete_rows(kept_a, authors), books.join(authors.select(F.col("id").alias("author_id")), "author_id", "left_anti")
    if publishers is not None:
        kept_p, books = delete_rows(kept_p, publishers), books.join(publishers.select(F.col("id").alias("publisher_id")), "publisher_id", "left_anti")
    return Catalogue(books.select(c.books.columns), kept_a, kept_p)


def get_or_create(dimension: DataFrame, rows: DataFrame, name: str, ordinal: str) -> DataFrame:
    """dimension with a row for each trimmed, non-blank name of rows that it lacks, in order of first use."""
    wanted = rows.select(blank_to_null(F.col(name)).alias("name"), F.col(ordinal).alias("ordinal")).where("name is not null")
    wanted = wanted.groupBy("name").agg(F.min("ordinal").alias("ordinal"))
    return _with_fresh(dimension, wanted, "name", "ordinal")


def save_books(c: Catalogue, forms: DataFrame) -> tuple[Catalogue, DataFrame]:
    """Save a batch of books with author and publisher names; the new catalogue and a status for each row.

    forms: ordinal, author_name, publisher_name and the columns of books without the two references; id is null or 0 for a
    new book. A non-blank ISBN that another stored book has, or an earlier row of the batch, is a conflict and nothing
    of its row is saved. Of several updates of one book the earliest counts. Status: saved or isbn_conflict.
    """
    rows = forms.withColumn("_id", F.when(F.coalesce(F.col("id"), F.lit(0)) != 0, F.col("id")))
    rows = rows.withColumn("_key", F.when(present(F.col("isbn")), F.col("isbn")))
    # a form without ISBN meets no book; a key of its own keeps all of them from one task
    alone = F.concat(F.lit("\u0000"), F.col("ordinal").cast("string"))
    held = c.books.where("isbn is not null").select(F.col("isbn").alias("_isbn"), F.col("id").alias("_holder"))
    rows = rows.join(held, F.coalesce("_key", alone) == F.col("_isbn"), "left")
    clash = F.col("_isbn").isNotNull() & ~F.col("_holder").eqNullSafe(F.col("_id"))
    rows = rows.withColumn("_clash", clash).withColumn("_key", F.coalesce(F.when(~F.col("_clash"), F.col("_key")), alone))
    again = F.row_number().over(Window.partitionBy("_key").orderBy("ordinal")) > 1
    rows = materialize(rows.withColumn("_clash", F.col("_clash") | again).drop("_isbn", "_holder", "_key"), "forms")
    status = rows.select("ordinal", F.when(F.col("_clash"), "isbn_conflict").otherwise("saved").alias("status"))
    good = rows.where(~F.col("_clash")).drop("_clash")
    authors, publishers = (materialize(get_or_create(d, good, f"{n}_name", "ordinal"), f"{n}s") for d, n in ((c.authors, "author"), (c.publishers, "publisher")))
    a, p = authors.select(F.col("id").alias("author_id"), F.col("name").alias("_an")), publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("_pn"))
    name = lambda n: F.coalesce(blank_to_null(F.col(n)), alone)
    linked = good.drop("author_id", "publisher_id").join(a, name("author_name") == F.col("_an"), "left").join(p, name("publisher_name") == F.col("_pn"), "left")
    linked = materialize(linked.drop("_an", "_pn"), "linked")
    changed = first_of(linked.where("_id is not null").withColumn("id", F.col("_id")), "id", "ordinal").select(c.books.columns)
    fresh = number(linked.where("_id is null").drop("id"), c.books, "ordinal").select(c.books.columns)
    return Catalogue(update_rows(c.books, changed).unionByName(fresh), authors, publishers), status


def migrate_1_2(books: DataFrame) -> DataFrame:
    """Version 1 to 2: placeholder ISBNs (TEMP-, in any case) become null."""
    return books.withColumn("isbn", F.when(~F.coalesce(F.col("isbn").ilike("TEMP-%"), F.lit(False)), F.col("isbn"))).select(list(BASE_TYPES))


def migrate_2_3(books: DataFrame) -> DataFrame:
    """Version 2 to 3: the detail columns are added as nulls."""
    return books.select(*[F.col(n).cast(t) if n in BASE_TYPES else F.lit(None).cast(t).alias(n) for n, t in BOOK_TYPES.items()])


#: Numeric form fields, in the order in which they are checked: column, type, error.
NUMBERS = (("page_count", "int", "pages_must_be_number"), ("publication_year", "int", "year_must_be_number"), ("purchase_price", "double", "price_must_be_number"), ("rating", "float", "rating_must_be_number"))


def parse_form(forms: DataFrame) -> DataFrame:
    """forms (all fields as text, signed as boolean) with typed columns and error.

    Text is trimmed and blank becomes null; signed is true or null. error names the first thing that is wrong: a missing
    title, pages, or, where detailed is true, year, price or rating; else it is null.
    """
    checks = F.when(~present(F.col("title")), "title_required")
    values = {}
    for name, kind, error in NUMBERS:
        text = blank_to_null(F.col(name))
        values[name] = text.try_cast(kind)
        wrong = text.isNotNull() & text.try_cast(kind).isNull()
        checks = checks.when(wrong if name == "page_count" else wrong & F.col("detailed"), error)
    texts = [n for n, t in BOOK_TYPES.items() if t == "string"] + ["author_name", "publisher_name"]
    values |= {n: blank_to_null(F.col(n)) for n in texts if n in forms.columns}
    if "signed" in forms.columns:
        values["signed"] = F.when(F.col("signed"), True)
    return forms.select(*[values.get(n, F.col(n)).alias(n) for n in forms.columns], checks.alias("error"))


def save_mode(parsed: DataFrame, old: DataFrame) -> DataFrame:
    """The row that a form saves. old: stored details by id, with publisher_name.

    A detailed form, and any form of a new book, gives all its own fields. A short form of a stored book keeps the stored
    details, but genres, year and publisher that were typed win.
    """
    names = [n for n in DETAIL_TYPES if n in parsed.columns]
    stored = old.select(F.col("id").alias("_id"), F.struct(*names, "publisher_name").alias("_old"))
    rows = parsed.join(stored, F.col("id") == F.col("_id"), "left").drop("_id")
    keep = ~F.col("detailed") & F.col("_old").isNotNull()
    out = {}
    for n in [*names, "publisher_name"]:
        typed = n in ("genres", "publication_year", "publisher_name")
        out[n] = F.when(keep, F.coalesce(F.col(n), F.col(f"_old.{n}")) if typed else F.col(f"_old.{n}")).otherwise(F.col(n))
    return rows.withColumns(out).drop("_old")


def fill_if_empty(forms: DataFrame, metadata: DataFrame, on: str = "isbn") -> DataFrame:
    """forms with what metadata knows of empty fields: title, author, publisher, genres, pages (above 0) and year."""
    m = metadata.select(F.col(on).alias("_on"), F.struct("title", "author", "publisher", "genres", "page_count", "publication_year").alias("_m"))
    rows = forms.join(m, F.col(on) == F.col("_on"), "left")

    def text(name: str, source: str) -> Column:
        new = F.col(f"_m.{source}")
        return F.when(present(new) & ~present(F.col(name)), new).otherwise(F.col(name))

    pages, year = F.col("_m.page_count"), F.col("_m.publication_year")
    out = {n: text(n, s) for n, s in (("title", "title"), ("author_name", "author"), ("publisher_name", "publisher"), ("genres", "genres"))}
    out["page_count"] = F.when(~present(F.col("page_count")) & (pages > 0), pages.cast("string")).otherwise(F.col("page_count"))
    out["publication_year"] = F.when(~present(F.col("publication_year")) & year.isNotNull(), year.cast("string")).otherwise(F.col("publication_year"))
    return rows.withColumns(out).drop("_on", "_m")


def to_form(books: DataFrame) -> DataFrame:
    """books as form text: placeholder ISBNs and page counts of 0 or less are left out; null is empty."""
    from .catalogue import shown_isbn

    special = {"isbn": shown_isbn(F.col("isbn")), "page_count": F.when(F.col("page_count") > 0, F.col("page_count").cast("string")), "signed": F.coalesce(F.col("signed"), F.lit(False))}
    return books.select(*[F.coalesce(special.get(n, F.col(n)).cast("string"), F.lit("")).alias(n) if n not in ("id", "signed") else special.get(n, F.col(n)).alias(n) for n in BOOK_TYPES])



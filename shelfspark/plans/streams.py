"""Queries of streams, on tables: the same plan without a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.catalogue import derived, table, with_views
from ..storage import scratch, settled
from ..streaming import changes
from ..streaming.live import event_counts
from .registry import query


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def daily_events(spark, sf_dir):
    counts = event_counts(table(spark, sf_dir, "events"))
    return counts.withColumn("start", counts["start"].cast("timestamp_ntz"))


@query(with_views("""SELECT id, CASE WHEN id % 3 = 0 THEN title || ' revised' ELSE title END AS title, CASE WHEN id % 3 = 0 THEN id % 9 + 1 ELSE author_id END AS author_id, isbn, n.name AS author_name
    FROM (SELECT * FROM books WHERE id % 5 <> 0) b LEFT JOIN (SELECT id AS a, CASE WHEN id % 4 = 0 THEN upper(name) ELSE name END AS name FROM authors WHERE id <> 6) n ON a = CASE WHEN b.id % 3 = 0 THEN b.id % 9 + 1 ELSE b.author_id END"""))
def observed_books(spark, sf_dir):
    """Books with authors kept up by changes: all inserted, then a third of the books revised, a fifth deleted, authors renamed and one deleted."""
    c = derived(spark, sf_dir)
    name = lambda n: F.lit(None).cast(n)
    book = lambda rows, kind, seq, title, author: rows.select(F.lit("books").alias("table"), F.lit(kind).alias("kind"), F.lit(seq).cast("long").alias("seq"), "id", title.alias("title"), author.alias("author_id"), "isbn", name("string").alias("name"))
    person = lambda rows, kind, seq, n: rows.select(F.lit("authors").alias("table"), F.lit(kind).alias("kind"), F.lit(seq).cast("long").alias("seq"), "id", name("string").alias("title"), name("long").alias("author_id"), name("string").alias("isbn"), n.alias("name"))
    title, author, own = F.col("title"), F.col("author_id"), F.col("name")
    batches = [
        book(c.books, changes.INSERT, 1, title, author).union(person(c.authors, changes.INSERT, 1, own)),
        book(c.books.where("id % 3 = 0"), changes.UPDATE, 2, F.concat(title, F.lit(" revised")), (F.col("id") % 9 + 1).cast("long")).union(person(c.authors.where("id % 4 = 0"), changes.UPDATE, 2, F.upper(own))),
        book(c.books.where("id % 5 = 0"), changes.DELETE, 3, title, author).union(person(c.authors.where("id = 6"), changes.DELETE, 3, own)),
    ]

    def build():
        stored = changes.Stored(spark, scratch(spark, "observed"))
        for k, batch in enumerate(batches):
            changes.apply(stored, batch, k)
        return stored.table("books")

    return settled(spark, build, "observed-books")

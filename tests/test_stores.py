"""Data sources, the trigram index, changes and the latch: whole results against plain ones, work counted."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import catalogue, trigrams
from shelfspark.operators.codes import first_hits
from shelfspark.sources import stores
from shelfspark.sources.catalogue import Catalogue
from shelfspark.streaming import changes as feed
from shelfspark.streaming import latch


def explained(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_answers_are_found_by_isbn(spark, tmp_path):
    rows = [(f"978{i}", 503 if i % 7 == 0 else 200, None if i % 5 == 0 else f'{{"t": "Ünï {i}\\n"}}') for i in range(300)] + [(None, 200, "x")]
    path = f"file://{tmp_path}/a"
    stores.store_answers(spark.createDataFrame(rows, stores.ANSWERS), path, 16)
    stores.register(spark)
    read = spark.read.format("stored_answers").option("buckets", 16).load(path)
    assert sorted(map(tuple, read.collect())) == sorted(rows[:-1]) and read.rdd.getNumPartitions() == 16
    some = read.where("isbn in ('9784', '97811', 'none') and http_code = 200")
    assert sorted(r.isbn for r in some.collect()) == ["97811", "9784"]
    reader = stores.AnswersReader(path, 16)
    left = [*reader.pushFilters([stores.EqualTo(("isbn",), "9784"), stores.EqualTo(("http_code",), 200)])]
    assert [f.attribute for f in left] == [("http_code",)] and len(reader.partitions()) == 1 and len([*reader.read(reader.partitions()[0])]) == 1
    assert read.where("isbn = '9784'").rdd.getNumPartitions() == 1 and "PushedFilters: [IsNotNull(isbn), EqualTo(isbn,9784)]" in explained(read.where("isbn = '9784'")) and "* Filter" not in explained(read.where("isbn = '9784'"))


def test_ladder_and_whole_files(spark, tmp_path):
    """The first whole payload is taken; a failing task and a repeated one leave no partial file."""
    big = lambda c: bytes([c]) * 60
    payloads = spark.createDataFrame([("a", 1, big(1)), ("a", 0, b"cut"), ("b", 0, big(2)), ("b", 1, big(3)), ("c", 0, None), ("c", 1, b"short"), ("d", 0, big(4))], "code string, mirror int, content binary")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("b",), ("e",)], "code string")
    whole = stores.first_whole(wanted, payloads, 50)
    assert {(r.name, r.content[0]) for r in whole.collect()} == {("a.traineddata", 1), ("b.traineddata", 2)}
    stores.register(spark)
    path = tmp_path / "packs"
    path.mkdir()
    (path / "a.traineddata").write_bytes(b"old")
    whole.write.format("whole_files").option("least", 50).mode("append").save(f"file://{path}")
    assert {f.name: f.read_bytes()[:1] for f in path.iterdir()} == {"a.traineddata": b"\1", "b.traineddata": b"\2"}
    broken = spark.createDataFrame([("x", big(5)), ("y", b"short"), ("z", big(6))], "name string, content binary").repartition(3)
    with pytest.raises(Exception, match="fewer than"):
        broken.write.format("whole_files").option("least", 50).mode("append").save(f"file://{path}")
    assert {f.name for f in path.iterdir()} == {"a.traineddata", "b.traineddata"}
    writer = stores.WholeFilesWriter(f"file://{path}", 50)
    row = payloads.selectExpr("code as name", "content").where("name = 'd'").collect()
    first, again = writer.write(iter(row)), writer.write(iter(row))  # two attempts of one task; the second is told
    assert first.files != again.files and not (path / "d").exists()
    writer.commit([again, None])
    assert (path / "d").read_bytes() == big(4) and len([*path.iterdir()]) == 3
    writer.abort([None])


TITLES = ["Candle and Handle", "The handling of %", "ÉLÈVE one", "élève two", "x", None, "Straße İstanbul", "candle"] * 12


def library(spark):
    books = [(i, t, i % 7 if i % 5 else None, f"97800{i:04d}") for i, t in enumerate(TITLES)]
    authors = [(i, n) for i, n in enumerate(["Candlemaker", "Ann Other", "Élise", "hand", "Zoë Q", "a_b", "STRASSE"])]
    return Catalogue(spark.createDataFrame(books, "id long, title string, author_id long, isbn string"), spark.createDataFrame(authors, "id long, name string"), None)


def test_search_by_index(spark, tmp_path):
    """The rows of every search are those of the scan; an indexed one reads few postings."""
    c = library(spark)
    books, authors = trigrams.build(c.books, ["title", "isbn"], f"file://{tmp_path}/b"), trigrams.build(c.authors, ["name"], f"file://{tmp_path}/a")
    plain = lambda df: sorted(map(str, df.collect()))
    for needle in ["candle", "HANDL", "élève", "andl", "e", "ha", "%", "a_b", "97800001", "nothing", "straße", "İst", "istanbul", "\\", "ann other"]:
        assert plain(trigrams.search_all(c, books, authors, needle)) == plain(catalogue.search_all(c, needle)), needle
        assert plain(trigrams.search_title(c, books, needle)) == plain(catalogue.search_title(c, needle))
        assert plain(trigrams.search_isbn(c, books, needle)) == plain(catalogue.search_isbn(c, needle))
        assert plain(trigrams.search_author(c, authors, needle)) == plain(catalogue.search_author(c, needle))
    found = trigrams.candidates(books, "97800001", ["isbn"])
    assert "PartitionFilters: [isnotnull(bucket" in explained(found).replace("[bucket", "[isnotnull(bucket") and "In(gram" in explained(found)
    read = books.where(F.col("bucket").isin([r.bucket for r in books.where("gram in ('handl', 'ndl')").select("bucket").distinct().collect()]))
    assert 0 < read.count() < books.count() / 10


CHANGES = [
    [("authors", "insert", 1, 1, None, None, None, "Ann"), ("authors", "insert", 2, 2, None, None, None, "Bob"), ("books", "insert", 3, 10, "Ten", 1, "i10", None), ("books", "insert", 4, 11, "Eleven", 2, None, None), ("books", "insert", 5, 12, "Twelve", None, None, None), ("books", "insert", 6, 13, "Thirteen", 9, None, None)],
    [("authors", "update", 7, 1, None, None, None, "Anne"), ("books", "update", 8, 11, "Eleven again", 1, "i11", None), ("books", "update", 9, 11, "Eleven at last", 1, "i11", None), ("books", "delete", 10, 12, None, None, None, None), ("books", "delete", 11, 99, None, None, None, None)],
    [("authors", "insert", 12, 9, None, None, None, "Nine"), ("authors", "delete", 13, 2, None, None, None, None), ("books", "insert", 14, 14, "Fourteen", 2, None, None)],
    [("authors", "update", 15, 1, None, None, None, "Anna")],
    [("books", "delete", 16, 10, None, None, None, None), ("books", "insert", 17, 10, "Ten anew", 9, None, None)],
]


def test_changes_keep_the_result_up(spark, tmp_path):
    """After each batch the stored result is that of the whole query; a batch that runs again changes nothing, and few folders are written."""
    source, state = tmp_path / "in", f"file://{tmp_path}/state"
    books, authors, seen = {}, {}, []
    for k, rows in enumerate(CHANGES):
        spark.createDataFrame(rows, feed.CHANGE).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema(feed.CHANGE).parquet(f"file://{source}")
        feed.observe(stream, state, f"file://{tmp_path}/check", lambda df, n: seen.append((n, df.count())), buckets=8).awaitTermination()
        for table, kind, _, key, title, author, isbn, name in sorted(rows, key=lambda r: r[2]):
            at, value = (books, (title, author, isbn)) if table == "books" else (authors, name)
            at.pop(key, None) if kind == "delete" else at.update({key: value})
        stored = feed.Stored(spark, state, 8)
        want = sorted((i, *b, authors.get(b[1])) for i, b in books.items())
        assert sorted(map(tuple, stored.table("books").collect())) == want and dict(map(tuple, stored.table("authors").collect())) == authors
        assert sorted(map(tuple, stored.table("by_author").collect())) == sorted((b[1], i) for i, b in books.items() if b[1] is not None)
        before = json.dumps(stored.manifest)
        feed.apply(stored, spark.createDataFrame(rows, feed.CHANGE), k)
        assert json.dumps(feed.Stored(spark, state, 8).manifest) == before
    assert [n for n, _ in seen] == list(range(len(CHANGES)))
    many = [("books", "insert", 100 + i, 1000 + i, f"t{i}", 1, None, None) for i in range(400)]
    big = feed.Stored(spark, f"file://{tmp_path}/big", 64)
    feed.apply(big, spark.createDataFrame(many, feed.CHANGE), 0)
    feed.apply(big, spark.createDataFrame([("books", "update", 900, 1007, "new", None, None, None)], feed.CHANGE), 1)
    assert len(big.manifest["books"]) > 40 and [v for v in big.manifest["books"].values()].count("1") == 1
    assert len(glob.glob(f"{tmp_path}/big/books/1/bucket=*")) == 1 and big.table("books").count() == 400


def test_latch_on_a_stream(spark, tmp_path):
    """Exactly one hit a frame over several micro-batches with late rows: those of the table."""
    rows = [(f, f * 100 + i, f" code{f}-{i} " if (f + i) % 6 else "x", float(i * 97 % 640), float(i * 53 % 480), f % 4 * 90, f * 1000 + i) for f in range(12) for i in range(20)]
    columns = "frame long, id long, raw string, cx double, cy double, rotation int, at long"
    zone = F.struct(F.lit(140.0).alias("l"), F.lit(660.0).alias("t"), F.lit(940.0).alias("r"), F.lit(1260.0).alias("b"))
    seen = lambda df: df.withColumn("ts", F.timestamp_millis("at")).drop("at")
    size = ((640.0, 480.0), (1080.0, 1920.0))
    want = {(r.frame, r.id, r.raw) for r in first_hits(seen(spark.createDataFrame(rows, columns)), zone, *size).collect()}
    late = [[r for r in rows if r[1] % 3 == 1], [r for r in rows if r[1] % 3 == 0], [r for r in rows if r[1] % 3 == 2], [(99, 9_999, "end of all", 0.0, 0.0, 0, 10**7)]]
    for part in [*late, [(98, 9_998, "and once more", 0.0, 0.0, 0, 10**7 + 1)]]:
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = seen(spark.readStream.schema(columns).parquet(f"file://{tmp_path}/in"))
        out = latch.hits(stream, zone, *size, late="30 seconds").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/check").outputMode("append")
        out.trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
    got = [(r.frame, r.id, r.raw) for r in spark.read.schema(latch.HIT).parquet(f"file://{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and {g for g in got if g[0] < 90} == want and len(want) > 6
    assert os.path.isdir(tmp_path / "check")

"""Queries of identifiers and metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import metadata as meta
from ..operators.codes import first_hits
from ..sources.catalogue import derived, table, with_views
from .registry import query

#: Scanned codes: ISBNs with hyphens, in lower case with blanks, with a wrong last digit, cut to ten characters, ISBN-10s,
#: ISBN-10s with a wrong check character, ASINs and short codes.
_TEN = "lpad((id * 7919 % 1000000000)::VARCHAR, 9, '0')"
_SUM10 = " + ".join(f"substr({_TEN}, {i + 1}, 1)::INT * {10 - i}" for i in range(9))
_CODES = f"""SELECT id, CASE id % 9 WHEN 0 THEN substr(isbn, 1, 3) || '-' || substr(isbn, 4) WHEN 1 THEN ' ' || lower(isbn) || ' '
    WHEN 2 THEN substr(isbn, 1, 12) || ((substr(isbn, 13, 1)::INT + 1) % 10)::VARCHAR WHEN 3 THEN substr(isbn, 1, 10)
    WHEN 4 THEN {_TEN} || CASE WHEN c10 = 10 THEN 'X' ELSE c10::VARCHAR END WHEN 5 THEN {_TEN} || ((c10 + 1) % 10)::VARCHAR
    WHEN 6 THEN 'b0' || substr({_TEN}, 1, 8) WHEN 7 THEN '12' WHEN 8 THEN isbn END AS raw
    FROM (SELECT id, isbn, (11 - ({_SUM10}) % 11) % 11 AS c10 FROM books)"""


def codes(spark, sf_dir) -> DataFrame:
    b = derived(spark, sf_dir).books.select("id", "isbn")
    ten = F.lpad((F.col("id") * 7919 % 1000000000).cast("string"), 9, "0")
    total = sum((F.substring(ten, i + 1, 1).cast("int") * (10 - i) for i in range(9)), F.lit(0))
    b = b.withColumns({"ten": ten, "c10": (11 - total % 11) % 11})
    cut = lambda c, a, n: F.substring(c, a, n)
    arms = [
        F.concat(cut("isbn", 1, 3), F.lit("-"), cut("isbn", 4, 99)), F.concat(F.lit(" "), F.lower("isbn"), F.lit(" ")),
        F.concat(cut("isbn", 1, 12), ((cut("isbn", 13, 1).cast("int") + 1) % 10).cast("string")), cut("isbn", 1, 10),
        F.concat("ten", F.when(F.col("c10") == 10, "X").otherwise(F.col("c10").cast("string"))), F.concat("ten", ((F.col("c10") + 1) % 10).cast("string")),
        F.concat(F.lit("b0"), cut("ten", 1, 8)), F.lit("12"), F.col("isbn"),
    ]
    raw = F.when(F.col("id") % 9 == 0, arms[0])
    for k, arm in enumerate(arms[1:], 1):
        raw = raw.when(F.col("id") % 9 == k, arm)
    return b.select("id", raw.alias("raw"))


_NORM = "upper(regexp_replace(coalesce(raw, ''), '[\\s-]', '', 'g'))"
_N13 = " + ".join(f"substr(code, {i + 1}, 1)::INT * {1 if i % 2 == 0 else 3}" for i in range(13))
_N10 = " + ".join(f"substr(code, {i + 1}, 1)::INT * {10 - i}" for i in range(9)) + " + CASE WHEN substr(code, 10, 1) = 'X' THEN 10 ELSE substr(code, 10, 1)::INT END"
_I13 = f"CASE WHEN regexp_full_match(code, '97[89][0-9]{{10}}') THEN ({_N13}) % 10 = 0 ELSE FALSE END"
_I10 = f"CASE WHEN regexp_full_match(code, '[0-9]{{9}}[0-9X]') THEN ({_N10}) % 11 = 0 ELSE FALSE END"
_JUDGED = f"SELECT id, raw, code, {_I13} AS isbn13, {_I10} AS isbn10 FROM (SELECT *, {_NORM} AS code FROM codes)"
_KIND = "CASE WHEN isbn13 OR isbn10 THEN 'ISBN' WHEN regexp_full_match(code, '[A-Z0-9]{10}') THEN 'ASIN' ELSE 'OTHER' END"


def _code_sql(what: str) -> str:
    return with_views(f"SELECT id, {what} FROM judged", codes=_CODES, judged=_JUDGED)


@query(_code_sql("code"))
def normalised_codes(spark, sf_dir):
    return codes(spark, sf_dir).select("id", ids.normalise(F.col("raw")).alias("code"))


@query(_code_sql("isbn13"))
def isbn13_valid(spark, sf_dir):
    return codes(spark, sf_dir).select("id", ids.is_isbn13(ids.normalise(F.col("raw"))).alias("isbn13"))


@query(_code_sql("isbn10, regexp_full_match(code, '[A-Z0-9]{10}') AND NOT isbn10 AS asin"))
def isbn10_valid(spark, sf_dir):
    code = ids.normalise(F.col("raw"))
    return codes(spark, sf_dir).select("id", ids.is_isbn10(code).alias("isbn10"), ids.is_asin(code).alias("asin"))


@query(_code_sql(f"{_KIND} AS kind, CASE WHEN {_KIND} = 'OTHER' THEN regexp_replace(raw, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') ELSE code END AS value"))
def classify_code(spark, sf_dir):
    return codes(spark, sf_dir).select("id", ids.classify(F.col("raw")).alias("kind"), ids.returned_value(F.col("raw")).alias("value"))


_ROUTED = f"CASE id % 4 WHEN 0 THEN 'ISBN' WHEN 1 THEN 'TITLE_TEXT' ELSE {_KIND} END"


@query(_code_sql(f"CASE {_ROUTED} WHEN 'ISBN' THEN 'isbn' WHEN 'ASIN' THEN 'asin' WHEN 'TITLE_TEXT' THEN CASE WHEN id % 8 = 1 THEN 'series_name' ELSE 'title' END END AS field"))
def route_scan(spark, sf_dir):
    kind = F.when(F.col("id") % 4 == 0, "ISBN").when(F.col("id") % 4 == 1, "TITLE_TEXT").otherwise("BARCODE?")
    pending = F.when(F.col("id") % 8 == 1, "series_name")
    return codes(spark, sf_dir).select("id", ids.route(kind, F.col("raw"), pending).alias("field"))


#: Barcodes seen in frames: 7 a frame, in a camera image of 640 x 480 shown in a view of 1080 x 1920.
_SEEN = "SELECT id // 7 AS frame, id, raw, (id * 37 % 640)::DOUBLE AS cx, (id * 53 % 480)::DOUBLE AS cy, (id // 7 % 4 * 90)::INT AS rotation FROM codes"


@query(with_views("""SELECT frame, id, trim(raw) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY id) AS k FROM (
    SELECT *, CASE WHEN rotation IN (90, 270) THEN 480 ELSE 640 END AS w, CASE WHEN rotation IN (90, 270) THEN 640 ELSE 480 END AS h, greatest(1080.0::DOUBLE / w, 1920.0::DOUBLE / h) AS s,
    cx * s + (1080 - w * s) / 2 AS x, cy * s + (1920 - h * s) / 2 AS y FROM seen WHERE length(trim(raw)) >= 3) WHERE x >= 140 AND x < 940 AND y >= 660 AND y < 1260) WHERE k = 1""", codes=_CODES, seen=_SEEN))
def zone_hits(spark, sf_dir):
    from ..functions.strings import trimmed

    seen = codes(spark, sf_dir).select(F.expr("id div 7").alias("frame"), "id", "raw", (F.col("id") * 37 % 640).cast("double").alias("cx"), (F.col("id") * 53 % 480).cast("double").alias("cy"), F.expr("cast(id div 7 % 4 * 90 as int)").alias("rotation"))
    zone = F.struct(F.lit(140.0).alias("l"), F.lit(660.0).alias("t"), F.lit(940.0).alias("r"), F.lit(1260.0).alias("b"))
    return first_hits(seen, zone, (640.0, 480.0), (1080.0, 1920.0)).select("frame", "id", "raw")


#: Lookup answers made from parts: documents with one book, empty documents, broken text, failures.
_BOOK_JSON = """'{"ISBN:' || p_partkey || '": {"title": " ' || p_name || ' ", "authors": [{"name": "Author ' || (p_partkey % 9) || '"}, {"name": "Other"}], "number_of_pages": ' || (p_size * 10) || ', "publish_date": "May ' || (1950 + p_partkey % 70) || CASE WHEN p_partkey % 3 = 0 THEN ', reprint 2004' ELSE '' END || '", "subjects": [{"name": "' || p_type || '"}, {"name": "  "}, {"name": "' || p_brand || '"}]' || CASE WHEN p_partkey % 2 = 0 THEN ', "publishers": [{"name": "' || p_brand || '"}], "cover": {"small": "s", "large": "l' || p_partkey || '"}' ELSE '' END || '}}'"""
_ANSWERS = f"SELECT p_partkey, p_name, p_brand, p_type, p_size, CASE WHEN p_partkey % 10 = 1 THEN ' - ' ELSE '978-' || p_partkey END AS isbn, CASE WHEN p_partkey % 10 = 2 THEN 503 ELSE 200 END AS http_code, CASE p_partkey % 10 WHEN 3 THEN NULL WHEN 4 THEN '{{}}' WHEN 5 THEN '{{broken' ELSE {_BOOK_JSON} END AS body FROM part"


def answers(spark, sf_dir) -> DataFrame:
    view = f"_answers_{uuid.uuid4().hex}"  # of no other query
    table(spark, sf_dir, "part").createTempView(view)
    try:
        return spark.sql(_ANSWERS.replace("FROM part", f"FROM {view}"))
    finally:
        spark.catalog.dropTempView(view)


_STATUS = "CASE WHEN p_partkey % 10 = 1 THEN 'NOT_FOUND' WHEN p_partkey % 10 IN (2, 3, 5) THEN 'NETWORK_ERROR' WHEN p_partkey % 10 = 4 THEN 'NOT_FOUND' ELSE 'SUCCESS' END"


@query(f"""SELECT p_partkey, status, CASE WHEN ok THEN trim(p_name) END AS title, CASE WHEN ok THEN 'Author ' || (p_partkey % 9) END AS author, CASE WHEN ok AND p_partkey % 2 = 0 THEN p_brand END AS publisher,
    CASE WHEN ok THEN p_size * 10 END AS page_count, CASE WHEN ok THEN (CASE WHEN p_partkey % 3 = 0 THEN 2004 ELSE 1950 + p_partkey % 70 END)::INT END AS publication_year, CASE WHEN ok THEN p_type || ', ' || p_brand END AS genres,
    CASE WHEN ok AND p_partkey % 2 = 0 THEN 'l' || p_partkey END AS cover_url, CASE WHEN ok THEN '978' || p_partkey END AS isbn, coalesce(ok, FALSE) AS detailed
    FROM (SELECT *, {_STATUS} AS status, {_STATUS} = 'SUCCESS' AS ok FROM part)""")
def metadata_flat(spark, sf_dir):
    rows = meta.lookup(answers(spark, sf_dir))
    return rows.select("p_partkey", "status", "metadata.*", F.coalesce(meta.has_details(F.col("metadata")), F.lit(False)).alias("detailed"))


_DATES = "CASE p_partkey % 4 WHEN 0 THEN 'June 1998, reprint ' || (1900 + p_partkey % 200) WHEN 1 THEN p_name WHEN 2 THEN '2' || (p_partkey % 100) || '0045' ELSE '19' || p_partkey END"


@query(f"SELECT p_partkey, list_extract(regexp_extract_all({_DATES}, '((?:19|20)[0-9]{{2}})', 1), -1)::INT AS year FROM part")
def year_last(spark, sf_dir):
    text = F.expr(_DATES)
    return table(spark, sf_dir, "part").select("p_partkey", meta.year(text).alias("year"))


@query("""SELECT o_custkey, nullif(array_to_string((list_filter(list_transform(list(o_orderpriority ORDER BY o_orderkey), lambda x: trim(x)), lambda x: length(x) > 0 AND x <> '5-LOW'))[1:8], ', '), '') AS genres FROM orders GROUP BY o_custkey""")
def genres_joined(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"))
    names = F.transform("s", lambda x: F.struct(F.when(x["o_orderpriority"] == "5-LOW", F.lit(" \t")).otherwise(x["o_orderpriority"]).alias("name")))
    return o.select("o_custkey", meta.genres(names).alias("genres"))


@query("SELECT event_id, (regexp_extract(props, '\"k\": *(-?[0-9]+)', 1))::BIGINT AS k FROM events")
def event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get(F.map_values(F.from_json("props", "map<string,bigint>")), 0).alias("k"))


@query(f"SELECT isbn, http_code, body FROM ({_ANSWERS}) WHERE isbn IS NOT NULL")
def stored_answers(spark, sf_dir):
    """All answers stored by ISBN and read back through the data source."""
    from ..sources import stores
    from ..storage import scratch, settled

    def build():
        path = scratch(spark, "answers")
        stores.store_answers(answers(spark, sf_dir), path)
        stores.register(spark)
        return spark.read.format("stored_answers").load(path)

    return settled(spark, build, "answers-read")


@query(f"SELECT isbn, http_code, body FROM ({_ANSWERS}) WHERE isbn IN ('978-13', '978-14', '978-22', ' - ')")
def answers_by_isbn(spark, sf_dir):
    """Answers of some ISBNs; the filter reaches the data source, which opens their folders only."""
    from ..sources import stores
    from ..storage import scratch, settled

    def build():
        path = scratch(spark, "answers")
        stores.store_answers(answers(spark, sf_dir), path)
        stores.register(spark)
        return spark.read.format("stored_answers").load(path).where(F.col("isbn").isin("978-13", "978-14", "978-22", " - "))

    return settled(spark, build, "answers-read")

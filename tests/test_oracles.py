"""Queries against their DuckDB oracles at the smallest size."""

import glob
import math
import os

import duckdb
import pytest

from shelfspark.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "search_all", "search_author", "search_books", "book_form", "display_rows", "detailed_flag", "isbn_conflict", "classify_code", "route_scan", "zone_hits", "metadata_flat", "year_last",
    "insert_ignore", "update_full_row", "delete_cascade", "upsert_books", "upsert_status", "migrate_2_3", "form_parse", "save_mode", "fill_if_empty", "line_clean", "split_pages", "hough_peaks", "line_initials", "line_flags",
    "digit_runs", "attempt_score", "drop_covered", "pack_for_locale", "pack_resolve", "stretch", "percentile", "enhanced", "blur", "sobel", "nms", "hysteresis", "quad_geometry", "quad_score", "quad_order", "quad_scale", "nearest_edge", "similar_line", "daily_events",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    one = lambda v: float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(one(v) for v in r) for r in rows), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", CHOSEN)
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert plain(map(tuple, df.select(columns).collect())) == plain(found)


def test_every_query_is_known():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 90


def test_plans_push_down(spark):
    """A lookup reads the columns it needs and pushes its filter to the scan."""
    from shelfspark.operators.catalogue import by_id
    from shelfspark.sources.catalogue import table

    df = by_id(table(spark, SF, "part").withColumnRenamed("p_partkey", "id"), 5).select("id", "p_name")
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "EqualTo(p_partkey,5)" in plan and "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan


def test_pixels_at_the_edge_of_a_whole_number(spark, duck, tmp_path):
    """Values whose product with 200 is whole as a real and not as a double."""
    near = [k / 200 for k in range(-128, 128)]
    rows = [(i, near[i * 64 : i * 64 + 64], 0) for i in range(4)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("inverted", "luma", "blur", "hysteresis"):
        df = QUERIES[name](spark, str(tmp_path))
        assert plain(map(tuple, df.collect())) == plain(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall())


IMAGES = ["chroma_as_dark", "dark_on_light", "enhanced", "hough_votes", "hysteresis", "inverted", "min_channel", "nms", "sobel"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Embeddings with reals that are no numbers, infinite, very large or missing, and without any; and reals of the driver's kind at an edge."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    nan, inf, path = math.nan, math.inf, tmp_path_factory.mktemp("odd")
    edge = [k / 200 * (-1) ** k for k in range(64)]
    rows = [[nan] * 5 + edge[5:], [inf] * 3 + [-inf] * 3 + edge[6:], [None] * 4 + edge[4:], None, [1e30] * 8 + [-1e30] * 8 + edge[16:], []]
    pq.write_table(pa.table({"vec_id": pa.array(range(6), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", IMAGES)
def test_images_of_odd_values(spark, odd, name):
    path, con = odd
    df = QUERIES[name](spark, path)
    assert plain(map(tuple, df.collect())) == plain(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall())


def test_formula_words_before_letters_with_accents(spark, tmp_path):
    text = "\n".join(["1 sinó", "cosß", "tan", "tana", "Λb", "ab", "expé maisons bleues", "log 2"])
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("line_score", "line_flags", "attempt_score"):
        df = QUERIES[name](spark, str(tmp_path))
        assert plain(map(tuple, df.collect())) == plain(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall())


def test_lines_are_cleaned_once(spark):
    """A line's words are made below a generator, so that no filter or column makes them again; blanks at its ends need no pattern."""
    for name in ("line_split", "admit_lines", "attempt_score"):
        df = QUERIES[name](spark, SF)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        assert "inline(" in plan and not any("\u00a0" in x for x in plan.splitlines() if "Filter" in x)  # which cleaning replaces


def test_lines_are_judged_once(spark):
    """Formulas are looked for once a line, and what a longer key adds is told by lengths before a key is searched for."""
    for name in ("line_flags", "attempt_score", "best_attempt", "gray_or_inverted", "drop_covered"):
        df = QUERIES[name](spark, SF)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        assert plan.count("sgn|chi") == (2 if name == "gray_or_inverted" else 0 if name == "drop_covered" else 1) and "levenshtein" not in plan


def test_numbers_and_scripts_by_patterns(spark):
    """Lines at the limits of what is told without counting, by counts of their characters."""
    import re
    import unicodedata as u

    from shelfspark.functions import lines as L

    texts = ["12", "12 ab", "1234 O", "1 2 3 4", "a 1234 b", "O 1234 l", "12345 xy", "1234 x", "x", "xy", "да", "xд", "日本", "é 1", "", "()ab", "(a)bcdefg", "=+*abcdef", "=+*abcdefg", "a(b)c=d+e", "((((((", "1234"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = df.t
    from pyspark.sql import functions as F

    for r in df.select("t", L.script_mismatch(c, F.lit("CYRILLIC")).alias("c"), L.script_mismatch(c, F.lit("LATIN")).alias("l"), L.mostly_digits(c).alias("d"), L.math_noise(c).alias("m")).collect():
        letters = [x for x in r.t if u.category(x)[0] == "L"]
        latin, cyr = sum(x <= "\u024f" for x in letters), sum("\u0400" <= x <= "\u052f" for x in letters)
        n, signs = len(letters) + sum(x.isdigit() for x in r.t), sum(x in "()[]{}=+*/\\^_<>|×−" for x in r.t)
        initials = r.t == "x"  # a letter by itself needs a dot
        assert r.c == (len(letters) == latin >= 2 and not r.d) and r.l == (len(letters) == cyr >= 2) and not (initials and r.c)
        by_sign = len(letters) < 8 and re.search("[_^=]", r.t) is not None
        assert r.m == (by_sign or (sum(x in "()[]{}" for x in r.t) >= 2 and n < 6) or (signs >= 3 and n <= signs + 3)), r
    numbers = {r.t for r in df.where(L.mostly_digits(c)).collect()}
    assert numbers == {"1234 O", "1 2 3 4", "a 1234 b", "O 1234 l", "1234 x", "1234"}

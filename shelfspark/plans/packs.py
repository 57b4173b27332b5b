"""Queries of language packs and locales."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packs as ops
from ..sources.catalogue import table
from ..sources.packs import duckdb_values, packs
from .registry import query

_P = f"WITH packs AS ({duckdb_values()})"
_B = "regexp_replace(id, '_(cyrl|latn)$', '')"


#: Whether a pack is found by the column needle.
_FOUND = f"""starts_with(id, needle) OR starts_with({_B}, needle) OR starts_with(iso6391, needle) OR starts_with(lower(label), needle)
    OR length(list_filter(string_split_regex(lower(label), '[\\s(/)\\-]+'), lambda x: starts_with(x, needle))) > 0"""
#: Documents by language.
_LANGS = "SELECT lang, count(*)::BIGINT AS docs FROM documents WHERE lang IS NOT NULL GROUP BY lang"


def _langs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))


def _with_docs(spark, sf_dir):
    """Packs with docs, the number of documents in their language."""
    known = _langs(spark, sf_dir).withColumnRenamed("lang", "iso6391")
    return packs(spark).join(known, "iso6391", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))


_DOCS = f"{_P}, l AS ({_LANGS}), d AS (SELECT packs.*, coalesce(docs, 0)::BIGINT AS docs FROM packs LEFT JOIN l ON lang = iso6391)"


@query(f"{_DOCS} SELECT family, recogniser, count(*)::BIGINT AS n, sum(docs)::BIGINT AS docs, string_agg(id, ',' ORDER BY ordinal) AS ids FROM d GROUP BY ALL")
def pack_families(spark, sf_dir):
    """Families with their packs and the documents that these would read."""
    p = _with_docs(spark, sf_dir).groupBy("family", "recogniser").agg(F.count(F.lit(1)).alias("n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("ordinal", "id"))).alias("x"))
    return p.select("family", "recogniser", "n", "docs", F.array_join(F.transform("x", lambda x: x["id"]), ",").alias("ids"))


@query(f"{_P}, l AS ({_LANGS}), w AS (SELECT lang AS needle, docs FROM l) SELECT needle, docs, ordinal, id, label, {_B} AS base FROM w, packs WHERE {_FOUND}")
def pack_search(spark, sf_dir):
    """The packs that each language of documents finds as a needle."""
    found = ops.search_each(_langs(spark, sf_dir).withColumnRenamed("lang", "needle"), packs(spark))
    return found.select("needle", "docs", "ordinal", "id", "label", ops.base_id(F.col("id")).alias("base"))


@query(f"{_P}, l AS ({_LANGS}) SELECT DISTINCT lang, p.ordinal, p.id FROM l JOIN packs f ON f.iso6391 = lang JOIN packs p ON p.family = f.family")
def pack_family(spark, sf_dir):
    """All packs of the families that documents' languages belong to."""
    p = packs(spark)
    own = _langs(spark, sf_dir).join(F.broadcast(p.select("iso6391", "family")), F.col("lang") == F.col("iso6391")).select("lang", "family").distinct()
    return own.join(F.broadcast(p.select("ordinal", "id", "family")), "family").select("lang", "ordinal", "id")


_WANTED = "SELECT DISTINCT lower(substr(c_mktsegment, 1, 1)) AS needle FROM customer"


@query(f"{_P}, w AS ({_WANTED}) SELECT needle, id, (row_number() OVER (PARTITION BY needle ORDER BY label, ordinal) - 1)::INT AS place, id = 'cat' AS checked FROM w, packs WHERE {_FOUND}")
def pack_chooser(spark, sf_dir):
    """What the chooser shows for the first letters of customers' segments."""
    wanted = table(spark, sf_dir, "customer").select(F.lower(F.substring("c_mktsegment", 1, 1)).alias("needle"))
    return ops.chooser_each(wanted, packs(spark), F.lit("cat")).select("needle", "id", "place", "checked")


@query(f"{_DOCS} SELECT ordinal, id, label, docs FROM d")
def packs_by_label(spark, sf_dir):
    return ops.by_label(_with_docs(spark, sf_dir)).select("ordinal", "id", "label", "docs")


#: Thirteen locales that name a pack, and some with scripts and countries.
LOCALES = [
    ("be", "bel", "", ""), ("kk", "kaz", "", ""), ("ky", "kir", "", ""), ("lt", "lit", "", ""), ("lv", "lav", "", ""), ("ru", "rus", "", ""), ("uk", "ukr", "", ""),
    ("es", "spa", "", ""), ("en", "eng", "", ""), ("zh", "zho", "", "CN"), ("zh", "zho", "", "TW"), ("nb", "nob", "", ""), ("sr", "srp", "", ""), ("sr", "srp", "Latn", "RS"),
    ("az", "aze", "Cyrl", ""), ("uz", "uzb", "Latn", ""), ("zh", "zho", "Hant", ""), ("iw", "heb", "", "IL"), ("in", "ind", "", ""), ("tl", "tgl", "", ""), ("xx", "", "", ""), ("nn", "nno", "", "NO"),
]


def _score() -> str:
    return """CASE WHEN s0 = 0 THEN 0 ELSE s0 + CASE WHEN ends_with(id, '_cyrl') THEN CASE script WHEN 'Cyrl' THEN 6 WHEN 'Latn' THEN -8 ELSE -1 END WHEN ends_with(id, '_latn') THEN CASE script WHEN 'Latn' THEN 6 WHEN 'Cyrl' THEN -8 ELSE -1 END
    WHEN id = 'srp' AND lang = 'sr' THEN CASE WHEN script IN ('Cyrl', '') THEN 4 ELSE -4 END WHEN (id, lang) IN (('aze', 'az'), ('uzb', 'uz')) THEN CASE WHEN script IN ('Latn', '') THEN 4 ELSE -4 END ELSE 0 END
    + CASE id WHEN 'chi_tra' THEN CASE WHEN country IN ('TW', 'HK', 'MO') OR script = 'Hant' THEN 6 ELSE -4 END WHEN 'chi_sim' THEN CASE WHEN country IN ('CN', 'SG') OR script IN ('Hans', '') THEN 4 ELSE 0 END ELSE 0 END END"""


_SCORED = f"""{_P}, n(k, lang, iso3, script, country) AS (VALUES {", ".join(str((i, *v)) for i, v in enumerate(LOCALES))}),
c AS (SELECT c_custkey, lang, iso3, script, country FROM customer JOIN n ON k = c_custkey % {len(LOCALES)}), l AS (SELECT DISTINCT lang, iso3, script, country FROM c), z AS (SELECT *, {_B} AS base FROM l, packs),
y AS (SELECT *, CASE WHEN iso3 IN (id, base) THEN 12 ELSE 0 END + CASE WHEN lang IN (id, base, iso6391) THEN 10 ELSE 0 END + CASE WHEN lang = 'zh' AND id IN ('chi_sim', 'chi_tra') THEN 12 ELSE 0 END
    + CASE WHEN lang IN ('nb', 'nn', 'no') AND id = 'nor' THEN 12 ELSE 0 END + CASE WHEN (lang, id) IN (('iw', 'heb'), ('in', 'ind')) THEN 12 ELSE 0 END + CASE WHEN (lang, id) = ('tl', 'fil') THEN 10 ELSE 0 END AS s0 FROM z),
x AS (SELECT *, ({_score()})::INT AS score FROM y)"""


@query(f"""{_SCORED} SELECT c_custkey, lang, iso3, script, country, pack, score FROM c JOIN (SELECT lang, iso3, script, country, CASE WHEN score > 0 THEN id ELSE 'eng' END AS pack, greatest(score, 0) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, iso3, script, country ORDER BY score DESC, ordinal) AS k FROM x) WHERE k = 1) USING (lang, iso3, script, country)""")
def pack_for_locale(spark, sf_dir):
    """The pack of each customer, whose locale is one of LOCALES; every distinct locale is judged once."""
    names = ["lang", "iso3", "script", "country"]
    known = spark.createDataFrame([(i, *v) for i, v in enumerate(LOCALES)], "k int, lang string, iso3 string, script string, country string")
    own = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(LOCALES)).alias("k")).join(F.broadcast(known), "k").drop("k")
    return own.join(ops.best_for(own.select(names).distinct(), packs(spark)), names)


@query(f"{_P} SELECT w.c_custkey, w.wanted, coalesce(p.id, 'eng') AS pack FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Latin' WHEN 3 THEN 'no such' ELSE upper(id) END AS wanted FROM customer LEFT JOIN packs ON ordinal = c_custkey % 110) w LEFT JOIN packs p ON p.id = lower(w.wanted) AND lower(w.wanted) <> 'latin'")
def pack_resolve(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(packs(spark).select("ordinal", "id")), F.col("c_custkey") % 110 == F.col("ordinal"), "left")
    k = F.col("c_custkey") % 6
    wanted = F.when(k == 0, None).when(k == 1, "").when(k == 2, "Latin").when(k == 3, "no such").otherwise(F.upper("id"))
    return ops.resolve(c.select("c_custkey", wanted.alias("wanted")), packs(spark))


_TAG = "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'en' WHEN 3 THEN 'es-MX' WHEN 4 THEN 'RU' WHEN 5 THEN 'be-BY' ELSE 'fr' END"


@query(f"SELECT c_custkey, language, CASE language WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'ru' THEN 3 WHEN 'be' THEN 4 ELSE 0 END AS option FROM (SELECT c_custkey, lower(string_split(coalesce({_TAG}, ''), '-')[1]) AS language FROM customer)")
def locale_options(spark, sf_dir):
    tag = F.expr(_TAG)
    return table(spark, sf_dir, "customer").select("c_custkey", ops.language_only(tag).alias("language"), ops.option_index(tag).alias("option"))


@query("SELECT DISTINCT p_brand AS code FROM part WHERE p_brand NOT IN (SELECT 'Brand#' || c_nationkey FROM customer WHERE c_acctbal * 10 >= 50000)")
def missing_files(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("Brand#"), F.col("c_nationkey").cast("string")).alias("code"), (F.col("c_acctbal") * 10).alias("bytes"))
    return ops.missing_files(p.select(F.col("p_brand").alias("code")).distinct(), files)


@query("SELECT bool_and(coalesce(s_acctbal >= 50000, FALSE)) AS present FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def all_present(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_acctbal").alias("bytes"))
    return ops.all_present(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code")), files)

"""Language packs: search, families, resolving identifiers, ranking for locales, and which files are missing.

The packs are a dimension of fixed size (110 rows) and may be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Identifiers of script families that older settings stored, the languages of the interface, and the least size
# of a whole language file.
LEGACY = ("cyrillic", "latin", "semitic", "persian", "jck", "armenian", "georgian", "greek", "indic", "other", "arabic", "hebrew")
OPTIONS = ("", "en", "es", "ru", "be")
MIN_BYTES = 50_000
DEFAULT = "eng"


def base_id(pack: Column) -> Column:
    return F.regexp_replace(pack, "_(cyrl|latn)$", "")


def _name_starts(name: Column, needle: str) -> Column:
    lower = F.lower(name)
    return lower.startswith(needle) | F.exists(F.split(lower, r"[\s(/)\-]+"), lambda p: p.startswith(needle))


def search(packs: DataFrame, needle: str, localized: Column | None = None) -> DataFrame:
    """Packs whose identifier, ISO code, or a word of whose name begins with needle; all for a blank one."""
    needle = needle.strip().lower()
    if not needle:
        return packs
    tests = [F.lower("id").startswith(needle), F.lower(base_id(F.col("id"))).startswith(needle), F.col("iso6391").startswith(needle), _name_starts(F.col("label"), needle)]
    if localized is not None:
        tests.append(_name_starts(localized, needle))
    return packs.where(reduce(lambda a, b: a | b, tests))


def search_each(needles: DataFrame, packs: DataFrame, needle: str = "needle") -> DataFrame:
    """needles with the packs that search() finds for each; none, and no row, for needles that find nothing.

    Each distinct needle meets the 110 packs once, whatever the number of rows.
    """
    word = F.lower(F.trim(F.coalesce(F.col(needle), F.lit(""))))
    starts = lambda name: F.col(name).startswith(F.col("_word"))
    names = packs.withColumns({"_id": F.lower("id"), "_base": F.lower(base_id(F.col("id"))), "_name": F.lower("label")})
    names = names.withColumn("_parts", F.split("_name", r"[\s(/)\-]+"))
    words = needles.select(word.alias("_word")).distinct()
    hit = starts("_id") | starts("_base") | starts("iso6391") | starts("_name") | F.exists("_parts", lambda p: p.startswith(F.col("_word")))
    found = words.join(F.broadcast(names), hit).drop("_id", "_base", "_name", "_parts")
    return needles.withColumn("_key", word).join(found, F.col("_key") == F.col("_word")).drop("_key", "_word")


def chooser_each(needles: DataFrame, packs: DataFrame, chosen: Column, needle: str = "needle") -> DataFrame:
    """What chooser() shows for each distinct needle (of rows with needle and what chosen needs)."""
    place = F.row_number().over(Window.partitionBy(needle).orderBy(F.collate("label", "UNICODE_CI_AI"), "ordinal")) - 1  # at most 110 rows
    return search_each(needles.distinct(), packs, needle).withColumns({"place": place, "checked": F.col("id") == chosen})


def of_family(packs: DataFrame, family: str) -> DataFrame:
    return packs.where(F.col("family") == family).orderBy("ordinal")


def by_label(packs: DataFrame) -> DataFrame:
    """Packs in the order of their labels, case and accents aside."""
    return packs.orderBy(F.collate("label", "UNICODE_CI_AI"), "ordinal")


# Points of a pack whose code, or whose language, is the locale's; languages with packs under other names.
BY_ISO3, BY_LANGUAGE = 12, 10
BY_OTHER_NAME = ((("zh",), ("chi_sim", "chi_tra"), 12), (("nb", "nn", "no"), ("nor",), 12), (("iw",), ("heb",), 12), (("in",), ("ind",), 12), (("tl",), ("fil",), 10))
# Points for a script that is the pack's, another, or not told; for the script that goes without saying; of Chinese packs.
SCRIPT_FITS, SCRIPT_CLASHES, SCRIPT_UNTOLD = 6, -8, -1
USUAL_FITS, USUAL_CLASHES = 4, -4
TRADITIONAL_FITS, TRADITIONAL_CLASHES, SIMPLIFIED_FITS = 6, -4, 4


def locale_score(lang: Column, iso3: Column, script: Column, country: Column) -> Column:
    """How well the pack of a row (id, iso6391) suits a locale; 0 if not at all."""
    pack = F.col("id")
    base = base_id(pack)
    same = lambda a, b: F.lower(a) == F.lower(b)
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = points(same(pack, iso3) | same(base, iso3), BY_ISO3) + points(same(pack, lang) | same(base, lang) | same(F.col("iso6391"), lang), BY_LANGUAGE)
    for langs, ids, n in BY_OTHER_NAME:
        score = score + points(lang.isin(*langs) & pack.isin(*ids), n)
    suits = lambda good, bad: F.when(script == good, SCRIPT_FITS).when(script == bad, SCRIPT_CLASHES).otherwise(SCRIPT_UNTOLD)
    usual = lambda good: F.when(script.isin(good, ""), USUAL_FITS).otherwise(USUAL_CLASHES)
    by_script = F.when(pack.endswith("_cyrl"), suits("Cyrl", "Latn")).when(pack.endswith("_latn"), suits("Latn", "Cyrl"))
    by_script = by_script.when((pack == "srp") & (lang == "sr"), usual("Cyrl")).when((pack == "aze") & (lang == "az"), usual("Latn")).when((pack == "uzb") & (lang == "uz"), usual("Latn")).otherwise(0)
    land = F.upper(country)
    chinese = F.when(pack == "chi_tra", F.when(land.isin("TW", "HK", "MO") | (script == "Hant"), TRADITIONAL_FITS).otherwise(TRADITIONAL_CLASHES))
    chinese = chinese.when(pack == "chi_sim", F.when(land.isin("CN", "SG") | script.isin("Hans", ""), SIMPLIFIED_FITS).otherwise(0)).otherwise(0)
    return F.when(score == 0, 0).otherwise(score + by_script + chinese).cast("int")


def best_for(locales: DataFrame, packs: DataFrame) -> DataFrame:
    """locales (lang, iso3, script, country) with pack and score of the best pack; English where none scores above 0."""
    cols = [F.coalesce(F.col(f"l.{n}"), F.lit("")) for n in ("lang", "iso3", "script", "country")]
    keyed = locales.withColumn("_row", F.monotonically_increasing_id()).alias("l")
    scored = keyed.crossJoin(F.broadcast(packs)).withColumn("score", locale_score(*cols))  # 110 packs a locale
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.col("score").desc(), "ordinal"))
    top = scored.withColumn("_rank", rank).where("_rank = 1")
    return top.select(*[F.col(f"l.{c}") for c in locales.columns], F.when(F.col("score") > 0, F.col("id")).otherwise(DEFAULT).alias("pack"), F.greatest("score", F.lit(0)).alias("score"))


def resolve(wanted: DataFrame, packs: DataFrame, default: str = DEFAULT, column: str = "wanted") -> DataFrame:
    """wanted with pack: the pack of that identifier in any case; the default for null, empty, legacy and unknown ones."""
    key = F.when(~F.lower(column).isin(*LEGACY), F.lower(column))
    known = packs.select(F.col("id").alias("_id"))
    return wanted.join(F.broadcast(known), key == F.lower("_id"), "left").withColumn("pack", F.coalesce("_id", F.lit(default))).drop("_id")


def language_only(tag: Column) -> Column:
    return F.lower(F.substring_index(F.coalesce(tag, F.lit("")), "-", 1))


def option_index(tag: Column, options: tuple[str, ...] = OPTIONS) -> Column:
    """Place from 0 of a tag's language among the interface's options; 0 for others."""
    return F.greatest(F.array_position(F.array(*map(F.lit, options)), language_only(tag)).cast("int") - 1, F.lit(0))


def chooser(packs: DataFrame, needle: str, chosen: str) -> DataFrame:
    """Found packs by label with place (from 0) and checked for the chosen one."""
    place = F.row_number().over(Window.orderBy(F.collate("label", "UNICODE_CI_AI"), "ordinal")) - 1  # at most 110 rows
    return search(packs, needle).withColumns({"place": place, "checked": F.col("id") == chosen})


def missing_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Codes of wanted(code) without a whole file in files(code, bytes)."""
    return wanted.join(files.where(F.col("bytes") >= MIN_BYTES), "code", "left_anti")


def all_present(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """present: whether every wanted code has a whole file."""
    rows = wanted.join(files.select("code", "bytes"), "code", "left")
    return rows.agg(F.coalesce(F.bool_and(F.coalesce(F.col("bytes") >= MIN_BYTES, F.lit(False))), F.lit(True)).alias("present"))

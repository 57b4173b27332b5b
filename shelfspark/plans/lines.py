"""Queries of text lines and pages of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.strings import once
from ..operators import pages as ops
from ..sources.lines import LOCATED, located
from .registry import query

_TRIM = "regexp_replace({}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
_JUNK = "[" + L.JUNK.replace("'", "''") + "]+"
_SHUT, _OPEN = "\ufdd0", "\ufdd1"


def _marked() -> str:
    out = "t"
    for o, c in ("()", "[]", "{}"):
        out = f"CASE WHEN strpos(t, '{o}') = 0 THEN replace({out}, '{c}', '{_SHUT}') WHEN strpos(t, '{c}') = 0 THEN replace({out}, '{o}', '{_OPEN}') ELSE {out} END"
    return out


def _cleaned(source: str) -> str:
    """CTEs from a table with text: c is the cleaned text."""
    return f"""{source}1 AS (SELECT *, {_TRIM.format("regexp_replace(regexp_replace(translate(" + _TRIM.format("coalesce(text, '')") + f", chr(160), ' '), '^{_JUNK}', ''), '{_JUNK}$', '')")} AS t FROM {source}),
{source}2 AS (SELECT *, {_marked()} AS m FROM {source}1),
{source}3 AS (SELECT *, regexp_replace(m, '(?s)^(.+?)[{_SHUT}\\x00-\\x20]+$', '\\1') AS lf FROM {source}2),
{source}4 AS (SELECT *, length(regexp_extract(lf, '(?s)^([{_OPEN}\\x00-\\x20]+).', 1)) AS k FROM {source}3),
{source}c AS (SELECT * EXCLUDE (t, m, lf, k), {_TRIM.format("regexp_replace(substr(t, k + 1, length(lf) - k), '\\s+', ' ', 'g')")} AS c FROM {source}4)"""


def _initials(column: str) -> str:
    # fixed values: the patterns of L.TRIPLE and the others, whose look-behind this dialect lacks
    out, p = column, "(^|[^\\p{L}])"
    for pattern, n in (("(\\p{L})\\s*\\.\\s*(\\p{L})\\s*\\.\\s*(\\p{L})\\s*\\.\\s*", 3), ("(\\p{L})\\s*\\.\\s*(\\p{L})\\s*\\.\\s*", 2), ("(\\p{L})\\s+(\\p{L})\\s+", 2), ("(\\p{L})\\.(\\p{L})\\s+", 2)):
        made = "".join(f"\\{i + 2}. " for i in range(n))
        out = f"regexp_replace({out}, '{p}{pattern}(\\p{{L}}{{2}})', '\\1{made}\\{n + 2}', 'g')"
    return _TRIM.format(f"regexp_replace({out}, '\\s+', ' ', 'g')")


def _n(column: str, chars: str) -> str:
    return f"length(regexp_replace({column}, '[^{chars}]', '', 'g'))"


_LAT = "A-Za-z\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}"
_CYR = "\\x{400}-\\x{481}\\x{48A}-\\x{52F}"


def _flags(c: str) -> dict[str, str]:
    l, d, lat, cyr = _n(c, "\\p{L}"), _n(c, "\\p{Nd}"), _n(c, _LAT), _n(c, _CYR)
    br, op = _n(c, "()\\[\\]{}"), _n(c, "=+*/\\^_<>|\\\\×−")
    runs = f"list_transform(regexp_extract_all({c}, '\\p{{L}}+'), lambda x: length(x))"
    four = f"length(list_filter({runs}, lambda x: x >= 4))"
    useful = f"(length(list_filter({runs}, lambda x: x >= 5)) >= 1 OR {four} >= 2 OR (length({runs}) = 1 AND {four} = 1))"
    ini = f"regexp_full_match({_TRIM.format(c)}, '(\\p{{L}}\\.\\s*){{1,4}}\\p{{L}}?\\.?')"
    num = f"({d} >= 4 AND {l} <= 1)"
    math = f"({c} <> '' AND ((regexp_matches({c}, '{L.MATH}') AND {l} < 8) OR ({br} >= 2 AND {l} + {d} < 6) OR ({op} + {br} >= 3 AND {l} + {d} <= {op} + {br} + 3)))"
    mixed = f"({cyr} >= 2 AND {lat} >= 2)"
    return {
        "initials": ini, "useful": useful, "mixed": mixed, "gibberish": f"({c} <> '' AND NOT {ini} AND NOT {num} AND NOT {useful})", "math": math,
        "keep": f"({c} <> '' AND NOT {math} AND NOT {mixed} AND ({ini} OR {num} OR {useful}))", "foreign": f"({cyr} = 0 AND {lat} >= 2 AND {l} - {cyr} - {lat} = 0 AND NOT {ini})",
        "letters": l, "digits": d,
    }


def _score(c: str, confidence: str) -> str:
    f = _flags(c)
    return f"CASE WHEN {c} = '' THEN 0 ELSE {f['letters']} * 4 + {f['digits']} * 3 + floor({confidence} + 0.5) - CASE WHEN {f['math']} THEN 80 ELSE 0 END END::INT"


_BASE = f"WITH lines AS ({LOCATED}),\n{_cleaned('lines')}"
_ID = "page_id, ordinal"


@query(f"{_BASE} SELECT page_id, ordinal, c AS text, lower(regexp_replace(c, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS key FROM linesc WHERE c <> ''")
def line_split(spark, sf_dir):
    rows = once(located(spark, sf_dir).select("page_id", "ordinal", "text"), text=L.clean(F.col("text"))).where("text <> ''")
    return rows.select("page_id", "ordinal", "text", L.key(F.col("text")).alias("key"))


@query(f"{_BASE} SELECT {_ID}, c AS text FROM linesc")
def line_clean(spark, sf_dir):
    return located(spark, sf_dir).select("page_id", "ordinal", L.clean(F.col("text")).alias("text"))


#: Every kind of line break in turn, in the place of the documents' own.
_BREAKS = ("\\r\\n", "\\n", "\\x0b", "\\x0c", "\\r", "\\u0085", "\\u2028", "\\u2029")
_BREAK_CODES = ("chr(13) || chr(10)", "chr(10)", "chr(11)", "chr(12)", "chr(13)", "chr(133)", "chr(8232)", "chr(8233)")
_BROKEN = f"SELECT doc_id AS page_id, replace(text, chr(10), ([{', '.join(_BREAK_CODES)}])[(doc_id % 8 + 1)::INT]) AS body FROM documents"


@query(f"""WITH broken AS ({_BROKEN}), cut AS (SELECT page_id, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_split_to_array(body, '\\r\\n|[\\n\\x0b\\x0c\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM broken)),
{_cleaned('cut')} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS place, c AS text FROM cutc WHERE c <> ''""")
def split_pages(spark, sf_dir):
    """Cleaned lines of texts with every kind of line break."""
    from ..sources.catalogue import table

    breaks = F.array(*[F.lit(b.encode().decode("unicode_escape")) for b in _BREAKS])
    body = F.replace(F.col("text"), F.lit("\n"), F.get(breaks, (F.col("doc_id") % 8).cast("int")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(L.split_lines(body)).alias("place", "text"))


#: Lines made of names with initials in all four ways of writing them.
_NAMES = """SELECT p_partkey AS page_id, 0 AS ordinal, CASE p_partkey % 5 WHEN 0 THEN 'A.I. ' || p_name WHEN 1 THEN 'A I ' || p_name WHEN 2 THEN 'B . C. D.' || p_name WHEN 3 THEN p_name || ', X.Y ' || p_name ELSE '(' || p_name || ', J. R. ' || p_type END AS text FROM part"""


def _names(spark, sf_dir):
    from ..sources.catalogue import table

    k, name = F.col("p_partkey"), F.col("p_name")
    text = F.when(k % 5 == 0, F.concat(F.lit("A.I. "), name)).when(k % 5 == 1, F.concat(F.lit("A I "), name)).when(k % 5 == 2, F.concat(F.lit("B . C. D."), name)).when(k % 5 == 3, F.concat(name, F.lit(", X.Y "), name)).otherwise(F.concat(F.lit("("), name, F.lit(", J. R. "), F.col("p_type")))
    return table(spark, sf_dir, "part").select(k.alias("page_id"), F.lit(0).alias("ordinal"), text.alias("text"))


@query(f"WITH names AS ({_NAMES}),\n{_cleaned('names')} SELECT {_ID}, {_initials('c')} AS text FROM namesc")
def line_initials(spark, sf_dir):
    return _names(spark, sf_dir).select("page_id", "ordinal", L.initials(F.col("text")).alias("text"))


_F = _flags("c")


@query(f"{_BASE} SELECT {_ID}, {', '.join(f'{_F[n]} AS {n}' for n in ('initials', 'useful', 'mixed', 'gibberish', 'math', 'keep'))}, {_F['foreign']} AS mismatch FROM linesc")
def line_flags(spark, sf_dir):
    c, m = F.col("c"), F.col("m")
    rows = once(located(spark, sf_dir).select("page_id", "ordinal", "text"), m=L.measured(F.col("text")))
    rows = once(rows, c=L.cleaned(F.col("text"), m)).drop("text")
    judged = {"initials": L.looks_like_initials(c), "useful": L.has_useful_word(c), "worded": L.worded(c, m), "mixed": L.mixed_scripts(c, m), "math": L.math_noise(c, m)}
    rows = once(rows, **judged)  # keepable() and gibberish() are made of these
    some = c != ""
    return rows.select("page_id", "ordinal", "initials", "useful", "mixed", (some & ~F.col("worded")).alias("gibberish"), "math", (some & F.col("worded") & ~F.col("mixed") & ~F.col("math")).alias("keep"), L.script_mismatch(c, F.lit("CYRILLIC"), m).alias("mismatch"))


@query(f"{_BASE} SELECT {_ID}, {_F['letters']}::INT AS letters, {_F['digits']}::INT AS digits, {_score('c', 'confidence')} AS score, CASE WHEN length(c) > 80 THEN substr(c, 1, 80) || '…' ELSE c END AS preview FROM linesc")
def line_score(spark, sf_dir):
    c = F.col("c")
    rows = once(located(spark, sf_dir).select("page_id", "ordinal", "confidence", "text"), c=L.clean(F.col("text")))
    return rows.select("page_id", "ordinal", L.letters(c).alias("letters"), L.digits(c).alias("digits"), L.line_score(c, F.col("confidence")).alias("score"), L.preview(c).alias("preview"))


#: Lines with numbers, some of them spaced or with lookalikes.
_NUMBERS = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_orderkey % 4 WHEN 0 THEN 'Nr ' || l_partkey || ' x' WHEN 1 THEN l_partkey || 'O' || l_suppkey WHEN 2 THEN regexp_replace(l_partkey::VARCHAR, '(.)', '\\1 ', 'g') || 'xx' ELSE 'ly ' || l_returnflag END AS text FROM lineitem"""


@query(f"""SELECT id, translate(coalesce(list_reduce(list_prepend('', list_filter(regexp_extract_all(regexp_replace(text, '\\s+', '', 'g'), '[\\p{{Nd}}{L.LOOKALIKES.replace("|", "|")}]+'), lambda r: {_n('r', chr(92) + 'p{Nd}')} >= 2)), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END), ''), '{L.LOOKALIKES}', '{L.LOOKALIKE_DIGITS}') AS run FROM ({_NUMBERS})""")
def digit_runs(spark, sf_dir):
    from ..sources.catalogue import table

    k, p, s = F.col("l_orderkey"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("Nr "), p, F.lit(" x"))).when(k % 4 == 1, F.concat(p, F.lit("O"), s)).when(k % 4 == 2, F.concat(F.regexp_replace(p, "(.)", "$1 "), F.lit("xx"))).otherwise(F.concat(F.lit("ly "), F.col("l_returnflag")))
    return table(spark, sf_dir, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("id"), L.digit_run(text).alias("run"))


@query()
def number_lines(spark, sf_dir):
    """Collapsed and exploded number lines: a fold without SQL form."""
    from ..sources.catalogue import table

    text = F.concat_ws(" ", F.lit("Vol"), F.regexp_replace(F.col("p_partkey").cast("string"), "(.)", "$1 "), F.lit("O"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", L.collapse_digits(text).alias("collapsed"), L.explode_number(text).alias("parts"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, x = y OR (least(length(x), length(y)) >= 4 AND least(length(x), length(y)) * 100 >= greatest(length(x), length(y)) * 70 AND (levenshtein(x, y) <= 1 OR levenshtein(x, y) * 6 <= greatest(length(x), length(y)))) AS variant
    FROM (SELECT p_partkey, lower(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g')) AS x FROM part) a JOIN (SELECT p_partkey, lower(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g')) AS y FROM part) b ON b.p_partkey = a.p_partkey + 1""")
def noisy_variants(spark, sf_dir):
    from ..sources.catalogue import table

    p = table(spark, sf_dir, "part").select("p_partkey", L.key(F.col("p_name")).alias("k"))
    pairs = p.join(p.toDF("b", "y"), F.col("b") == F.col("p_partkey") + 1)
    return pairs.select(F.col("p_partkey").alias("a"), "b", L.noisy_variant(F.col("k"), F.col("y")).alias("variant"))


_LISTED = "SELECT p_partkey, [p_type, p_brand || ' x', p_name] AS listed, CASE p_partkey % 4 WHEN 0 THEN left(p_name, length(p_name) - 1) WHEN 1 THEN p_brand || '.' WHEN 2 THEN p_type || 's' ELSE 'No. ' || p_partkey END AS wanted FROM part"
_SAME = """length(k) >= 2 AND length(o) >= 2 AND (k = o OR (NOT kd AND NOT od AND least(length(k), length(o)) >= 4 AND least(length(k), length(o)) * 100 >= greatest(length(k), length(o)) * 70 AND (levenshtein(k, o) <= 1 OR levenshtein(k, o) * 6 <= greatest(length(k), length(o))))
    OR (kd = od AND least(length(k), length(o)) >= 3 AND (contains(k, o) OR contains(o, k)) AND least(length(k), length(o)) * 100 >= greatest(length(k), length(o)) * 55))"""
_KEY = "lower(regexp_replace({}, '[^a-zA-Z0-9]', '', 'g'))"


@query(f"""SELECT p_partkey, coalesce(min(i) FILTER ({_SAME}), -1)::INT AS place FROM (SELECT *, regexp_full_match(k, '[0-9]+') AS kd, regexp_full_match(o, '[0-9]+') AS od FROM (
    SELECT p_partkey, {_KEY.format('wanted')} AS k, {_KEY.format('unnest(listed)')} AS o, unnest([0, 1, 2]) AS i FROM ({_LISTED}))) GROUP BY p_partkey""")
def similar_line(spark, sf_dir):
    """The place of the first of three lines that a fourth one repeats with small differences."""
    from ..sources.catalogue import table

    k, name = F.col("p_partkey"), F.col("p_name")
    wanted = F.when(k % 4 == 0, F.expr("left(p_name, length(p_name) - 1)")).when(k % 4 == 1, F.concat("p_brand", F.lit("."))).when(k % 4 == 2, F.concat("p_type", F.lit("s"))).otherwise(F.concat(F.lit("No. "), k.cast("string")))
    listed = F.array("p_type", F.concat("p_brand", F.lit(" x")), name)
    return table(spark, sf_dir, "part").select("p_partkey", L.index_of_similar(listed, wanted).alias("place"))


_I = _flags("i")
_ADMIT = f"adm AS (SELECT * FROM (SELECT *, {_initials('c')} AS i FROM linesc) WHERE {_I['keep']} AND (confidence >= 32 OR {_I['letters']} >= 6 OR {_I['digits']} >= 4))"
_SCORED = f"""sco AS (SELECT page_id, attempt, (floor(avg(confidence)) + sum(CASE WHEN bad THEN -20 WHEN good THEN 30 + n + floor(confidence / 2 + 0.5) ELSE 0 END) - CASE WHEN sum((good AND NOT bad)::INT) = 0 THEN 50 ELSE 0 END)::BIGINT AS score
    FROM (SELECT page_id, attempt, confidence, {_I['keep']} AS good, {_I['letters']} AS n, {_I['gibberish']} OR {_I['mixed']} AS bad FROM adm) GROUP BY page_id, attempt)"""


@query(f"{_BASE}, {_ADMIT} SELECT {_ID}, attempt, i AS text, top, \"left\", height, confidence FROM adm")
def admit_lines(spark, sf_dir):
    return ops.admit(located(spark, sf_dir))


@query(f"{_BASE}, {_ADMIT}, {_SCORED} SELECT * FROM sco")
def attempt_score(spark, sf_dir):
    return ops.attempt_scores(ops.admit(located(spark, sf_dir), measures=True), "LATIN", admitted=True)


@query(f"{_BASE}, {_ADMIT}, {_SCORED} SELECT page_id, attempt, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, attempt) AS k FROM sco) WHERE k = 1")
def best_attempt(spark, sf_dir):
    return ops.best_attempts(ops.admit(located(spark, sf_dir), measures=True), "LATIN", admitted=True)


@query(f"{_BASE}, {_ADMIT}, g AS (SELECT page_id, coalesce(sum(CASE WHEN attempt = 0 THEN s END), 0)::BIGINT AS gray, coalesce(sum(CASE WHEN attempt = 1 THEN s END), 0)::BIGINT AS inverted FROM (SELECT page_id, attempt, {_score('i', 'confidence')} AS s FROM adm) GROUP BY page_id) SELECT *, CASE WHEN gray >= inverted THEN 'gray' ELSE 'inverted' END AS chosen FROM g")
def gray_or_inverted(spark, sf_dir):
    return ops.gray_or_inverted(ops.admit(located(spark, sf_dir), measures=True))


@query(f"{_BASE} SELECT page_id, bool_or({_F['keep']} AND NOT {_F['foreign']} AND NOT {_F['gibberish']}) AS real FROM linesc GROUP BY page_id")
def real_content(spark, sf_dir):
    return ops.real_content(located(spark, sf_dir).withColumn("text", L.clean(F.col("text"))), "CYRILLIC")


_KEYS = f"keys AS (SELECT {_ID}, c AS text, lower(regexp_replace(c, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS k, {_F['initials']} AS ini FROM linesc)"


@query(f"""{_BASE}, {_KEYS} SELECT {_ID}, text FROM keys a WHERE NOT EXISTS (SELECT 1 FROM keys b WHERE b.page_id = a.page_id AND b.ordinal <> a.ordinal AND length(b.k) > length(a.k) AND contains(b.k, a.k)
    AND (a.ini OR length(a.k) <= 4 OR (length(a.k) >= 4 AND length(a.k) * 100 >= length(b.k) * 70 AND (length(b.k) - length(a.k) <= 1 OR (length(b.k) - length(a.k)) * 6 <= length(b.k)))))""")
def drop_covered(spark, sf_dir):
    """Lines that no longer line covers. A key inside another differs from it by its missing characters alone."""
    rows = once(located(spark, sf_dir).select("page_id", "ordinal", "text"), text=L.clean(F.col("text")))
    return ops.drop_covered(rows)


@query()
def page_result(spark, sf_dir):
    """The whole page pipeline: folds that SQL has no form for."""
    return ops.recognise(located(spark, sf_dir), "LATIN")


@query("SELECT page_id, string_agg(t, ' ' ORDER BY i) AS text FROM (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE i % 3 = 1 GROUP BY page_id")
def selected_text(spark, sf_dir):
    from ..sources.catalogue import table

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.split("text", "\n").alias("l"))
    return rows.select("page_id", ops.selected_text(F.col("l"), F.transform("l", lambda x, i: i % 3 == 0)).alias("text"))

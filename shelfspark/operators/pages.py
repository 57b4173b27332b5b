"""Pages of located lines: admitting, choosing among attempts, joining fragments, merging and the final result.

A page's lines are gathered in one array (a page is small, whatever the number of pages) in a fixed order that ends in a
unique ordinal; order-dependent steps fold over it with expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lines as L
from ..functions.strings import let, once

MIN_CONFIDENCE = 32.0


def admit(rows: DataFrame, band_top: Column | None = None, measures: bool = False) -> DataFrame:
    """Rows whose cleaned text is worth keeping, text cleaned and the band's top added.

    A line of low confidence needs six letters or four digits. With measures a column m has what was measured() of each line.
    """
    text, m = F.col("text"), F.col("m")
    out = once(once(rows, m=L.measured(text)), text=L.with_initials(text, m)).where(L.keepable(text, m))
    out = out.where((F.col("confidence") >= MIN_CONFIDENCE) | (m["letters"] >= 6) | (m["digits"] >= 4))
    out = out if measures else out.drop("m")
    return out if band_top is None else out.withColumn("top", (F.col("top") + band_top).cast("int"))


def _measures(rows: DataFrame) -> Column | None:
    return F.col("m") if "m" in rows.columns else None


def unwanted(text: Column, family: Column) -> Column:
    return L.script_mismatch(text, family) | L.gibberish(text) | L.mixed_scripts(text)


def attempt_scores(rows: DataFrame, family: str, admitted: bool = False) -> DataFrame:
    """page_id, attempt, score: the mean confidence (whole), less 20 an unwanted line, plus 30, letters and half confidence a good one; 50 less without any.

    Lines of admit() (admitted) are keepable, so neither gibberish nor of mixed scripts, and are not judged again.
    """
    m = _measures(rows)
    bad = L.script_mismatch(F.col("text"), F.lit(family), m) if admitted else unwanted(F.col("text"), F.lit(family))
    worth = 30 + (L.letters(F.col("text")) if m is None else F.col("letters")) + F.floor(F.col("confidence") / 2 + 0.5)
    good = ~F.col("bad") & F.col("good")
    counted = [] if m is None else [m["letters"].alias("letters"), "m"]
    worded = once(rows.select("page_id", "attempt", "confidence", "text", *counted), bad=bad, good=F.lit(True) if admitted else L.keepable(F.col("text")))
    points = worded.select("page_id", "attempt", "confidence", good.alias("good"), F.when(F.col("bad"), -20).when(good, worth).otherwise(0).alias("points"))
    grouped = points.groupBy("page_id", "attempt").agg(F.floor(F.avg("confidence")).alias("mean"), F.sum("points").alias("points"), F.sum(F.col("good").cast("int")).alias("useful"))
    return grouped.select("page_id", "attempt", (F.col("mean") + F.col("points") - F.when(F.col("useful") == 0, 50).otherwise(0)).cast("bigint").alias("score"))


def best(rows: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """The row with the highest score of each group; of equal ones the first in order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def best_attempts(rows: DataFrame, family: str, admitted: bool = False) -> DataFrame:
    """page_id, attempt, score of the best attempt of each page."""
    return best(attempt_scores(rows, family, admitted), ["page_id"], "score", "attempt")


def gray_or_inverted(rows: DataFrame) -> DataFrame:
    """page_id, gray, inverted (sums of line scores of attempts 0 and 1) and chosen; gray wins a tie.

    Characters of lines that admit() gives with their measures are not counted again.
    """
    score = F.when(F.col("attempt") < 2, L.line_score(F.col("text"), F.col("confidence"), _measures(rows)))
    out = rows.withColumn("_s", score).groupBy("page_id").agg(*[F.coalesce(F.sum(F.when(F.col("attempt") == k, F.col("_s"))), F.lit(0)).cast("bigint").alias(n) for k, n in enumerate(("gray", "inverted"))])
    return out.withColumn("chosen", F.when(F.col("gray") >= F.col("inverted"), "gray").otherwise("inverted"))


def real_content(rows: DataFrame, family: str) -> DataFrame:
    """page_id and real: whether any line is keepable, of the right script and no gibberish."""
    good = L.keepable(F.col("text")) & ~L.script_mismatch(F.col("text"), F.lit(family)) & ~L.gibberish(F.col("text"))
    return rows.groupBy("page_id").agg(F.bool_or(good).alias("real"))


def same_row(a: Column, b: Column) -> Column:
    """Whether two lines stand on one row: tops within half the smaller height (12 at least), 8 at least."""
    height = F.least(F.greatest(a["height"], F.lit(12)), F.greatest(b["height"], F.lit(12)))
    return F.abs(a["top"] - b["top"]) <= F.greatest(F.lit(8), F.floor(height / 2))


def can_join(a: Column, b: Column) -> Column:
    """Whether two lines of a row are different fragments, side by side."""
    ka, kb = L.key(a["text"]), L.key(b["text"])
    apart = F.abs(a["left"] - b["left"]) > F.greatest(F.lit(12), F.least(a["height"], b["height"]))
    differ = (ka != "") & (kb != "") & (F.instr(ka, kb) == 0) & (F.instr(kb, ka) == 0) & ~L.noisy_variant(ka, kb)
    return apart & differ & ~L.mostly_digits(a["text"]) & ~L.mostly_digits(b["text"])


def should_replace(current: Column, candidate: Column) -> Column:
    """Of two numbers one that is no shorter wins, else the text with more letters and digits."""
    return F.when(L.mostly_digits(candidate) & L.mostly_digits(current), F.length(candidate) >= F.length(current)).otherwise(L.alnum(candidate) > L.alnum(current))


_LINE = ["text", "top", "left", "height", "confidence"]


def page_lines(rows: DataFrame) -> DataFrame:
    """page_id and lines: keepable lines as an array in reading order (top, left, score down, ordinal)."""
    score = L.line_score(F.col("text"), F.col("confidence"))
    order = F.struct("top", "left", (-score).alias("down"), "ordinal", F.struct(*_LINE).alias("line"))
    kept = rows.where(L.keepable(F.col("text")))
    return kept.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]).alias("lines"))


def cluster_rows(lines: Column) -> Column:
    """Fold lines into rows: each meets the first row it stands on, and joins it, replaces it if better, or is left out."""

    def put(done: Column, x: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(done, lambda d: same_row(d, x)), True), F.lit(0)).cast("int")

        def meet(k: Column) -> Column:
            def decide(d: Column) -> Column:
                first = d["left"] <= x["left"]
                text = L.initials(F.concat(F.when(first, d["text"]).otherwise(x["text"]), F.lit(" "), F.when(first, x["text"]).otherwise(d["text"])))
                joined = F.struct(text.alias("text"), F.least(d["top"], x["top"]).alias("top"), F.least(d["left"], x["left"]).alias("left"), F.greatest(d["height"], x["height"]).alias("height"), F.greatest(d["confidence"], x["confidence"]).alias("confidence"))
                better = L.line_score(x["text"], x["confidence"]) > L.line_score(d["text"], d["confidence"])
                return F.when(can_join(d, x), joined).when(better, x).otherwise(d)

            return F.transform(done, lambda d, i: F.when(i == k - 1, decide(d)).otherwise(d))

        return let(at, lambda k: F.when(k == 0, F.concat(done, F.array(x))).otherwise(meet(k)))

    return F.aggregate(lines, F.filter(lines, lambda x: F.lit(False)), put)


def merge_similar(texts: Column) -> Column:
    """Fold texts: each is added, or replaces the first similar one if that is worse."""

    def put(done: Column, x: Column) -> Column:
        place = L.index_of_similar_key(F.transform(done, lambda d: d["k"]), x["k"])
        return let(place, lambda k: F.when(k < 0, F.concat(done, F.array(x))).otherwise(F.transform(done, lambda d, i: F.when((i == k) & should_replace(d["t"], x["t"]), x).otherwise(d))))

    return F.transform(_fold_keyed(texts, put), lambda x: x["t"])


def _fold_keyed(texts: Column, put) -> Column:
    """Fold texts t with their keys k, each of which is made once."""
    keyed = F.transform(texts, lambda t: F.struct(t.alias("t"), L.key(t).alias("k")))
    return let(keyed, lambda ks: F.aggregate(ks, F.slice(ks, 1, 0), put))


def distinct_parts(texts: Column) -> Column:
    """Texts cut at their numbers, cleaned, kept if worth it and not similar to an earlier one."""
    parts = F.transform(F.flatten(F.transform(texts, L.explode_number)), L.initials)
    parts = F.filter(parts, lambda x: L.keepable(x))
    put = lambda done, x: F.when(L.index_of_similar_key(F.transform(done, lambda d: d["k"]), x["k"]) < 0, F.concat(done, F.array(x))).otherwise(done)
    return F.transform(_fold_keyed(parts, put), lambda x: x["t"])


def covered(line: Column, key: Column, other: Column) -> Column:
    """Whether a longer key holds this line's key, which is initials, short or nearly as long."""
    inside = (F.length(other) > F.length(key)) & (F.instr(other, key) > 0)
    return inside & (L.looks_like_initials(line) | (F.length(key) <= 4) | L.noisy_variant(key, other))


def uncovered(texts: Column) -> Column:
    """Texts without those that another text covers; numbers always stay."""
    keyed = F.transform(texts, lambda t: F.struct(t.alias("t"), L.key(t).alias("k"), L.mostly_digits(t).alias("n")))
    return let(keyed, lambda ks: F.transform(F.filter(ks, lambda x: x["n"] | ~F.exists(ks, lambda o: covered(x["t"], x["k"], o["k"]))), lambda x: x["t"]))


def drop_covered(rows: DataFrame) -> DataFrame:
    """Rows (page_id, ordinal, text) without those that another row of the page covers, as a self-join on the page."""
    keyed = once(rows.select("page_id", "ordinal", "text"), k=L.key(F.col("text")))
    keyed = once(keyed, n=F.length("k"))
    other = keyed.select(F.col("page_id").alias("op"), F.col("ordinal").alias("oo"), F.col("k").alias("ok"), F.col("n").alias("on"))
    # a short line or initials may be in any longer key, others in one that is longer by a sixth or by one; numbers in none
    most = F.when(L.mostly_digits(F.col("text")), 0).when(L.looks_like_initials(F.col("text")) | (F.col("n") <= 4), 1 << 30).otherwise(F.greatest(F.col("n") + 1, F.floor(F.col("n") * 6 / 5).cast("int")))
    mine = once(keyed, most=most)
    hides = (F.col("page_id") == F.col("op")) & (F.col("on") > F.col("n")) & (F.col("on") <= F.col("most")) & (F.instr("ok", F.col("k")) > 0)
    return mine.join(other, hides, "left_anti").select("page_id", "ordinal", "text")


def result(filtered: Column) -> dict[str, Column]:
    """lines, full_text and options of final lines: the whole text first, then the lines if there are several."""
    full = F.array_join(filtered, " ")
    options = F.when(F.size(filtered) == 0, F.array().cast("array<string>")).when(F.size(filtered) == 1, F.array(full)).otherwise(F.array_distinct(F.concat(F.array(full), filtered)))
    return {"lines": filtered, "full_text": full, "options": options}


def recognise(rows: DataFrame, family: str) -> DataFrame:
    """page_id, lines, full_text, options of each page: admitted lines of its best attempt, clustered, merged and filtered."""
    admitted = admit(rows)
    chosen = admitted.join(best_attempts(admitted, family, True).select("page_id", "attempt"), ["page_id", "attempt"], "left_semi")
    pages = page_lines(chosen).select("page_id", cluster_rows(F.col("lines")).alias("rows"))
    texts = pages.select("page_id", F.filter(F.transform(F.filter("rows", lambda r: ~unwanted(r["text"], F.lit(family))), lambda r: L.initials(r["text"])), lambda x: L.keepable(x)).alias("texts"))
    merged = texts.select("page_id", merge_similar(F.col("texts")).alias("m"))
    parts = merged.select("page_id", distinct_parts(F.col("m")).alias("p"))
    final = parts.select("page_id", uncovered(F.col("p")).alias("f"))
    return final.select("page_id", *[c.alias(n) for n, c in result(F.col("f")).items()])


def selected_text(lines: Column, checked: Column) -> Column:
    """The checked lines joined by spaces, in order."""
    pairs = F.filter(F.arrays_zip(lines.alias("l"), checked.alias("c")), lambda x: x["c"])
    return F.array_join(F.transform(pairs, lambda x: x["l"]), " ")

"""Quality rules: base rules on each whole text and a hashed n-gram likelihood ratio.

Two multinomials over the hashed unigrams and bigrams are counted: the raw corpus (all documents) and a trusted target
(documents marked as good). A document's score is the mean over its n-grams of log p_target - log p_raw; it is kept if it
passes the base rules and its score is at least a threshold, which is calibrated on good documents that the target was not
counted on. The number of hash buckets grows with the square root of the corpus's bytes, as vocabularies do, so that what
is counted grows with the corpus and no text is shuffled: up to BROADCAST_BUCKETS the ratios are broadcast; beyond that those of
frequent buckets are, and all others meet the n-grams in a shuffled join. Everything is DataFrame expressions.

Defined results: a null or empty text has no words, fails the base rules and is not kept; with an empty target or corpus
every ratio is 0; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, materialize, spaced_words

#: Least number of hash buckets, and buckets for each square root of a byte; the number is the nearest power of two.
BUCKETS = 1 << 14
BUCKETS_PER_ROOT = 24
#: Most buckets whose ratios are broadcast, some 24 bytes each.
BROADCAST_BUCKETS = 1 << 22
#: Added to each bucket's count, as a share of the mean count.
SMOOTHING = 0.1
#: Highest threshold, and the one without held-out documents: lowest mean log-likelihood ratio that is kept.
THRESHOLD = -0.2
#: Share of the held-out good documents that the calibrated threshold keeps at least.
KEPT = 0.99
#: Most labelled documents that are trusted; the raw corpus is always counted whole.
TRUSTED = 20_000
#: One in so many trusted documents is held out of the target, to calibrate the threshold.
HELD = 5
#: Buckets with at least this share of all occurrences are broadcast in any case; there are no more than 1 / HOT_SHARE.
HOT_SHARE = 1 / 65_536
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5


def repeat_words(words: Column) -> Column:
    """Number of words that lie in a 5-word window found twice or more in the text, first included.

    Windows are compared by 64-bit hashes, which are put together from hashes of words and of pairs. Only texts with a repeated
    window pay for locating it: hashes are sorted with their positions, neighbours with equal hashes are repeated, and the
    covered positions are added up in order.
    """

    def cut(x: Column, first: int, less: int) -> Column:
        return F.slice(x, first, F.greatest(F.size(x) - less, F.lit(0)))

    def joined(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))

    def covered(tagged: Column) -> Column:
        def repeated(x: Column, k: Column) -> Column:
            same = lambda j: F.coalesce(F.get(tagged, j)["h"] == x["h"], F.lit(False))
            return same(k - 1) | same(k + 1)

        starts = F.array_sort(F.transform(F.filter(tagged, repeated), lambda x: x["i"]))
        init = F.struct(F.lit(0).alias("n"), F.lit(1 - WINDOW).alias("last"))
        return F.aggregate(starts, init, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    def located(hashes: Column) -> Column:
        tagged = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), (k + 1).alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bound(tagged, covered))

    def windows(ones: Column) -> Column:
        def of_pairs(pairs: Column) -> Column:
            fours = joined(cut(pairs, 1, 2), cut(pairs, 3, 2))
            return bound(joined(fours, cut(ones, WINDOW, WINDOW - 1)), located)

        return bound(joined(cut(ones, 1, 1), cut(ones, 2, 1)), of_pairs)

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(bound(F.transform(words, lambda w: F.xxhash64(w)), windows))


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with words and the base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Names that docs has already are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("words", spaced_words(F.col(text)))
    out = out.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(F.col("words")).cast("long"),
    })
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _grams(words: Column) -> Column:
    """Array of (word, next word or null), one for each word."""
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))


def _buckets(gram: Column, buckets: int) -> Column:
    """Buckets of the unigram and of the bigram; the last word has no bigram, and a text without words neither."""
    one = F.when(gram["a"].isNotNull(), F.xxhash64(gram["a"]).bitwiseAND(F.lit(buckets - 1)))
    two = F.when(gram["b"].isNotNull(), F.xxhash64(gram["a"], gram["b"], F.lit(2)).bitwiseAND(F.lit(buckets - 1)))
    return F.array(one, two)


def space(docs: DataFrame, text: str = "text") -> int:
    """Number of hash buckets for docs: a power of two near BUCKETS_PER_ROOT times the square root of all texts' bytes."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 1
    return max(BUCKETS, 1 << round(math.log2(BUCKETS_PER_ROOT * math.sqrt(total))))


def fit(docs: DataFrame, trusted: Column, text: str = "text", held: Column | None = None) -> DataFrame:
    """The model: bucket, llr and hot; and one row with a null bucket, which has the number of buckets and the threshold.

    trusted: which rows of docs are the target; all rows are the raw corpus. held: good rows outside the target, by default
    those with _held if docs has that column. The threshold keeps KEPT of them, and is at most THRESHOLD.
    """
    spark = docs.sparkSession
    if held is None and "_held" in docs.columns:
        held = docs["_held"]
    buckets = space(docs, text)
    rows = docs.select(F.coalesce(trusted, F.lit(False)).cast("long").alias("good"), F.explode(_grams(spaced_words(F.col(text)))).alias("g"))
    rows = rows.select("good", F.explode(_buckets(F.col("g"), buckets)).alias("bucket")).where("bucket is not null")
    counts = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target")), "counts")
    totals = counts.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    share = lambda n, total: (F.col(n) + SMOOTHING * F.col(total) / buckets) / ((1 + SMOOTHING) * F.col(total))
    llr = F.when((F.col("n_target") > 0) & (F.col("n_raw") > 0), F.log(share("target", "n_target")) - F.log(share("raw", "n_raw"))).otherwise(0.0)
    hot = F.col("raw") >= HOT_SHARE * F.col("n_raw")
    ratios = materialize(counts.crossJoin(F.broadcast(totals)).select("bucket", llr.alias("llr"), hot.alias("hot")), "ratios")  # totals is one row
    least = THRESHOLD
    if held is not None:
        tried = _scored(docs.where(held).select(F.col(text).alias("_text")), ratios, buckets, [], "_text")
        # no filter, which would be pushed below the base columns and compute them again; percentiles leave out nulls
        low = tried.agg(F.expr(f"percentile_disc({1 - KEPT:.6f}) within group (order by case when not base_failed then score end)")).first()[0]
        least = THRESHOLD if low is None else min(low, THRESHOLD)
    facts = spark.range(1).select(F.lit(None).cast("long").alias("bucket"), F.lit(0.0).alias("llr"), F.lit(False).alias("hot"), F.lit(buckets).cast("long").alias("buckets"), F.lit(float(least)).alias("threshold"))
    return ratios.withColumns({"buckets": F.lit(None).cast("long"), "threshold": F.lit(None).cast("double")}).union(facts)


def _scored(docs: DataFrame, ratios: DataFrame, buckets: int, columns: list[str], text: str) -> DataFrame:
    """columns of docs, base columns and score (0 without n-grams) of every row.

    A row's n-grams are exploded, meet their ratios and are added up again by a number of the row, which combines in the task that
    read it. The columns go along as grouping keys.
    """
    keys = ["_row", *columns, *BASE]
    rows = base_columns(docs, text).select(F.monotonically_increasing_id().alias("_row"), *columns, *BASE, "words")
    slim = ratios.where("bucket is not null").select("bucket", "llr")
    done = lambda df, s, n: df.groupBy(*keys).agg(F.sum(s).alias("_s"), F.sum(n).alias("_n"))
    grams = rows.select(*keys, F.explode_outer(_grams(F.col("words"))).alias("_g"))
    if buckets <= BROADCAST_BUCKETS:
        pair = _buckets(F.col("_g"), buckets)
        grams = grams.select(*keys, pair[0].alias("_b1"), pair[1].alias("_b2"))
        for b, llr in (("_b1", "_l1"), ("_b2", "_l2")):
            grams = grams.join(F.broadcast(slim.select(F.col("bucket").alias("_x"), F.col("llr").alias(llr))), F.col(b) == F.col("_x"), "left").drop("_x")
        parts = done(grams, F.coalesce("_l1", F.lit(0.0)) + F.coalesce("_l2", F.lit(0.0)), F.col("_b1").isNotNull().cast("long") + F.col("_b2").isNotNull().cast("long"))
    else:
        grams = grams.select(*keys, F.explode(_buckets(F.col("_g"), buckets)).alias("_b"))
        met, x = F.col("_b") == F.col("_x"), F.col("bucket").alias("_x")
        hot = F.broadcast(ratios.where("hot").select(x, "llr"))
        rest = ratios.where("not hot and bucket is not null").select(x, "llr").hint("shuffle_hash")
        score, n = F.coalesce("llr", F.lit(0.0)), F.col("_b").isNotNull().cast("long")
        # n-grams that are not there (null) go with the broadcast ones, so that they never meet in one task
        frequent = grams.join(hot, met, "left").where("_b is null or _x is not null")
        parts = done(frequent, score, n).union(done(grams.where("_b is not null").join(hot, met, "left_anti").join(rest, met, "left"), score, n))
        parts = parts.groupBy(*keys).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return parts.select(*columns, *BASE, F.when(F.col("_n") > 0, F.round(F.col("_s") / F.col("_n"), 9)).otherwise(0.0).alias("score"))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judge_rows(docs: DataFrame, model: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """columns of docs, base columns, score and kept of every row."""
    facts = model.where("bucket is null").first()
    out = _scored(docs, model, facts.buckets, columns, text)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= facts.threshold))


def judge(docs: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base columns, score and kept of every row of docs."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return judge_rows(rows, model, ["_key"], "_text").withColumnRenamed("_key", key).select(key, *BASE, "score", "kept")


def trusted_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", most: int = TRUSTED) -> DataFrame:
    """docs with _good: true for the documents of the target; and _held: true for those held out to calibrate the threshold.

    Trusted are identifiers that every label of theirs calls good quality and not toxic; of more than most of them, those
    with the least MD5. The bound makes the trusted set small enough to broadcast at any size of the corpus. About one in
    HELD of them is held out, the others are the target.
    """
    good = labels.groupBy(F.col(key)).agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("_g")).where("_g = 1")
    good = good.select(F.col(key).alias("_k")).orderBy(F.md5(F.col("_k").cast("string"))).limit(most)
    good = good.withColumn("_out", F.pmod(F.xxhash64("_k"), F.lit(HELD)) == 0)
    sure = lambda c: F.coalesce(c, F.lit(False))
    out = docs.join(F.broadcast(good), docs[key] == good["_k"], "left")
    return out.withColumns({"_good": sure(~F.col("_out")), "_held": sure(F.col("_out"))}).drop("_k", "_out")

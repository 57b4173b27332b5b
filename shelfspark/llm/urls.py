"""URL filters: path rules and a character language-model ratio.

Rules decide the URLs they fit. They also label those URLs: two character models of variable order are counted, one on
accepted and one on rejected URLs, and a URL without rule is judged by the mean over its characters of
log p_accepted - log p_rejected against a threshold calibrated on labelled URLs that the models have not seen.

A model interpolates all orders up to ORDER: p_k(c | h) = (count(hc) + PRIOR * p_(k-1)(c | h')) / (count(h) + PRIOR), h' being h
without its first character, down to a uniform distribution over ALPHABET characters. All is DataFrame expressions. Only
the distinct (ORDER + 1)-grams of the URLs, a number that hardly grows with them, are ever given a probability; the URLs then
add up what their grams have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small_side

#: (verdict, rule): the rule is a host, a slash and the rest of a path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ORDER = 4
PRIOR = 2.0
ALPHABET = 100.0
#: Labelled URLs whose MD5 begins with one of these are kept from the models, for calibration.
HELD_OUT = ("0", "1", "2")
PAD, END = "\x01", "\x02"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first :// up to / ? # or end, A-Z lower-cased; then up to ? # or end. Else empty."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of equally long ones the first listed wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def _grams(s: Column) -> Column:
    """The (ORDER + 1)-gram that ends at each character of s and at its end mark."""
    padded = F.concat(F.lit(PAD * ORDER), s, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(s) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def ratios(labelled: DataFrame, grams: DataFrame) -> DataFrame:
    """gram and ratio, log p_accepted - log p_rejected of its last character, of each row of grams(gram).

    labelled: url strings s with good (true: accepted). With one of both kinds missing every ratio is null.
    """
    seen = labelled.select("good", F.explode(_grams(F.col("s"))).alias("gram")).groupBy("gram").agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r"))
    out = grams.withColumns({"pa": F.lit(1 / ALPHABET), "pr": F.lit(1 / ALPHABET)})
    for k in range(ORDER + 1):  # histories of k characters
        full = seen.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias(f"g{k}")).agg(F.sum("a").alias("ga"), F.sum("r").alias("gr"))
        head = seen.groupBy(F.substring("gram", ORDER + 1 - k, k).alias(f"h{k}")).agg(F.sum("a").alias("ha"), F.sum("r").alias("hr"))
        out = out.withColumns({f"g{k}": F.substring("gram", ORDER + 1 - k, k + 1), f"h{k}": F.substring("gram", ORDER + 1 - k, k)})
        out = out.join(full, f"g{k}", "left").join(head, f"h{k}", "left").na.fill(0, ["ga", "gr", "ha", "hr"])
        out = out.select("gram", *[((F.col("g" + x) + PRIOR * F.col("p" + x)) / (F.col("h" + x) + PRIOR)).alias("p" + x) for x in "ar"])
    both = seen.agg((F.sum("a") > 0).alias("any_a"), (F.sum("r") > 0).alias("any_r"))  # one row
    return out.crossJoin(F.broadcast(both)).select("gram", F.when(F.col("any_a") & F.col("any_r"), F.log("pa") - F.log("pr")).alias("ratio"))


def scores(strings: DataFrame, ratio: DataFrame, keep: list[str]) -> DataFrame:
    """keep and score of each distinct row of strings(s, ...): the mean ratio over its characters and end mark.

    ratio is a written table. The first grams are those of nearly all URLs; where ratio is too large to be broadcast Spark splits them.
    """
    rows = strings.select(*keep, F.explode(_grams(F.col("s"))).alias("gram")).join(small_side(ratio), "gram")
    return rows.groupBy(*keep).agg(F.avg("ratio").alias("score"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict and score of every row of pages.

    A null URL, and one without ://, has an empty host and path, fits no rule and is judged like any other. Without
    labelled URLs of both kinds there is no model, and what no rule fits is allowed. Repeated rows are judged alike and
    count once in the models; other columns are ignored.
    """
    host, path = parts(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, say = rule_of(F.col("host"), F.col("path"), rules)
    rows = materialize(rows.select(key, "host", "path", rule.alias("rule"), say.alias("say"), F.concat("host", "path").alias("s")), "urls")
    distinct = rows.groupBy("s", "host", "path", "say").agg(F.count(F.lit(1)).alias("n"))
    known = distinct.where("say is not null").select("s", "host", "path", (F.col("say") == "allow").alias("good"))
    held = F.substring(F.md5("s"), 1, 1).isin(*HELD_OUT)
    grams = distinct.select(F.explode(_grams(F.col("s"))).alias("gram")).distinct()
    ratio = materialize(ratios(known.where(~held), grams), "ratios")
    each = scores(known.where(held), ratio, ["s", "host", "path", "good"])
    means = each.agg(F.avg(F.when(F.col("good"), F.col("score"))).alias("ma"), F.avg(F.when(~F.col("good"), F.col("score"))).alias("mr"))
    cut = means.select(((F.col("ma") + F.col("mr")) / 2).alias("threshold"))  # one row
    judged = scores(distinct.where("say is null"), ratio, ["host", "path"]).withColumnsRenamed({"host": "h", "path": "p"})
    out = rows.join(judged, F.col("say").isNull() & (rows["host"] == judged["h"]) & (rows["path"] == judged["p"]), "left").crossJoin(F.broadcast(cut))
    passes = F.col("score") >= F.coalesce("threshold", F.lit(0.0))
    verdict = F.coalesce("say", F.when(F.coalesce(passes, F.lit(True)), "allow").otherwise("block"))
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), "score")

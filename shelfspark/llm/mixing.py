"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code-point order (null last) have the weights 5, 2, 1, repeating, and share the words of the whole table. A
source's target stops at MAX_EPOCHS times its words; what it cannot take goes to the others by weight. Each source gives
complete epochs first; the rest of its target is filled in the order of exponential keys -ln(u) / weight, u being a
hash of the identifier and of the text, so that a heavier document comes earlier with the proper probability and reruns agree.

A source may hold any share of the rows: its documents are spread evenly over key ranges, each range is summed up where it
lies, and only the sums of ranges are accumulated across a source. Rows alike in everything are one row with a count.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small_side, spaced_words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: About as many documents are sorted together.
RANGE_ROWS = 10_000
SEED = "mix-1"
#: Most sources whose cuts are broadcast.
SOURCES = 100_000
#: Alike rows that come out of one row of the plan.
ALIKE = 1 << 16
#: Quality weights: of documents labelled good, labelled bad, and without label.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, source_rows and target of each source. sizes: source, size.

    A source is held at max_epochs times its size if its share at the common rate would be more. Ordered by how soon
    they are held, the rate left for those from a source onwards rises while sources are held and falls after, so the
    rate is its maximum. The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("hold", max_epochs * F.col("source_size"))
    order = every.orderBy(F.col("hold") / F.col("weight"), F.col("source").asc_nulls_last())
    held = F.coalesce(F.sum("hold").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(every)
    per = per.withColumn("rate", (total - held) / left)
    target = F.least(F.col("hold").cast("double"), F.max("rate").over(every) * F.col("weight"))
    return per.select("source", "source_size", "source_rows", target.alias("target"))


def uniform(key: Column, salt: Column | None = None) -> Column:
    """A number in (0, 1) from the identifier, and salt if given; alike ones get equal numbers."""
    parts = [F.lit(SEED), F.coalesce(key.cast("string"), F.lit("null")), *([] if salt is None else [F.coalesce(salt, F.lit(""))])]
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 48)


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size, the number of words [^\\x20\\x09-\\x0D]+ of the whole text (0 for null)."""
    return docs.withColumn("size", F.size(spaced_words(F.col(text))).cast("long"))


def order_key(weight: Column, key: Column, salt: Column | None = None) -> Column:
    """The exponential key: the least come first. A null weight counts as 1."""
    return -F.log(uniform(key, salt)) / F.coalesce(weight, F.lit(1.0))


def mix(sized: DataFrame, weight: Column | None = None, key: str = "doc_id", source: str = "source", salt: Column | None = None) -> DataFrame:
    """sized (slim rows with a size) with source_size, target and taken, the words that the mix takes of the row, repeats counted.

    taken is a whole multiple of size: the complete epochs, and one more for the documents first in key order whose sizes
    add up to the rest of the target; the last one is taken if that brings the sum nearer. salt tells rows of one identifier
    apart, best by a hash of the text. Ties of keys are broken by identifier, salt and size; rows alike in all columns are
    interchangeable. A row of size 0 takes 0; a null weight counts as 1; a null source is a source of its own. An empty table gives
    an empty result. Columns of sized that are named like the new ones are replaced; those of map type can't be there.
    """
    new = ["source_size", "target", "taken"]
    sized = sized.drop(*new)
    out = _placed(sized, weight, key, source, salt)
    # of _m rows alike the first _more are in the last epoch
    taken = (F.col("epochs") + (F.col("_nth") < F.col("_more")).cast("int")) * F.col("size")
    # in chunks, which are dealt to as many tasks as there are shuffle partitions, so that very many alike rows are no long array and no single task
    chunks = out.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(ALIKE).cast("long"))))
    dealt = chunks.repartition(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key", "_from")
    each = dealt.withColumn("_nth", F.explode(F.sequence(F.col("_from"), F.least(F.col("_m"), F.col("_from") + ALIKE) - 1)))
    return each.withColumn("taken", taken.cast("long")).select(*sized.columns, *new)


def cuts(sized: DataFrame, weight: Column | None = None, key: str = "doc_id", source: str = "source", salt: Column | None = None) -> DataFrame:
    """_s, epochs and cut of each source: what mix() takes once more than epochs are its rows up to cut, a struct of key, identifier and salt.

    Rows alike count together here.
    """
    out = _placed(sized, weight, key, source, salt)
    last = F.max(F.when((F.col("_more") > 0) & (F.col("size") > 0), F.struct("_key", F.col(key).alias("id"), F.col("_salt").alias("salt"))))
    return out.groupBy("_s").agg(F.first("epochs").alias("epochs"), last.alias("cut"))


def _placed(sized: DataFrame, weight: Column | None, key: str, source: str, salt: Column | None) -> DataFrame:
    """Groups of alike rows: sized's columns, _s, _m (rows), _key, _salt, source_size, target, epochs, and _more, how many are in the last epoch."""
    weight = F.coalesce(weight if weight is not None else F.lit(1.0), F.lit(1.0)).cast("double")
    rows = sized.withColumns({"_w": weight, "_salt": (salt if salt is not None else F.lit("")).cast("string"), "_key": order_key(weight, F.col(key), salt)})
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_m"))
    goal = targets(sized.select(F.col(source).alias("source"), "size")).withColumnRenamed("source", "_s")
    goal = goal.withColumns({"epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0), "ranges": F.ceil(F.col("source_rows") / RANGE_ROWS)})
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # a key of weight w lies below x with probability 1 - exp(-w x), so the mean of that over a source's weights, in few steps, is even
    step = F.greatest(F.lit(-40), F.least(F.lit(40), F.round(4 * F.log2("_w")))).cast("int")
    shares = rows.groupBy(F.col(source).alias("_ws"), step.alias("step")).agg(F.sum("_m").alias("n"))
    shares = shares.groupBy("_ws").agg(F.collect_list(F.struct(F.pow(F.lit(2.0), F.col("step") / 4).alias("w"), "n")).alias("weights"))
    goal = goal.join(shares, F.col("_s").eqNullSafe(F.col("_ws"))).drop("_ws")
    dealt = rows.join(goal, rows[source].eqNullSafe(goal["_s"]))
    below = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x["n"] * (1 - F.exp(-x["w"] * F.col("_key"))))
    dealt = dealt.withColumn("_range", F.least(F.floor(below / F.col("source_rows") * F.col("ranges")), F.col("ranges") - 1))
    sums = dealt.groupBy(F.col("_s").alias("_rs"), F.col("_range").alias("_r")).agg(F.sum(F.col("size") * F.col("_m")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_rs").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_rs", "_r", before.alias("_before"))
    placed = dealt.join(sums, dealt["_s"].eqNullSafe(sums["_rs"]) & (dealt["_range"] == sums["_r"]))
    inside = Window.partitionBy("_s", "_range").orderBy("_key", F.col(key).asc_nulls_first(), "_salt", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("_before") - F.coalesce(F.sum(F.col("size") * F.col("_m")).over(inside), F.lit(0))
    # the row that is the j-th of its kind is in if what lies before it and half of itself fit
    more = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.greatest(F.lit(0), F.least(F.col("_m"), F.floor(left / F.col("size") + 0.5)))).otherwise(0)
    return placed.withColumn("_more", more)


def quality_weights(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """_k and _quality: the weight of each labelled identifier; several labels count as good if all are."""
    return labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.when(F.min("quality") == 1, GOOD).when(F.min("quality") == 0, BAD).otherwise(UNKNOWN).alias("_quality"))


def weighed(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with _quality, the weight from labels(doc_id, quality). Rows without identifier have no label and meet none."""
    marks = small_side(materialize(quality_weights(labels, key), "weights"))
    rows = docs.drop("_quality", "_k")
    known = rows.where(F.col(key).isNotNull()).join(marks, F.col(key) == F.col("_k"), "left").drop("_k")
    known = known.withColumn("_quality", F.coalesce("_quality", F.lit(UNKNOWN)))
    return known.union(rows.where(F.col(key).isNull()).withColumn("_quality", F.lit(UNKNOWN)))


def repeated(docs: DataFrame, plan: DataFrame, weight: Column, columns: list[str], key: str = "doc_id", source: str = "source", text: str = "text", salt: Column | None = None) -> DataFrame:
    """The mix itself: columns of each row of docs as often as plan, from cuts(), takes it; docs are neither sorted nor shuffled.

    Rows without words are kept once; they weigh nothing.
    """
    here = F.struct(order_key(weight, F.col(key), salt).alias("_key"), F.col(key).alias("id"), (salt if salt is not None else F.lit("")).cast("string").alias("salt"))
    rows = docs.join(F.broadcast(plan) if plan.count() <= SOURCES else plan, docs[source].eqNullSafe(plan["_s"]))
    once_more = F.coalesce(here <= F.col("cut"), F.lit(False)).cast("int")
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    times = F.when(worded, F.col("epochs").cast("int") + once_more).otherwise(1)
    return rows.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*columns)

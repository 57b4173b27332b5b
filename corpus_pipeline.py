"""The corpus pipeline: quality rules, near-duplicate join, decontamination, mixing, token-ID output.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import decontam, jaccard, mixing, quality, sst
from shelfspark.llm.common import materialize, settled, small_side, table, text_hash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs without the rows whose identifier and text hash are in bad(_k, _h), a written table."""
    same = (text_hash(F.coalesce("text", F.lit(""))) == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_k"))
    return docs.select(COLUMNS).join(small_side(bad), same, "left_anti")


def _marks(docs: DataFrame) -> DataFrame:
    """docs with _k and _h, by which _without finds them again."""
    return docs.withColumns({"_k": F.col("doc_id"), "_h": text_hash(F.coalesce("text", F.lit("")))})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the likelihood ratio reject."""

    def rejected() -> DataFrame:
        marked = quality.trusted_rows(docs, table(spark, sf_dir, "labels"))
        model = quality.fit(marked, marked["_good"])
        verdicts = quality.judge_rows(_marks(docs).select("_k", "_h", "text"), model, ["_k", "_h"])
        return verdicts.where("not kept").select("_k", "_h").distinct()

    return _without(docs, settled(spark, rejected, "rejected"))


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class: that with the least identifier, of its texts that with the least hash.

    A document without an identifier is kept if its class has no other; of equal documents one. Documents without words are
    in no class and are all kept.
    """

    def passed() -> DataFrame:
        """_k, _h of rows that go (n is 1), and of those of which one stays (n over 1)."""
        classes = jaccard.classed_rows(docs).where("class_no is not null")
        rows = materialize(classes.groupBy("class_no", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")), "rows")
        lead = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("lead")
        leads = materialize(rows.groupBy("class_no").agg(lead), "leads")
        first = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash"))
        met = rows.join(leads, "class_no").where(~first | (F.col("n") > 1))
        return met.select(F.col("doc_id").alias("_k"), F.col("text_hash").alias("_h"), F.when(first, F.col("n")).otherwise(1).alias("n"))

    gone = settled(spark, passed, "duplicates")
    kept = _without(docs, gone.select("_k", "_h"))
    again = materialize(gone.where("n > 1").select("_k", "_h"), "repeated")
    if not again.count():
        return kept
    same = (F.col("_ih") == F.col("_h")) & F.col("_ik").eqNullSafe(F.col("_k"))
    alike = _marks(docs.select(COLUMNS)).withColumnsRenamed({"_k": "_ik", "_h": "_ih"}).join(small_side(again), same)
    one = alike.groupBy("_ik", "_ih").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("r"))
    return kept.union(one.select(*[F.col(f"r.{c}").alias(c) for c in COLUMNS]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark windows over the contract's share of their words."""

    def found() -> DataFrame:
        hits = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
        return hits.where("contaminated").select("doc_id", "text_key").distinct()

    bad = settled(spark, found, "contaminated").select(F.col("doc_id").alias("_k"), F.col("text_key").alias("_h"))
    same = (decontam.text_key(F.col("doc_id"), F.col("text")) == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_k"))
    return docs.select(COLUMNS).join(small_side(bad), same, "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, sample or leave out documents so that sources reach their targets.

    The mix is decided on slim rows without texts; what it takes of a source is everything up to a cut in key order, so the texts
    themselves are neither sorted nor shuffled for it.
    """
    labels, salt = table(spark, sf_dir, "labels"), F.md5(F.coalesce("text", F.lit("")))

    def plan() -> DataFrame:
        sized = mixing.with_sizes(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", salt.alias("salt"))
        slim = materialize(mixing.weighed(sized, labels), "sizes")
        return mixing.cuts(slim, slim["_quality"], salt=slim["salt"])

    cuts = settled(spark, plan, "cuts")
    rows = mixing.weighed(docs.select(COLUMNS), labels)
    return mixing.repeated(rows, cuts, F.col("_quality"), COLUMNS, salt=salt)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the mix as sorted-string-table shards and read them back."""
    return settled(spark, lambda: sst.sorted_token_table(docs), "tokens")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicate_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID output", token_shards),
]

#: SQL cannot express hashed likelihood ratios or a tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input, and deleted when that is written."""
    docs = table(spark, sf_dir, "documents")

    def after(docs: DataFrame, k: int) -> DataFrame:
        return STAGES[k][1](spark, settled(spark, lambda: after(docs, k - 1), f"stage-{k - 1}") if k else docs, sf_dir)

    return settled(spark, lambda: after(docs, len(STAGES) - 1), "pipeline")

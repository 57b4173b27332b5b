"""The corpus operators over the driver's tables: one query an operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, importance, jaccard, licenses, mixing, quality, sharding, spelling, sst, token_counts, urls, warc
from .common import materialize, settled, table
from .sql import ORACLE_SQL  # noqa: F401  part of this module's tables


def _settled(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """build with its result written out, and the files that it has made on the way deleted."""

    @wraps(build)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return settled(spark, lambda: build(spark, sf_dir), build.__name__)

    return query


@_settled
def op1_sst_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.sorted_token_table(table(spark, sf_dir, "documents"))


@_settled
def op2_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@_settled
def op3_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


@_settled
def op4_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=True).drop("text_key")


def op5_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@_settled
def op6_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("score")


@_settled
def op7_epoch_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_sizes(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", F.md5(F.coalesce("text", F.lit(""))).alias("salt"))
    slim = materialize(mixing.weighed(docs, table(spark, sf_dir, "labels")), "sizes")
    return mixing.mix(slim, slim["_quality"], salt=slim["salt"]).select("doc_id", "size", "source_size", "target", "taken")


def op8_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"))


def op9_permutation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


@_settled
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = quality.trusted_rows(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, quality.fit(marked, marked["_good"]))


@_settled
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@_settled
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


_ALL = (
    op1_sst_shards,
    op2_bayes_jaccard,
    op3_chunked_warc,
    op4_positional_index,
    op5_license_compression,
    op6_url_model,
    op7_epoch_mix,
    op8_section_tokens,
    op9_permutation_shards,
    op10_quality_rules,
    op11_spelling_variants,
    op12_importance_resampling,
    op13_bpe_transducer,
)
QUERIES = {f.__name__: f for f in _ALL}

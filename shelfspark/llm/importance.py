"""Importance resampling towards a target distribution, with n-gram features counted by an external sort.

1. Texts are read once. The features of each are the runs of 1 to 3 words, hashed to one of BUCKETS buckets; they are written
   as blocks: the buckets of many documents as one packed stream of 16-bit integers, with the offset at which each document begins.
2. To count them, each block's stream is sorted and run-length encoded; runs of one bucket are added up, in the tasks first.
3. A bucket's gain is the logarithm of its share in the target over its share in the corpus, in thousandths. The BUCKETS gains are
   gathered along each stream and added up between the offsets with np.add.reduceat, which is the weight of each document.
4. Gumbel noise, fixed by seed and identifier, turns the highest scores into a sample without replacement. Scores are sorted by ranges, and a
   row's rank is its place in its range behind the sizes of earlier ranges.

Defined results: a null or empty text has no features and weight 0; an empty target or corpus counts as nothing seen; equal rows of one
identifier have equal scores and take ranks in any order among themselves; a null identifier is hashed as an empty string and comes
first among equal scores; an empty table gives no rows; other columns are ignored. A document's features lie in one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import folded_words, materialize, small_batches

BUCKETS = 10_000
#: Bytes of a stream after which a block is closed, words that are hashed at one go, and documents in a block at most.
BLOCK_BYTES, WORDS, DOCUMENTS = 1 << 20, 50_000, 2_000
MIN_WORDS, PERCENT, SEED = 20, 5, 42
_BLOCK = "stream binary, offsets array<long>, doc_ids array<long>, words array<long>, features array<long>"


def _features(words: list[bytes]) -> Iterator[bytes]:
    """Packed buckets of the runs of 1, 2 and 3 words; a run's checksum goes on from that of the run without its last word."""
    import numpy as np

    for start in range(0, len(words), WORDS):
        part = words[start : start + WORDS + 2]
        n = min(WORDS, len(part))
        spaced = [b" " + w for w in part[1:]]
        one = [*map(zlib.crc32, part[:n])]
        two = [*map(zlib.crc32, spaced, one)]  # map ends with the shorter list: the last word begins no pair
        three = [*map(zlib.crc32, spaced[1:], two)]
        sums = np.fromiter(chain(one, two, three), np.uint32, len(one) + len(two) + len(three))
        yield (sums % BUCKETS).astype("<u2").tobytes()


def streams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of feature streams: what is to be written and read again for counts and for gains."""
    small_batches(docs.sparkSession)

    def pack(batches):
        import pyarrow as pa

        def block() -> pa.RecordBatch:
            columns = [pa.array([b"".join(stream)], pa.binary()), *(pa.array([c], pa.list_(pa.int64())) for c in (offsets, keys, words, features))]
            return pa.RecordBatch.from_arrays(columns, names=["stream", "offsets", "doc_ids", "words", "features"])

        stream, offsets, keys, words, features, size = [], [], [], [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                found = folded_words(t.as_py())
                offsets.append(size // 2)
                before = size
                for packed in _features(found):
                    stream.append(packed)
                    size += len(packed)
                keys.append(k.as_py())
                words.append(len(found))
                features.append((size - before) // 2)
                if size >= BLOCK_BYTES or len(keys) == DOCUMENTS:
                    yield block()
                    stream, offsets, keys, words, features, size = [], [], [], [], [], 0
        if keys:
            yield block()

    return docs.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(pack, _BLOCK)


def counts(blocks: DataFrame) -> DataFrame:
    """(bucket, n) over all streams."""

    def runs(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0):
                ids = np.sort(np.frombuffer(raw.as_py(), "<u2"), kind="stable")  # by radix
                starts = np.flatnonzero(np.diff(ids, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[starts].astype("i4")), pa.array(np.diff(starts, append=len(ids)).astype("i8"))], names=["bucket", "n"])

    found = blocks.select("stream").mapInArrow(runs, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> list[int]:
    """Gain of each bucket from the counts of both; BUCKETS numbers, whatever the tables hold."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).union(target.select("bucket", F.lit(0), "n"))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = corpus.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(rows, "bucket", "left").fillna(0, ["s", "t"])
    total = Window.partitionBy()  # over BUCKETS rows
    part = lambda c: (F.col(c) + 1).cast("double")
    whole = lambda c: (F.sum(c).over(total) + BUCKETS).cast("double")
    gain = F.floor(1000 * F.log(part("t") * whole("s") / (part("s") * whole("t"))))
    return [r.gain for r in every.select("bucket", gain.alias("gain")).orderBy("bucket").collect()]


def weights(blocks: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""

    def gather(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(gain, "i8")
        for batch in batches:
            for raw, offsets, keys, words, features in zip(*(batch.column(i) for i in range(5)), strict=True):
                n = np.array(features.as_py(), "i8")
                sums, some = np.zeros(len(n), "i8"), n > 0
                if some.any():  # reduceat takes a place with nothing for one value
                    sums[some] = np.add.reduceat(table[np.frombuffer(raw.as_py(), "<u2")], np.array(offsets.as_py(), "i8")[some])
                yield pa.RecordBatch.from_arrays([keys.values, words.values, pa.array(n), pa.array(sums)], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an identifier, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document: the drawn ones have ranks from 1, the others null.

    docs has doc_id and text, target has text. Of documents with min_words or more, percent % are drawn.
    """
    blocks = materialize(streams(docs), "streams")
    aims = materialize(streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text")), "target")
    gain = gains(counts(blocks), counts(aims))
    scored = weights(blocks, gain).withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "_row": F.monotonically_increasing_id()})
    scored = materialize(scored, "scores")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "_row"]
    able = scored.where(F.col("n_words") >= min_words)
    ranged = materialize(able.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    drawn = able.count() * percent // 100
    place = (F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")).cast("long")
    ranks = ranged.join(F.broadcast(starts), "_part").withColumn("rank", place)
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranks.select(columns).union(rest.select(columns))

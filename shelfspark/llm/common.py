"""Helpers shared by the corpus operators: shared storage, tables, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BROADCAST_ROWS, materialize, remove, scratch, settled, shared_dir, small_side  # noqa: F401  for the operators

#: Rows in one Arrow batch; with whole documents as rows this keeps a Python worker small.
BATCH_ROWS = 256


def spread_files(files: DataFrame, per_task: int = 2) -> DataFrame:
    """Deal a stored list of files to tasks, per_task to each.

    The list itself is tiny whatever the files hold, so adaptive execution would hand all of it to one task; a stated number of
    partitions is left alone. Only the number of files reaches the driver.
    """
    return files.repartition(max(1, -(-files.count() // per_task)))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or a plain path; used inside tasks."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class Publisher:
    """A file that is written piece by piece under a private name beside uri and moved into place when it is whole.

    A task that is lost or runs twice therefore never leaves half a file under the final name.
    """

    def __init__(self, uri: str) -> None:
        self.uri = uri
        self.store, self.path = filesystem(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out, self.bytes = self.store.open_output_stream(self.part, compression=None), 0

    def write(self, data) -> None:
        self.bytes += len(data)
        self.out.write(data)

    def finish(self) -> None:
        self.out.close()
        self.store.move(self.part, self.path)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced_words(text: Column) -> Column:
    """Array of the runs [^\\x20\\x09-\\x0D]+ of text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]"), "")


def text_hash(text: Column) -> Column:
    """128 bits, so that no two texts of even a very large corpus share a value."""
    return F.unhex(F.md5(text.cast("binary")))


#: bytes.translate table: A-Z to a-z, every other ASCII character that is no digit or letter to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def folded_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the UTF-8 text with A-Z lower-cased; none for null."""
    return text.translate(_FOLD).split() if text else []


#: What a Python worker remembers between tasks, by kind: how to forget it.
_memories: dict[str, Callable[[], None]] = {}


def remembers(kind: str, forget: Callable[[], None]) -> None:
    _memories[kind] = forget


def keep_only(kind: str) -> None:
    """Forget what this worker remembers of other kinds. A worker serves one operator after the other; its memory is that of one."""
    for other, forget in _memories.items():
        if other != kind:
            forget()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound; keeps a worker's memory flat."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxh64_intdigest(word)
        return value


#: Of this worker, for all operators on folded words.
word_hashes = WordHashes()
remembers("words", word_hashes.clear)

"""Data sources of the catalogue's own: stored lookup answers that are found by ISBN, and a sink of whole files.

    register(spark)
    spark.read.format("stored_answers").load(path).where("isbn = '9780306406157'")
    payloads.write.format("whole_files").mode("append").save(path)

Both work on any file system that pyarrow.fs knows by URI, from the tasks; the driver only lists names.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from ..operators.packs import MIN_BYTES

ANSWERS = "isbn string, http_code int, body string"
#: Folders that answers are dealt to by a checksum of their ISBN.
BUCKETS = 64


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:"))


def bucket_of(isbn: str, buckets: int) -> int:
    return zlib.crc32(isbn.encode()) % buckets


def store_answers(answers: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write answers (isbn, http_code, body) as lines of JSON, dealt to folders by ISBN. Answers without an ISBN are not kept."""
    rows = answers.select("isbn", "http_code", "body").where("isbn is not null")
    at = F.pmod(F.crc32(F.col("isbn").cast("binary")), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", at).repartition("bucket").write.partitionBy("bucket").option("ignoreNullFields", False).json(path)


class StoredAnswers(DataSource):
    """Answers that store_answers() wrote: isbn, http_code and body. Option buckets: as it was written with."""

    @classmethod
    def name(cls) -> str:
        return "stored_answers"

    def schema(self) -> str:
        return ANSWERS

    def reader(self, schema) -> DataSourceReader:
        return AnswersReader(self.options["path"], int(self.options.get("buckets", BUCKETS)))


class AnswersReader(DataSourceReader):
    """One task a folder. Filters that name ISBNs are taken over: only their folders are opened, and other lines skipped."""

    def __init__(self, path: str, buckets: int) -> None:
        self.path, self.buckets, self.isbns = path, buckets, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("isbn",):
                wanted = {v for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
                self.isbns = wanted if self.isbns is None else self.isbns & wanted
            elif not (isinstance(f, IsNotNull) and f.attribute == ("isbn",)):  # none is null
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = filesystem(self.path)
        wanted = None if self.isbns is None else {bucket_of(v, self.buckets) for v in self.isbns}
        found = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory and f.base_name.startswith("bucket=")]
        return [InputPartition(f) for f in sorted(found) if wanted is None or int(f.rpartition("=")[2]) in wanted]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = filesystem(self.path)
        for file in store.get_file_info(fs.FileSelector(partition.value)):
            if file.base_name.startswith("part-"):
                with store.open_input_stream(file.path) as raw:
                    rest = b""
                    while data := raw.read(1 << 20):
                        *lines, rest = (rest + data).split(b"\n")
                        yield from self._rows(lines)
                    yield from self._rows([rest])

    def _rows(self, lines: list[bytes]) -> Iterator[tuple]:
        for line in filter(None, lines):
            row = json.loads(line)
            if self.isbns is None or row["isbn"] in self.isbns:
                yield row["isbn"], row["http_code"], row["body"]


def first_whole(wanted: DataFrame, payloads: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """(name, content) for each code of wanted(code): the payload of the first mirror that gave least bytes or more.

    payloads: code, mirror (tried in ascending order) and content, null where a mirror failed. Codes that no mirror has whole have no row.
    Contents are only moved once it is known which are taken.
    """
    whole = payloads.where(F.octet_length("content") >= least)
    best = whole.groupBy(F.col("code").alias("_code")).agg(F.min("mirror").alias("_mirror"))
    chosen = wanted.select(F.col("code").alias("_wanted")).distinct().join(best, F.col("_wanted") == F.col("_code")).select("_code", "_mirror")
    met = whole.join(chosen, (F.col("code") == F.col("_code")) & (F.col("mirror") == F.col("_mirror")))
    return met.select(F.concat("code", F.lit(".traineddata")).alias("name"), "content")


@dataclass
class Written(WriterCommitMessage):
    """Files that one task has written under private names, and their final ones."""

    files: list[tuple[str, str]] = field(default_factory=list)


class WholeFiles(DataSource):
    """Sink of rows (name, content): a file each below the path. Option least: fewest bytes; a shorter content fails the write."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WholeFilesWriter(self.options["path"], int(self.options.get("least", MIN_BYTES)))


class WholeFilesWriter(DataSourceWriter):
    """Tasks write below a private folder of this job; commit moves the files of successful tasks into place, then that folder goes.

    A task that fails or runs twice leaves nothing under a final name, since only one of its attempts reports its files.
    """

    def __init__(self, path: str, least: int) -> None:
        self.path, self.least, self.staging = path, least, f"_staging-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        store, base = filesystem(self.path)
        attempt, out = f"{base}/{self.staging}/{uuid.uuid4().hex}", Written()
        store.create_dir(attempt, recursive=True)
        for row in rows:
            if row.content is None or len(row.content) < self.least:
                raise ValueError(f"{row.name} has fewer than {self.least} bytes")
            part = f"{attempt}/{len(out.files)}"
            with store.open_output_stream(part, compression=None) as file:
                file.write(row.content)
            out.files.append((part, f"{base}/{row.name}"))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        store, base = filesystem(self.path)
        for message in filter(None, messages):
            for part, final in message.files:
                store.move(part, final)
        self._clear(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*filesystem(self.path))

    def _clear(self, store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{base}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.staging}")


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, and let Spark hand filters to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredAnswers)
    spark.dataSource.register(WholeFiles)

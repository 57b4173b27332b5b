"""WARC archives and the chunked record table.

Writing: payloads become rows (record, chunk number, bytes) before they leave the JVM; each task streams its rows into archive files
of bounded size, one gzip member a record, and checks each payload's digest as it goes, so no task's Python ever holds a whole
record. Of records with equal payloads of at least MIN_SHARED bytes only the one with the least identifier carries the
payload (response); the others are revisit records that name it, and their payloads are dropped where they are read.
Reading: archives are streamed as rows (record, chunk number, bytes), each with the payload's SHA-256 up to and including that
chunk, so that the digest of the last chunk is the record's. Files appear under their final name when whole; the manifest
lists those of successful tasks, so lost executors and second attempts do no harm.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Publisher, filesystem, materialize, scratch, small_batches, small_side, spread_files

MIN_SHARED = 100
#: Bytes of a chunk, and of compressed records after which a file is closed.
CHUNK = 1 << 18
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
CHUNKS = "page_id long, record_type string, refers_to long, chunk_no int, last boolean, chunk_bytes long, digest_so_far string, length_in_header long, digest_in_header string, data binary"


def roles(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """k, url, payload, n (bytes), digest and refers_to (null for a response) of every row; payload is empty for a revisit.

    Which rows are revisits is found on slim rows (identifier, length, digest); payloads of responses then stay where they are read,
    or, with more revisits than are broadcast, are dealt by identifier and digest: equal payloads never meet in one task.
    Rows that repeat the least identifier are responses as well: they are the same record. A null identifier never
    becomes the response of others unless all are null.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("k"), url.alias("url"), body.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"))
    slim = materialize(rows.select("k", "url", "n", "digest"), "warc-digests")
    twice = slim.where(F.col("n") >= MIN_SHARED).groupBy("digest").agg(F.count(F.lit(1)).alias("m"), F.min("k").alias("first")).where("m > 1")
    met = slim.join(small_side(materialize(twice.select("digest", "first"), "warc-twice")), "digest")
    later = F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))
    revisits = materialize(met.where(later).select("k", "url", F.lit(b"").alias("payload"), "n", "digest", F.col("first").alias("refers_to")), "warc-revisits")
    gone = small_side(revisits.select(F.col("k").alias("_k"), F.col("digest").alias("_d")))
    responses = rows.join(gone, (F.col("digest") == F.col("_d")) & F.col("k").eqNullSafe(F.col("_k")), "left_anti")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)


def _uri(k: int | None, digest: str) -> str:
    """Name of a record. Rows alike in identifier and payload are one record, however often it is written."""
    return f"urn:page:{'null' if k is None else k}:{digest[:16]}"


def _header(k, url, n, digest, refers_to, body_length: int) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_uri(k, digest)}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Identified-Payload-Length: {n}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_uri(refers_to, digest)}>"]
    return ("\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {body_length}"]) + "\r\n\r\n").encode()


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of roles() as rows of a chunk each: k, url, n, digest, refers_to, chunk_no, last and data; an empty payload has one empty chunk."""
    chunks = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk)).cast("int")
    out = rows.select("k", "url", "n", "digest", "refers_to", "payload", chunks.alias("_n"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk_no"))
    data = F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return out.select("k", "url", "n", "digest", "refers_to", "chunk_no", (F.col("chunk_no") == F.col("_n") - 1).alias("last"), data.alias("data"))


def write_archives(rows: DataFrame, uri: str, chunk: int = CHUNK) -> DataFrame:
    """Write rows of roles() as archives below uri; the manifest: path, records, bytes."""
    small_batches(rows.sparkSession)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, file, records = TaskContext.get().partitionId(), 0, None, 0
        packer = digest = None

        def row():
            file.finish()
            return pa.RecordBatch.from_arrays([pa.array([file.uri]), pa.array([records], pa.int64()), pa.array([file.bytes], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                k, url, n, sha, refers_to, number, last = (c[i].as_py() for c in batch.columns[:7])
                data = memoryview(batch.column(7)[i].as_buffer())
                if file is None:
                    file, records = Publisher(f"{uri}/pages-{part:05d}-{seq:05d}.warc.gz"), 0
                if number == 0:
                    packer, digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha256()
                    file.write(packer.compress(_header(k, url, n, sha, refers_to, n if refers_to is None else 0)))
                digest.update(data)
                file.write(packer.compress(data))
                if last:
                    if refers_to is None and digest.hexdigest() != sha:
                        raise ValueError(f"chunks of record {k} do not add up to its payload")
                    file.write(packer.compress(b"\r\n\r\n"))
                    file.write(packer.flush())
                    records += 1
                    if file.bytes >= FILE_BYTES:
                        yield row()
                        seq, file = seq + 1, None
        if file is not None:
            yield row()

    return chunked(rows, chunk).mapInArrow(write, "path string, records long, bytes long")


class _Inflated:
    """Reads concatenated gzip members from a stream, a bounded piece at a time."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.out = stream, b"", bytearray()
        self.unpack = zlib.decompressobj(31)

    def _more(self) -> bool:
        self.raw = self.raw or self.stream.read(CHUNK)
        if not self.raw:
            return False
        if self.unpack.eof:
            self.unpack = zlib.decompressobj(31)
        self.out += self.unpack.decompress(self.raw, CHUNK)
        self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before mark, which is skipped; None at the end of the stream."""
        while (at := self.out.find(mark)) < 0:
            if not self._more():
                if self.out:
                    raise ValueError("archive ends within a record header")
                return None
        head = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return head

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more():
                raise ValueError("archive ends within a record")
        part = bytes(self.out[:n])
        del self.out[:n]
        return part


def _identifier(value: str) -> int | None:
    name = value.strip("<>").removeprefix("urn:page:").partition(":")[0]
    return None if name == "null" else int(name)


def record_chunks(stream, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of the chunked record table from one archive; a record without payload has one empty chunk."""
    source = _Inflated(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        left, digest, number = int(fields["Content-Length"]), hashlib.sha256(), 0
        about = (_identifier(fields["WARC-Record-ID"]), fields["WARC-Type"], _identifier(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None)
        while True:
            data = source.take(min(chunk, left))
            left -= len(data)
            digest.update(data)
            yield *about, number, not left, len(data), digest.copy().hexdigest(), int(fields["WARC-Identified-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), data
            number += 1
            if not left:
                break
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("no blank lines after a record")


def read_chunks(manifest: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of all archives of a manifest (columns CHUNKS); data is null without with_data."""
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(CHUNKS).fields]

    def read(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = filesystem(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for row in record_chunks(stream, chunk):
                        rows.append(row if with_data else (*row[:-1], None))
                        held += len(row[-1]) if with_data else 0
                        if held >= 4 << 20 or len(rows) >= 4096:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    return spread_files(manifest.select("path")).mapInArrow(read, CHUNKS)


def records(chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a record from its last chunk and the sum of chunks: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    A revisit has the length and digest of the payload that it stands for, from its header. intact: what was read has
    the header's length and digest. chunk must be the size that the chunks were read with.
    """
    ends = chunks.where("last")
    read = F.col("record_type") == "response"
    full = F.col("chunk_no").cast("long") * chunk + F.col("chunk_bytes")
    size = F.when(read, full).otherwise(F.col("length_in_header"))
    digest = F.when(read, F.col("digest_so_far")).otherwise(F.col("digest_in_header"))
    intact = (size == F.col("length_in_header")) & (digest == F.col("digest_in_header"))
    return ends.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", intact.alias("intact"))


def archive(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """Write every row of pages as a WARC record and read the archives back, one row a record.

    Null payloads are empty; short payloads (under MIN_SHARED bytes) and unique ones are responses; a null url has no target
    header; null identifiers are kept; an empty table gives no archives and no rows; other columns are ignored.
    """
    manifest = materialize(write_archives(roles(pages, key, payload), scratch(pages.sparkSession, "warc")), "warc-manifest")
    return records(read_chunks(manifest, with_data=False)).withColumnRenamed("page_id", key)

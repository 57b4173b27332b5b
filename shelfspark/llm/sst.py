"""Token-ID output as sorted-string-table shards.

Documents become entries of immutable, sorted shard files::

    data blocks | index block | Bloom filter | footer

* A key is one null-flag byte and the identifier as 8 big-endian bytes with the sign bit flipped, so that
  byte order is identifier order; null identifiers sort first.
* A value is the token ids as little-endian integers, 2 bytes wide where all fit, else 4.
* In a data block each entry stores how many key bytes it shares with the entry before it, then the rest of
  the key; blocks are compressed with zstandard and close at BLOCK_BYTES of raw entries.
* The sparse index has the first key, offset and length of each block; a reader finds a key's block by
  binary search in it and skips shards whose key range or Bloom filter excludes the key.
* The footer has fixed size and locates the other parts.

Shards are range partitions of the identifier, so their file order is the ascending order of documents. A task
writes its rows in order and starts a new file at SHARD_BYTES; its memory holds one shard. A file appears under
its final name only when it is whole, and the manifest lists files of successful tasks only, so a lost
executor or a second attempt does no harm.
"""

from __future__ import annotations

import bisect
import io
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Publisher, filesystem, keep_only, materialize, remembers, scratch, small_batches, spread_files

MAGIC = b"SHSST001"
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 16 << 20
BLOOM_BITS_PER_KEY = 10
BLOOM_PROBES = 7
_ENTRY = struct.Struct("<BBBI")  # shared key bytes, further key bytes, id width, value bytes
_INDEX = struct.Struct("<9sQII")  # first key, offset, stored bytes, entries
_FOOTER = struct.Struct("<QIQIIQQ9s9s8s")  # index, bloom, blocks, documents, ids, first and last key, magic


def encode_key(key: int | None) -> bytes:
    return b"\0" * 9 if key is None else b"\1" + (key + (1 << 63)).to_bytes(8, "big")


def decode_key(raw: bytes) -> int | None:
    return None if raw[:1] == b"\0" else int.from_bytes(raw[1:], "big") - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    from xxhash import xxh64_intdigest

    a, b = xxh64_intdigest(key), xxh64_intdigest(key, seed=1) | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Builds one shard in memory; entries come in key order."""

    def __init__(self) -> None:
        self.body, self.index, self.keys = io.BytesIO(), [], []
        self.block, self.first, self.last, self.in_block = bytearray(), b"", b"", 0
        self.low = self.high = b""
        self.documents = self.ids = 0

    def add(self, key: int | None, ids) -> None:
        """ids: a NumPy array of unsigned 32-bit integers."""
        raw = encode_key(key)
        width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
        value = ids.astype(f"<u{width}").tobytes()
        shared = 0
        while self.in_block and shared < len(raw) and raw[shared] == self.last[shared]:
            shared += 1
        if not self.in_block:
            self.first = raw
        self.block += _ENTRY.pack(shared, len(raw) - shared, width, len(value)) + raw[shared:] + value
        self.in_block += 1
        self.low, self.high, self.last = self.low or raw, raw, raw
        self.documents += 1
        self.ids += len(ids)
        if not self.keys or self.keys[-1] != raw:
            self.keys.append(raw)
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        import zstandard

        if self.in_block:
            data = zstandard.ZstdCompressor(level=1).compress(bytes(self.block))
            self.index.append((self.first, self.body.tell(), len(data), self.in_block))
            self.body.write(data)
            self.block, self.in_block = bytearray(), 0

    def size(self) -> int:
        return self.body.tell() + len(self.block)

    def finish(self) -> bytes:
        self._close_block()
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        at = self.body.tell()
        for entry in self.index:
            self.body.write(_INDEX.pack(*entry))
        self.body.write(bloom)
        self.body.write(_FOOTER.pack(at, len(self.index), at + _INDEX.size * len(self.index), len(bloom), bits, self.documents, self.ids, self.low, self.high, MAGIC))
        return self.body.getvalue()


class ShardReader:
    """Reads a shard through a random-access file; holds the index and one block."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.seek(0, 2) or file.tell()
        if size < _FOOTER.size:
            raise ValueError("not a shard: too short")
        (index_at, blocks, bloom_at, bloom_len, self.bits, self.documents, self.ids, self.low, self.high, magic) = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: wrong footer")
        raw = self._read(index_at, _INDEX.size * blocks)
        self.index = [_INDEX.unpack_from(raw, i * _INDEX.size) for i in range(blocks)]
        self.bloom = self._read(bloom_at, bloom_len)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, number: int) -> Iterator[tuple[bytes, object]]:
        import numpy as np
        import zstandard

        _, at, stored, n = self.index[number]
        raw, pos, key = zstandard.ZstdDecompressor().decompress(self._read(at, stored)), 0, b""
        for _ in range(n):
            shared, rest, width, length = _ENTRY.unpack_from(raw, pos)
            pos += _ENTRY.size
            key = key[:shared] + raw[pos : pos + rest]
            pos += rest
            yield key, np.frombuffer(raw, f"<u{width}", length // width, pos).astype("<u4")
            pos += length

    def scan(self) -> Iterator[tuple[int | None, object]]:
        for number in range(len(self.index)):
            for key, ids in self._entries(number):
                yield decode_key(key), ids

    def may_hold(self, key: int | None) -> bool:
        raw = encode_key(key)
        return bool(self.index) and self.low <= raw <= self.high and all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(raw, self.bits))

    def get(self, key: int | None) -> list:
        """All values under key: binary search for the last block that starts before it, then onwards."""
        raw, found = encode_key(key), []
        if not self.may_hold(key):
            return found
        firsts = [e[0] for e in self.index]
        for number in range(max(0, bisect.bisect_left(firsts, raw) - 1), len(firsts)):
            if firsts[number] > raw:
                break
            found += [ids for k, ids in self._entries(number) if k == raw]
        return found


# A blank between two non-blanks always starts a pre-token, and a run of letters always ends one before an ASCII character
# that is none, so texts may be cut there without changing ids.
_BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space of the pre-tokenizer's pattern
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PIECES = re.compile(f" ?[{_LETTERS}]+(?=[\x00-@\\[-`{{-\x7f]|$)| ?[^{_BLANKS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")


class Encoder:
    """A tokenizer of the tokenizers library, with a bounded memory of pieces it has encoded.

    For byte-level BPE files, encoding a text is encoding its pieces one after another; each new piece goes through
    the library once. Texts with a special token's string, and vocabularies of other kinds, go through the library whole.
    """

    #: Bytes of what is remembered, as estimated; pieces of more characters than KEPT are not.
    LIMIT, KEPT, EACH = 200 << 20, 64, 200

    def __init__(self, path: str) -> None:
        import os

        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        kind = str(self.library.pre_tokenizer)
        self.by_piece = kind.startswith("ByteLevel") and "add_prefix_space=False" in kind and self.library.normalizer is None
        self.opens = np.zeros(self.library.get_vocab_size(), bool)  # tokens that begin with a blank
        self.opens[[i for t, i in self.library.get_vocab().items() if t.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {}  # ids of a piece as little-endian 32-bit integers
        self.size = 0

    def _learn(self, new: list[str]) -> None:
        import numpy as np

        # pieces with a leading blank may be encoded in a row: each begins at a token that begins with a blank
        rows = [p for p in new if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        alone = [p for p in new if p[0] != " " or len(p) == 1 or p[1].isspace()]
        for i in range(0, len(rows), 2_000):
            part = rows[i : i + 2_000]
            ids = np.array(self.library.encode("".join(part), add_special_tokens=False).ids, "<u4")
            at = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
            raw = ids.tobytes()
            self.known.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(part, at[:-1], at[1:], strict=True))
        for i in range(0, len(alone), 10_000):
            part = alone[i : i + 10_000]
            self.known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True))

    def encode(self, texts: list[str | None]) -> list:
        """A NumPy array of ids for each text; null is empty."""
        import numpy as np

        texts = [t or "" for t in texts]
        pieces = [_PIECES.findall(t) if self.by_piece and not any(s in t for s in self.special) else None for t in texts]
        every = set().union(*(ps for ps in pieces if ps))
        new = every.difference(self.known)
        size = self.EACH * len(new)
        if self.size + size > self.LIMIT:
            self.known.clear()
            self.size, new = 0, every
            size = self.EACH * len(new)
        self._learn(list(new))
        of = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(of, ps)), "<u4") if ps is not None else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4") for t, ps in zip(texts, pieces, strict=True)]
        for p in [p for p in new if len(p) > self.KEPT]:
            del self.known[p]
            size -= self.EACH
        self.size += size
        return out


_encoders: dict[str, Encoder] = {}
remembers("pieces", _encoders.clear)


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker."""
    keep_only("pieces")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine; looked up inside tasks."""
    import public_tokenizers

    return public_tokenizers.path(name)


MANIFEST = "first_key long, last_key long, shard string, documents long, ids long, part int, seq int"


def write_shards(docs: DataFrame, uri: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append end_id, and write shards below uri in ascending key order.

    Returns the manifest, one row a shard. Null texts are empty (end_id alone), null keys come first, rows with one
    key stand side by side, an empty table writes no shard; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    # the hash of the text and a number of the row spread rows of one identifier, or of none, over ranges
    rows = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(F.col(text)).alias("h"), F.monotonically_increasing_id().alias("i"), F.col(text).alias("t"))
    order = [F.col("k").asc_nulls_first(), "h", "i"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("k", "t")

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, shard = TaskContext.get().partitionId(), 0, ShardWriter()
        encode, end = encoder(tokenizer_path(vocabulary)).encode, np.array([end_id], "<u4")

        def close():
            name = f"{uri}/shard-{part:05d}-{seq:05d}.sst"
            file = Publisher(name)
            file.write(shard.finish())
            file.finish()
            row = [decode_key(shard.low), decode_key(shard.high), name, shard.documents, shard.ids, part, seq]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["first_key", "last_key", "shard", "documents", "ids", "part", "seq"])

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, ids in zip(keys, encode(texts), strict=True):
                shard.add(k, np.concatenate([ids, end]))
                if shard.size() >= SHARD_BYTES:
                    yield close()
                    seq, shard = seq + 1, ShardWriter()
        if shard.documents:
            yield close()

    return rows.mapInArrow(write, MANIFEST)


def read_shards(manifest: DataFrame) -> DataFrame:
    """Read shards back: key, start, n_tokens and ids_crc32 of each document.

    start counts all ids of documents before it: those of earlier parts (one row a writing task), those of earlier shards of
    the part, and those earlier in the shard.
    """
    earlier = lambda over: F.coalesce(F.sum("ids").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select(F.col("part").alias("_part"), earlier(Window.orderBy("part")).alias("before"))
    inside = manifest.select("part", "shard", earlier(Window.partitionBy("part").orderBy("seq")).alias("within"))
    placed = inside.join(parts, F.col("part") == F.col("_part")).select("shard", (F.col("before") + F.col("within")).cast("long").alias("base"))
    placed = spread_files(materialize(placed, "sst-starts"))

    def read(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        keep_only("shards")
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = filesystem(shard)
                rows, at = [], base
                with store.open_input_file(path) as file:
                    for key, ids in ShardReader(file).scan():
                        rows.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 10_000], strict=True)], names=names)

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: list[int | None]) -> DataFrame:
    """Point lookups of a short list of keys: (doc_id, ids) for each key and stored document.

    Only shards whose key range in the manifest admits a key are opened, by a task each; those whose Bloom filter admits it are
    searched, by binary search in the sparse index and reading one block. A key without document gives no row.
    """
    wanted = sorted(set(keys), key=encode_key)
    from_first = lambda k: F.col("first_key").isNull() | (F.lit(k).isNotNull() & (F.col("first_key") <= F.lit(k)))
    within = [F.coalesce(from_first(k) & (F.lit(k is None) | (F.col("last_key") >= F.lit(k))), F.lit(False)) for k in wanted]
    able = manifest.where(reduce(or_, within, F.lit(False)))

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            for shard in batch.column(0).to_pylist():
                store, path = filesystem(shard)
                with store.open_input_file(path) as file:
                    reader = ShardReader(file)
                    found = [(key, ids.tolist()) for key in wanted for ids in reader.get(key)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return spread_files(able.select("shard"), 1).mapInArrow(search, "doc_id long, ids array<long>")


def sorted_token_table(docs: DataFrame, spark: SparkSession | None = None, uri: str | None = None) -> DataFrame:
    """Write docs as shards and read them back: doc_id, start, n_tokens, ids_crc32 (see the two steps)."""
    spark = spark or docs.sparkSession
    uri = uri or scratch(spark, "sst")
    return read_shards(materialize(write_shards(docs, uri), "sst-manifest"))

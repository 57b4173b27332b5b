"""Spelling variants: words of the corpus that differ by one letter, found by generating every word's full neighbourhood.

1. Words are counted over all texts; those of MIN_LENGTH letters and MIN_COUNT occurrences or more are the vocabulary.
2. The letters that the vocabulary holds are the alphabet. Of each word all distinct deletions, replacements and insertions over it are
   generated: a deletion or insertion in a run of one letter is made once, at its first or last place. They are made as 64-bit rolling hashes, whole
   arrays at a time; only those whose bits are set in a bitmap of the vocabulary's hashes become strings. The bitmap has no false negatives,
   and its size has an upper bound (BITS), so no vocabulary is too large for it.
3. The strings are hash-joined to the vocabulary. What meets is near, by construction; no distance is computed.
4. A word's form is the most frequent near word, if it is at least twice as frequent. As counts double with each step, forms are followed to
   the last by a few rounds of doubling.

Defined results: null and empty texts have no words; an empty vocabulary gives no rows; repeated rows count again; a null identifier stands
as an empty string before the colon; ties in frequency go to the smallest word; other columns are ignored; runs and words may have any length.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, filesystem, keep_only, materialize, remembers, scratch, small_side

LETTERS, MIN_LENGTH, MIN_COUNT, DAMAGED = "a-zÀ-ÿ", 5, 3, 97
#: Bits of the bitmap for each word (rounded up to a power of two), and at most; probes of each hash.
BITS_PER_WORD, BITS, PROBES = 64, 1 << 29, 4
#: Candidates whose hashes are made at one go, and words in a batch.
AT_ONCE, WORDS = 1 << 20, 20_000


def damaged(key: Column, run: Column, one_in: int = DAMAGED) -> Column:
    """run, or in one of so many cases, by checksum of identifier and run, run without one letter."""
    sum_ = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (sum_ % F.length(run)).cast("int")
    return F.when(sum_ % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): distinct words of enough letters and occurrences."""
    runs = docs.select(F.col(key).alias("_key"), F.explode(F.split(ascii_lower(F.col(text)), f"[^{LETTERS}]+")).alias("_run")).where("_run <> ''")
    words = runs.select(damaged(F.col("_key"), F.col("_run")).alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


class _Hashes:
    """Rolling hashes of all words of one length: the sum of a number for each letter times a power for its place."""

    STEP, SALT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd constants; any others do as well

    def __init__(self, words: list[str]) -> None:
        import numpy as np

        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
        powers = np.multiply.accumulate(np.full(self.codes.shape[1] + 2, self.STEP, np.uint64))
        self.powers, values = powers, self.letters(self.codes)
        none = np.zeros((len(words), 1), np.uint64)
        ahead = lambda shift: np.cumsum((values * np.roll(powers, -shift)[: values.shape[1]])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        self.values = values
        self.before = np.hstack([none, np.cumsum(values * powers[: values.shape[1]], axis=1, dtype=np.uint64)])  # letters before a place
        self.nearer = np.hstack([ahead(-1), none])  # letters from a place on, each moved one place to the front
        self.further = np.hstack([ahead(1), none])  # the same, moved one place back
        self.whole = self.before[:, -1]

    @classmethod
    def letters(cls, codes):
        import numpy as np

        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(cls.SALT)
        return mixed ^ (mixed >> np.uint64(29))


def _mixed(hashes):
    import numpy as np

    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(_Hashes.SALT)
    return hashes ^ (hashes >> np.uint64(32))


def _probe(mixed, k: int, bits: int):
    """Place of the k-th bit of mixed hashes in a bitmap."""
    import numpy as np

    return (mixed + np.uint64(k) * ((mixed >> np.uint64(17)) | np.uint64(1))) & np.uint64(bits - 1)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out = defaultdict(list)
    for i, w in enumerate(words):
        out[len(w)].append(i)
    return out


def bitmap(words: DataFrame, bits: int) -> DataFrame:
    """(bucket, bits) of the bits that the words' hashes set; at most bits / 32,768 rows of 4 KB."""

    def places(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = batch.column(0).to_pylist()
            for rows in _by_length(found).values():
                for i in range(0, len(rows), 4096):
                    mixed = _mixed(_Hashes([found[r] for r in rows[i : i + 4096]]).whole)
                    at = np.concatenate([_probe(mixed, k, bits) for k in range(PROBES)]).astype("i8") + 1  # counted from 1
                    yield pa.RecordBatch.from_arrays([pa.array(at)], names=["place"])

    at = words.select("word").mapInArrow(places, "place long")
    return at.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))


#: The bitmap that this worker has read, by path.
_bitmaps: dict = {}
remembers("bitmap", _bitmaps.clear)


def _read_bitmap(path: str, bits: int):
    import numpy as np
    import pyarrow.dataset as ds

    keep_only("bitmap")
    if path not in _bitmaps:
        _bitmaps.clear()
        store, at = filesystem(path)
        out = np.zeros(max(bits // 8, 4096), np.uint8)
        for batch in ds.dataset(at, filesystem=store, format="parquet").to_batches():
            for bucket, part in zip(batch.column("bucket").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part, np.uint8)
        _bitmaps[path] = out
    return _bitmaps[path]


def _neighbours(words: list[str], alphabet: str, bitmap, bits: int):
    """(index of a word, candidate) for all distinct candidates of words of one length that the bitmap may hold."""
    import numpy as np

    h, letters = _Hashes(words), np.array([ord(c) for c in alphabet], np.uint32)
    values, length = _Hashes.letters(letters), len(words[0])

    def held(hashes):
        """Places in the flattened array whose bits are all set."""
        left, mixed = None, _mixed(hashes.ravel())
        for k in range(PROBES):
            at = _probe(mixed, k, bits)
            set_ = np.flatnonzero((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            left, mixed = set_ if left is None else left[set_], mixed[set_]
        return left

    for i in held(h.before[:, :length] + h.nearer[:, 1:]).tolist():
        row, at = divmod(i, length)
        word = words[row]
        if not at or word[at] != word[at - 1]:
            yield row, word[:at] + word[at + 1 :]
    step = max(1, AT_ONCE // (len(words) * max(1, len(letters))))
    for first in range(0, length + 1, step):
        span = slice(first, min(first + step, length + 1))
        put = values[None, None, :] * h.powers[span][None, :, None]
        for i in held((h.before[:, span] + h.further[:, span])[:, :, None] + put).tolist():
            row, at, c = *divmod(i // len(letters), put.shape[1]), alphabet[i % len(letters)]
            word, at = words[row], at + first
            if at == length or word[at] != c:
                yield row, word[:at] + c + word[at:]
        span = slice(first, min(first + step, length))
        if span.start < span.stop:
            put = put[:, : span.stop - span.start]
            kept = h.whole[:, None] - h.values[:, span] * h.powers[span]
            for i in held(kept[:, :, None] + put).tolist():
                row, at, c = *divmod(i // len(letters), put.shape[1]), alphabet[i % len(letters)]
                word, at = words[row], at + first
                if word[at] != c:
                    yield row, word[:at] + c + word[at + 1 :]


def candidates(words: DataFrame, alphabet: str, path: str, bits: int) -> DataFrame:
    """(word, candidate): those of all neighbours that the bitmap written at path may hold."""

    def generate(batches):
        import pyarrow as pa

        seen = _read_bitmap(path, bits)
        for batch in batches:
            found = batch.column(0).to_pylist()
            for length, rows in _by_length(found).items():
                each = max(1, AT_ONCE // ((length + 1) * max(1, len(alphabet))))
                for i in range(0, len(rows), each):
                    part = [found[r] for r in rows[i : i + each]]
                    made = [*_neighbours(part, alphabet, seen, bits)]
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array([part[r] for r, _ in made]), pa.array([c for _, c in made])], names=["word", "candidate"])

    return words.select("word").mapInArrow(generate, "word string, candidate string")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all pairs of the written vocabulary that differ by one inserted, deleted or replaced letter."""
    spark, n = words.sparkSession, words.count()
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = "".join(sorted(r.c for r in letters.collect()))  # no more than LETTERS has
    bits = min(BITS, 1 << max(15, math.ceil(math.log2(BITS_PER_WORD * max(n, 1)))))
    if not n:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    path = scratch(spark, "bitmap")
    bitmap(words, bits).write.parquet(path)
    spread = words.repartition(max(spark.sparkContext.defaultParallelism, -(-n // WORDS)))
    made = candidates(spread, alphabet, path, bits)
    return made.join(small_side(words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))), F.col("candidate") == F.col("near")).drop("candidate")


def last_forms(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. most is the largest count, which bounds the length of a way."""
    way = forms.select("word", F.col("form").alias("root"))
    for k in range(max(1, math.ceil(math.log2(max(2, math.log2(max(2, most))))))):
        on = materialize(way, f"ways-{k}")
        further = small_side(on.select(F.col("word").alias("root"), F.col("root").alias("_next")))
        way = on.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return way


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the vocabulary."""
    words = materialize(vocabulary(docs, key, text), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    taken = F.col("b.n") * -1 >= 2 * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("b.w")).alias("form"), F.when(taken, -F.col("b.n")).alias("form_n"))
    rows = materialize(rows, "forms")
    most = rows.agg(F.max("n")).first()[0] or 1
    roots = last_forms(rows.where("form is not null").select("word", "form"), most)
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

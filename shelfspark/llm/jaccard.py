"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. The steps:

1. Every whole text becomes a digest of its shingle set, the set's size and a MinHash signature. Texts with one set form
   a class, one row from here on; its copies are counted, never paired.
2. Signatures are cut into bands; classes that share a band are candidates. Groups of the same classes, which most bands of a
   set of copies make, count once. With 30 bands of 4 values a pair at the threshold shares no band with probability 1e-7, more
   similar pairs with less.
3. Within a group candidates' MinHash values are compared a few at a time; a pair is dropped as soon as the posterior
   probability, under a uniform prior, that its similarity reaches the threshold falls below TOLERANCE. A group returns a
   spanning forest of the pairs that stay; components of all forests say which classes may be linked at all.
4. The members of a component meet with their shingle sets, are pruned in the same way, and what stays is verified exactly.
   A group returns link counts and a spanning forest of its links, never pairs.
5. Components of the verified links are the near-duplicate classes.

In 3 and 4 the members of a large group are dealt to chunks of bounded size, and each pair of chunks is compared by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folded_words, keep_only, materialize, small_batches, small_side, text_hash, word_hashes
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND = 30, 4
HASHES = BANDS * BAND
#: Posterior probability below which a candidate is dropped unverified.
TOLERANCE = 1e-7
#: MinHash values compared in one step.
STEP = 12
#: Most classes, and about as many shingles, in a chunk.
CHUNK_ROWS, CHUNK_GRAMS = 256, 500_000

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def shingles(text: bytes | None):
    """Sorted distinct 64-bit hashes of the five-word shingles; of all words at once for a shorter text; none without words."""
    import numpy as np

    words = folded_words(text)
    of = word_hashes.__getitem__
    h = np.fromiter(map(of, words), "u8", len(words))
    if not len(h):
        return h
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, "u8")
    for k, c in enumerate(_MIX[: min(SHINGLE, len(h))]):
        out += h[k : k + n] * np.uint64(c)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _multipliers():
    import numpy as np

    a = (np.arange(1, HASHES + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    return (a >> np.uint64(32)).astype("u4") | np.uint32(1), a.astype("u4")


def signatures(sets: list):
    """MinHash values of each set, one row of HASHES unsigned integers; all ones for an empty set."""
    import numpy as np

    out = np.full((len(sets), HASHES), 0xFFFFFFFF, "u4")
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    at = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    x = np.concatenate([sets[i] for i in full])
    x = (x >> np.uint64(32)).astype("u4")
    for k, (a, b) in enumerate(zip(*_multipliers(), strict=True)):
        y = x * a
        y += b
        y ^= y >> np.uint32(15)
        out[full, k] = np.minimum.reduceat(y, at)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ... compared values: the fewest matches m with which a pair stays.

    With a uniform prior the similarity's posterior after m of n matches is Beta(m + 1, n - m + 1), and its upper tail at
    the threshold is the probability that a binomial (n + 1, threshold) is at most m.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(sig, a: int, later, keep: list[int]):
    """Those of the rows later of sig that stay candidates of row a, comparing STEP values at a time."""
    import numpy as np

    met = np.zeros(len(later), "i4")
    for step, least in enumerate(keep):
        at = slice(step * STEP, (step + 1) * STEP)
        met += (sig[later, at] == sig[a, at]).sum(1, dtype="i4")
        stay = met >= least
        later, met = later[stay], met[stay]
        if not len(later):
            break
    return later


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, text_hash, digest (null without words), n (shingles) and sig (packed MinHash values) of every row."""
    small_batches(docs.sparkSession)

    def sketch(batches):
        import hashlib

        import pyarrow as pa

        keep_only("words")
        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sigs = signatures(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sigs], pa.binary())], names=["k", "text_hash", "digest", "n", "sig"])

    rows = docs.select(F.col(key).cast("long").alias("k"), text_hash(F.col(text)).alias("text_hash"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(sketch, "k long, text_hash binary, digest binary, n long, sig binary")


def with_shingles(rows: DataFrame, columns: list[str]) -> DataFrame:
    """columns of rows and grams, the packed shingle set of the text in t."""
    from pyspark.sql import types as T

    small_batches(rows.sparkSession)

    def pack(batches):
        import pyarrow as pa

        keep_only("words")
        for batch in batches:
            grams = [shingles(t).tobytes() for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(grams, pa.binary())], names=[*columns, "grams"])

    rows = rows.select(*columns, "t")
    return rows.mapInArrow(pack, T.StructType([*rows.schema.fields[:-1], T.StructField("grams", T.BinaryType())]))


def forest(ids, sig, split: int, keep: list[int]):
    """Candidates of one group: (position, position of the root) in a spanning forest of the pairs that stay.

    Rows before split meet those from split on; with split 0 all rows meet. What a pair already connected would add is nothing,
    so it is not compared.
    """
    import numpy as np

    label = np.arange(len(ids))
    for a in range(split or len(ids) - 1):
        later = np.arange(split or a + 1, len(ids))
        later = survivors(sig, a, later[label[later] != label[a]], keep)
        if len(later):
            joined = np.unique(np.append(label[later], label[a]))
            label[np.isin(label, joined)] = joined[0]
    return label


def _grouped(batches, columns: list[str]):
    """Tables of whole groups from Arrow batches whose rows are sorted by columns; holds one group and a batch."""
    import numpy as np
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in columns])
        starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [batch.num_rows]])
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            part = batch.slice(lo, hi - lo)
            if held and any(part.column(c)[0] != held[0].column(c)[0] for c in columns):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _signatures_of(table):
    import numpy as np

    return np.frombuffer(b"".join(table["sig"].to_pylist()), "<u4").reshape(table.num_rows, HASHES)


def candidate_edges(groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v) of a spanning forest of each group's candidates. groups: hash, chunk_a, chunk_b, chunk, rid, sig."""
    keep, by = least_matches(threshold), ["hash", "chunk_a", "chunk_b"]

    def prune(batches):
        import numpy as np
        import pyarrow as pa

        keep_only("signatures")
        for table in _grouped(batches, by):
            ids, chunk = table["rid"].to_numpy(), table["chunk"].to_numpy()
            two = table["chunk_a"][0] != table["chunk_b"][0]
            split = int(np.searchsorted(chunk, table["chunk_b"][0].as_py())) if two else 0
            if two and not 0 < split < len(ids):
                continue
            root = forest(ids, _signatures_of(table), split, keep)
            moved = np.flatnonzero(root != np.arange(len(ids)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["u", "v"])

    return groups.repartition(*by).sortWithinPartitions(*by, "chunk", "rid").mapInArrow(prune, "u long, v long")


def in_chunks(members: DataFrame) -> DataFrame:
    """A row of members for each pair of chunks that it takes part in: chunk_a, chunk_b and chunk. members has chunks, their number."""
    chunk = F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int")
    rows = members.withColumn("chunk", chunk).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumns({"chunk_a": F.least("chunk", "_other"), "chunk_b": F.greatest("chunk", "_other")}).drop("_other", "chunks")


def candidates(classes: DataFrame) -> DataFrame:
    """(node, component): which of classes(rid, sig) may be linked; those that are in no pair that stays are left out."""
    width = 4 * BAND
    of_band = lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width)))
    bands = classes.select("rid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), of_band)).alias("hash"))
    groups = bands.groupBy("hash").agg(F.count(F.lit(1)).alias("m"), F.min("rid").alias("least"), F.bit_xor(F.xxhash64("rid")).alias("who")).where("m > 1")
    once = materialize(groups.groupBy("m", "least", "who").agg(F.min("hash").alias("hash")).select("hash", "m"), "groups")
    members = materialize(bands.join(small_side(once), "hash").select("hash", F.ceil(F.col("m") / CHUNK_ROWS).cast("int").alias("chunks"), F.col("rid").alias("_rid")), "band-members")
    rows = classes.select("rid", "sig").join(small_side(members), F.col("rid") == F.col("_rid")).drop("_rid")
    return components(candidate_edges(in_chunks(rows)))


def link_groups(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Compare the classes of each pair of chunks; (rid, links, root) of every class with a link there.

    rows: component, chunk_a, chunk_b, chunk, rid, copies, sig, grams. links adds up the copies of linked classes; root is
    the least class that rid's links reach within the group.
    """
    keep, by = least_matches(threshold), ["component", "chunk_a", "chunk_b"]

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        keep_only("signatures")
        for table in _grouped(batches, by):
            ids, chunk, copies, sig = table["rid"].to_numpy(), table["chunk"].to_numpy(), table["copies"].to_numpy(), _signatures_of(table)
            grams = [np.frombuffer(g, "<u8") for g in table["grams"].to_pylist()]
            size = np.array([len(g) for g in grams])
            flat, at = np.concatenate(grams), np.concatenate([[0], np.cumsum(size)])
            two = table["chunk_a"][0] != table["chunk_b"][0]
            split = int(np.searchsorted(chunk, table["chunk_b"][0].as_py())) if two else 0
            if two and not 0 < split < len(ids):
                continue
            links, label = np.zeros(len(ids), "i8"), np.arange(len(ids))
            for a in range(split or len(ids) - 1):
                left = survivors(sig, a, np.arange(split or a + 1, len(ids)), keep)
                left = left[np.minimum(size[left], size[a]) >= threshold * np.maximum(size[left], size[a]) - 1e-9]
                if not len(left):
                    continue
                near = np.concatenate([flat[at[b] : at[b + 1]] for b in left])
                spot = np.searchsorted(grams[a], near)
                hit = grams[a][np.minimum(spot, size[a] - 1)] == near
                common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[left])[:-1]]), dtype="i8")
                linked = left[common >= threshold * (size[a] + size[left] - common) - 1e-9]
                if len(linked):
                    links[a] += copies[linked].sum()
                    links[linked] += copies[a]
                    joined = np.unique(np.append(label[linked], label[a]))
                    label[np.isin(label, joined)] = joined[0]
            kept = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array(links[kept]), pa.array(ids[label[kept]])], names=["rid", "links", "root"])

    small_batches(rows.sparkSession)
    rows = rows.select(*by, "chunk", "rid", "copies", "sig", "grams")
    return rows.repartition(*by).sortWithinPartitions(*by, "chunk", "rid").mapInArrow(compare, "rid long, links long, root long")


def classed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """near_duplicates, and of each row text_hash (null for a null text) and class_no, which tells classes apart: null without shingles."""
    sketched = materialize(sketches(docs, key, text), "sketches")
    first = F.min(F.struct(F.col("k").isNull(), "k", "text_hash")).alias("lead")  # one row stands for a class
    grouped = sketched.where("digest is not null").groupBy("digest").agg(first, F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.first("sig").alias("sig"))
    grouped = grouped.select("digest", F.col("lead.k").alias("first_key"), F.xxhash64("lead.k", "lead.text_hash").alias("row"), "copies", "n", "sig")
    classes = materialize(grouped.withColumn("rid", F.monotonically_increasing_id()), "classes")

    met = materialize(candidates(classes), "candidates")
    member = classes.join(small_side(met), classes["rid"] == met["node"]).select("component", "rid", "row", "copies", "n", "sig")
    totals = member.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK_ROWS, F.sum("n") / CHUNK_GRAMS)).cast("int").alias("chunks"))
    member = materialize(member.join(totals, "component"), "members")

    texts = docs.select(F.col(text).cast("binary").alias("t"), F.xxhash64(F.col(key).cast("long"), text_hash(F.col(text))).alias("row"))
    found = texts.join(small_side(member.select("row", "rid")), "row").groupBy("rid").agg(F.first("t").alias("t"))  # repeated rows are one
    sets = with_shingles(found, ["rid"]).join(member, "rid")
    linked = materialize(link_groups(in_chunks(sets)), "links")

    degree = linked.groupBy("rid").agg(F.sum("links").alias("links"))
    joined = components(linked.select(F.col("rid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rid")
    named = classes.select("rid", "digest", "first_key", "copies").join(degree, "rid", "left").join(joined, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = materialize(named, "degrees")
    least = materialize(named.groupBy("component").agg(F.min("first_key").alias("class_id")), "least")
    named = materialize(named.join(least, "component").select("digest", "component", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "named")
    rows = sketched.select("k", "text_hash", "digest")
    out = rows.where("digest is not null").join(named, "digest").select(F.col("k").alias(key), "class_id", F.col("links").cast("long").alias("n_links"), F.col("copies").cast("long").alias("n_copies"), "text_hash", F.col("component").alias("class_no"))
    none = F.lit(None).cast("long")
    alone = rows.where("digest is null").select(F.col("k").alias(key), F.col("k").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), "text_hash", none.alias("class_no"))
    return out.union(alone)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, class_id, n_links, n_copies.

    class_id is the least key among all rows that links connect to this one, itself included; n_links the number of other
    rows with similarity 0.8 or more, exact copies included; n_copies of the rows with the very same shingle set.

    Null or empty texts, and texts without words, have no shingles: they link to nothing and are their own class. Texts of
    fewer than five words have all their words as one shingle. Repeated rows are copies. A null key counts as a row but
    names a class only if the class has no other, so class_id can be null. Other columns are ignored.
    """
    return classed_rows(docs, key, text).select(key, "class_id", "n_links", "n_copies")

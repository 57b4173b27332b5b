"""Benchmark decontamination over a distributed positional inverted index.

1. The index stores postings of all words of the training texts, in segments of about SEGMENT_WORDS words: a row for a term and
   a segment has the documents and word positions of the term there, ascending. A document's length is kept beside them.
2. For every window of an item the rarest terms in the corpus are its anchors. Their position lists are adjusted by
   the term's offset in the item, so that one place of the item in a document is one diagonal, and are intersected:
   a diagonal stays if all anchors of some window lie on it.
3. For diagonals that stay, the words of the document there are compared with the item's; runs of a whole window's length are
   exact matches.
4. Proximity matches: the lists of an item's rarest terms are intersected within the item's length and SLOP words more; where
   they meet, all of the item's distinct words must lie in one such stretch, in any order.

Lists meet in joins and aggregates keyed by item, document and diagonal, so a frequent passage spreads over as many groups as
it has documents. Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased, compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folded_words, keep_only, materialize, small_batches, small_side, word_hashes

WINDOW = 13
#: Anchors of a window: its rarest terms.
ANCHORS = 2
#: Words further than the item's length in which a proximity match may lie, and rarest terms whose lists are intersected for it.
SLOP, NEAR_ANCHORS = 20, 3
#: Words of documents that are sorted together in a segment of the index.
SEGMENT_WORDS = 1_000_000


def _terms(text: bytes | None):
    """Signed 64-bit hashes of the words of a text, in order."""
    import numpy as np

    words = folded_words(text)
    return np.fromiter(map(word_hashes.__getitem__, words), "u8", len(words)).view("i8")


def item_terms(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """uid (of the row), item_id and terms of each item that has words."""
    small_batches(benchmark.sparkSession)

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            terms = [_terms(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.int64()))], names=["uid", "item_id", "terms"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("item_id"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(split, "uid long, item_id long, terms array<long>").where(F.size("terms") > 0)


def text_key(key: Column, text: Column) -> Column:
    return F.xxhash64(key.cast("long"), text.cast("binary"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents: (term, seg, docs, positions, df), sorted by term within a segment.

    docs has the document's number in the segment for each of positions, df counts different ones. Rows with a null term are the
    documents: docs and positions have one element each, the number and the length in words; k is the identifier, dk a hash
    of identifier and text that tells documents with one identifier apart.
    """
    small_batches(docs.sparkSession)

    def post(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names, first_seg, number = ["term", "seg", "docs", "positions", "df", "k", "dk"], TaskContext.get().partitionId() << 32, 0

        def lists(values, at):
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))

        def segment(held):
            seg, terms = first_seg + number, [t for ts, _, _ in held for t in ts]
            length = np.array([len(t) for t in terms], "i8")
            flat, doc = np.concatenate([*terms, np.empty(0, "i8")]), np.repeat(np.arange(len(terms), dtype="i4"), length)
            place = (np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)).astype("i4")
            order = np.argsort(flat, kind="stable")  # documents and positions stay ascending
            flat, doc, place = flat[order], doc[order], place[order]
            new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, bool)
            at = np.flatnonzero(new)
            df = np.add.reduceat(np.concatenate([[True], doc[1:] != doc[:-1]]) | new, at, dtype="i8") if len(flat) else np.empty(0, "i8")
            ends = np.concatenate([at, [len(flat)]])
            for i in range(0, len(at), 20_000):
                j = min(len(at), i + 20_000)
                part, none = slice(ends[i], ends[j]), pa.nulls(j - i, pa.int64())
                cut = lists(doc[part], ends[i : j + 1] - ends[i]), lists(place[part], ends[i : j + 1] - ends[i])
                yield pa.RecordBatch.from_arrays([pa.array(flat[at[i:j]]), pa.array(np.full(j - i, seg)), *cut, pa.array(df[i:j]), none, none], names=names)
            one = np.arange(len(terms) + 1)
            ids = [pa.concat_arrays([h[i] for h in held]) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(terms), pa.int64()), pa.array(np.full(len(terms), seg)), lists(one[:-1], one), lists(length, one), pa.nulls(len(terms), pa.int64()), *ids], names=names)

        keep_only("words")
        held, size = [], 0
        for batch in batches:
            terms = [_terms(t) for t in batch.column(2).to_pylist()]
            held.append((terms, batch.column(0), batch.column(1)))
            size += sum(map(len, terms))
            if size >= SEGMENT_WORDS:
                yield from segment(held)
                held, size, number = [], 0, number + 1
        if held:
            yield from segment(held)

    rows = docs.select(F.col(key).cast("long").alias("k"), text_key(F.col(key), F.col(text)).alias("dk"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(post, "term long, seg long, docs array<int>, positions array<int>, df long, k long, dk long")


def indexed_documents(index: DataFrame) -> DataFrame:
    """seg, doc, k, dk and n_words of every row that was indexed."""
    return index.where("term is null").select("seg", F.expr("docs[0]").alias("doc"), "k", "dk", F.expr("positions[0]").cast("long").alias("n_words"))


def postings(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Columns of wanted, a slim written table with a column term, and seg, doc and p of each place of the term."""
    found = index.where("term is not null").select("term", "seg", "docs", "positions").join(small_side(wanted), "term")
    found = found.select(*wanted.columns, "seg", F.explode(F.arrays_zip("docs", "positions")).alias("_at"))
    return found.select(*wanted.columns, "seg", F.col("_at.docs").alias("doc"), F.col("_at.positions").alias("p"))


def frequencies(items: DataFrame, index: DataFrame) -> DataFrame:
    """uid, pos, term and df, the number of documents with the term, of every word of items."""
    place = items.select("uid", F.posexplode("terms").alias("pos", "term"))
    here = materialize(place.select("term").distinct(), "item-terms")
    df = index.where("term is not null").select("term", "df").join(small_side(here), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    return place.join(df, "term", "left").select("uid", "pos", "term", F.coalesce("df", F.lit(0)).alias("df"))


def with_windows(items: DataFrame, counted: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """items with windows, the positions of each window's rarest terms, rarest first. counted: see frequencies()."""
    ranked = counted.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "df"))).alias("at"))
    width = F.least(F.size("at"), F.lit(window))
    rarest = lambda s: F.transform(F.slice(F.array_sort(F.transform(F.slice(F.col("at"), s, width), lambda x: F.struct(x["df"].alias("df"), x["pos"].alias("pos")))), 1, anchors), lambda x: x["pos"])
    return items.join(ranked.select("uid", F.transform(F.sequence(F.lit(1), F.size("at") - width + 1), rarest).alias("windows")), "uid")


def words_at(docs: DataFrame, places: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """places(k, dk, uid, start, stop), a written table, with the terms of the document's words from start to stop.

    A document's places are gathered for it, three numbers each, so its text is read once.
    """
    small_batches(docs.sparkSession)

    def cut(batches):
        import pyarrow as pa

        keep_only("words")
        for batch in batches:
            for k, dk, t, at in zip(*batch.columns, strict=True):
                h, at = _terms(t.as_py()), at.as_py()
                for i in range(0, len(at), 1000):
                    rows = [(max(0, x["start"]), x["uid"], h[max(0, x["start"]) : max(0, x["stop"])]) for x in at[i : i + 1000]]
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * n, pa.int64()), pa.array([dk.as_py()] * n, pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([x["start"] for x in at[i : i + 1000]], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["k", "dk", "uid", "start", "first", "words"])

    by = places.groupBy("k", "dk").agg(F.collect_list(F.struct("uid", "start", "stop")).alias("at"))
    by = small_side(materialize(by.withColumnsRenamed({"k": "_k", "dk": "_dk"}), "places"))
    texts = docs.select(F.col(key).cast("long").alias("k"), text_key(F.col(key), F.col(text)).alias("dk"), F.col(text).cast("binary").alias("t"))
    met = texts.join(by, (F.col("dk") == F.col("_dk")) & F.col("k").eqNullSafe(F.col("_k"))).select("k", "dk", "t", "at")
    return met.mapInArrow(cut, "k long, dk long, uid long, start long, first long, words array<long>")


def _named(places: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """places(seg, doc, ...) with k and dk in the place of segment and number, as a written table."""
    places = small_side(materialize(places, name))
    return materialize(indexed_documents(index).drop("n_words").join(places, ["seg", "doc"]).drop("seg", "doc").distinct(), name)


def phrase_matches(docs: DataFrame, index: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exact matches: (k, dk, item_id, uid, start, stop) for each run of words that an item's windows cover.

    start and stop are word positions in the document; a run joins windows that follow each other on one diagonal.
    """
    placed = materialize(with_windows(items, materialize(frequencies(items, index), "frequencies"), window), "windows")
    anchors = placed.select("uid", "terms", F.explode(F.array_distinct(F.flatten("windows"))).alias("pos")).select("uid", "pos", F.expr("terms[pos]").alias("term"))
    met = postings(index, materialize(anchors, "anchors"))
    met = met.groupBy("uid", "seg", "doc", (F.col("p") - F.col("pos")).cast("long").alias("start")).agg(F.collect_set("pos").alias("seen"))
    stays = F.exists("windows", lambda w: F.size(F.array_except(w, F.col("seen"))) == 0)
    met = met.join(placed, "uid").where(stays).select("uid", "seg", "doc", "start", (F.col("start") + F.size("terms")).alias("stop"))

    def verify(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k, dk, uid, item, start, first, words, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, off = np.array(words, "i8"), first - start  # off: place in the item of the first word
                same = np.concatenate([[0], (words == np.array(terms[off : off + len(words)], "i8")).astype("i1"), [0]])
                edge = np.flatnonzero(np.diff(same))
                rows += [(k, dk, item, uid, int(a) + first, int(b) + first) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= min(window, len(terms))]
            names = ["k", "dk", "item_id", "uid", "start", "stop"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=names)

    found = words_at(docs, _named(met, index, "diagonals"), key, text).join(items, "uid")
    return found.select("k", "dk", "uid", "item_id", "start", "first", "words", "terms").mapInArrow(verify, "k long, dk long, item_id long, uid long, start long, stop long")


def proximity_matches(docs: DataFrame, index: DataFrame, items: DataFrame, slop: int = SLOP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, dk, item_id, uid) of documents with a stretch, slop words longer than the item, that has all its distinct words in any order."""
    reach = F.size("terms") + slop
    counted = frequencies(items, index).groupBy("uid", "term").agg(F.first("df").alias("df"))
    rank = F.slice(F.array_sort(F.collect_list(F.struct("df", "term"))), 1, NEAR_ANCHORS)
    rarest = counted.groupBy("uid").agg(rank.alias("r")).join(items, "uid").select("uid", reach.alias("reach"), F.size("r").alias("n"), F.posexplode("r").alias("rank", "x"))
    wanted = materialize(rarest.select("uid", "reach", "n", "rank", F.col("x.term").alias("term")), "anchors")
    lists = postings(index, wanted).groupBy("uid", "reach", "n", "seg", "doc").agg(F.collect_list(F.struct("rank", "p")).alias("at"), F.countDistinct("rank").alias("has"))
    full = lists.where("has = n").select("uid", "seg", "doc", "reach", "at")

    def meet(batches):
        """Stretches around places of the rarest term that have the others near: sorted lists are merged, stretches that touch are one."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            took, starts, stops = [], [], []
            for i, (reach, at) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4), strict=True)):
                rank, p = (at.values.field(k).to_numpy(zero_copy_only=False).astype("i8") for k in (0, 1))
                first = np.sort(p[rank == 0])
                for r in range(1, int(rank.max()) + 1):
                    other = np.sort(p[rank == r])
                    after = np.searchsorted(other, first)
                    behind, ahead = first - other[np.maximum(after - 1, 0)], other[np.minimum(after, len(other) - 1)] - first
                    first = first[(np.abs(behind) < reach) | (np.abs(ahead) < reach)]
                if len(first):
                    begins = np.flatnonzero(np.diff(first, prepend=first[0] - 2 * reach) >= 2 * reach - 1)
                    ends = np.append(begins[1:], len(first)) - 1
                    took += [i] * len(begins)
                    starts.append(first[begins] - reach + 1)
                    stops.append(first[ends] + reach)
            out = pa.RecordBatch.from_arrays([*batch.columns[:3]], names=["uid", "seg", "doc"]).take(pa.array(took, pa.int64()))
            joined = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*out.columns, joined(starts), joined(stops)], names=["uid", "seg", "doc", "start", "stop"])

    kinds = ", ".join(f"{c} {full.schema[c].dataType.simpleString()}" for c in ("uid", "seg", "doc"))
    near = full.mapInArrow(meet, f"{kinds}, start long, stop long")

    def verify(batches):
        import pyarrow as pa

        def holds(words, terms):
            wanted, last, width = set(terms), {}, len(terms) + slop
            for i, w in enumerate(words):
                if w in wanted:
                    last.pop(w, None)  # words stand in the order of their last places
                    last[w] = i
                    if len(last) == len(wanted) and i - next(iter(last.values())) < width:
                        return True
            return False

        for batch in batches:
            rows = [(k, dk, item, uid) for k, dk, uid, item, words, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True) if holds(words, terms)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["k", "dk", "item_id", "uid"])

    found = words_at(docs, _named(near, index, "near"), key, text).join(items, "uid").select("k", "dk", "uid", "item_id", "words", "terms")
    return found.mapInArrow(verify, "k long, dk long, item_id long, uid long").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", near: bool = False) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated and text_key of every row of docs; with near also n_near.

    A document word inside any occurrence of an item's window (13 words; all of a shorter item) is hit. n_near counts items with
    a proximity match (see proximity_matches). Null and empty texts have no words and are never contaminated; items without
    words match nothing; repeated rows of docs get the same verdict each; items with one identifier count once (each in
    n_near), those with a null identifier hit words but are not listed.
    """
    items = materialize(item_terms(benchmark), "items")
    index = materialize(build_index(docs, key, text), "postings")
    spans = phrase_matches(docs, index, items, key=key, text=text)
    init = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    union = F.aggregate(F.array_sort("spans"), init, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["stop"]).alias("end")), lambda a: a["n"])
    hits = spans.groupBy(F.col("k").alias("hk"), F.col("dk").alias("hdk")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    hits = small_side(materialize(hits.select("hk", "hdk", union.alias("hit"), "ids"), "hits"))
    rows = indexed_documents(index)
    out = rows.join(hits, (rows["dk"] == hits["hdk"]) & rows["k"].eqNullSafe(hits["hk"]), "left")
    if near:
        close = proximity_matches(docs, index, items, key=key, text=text).groupBy(F.col("k").alias("nk"), F.col("dk").alias("ndk")).agg(F.count(F.lit(1)).alias("close"))
        out = out.join(small_side(materialize(close, "close")), (F.col("dk") == F.col("ndk")) & F.col("k").eqNullSafe(F.col("nk")), "left")
    n_hit, ids = F.coalesce("hit", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    verdict = ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    extra = [F.coalesce("close", F.lit(0)).cast("long").alias("n_near")] if near else []
    return out.select(F.col("k").alias(key), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), verdict, *extra, F.col("dk").alias("text_key"))

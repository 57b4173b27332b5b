"""Every stage of the pipeline on one small table."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    good = [f"plain words number {i} follow here one after another in this text about topic {i * 7 % 13} and place {i * 5 % 11} so that it is long enough" for i in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)]
    rows += [(100, good[0], "en", "s1", 1), (101, good[1].replace("plain", "simple"), "en", "s1", 1), (102, "too short", "en", "s0", 9), (103, None, None, None, None), (104, "again and again and again " * 9, "en", "s0", 1), (None, " ".join(f"nokey{i}" for i in range(40)), "en", None, 1), (5, good[5], "en", "s2", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda k: (k is None, k))


def test_quality_rules(spark, docs):
    out = corpus_pipeline.quality_rules(spark, docs, SF)
    assert out.columns == COLUMNS and not {102, 103, 104} & set(ids(out))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    marked = quality.trusted_rows(docs, labels)
    kept = quality.judge(docs, quality.fit(marked, marked["_good"])).where("kept")
    assert ids(out) == ids(kept)


def test_near_duplicates(spark, docs):
    out = corpus_pipeline.near_duplicate_join(spark, docs, SF)
    kept = ids(out)
    assert out.columns == COLUMNS and 100 not in kept and kept.count(5) == 1 and None in kept and 0 in kept
    assert len(kept) == len(set(kept)) and {102, 103, 104} <= set(kept)


def test_near_duplicates_of_null_and_repeated_identifiers(spark, docs):
    """Different texts stay, whether they have no identifier or one and the same; copies of an identified document go."""
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (7, text("c")), (8, text("d")), (8, text("e")), (9, text("d")), (None, None), (None, ""), (None, ""), (3, "..."), (3, "...")]
    df = spark.createDataFrame([(k, t, "en", "s0", 1) for k, t in rows], docs.schema)
    out = corpus_pipeline.near_duplicate_join(spark, df, SF)
    want = [(None, text("a")), (None, text("b")), (7, text("c")), (8, text("d")), (8, text("e")), (None, None), (None, ""), (None, ""), (3, "..."), (3, "...")]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=key) == sorted(want, key=key)


def test_decontamination(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    dirty = spark.createDataFrame([(900, item.text, "en", "s0", 1), (901, item.text + " filler" * 5000, "en", "s0", 1)], docs.schema)
    assert ids(corpus_pipeline.decontamination(spark, docs.union(dirty), SF)) == ids(docs.union(dirty).where(~(F.col("doc_id") == 900) | F.col("doc_id").isNull()))


def test_mix(spark, docs):
    out = corpus_pipeline.source_mix(spark, docs, SF)
    assert out.columns == COLUMNS
    most = out.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0]
    assert most <= 3 * 2  # one row is there twice


def test_tokens(spark, docs):
    out = corpus_pipeline.token_shards(spark, docs, SF).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((r.doc_id for r in docs.collect()), key=lambda k: (k is not None, k))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:], strict=False))


def test_run(spark):
    """The whole pipeline against plain Python, stage by stage; the verdicts of the quality rules are op10's, which has a test of its own."""
    import zlib

    from shelfspark.llm import mixing, queries
    from test_operators import brute_contamination, brute_links, encode, library, spaced

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    kept = {r.doc_id for r in queries.op10_quality_rules(spark, SF).where("kept").collect()}
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id in kept]
    classes = {}
    for (k, *_), row in zip([(r[0],) for r in docs], brute_links(docs), strict=True):
        classes.setdefault(row[1], []).append(k)
    leads = {min(ks) for ks in classes.values()}
    docs = [r for r in docs if r[0] in leads]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination(docs, items) if r[-1]}
    docs = [r for r in docs if r[0] not in bad]
    marks = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        marks[r.doc_id] = min(marks.get(r.doc_id, 1), r.quality)
    keys = spark.createDataFrame([(k, hashlib.md5(t.encode()).hexdigest(), {1: mixing.GOOD, 0: mixing.BAD, None: mixing.UNKNOWN}[marks.get(k)]) for k, t, _ in docs], "k long, salt string, w double")
    key = {r.k: r.x for r in keys.select("k", mixing.order_key(F.col("w"), F.col("k"), F.col("salt")).alias("x")).collect()}
    size = {k: len(spaced(t)) for k, t, _ in docs}
    total, names = {}, sorted({s for *_, s in docs})
    for k, _, s in docs:
        total[s] = total.get(s, 0) + size[k]
    weight, target, free = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set(names)
    while free:
        rate = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in free)
        held = {s for s in free if rate * weight[s] > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in held} if held else {s: rate * weight[s] for s in free}
        free = free - held if held else set()
    tok, want, at = library(), [], 0
    times = {}
    for s in names:
        epochs, left = divmod(target[s], total[s])
        for k in sorted((k for k, _, z in docs if z == s), key=key.get):
            times[k] = int(epochs) + (left > 0 and left >= size[k] / 2)
            left -= size[k]
    for k, t, _ in sorted(docs):
        ids = [*encode(tok, t), 2]
        for _ in range(times[k]):
            want.append((k, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
            at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()]
    assert got == want and len(want) > 100


def test_stages_without_labels(spark, docs, tmp_path):
    """With empty labels nothing is trusted and all documents weigh the same."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.decontamination, corpus_pipeline.source_mix):
        assert stage(spark, docs, str(tmp_path)).count()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty(spark, docs, stage):
    assert stage(spark, docs.limit(0), SF).count() == 0

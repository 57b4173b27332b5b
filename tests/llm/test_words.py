"""Spelling variants, importance resampling and BPE machines against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from shelfspark.llm import bpe, decontam, importance, mixing, spelling

CLASHES = ["k", "t", "word", "words", "n", "form", "root", "near", "rank", "score", "weight", "stream", "bucket", "_key", "_run", "_row", "_part", "ids", "bytes", "_decoded"]
TEXT = "Candle candles cand1e candel handle Handle handles the the the kandle candle candle, handle; handles sandle. ÉÀ× élève élèves élève Élève "
ROWS = [(1, TEXT), (2, TEXT * 3), (3, None), (4, ""), (2, TEXT * 3), (None, TEXT + "one two three " * 5), (5, " \n"), (6, "日本語 🎉 candle " * 9), (7, "ab" * 40_000 + " candlestick" * 4)]
ROWS += [(100 + i, f"candle handles bundle bundles bandle {'word ' * (i % 40)}") for i in range(150)]


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clash else df


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain_variants(rows):
    found = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    by_length, forms, out = collections.defaultdict(list), {}, {}
    for w in words:
        by_length[len(w)].append(w)
    for w, n in words.items():
        others = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = [n, len(others), forms[w], words.get(forms[w])]
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w].append(root)
    return {(w, *v) for w, v in out.items()}


def found_variants(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_variants(spark):
    want = plain_variants(ROWS)
    assert found_variants(spelling.variants(frame(spark, ROWS))) == want and any(r[-1] != r[0] for r in want)
    assert not spelling.variants(frame(spark, [(1, None), (None, "")])).collect()
    assert not spelling.variants(frame(spark, [])).collect()


def test_variants_of_a_dense_vocabulary(spark, monkeypatch):
    """Words over few letters have many neighbours, runs of one letter and long ways of forms; a small bitmap only lets more through."""
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abé") for _ in range(rng.choice([5, 5, 6, 7]))) for _ in range(int(300 * rng.random() ** 3) + 1))) for i in range(150)]
    ways = [(1000 + k, " ".join(["a" * 9 + "b" * (k + 1)] * 3 * 2**k)) for k in range(9)]
    want = plain_variants(rows + ways)
    assert found_variants(spelling.variants(frame(spark, rows + ways))) == want and ("a" * 9 + "b", 3, 1, "a" * 9 + "bb", 6, "a" * 9 + "b" * 9) in want
    monkeypatch.setattr(spelling, "BITS", 1 << 10)
    assert found_variants(spelling.variants(frame(spark, rows + ways))) == want


def test_neighbourhoods_are_whole_and_distinct():
    """With all bits set every neighbour is generated, each once."""
    import numpy as np

    for word in ["abc", "aaab", "cbbca", "a", "zzzz"]:
        made = [c for _, c in spelling._neighbours([word], "abcz", np.full(4096, 255, np.uint8), 1 << 15)]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))}
        want |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abcz"} - {word}
        want |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abcz"}
        assert len(made) == len(set(made)) and set(made) == want


def plain_sample(rows, targets):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    docs = [(key, *features(text)) for key, text in rows]
    s, t = collections.Counter(b for *_, f in docs for b in f), collections.Counter(b for text in targets for b in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for key, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[-1] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


def found_sample(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_importance(spark, monkeypatch):
    targets = ["candle candlestick bundle", None, "", "élève candle handles word word"]
    aim = spark.createDataFrame([(str(i), t) for i, t in enumerate(targets)], "item_id string, text string")
    rows = ROWS + [(5_000, ROWS[1][1]), (5_000, ROWS[1][1])]
    want = plain_sample(rows, targets)
    assert found_sample(importance.resampled(frame(spark, rows), aim)) == want and any(r[-1] == 3 for r in want)
    assert found_sample(importance.resampled(frame(spark, rows), aim.limit(0))) == plain_sample(rows, [])
    words = [b"a", b"bc", b"", b"d"] * 5
    whole = [b"".join(importance._features(words))]
    monkeypatch.setattr(importance, "WORDS", 3)  # cut within runs
    cut = [b"".join(importance._features(words))]
    assert [sorted(x[i : i + 2] for i in range(0, len(x), 2)) for x in cut] == [sorted(x[i : i + 2] for i in range(0, len(x), 2)) for x in whole]
    monkeypatch.setattr(importance, "DOCUMENTS", 2)
    monkeypatch.setattr(importance, "BLOCK_BYTES", 64)
    assert found_sample(importance.resampled(frame(spark, rows), aim)) == want
    assert not importance.resampled(frame(spark, []), aim).collect()
    assert found_sample(importance.resampled(frame(spark, [(1, None), (None, "")]), aim)) == plain_sample([(1, None), (None, "")], targets)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    import numpy as np

    return np.frombuffer(raw, "<i4").tolist()


def awkward_texts(ranks):
    rng = random.Random(5)
    chars = [*"abcdefgABC012 .,'-_!?\n\t\r  ", "é", "ß", "日", "語", "🎉", "́", " ", "　", " ", "\x85", "\x00", "\x1c", "я", "ا", "'s", "'LL", " the", "ing", "<|endoftext|>", "‍"]
    common = [t.decode("utf-8", "ignore").strip() for t in list(ranks)[:4000]]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(rng.choice(common) for _ in range(30)) for _ in range(300)]
    texts += ["".join(rng.choice(letters) for _ in range(400)) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aeéè", "日本語") for _ in range(20)]
    return texts + [c * n for c in "a =-0" for n in range(1, 150, 7)]


def test_transducer_is_the_library(ranks, reference):
    coder = bpe.Encoder(ranks, public_tokenizers.PATTERN, apart=True)
    plain = bpe.Encoder(ranks, public_tokenizers.PATTERN, apart=False)
    for text in awkward_texts(ranks):
        assert ids(coder.encode(text)) == ids(plain.encode(text)) == reference.encode_ordinary(text), repr(text)


def test_transducer_with_little_memory_and_lookahead(ranks, reference, monkeypatch):
    """Forgetting states, pairs and pieces, and emitting early, changes no ids; pieces of any length need a short buffer."""
    for name, value in (("STATES", 50), ("PAIRS", 20), ("LOOKAHEAD", 5)):
        monkeypatch.setattr(bpe.Transducer, name, value)
    for name, value in (("KEPT", 10), ("LONG", 4), ("WHOLE", 20)):
        monkeypatch.setattr(bpe.Encoder, name, value)
    coder = bpe.Encoder(ranks, public_tokenizers.PATTERN, apart=True)
    for text in awkward_texts(ranks)[::11]:
        assert ids(coder.encode(text)) == reference.encode_ordinary(text), repr(text)
    assert len(coder.transducer.states) <= 52 and len(coder.known) <= 10
    monkeypatch.setattr(bpe.Transducer, "STATES", 200_000)
    read, rng = 0, random.Random(9)

    def tell():
        nonlocal read
        for read in range(30_000):  # noqa: B007
            yield rng.randrange(97, 123)

    lag = done = 0
    for token in bpe.Transducer(ranks).stream(tell()):
        lag, done = max(lag, read - done), done + len(coder.transducer.tokens[token])
    assert done == 30_000 and lag < 500


def test_vocabularies_that_are_none(ranks):
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Transducer({b"a": 0})


def test_streaming_decode(ranks, reference):
    machine = bpe.Utf8Machine({i: t for t, i in ranks.items()})
    rng = random.Random(2)
    for text in awkward_texts(ranks)[::5]:
        assert "".join(machine.stream(reference.encode_ordinary(text))) == text
    one_byte = [ranks[bytes([b])] for b in "a日🎉é".encode()]
    assert [*machine.stream(one_byte)] == ["a", "", "", "日", "", "", "", "🎉", "", "é"]
    for _ in range(3000):
        some = [rng.choice(one_byte) if rng.random() < 0.7 else rng.randrange(50_256) for _ in range(rng.randrange(12))]
        data = b"".join(machine.tokens[i] for i in some)
        assert "".join(machine.stream(some)) == data.decode("utf-8", "replace")
        machine.BLOCK = rng.randrange(1, 5)
        assert machine.decode(some) == (data, data.decode("utf-8", "replace"))


def test_round_trip(spark, reference):
    rows = ROWS + [(8, "x" * 70_000), (9, "a b " * 100_000)]
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_chars) for r in bpe.round_trip(frame(spark, rows)).collect()), key=str)
    want = []
    for key, text in rows:
        found = reference.encode_ordinary(text or "")
        want.append((key, len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), len(text or "")))
    assert got == sorted(want, key=str)
    assert not bpe.round_trip(frame(spark, [])).collect()
    given = spark.createDataFrame([(1, [64, 65]), (2, None), (3, []), (4, [99_999]), (5, [161])], "k int, ids array<int>")
    out = {r.k: (r.bytes, r.text) for r in bpe.decoded(given).collect()}
    assert out[2] == (None, None) == out[4] and out[3] == (b"", "") and out[1][0].decode() == out[1][1] and len(out[5][0]) == 1


def test_proximity_in_a_long_repetitive_text(spark):
    """Repeated words cost one pass: 100,000 of them, where all are near and where they only just are not."""
    import time

    gap = "x " * (decontam.SLOP + 3)
    rows = [(1, "alpha beta gamma " * 33_400), (2, f"alpha beta {gap}" * 8_000 + "gamma"), (3, "gamma beta x alpha"), (4, ("alpha " + gap) * 5_000 + "beta alpha gamma")]
    docs, items = frame(spark, rows), spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    decontam.contamination(docs.limit(0), items, near=True).collect()
    began = time.perf_counter()
    got = {r.doc_id: (r.n_words, r.n_near) for r in decontam.contamination(docs, items, near=True).collect()}
    assert time.perf_counter() - began < 60
    assert got == {1: (100_200, 1), 2: (8_000 * (decontam.SLOP + 5) + 1, 0), 3: (4, 1), 4: (5_000 * (decontam.SLOP + 4) + 3, 1)}


def test_mix_of_very_many_alike_rows(spark, monkeypatch):
    """Alike rows come out of more than half the partitions, are all there, and of the last epoch as many are taken as fit."""
    n = 2_000_000
    rows = spark.range(n, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit(0).cast("long").alias("size"))
    more = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit(3).cast("long").alias("size"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = mixing.mix(rows.union(more))
        spread = out.groupBy(F.spark_partition_id().alias("p"), "source").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r.n for r in spread if r.source == "a") == n and len({r.p for r in spread if r.source == "a"}) > 4
    assert sum(r.n for r in spread if r.source == "b") == 1000 and abs(sum(r.t for r in spread) - 3000) <= 3
    monkeypatch.setattr(mixing, "ALIKE", 3)
    twins = spark.createDataFrame([(5, "a", 10)] * 8 + [(6, "b", 10)] * 40, "doc_id long, source string, size long")
    got = mixing.mix(twins).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("t"), F.max("taken").alias("m"), F.first("target").alias("g")).collect()
    assert all(r.n == {5: 8, 6: 40}[r.doc_id] and abs(r.t - r.g) <= 10 and r.m <= 30 for r in got)


@pytest.mark.parametrize("name", ["op6_url_model", "op7_epoch_mix", "op10_quality_rules", "op11_spelling_variants", "op12_importance_resampling"])
def test_queries_leave_no_scratch(spark, name):
    """Of all that a query writes below the shared folder only its result stays."""
    import os

    from shelfspark.llm.queries import QUERIES
    from shelfspark.storage import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(set(os.listdir(folder)) - before) == 1

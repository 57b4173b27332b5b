"""Pages of lines against plain Python, line by line and page by page."""

import collections
import functools
import math
import re

import pytest
import regex
from pyspark.sql import functions as F

from shelfspark.functions import lines as L
from shelfspark.plans import QUERIES
from shelfspark.sources.lines import located

SF = "/root/testdata/sf0.001"
LOOK, AS = L.LOOKALIKES, str.maketrans(L.LOOKALIKES, L.LOOKALIKE_DIGITS)
WS = " \t\n\x0b\x0c\r"
BLANK = "".join(map(chr, range(33)))


def count(s, pattern):
    return len(regex.findall(pattern, s))


def letters(s):
    return count(s, r"\p{L}")


def digits(s):
    return count(s, r"\p{Nd}")


def alnum(s):
    return letters(s) + digits(s)


def cyrillic(s):
    return sum("Ѐ" <= c <= "ԯ" for c in regex.findall(r"\p{L}", s))


def latin(s):
    return sum(c <= "ɏ" for c in regex.findall(r"\p{L}", s))


@functools.cache
def clean(s):
    t = (s or "").strip(BLANK).replace(" ", " ").lstrip(regex.sub(r"\\", "", L.JUNK)).rstrip(regex.sub(r"\\", "", L.JUNK)).strip(BLANK)
    shut, opened = "".join(c for o, c in ("()", "[]", "{}") if o not in t), "".join(o for o, c in ("()", "[]", "{}") if c not in t)
    n = len(t)
    while n > 1 and t[n - 1] in shut + BLANK:
        n -= 1
    k = 0
    while k < n - 1 and t[k] in opened + BLANK:
        k += 1
    return re.sub(f"[{WS}]+", " ", t[k:n]).strip(BLANK)


@functools.cache
def initials(s):
    t = regex.sub(L.TRIPLE.replace(r"\s", f"[{WS}]"), r"\1. \2. \3. ", clean(s))
    for p in (L.DOUBLE, L.DOUBLE_UNDOTTED, L.DOUBLE_ONE_DOT):
        t = regex.sub(p.replace(r"\s", f"[{WS}]"), r"\1. \2. ", t)
    return re.sub(f"[{WS}]+", " ", t).strip(BLANK)


def is_initials(s):
    return bool(regex.search(L.INITIALS, s.strip(BLANK)))


def useful(s):
    runs = [len(r) for r in regex.findall(r"\p{L}+", s)]
    return any(n >= 5 for n in runs) or sum(n >= 4 for n in runs) >= 2 or (len(runs) == 1 and runs[0] >= 4)


def number_like(s):
    return digits(s) >= 4 and letters(s) <= 1


def gibberish(s):
    return s != "" and not is_initials(s) and not number_like(s) and not useful(s)


def math_noise(s):
    brackets, ops, chars = sum(c in "()[]{}" for c in s), sum(c in "=+*/^_<>|\\×−" for c in s), letters(s) + digits(s)
    return s != "" and (bool(regex.search(L.MATH, s, regex.ASCII)) and letters(s) < 8 or brackets >= 2 and chars < 6 or ops + brackets >= 3 and chars <= ops + brackets + 3)


def mixed(s):
    return cyrillic(s) >= 2 and latin(s) >= 2


def keepable(s):
    return s != "" and not math_noise(s) and not mixed(s) and (is_initials(s) or number_like(s) or useful(s))


@functools.cache
def collapse(s):
    out, num, real = [], "", 0
    tokens = clean(s).split(" ") if clean(s) else []
    is_digits = [bool(regex.search(r"\p{Nd}", t)) and all(regex.match(r"\p{Nd}", c) or c in LOOK + ".,:-" for c in t) for t in tokens]
    for i, t in enumerate(tokens):
        ahead = i + 1 < len(tokens) and is_digits[i + 1]
        if is_digits[i] or (len(t) == 1 and t in LOOK and (real > 0 or ahead)):
            num += "".join(c for c in t if regex.match(r"\p{Nd}", c) or c in LOOK).translate(AS)
            real += digits(t)
        else:
            out += [num] if num and real >= 2 else []
            out.append(t)
            num, real = "", 0
    return " ".join(out + ([num] if num and real >= 2 else []))


def digit_run(s):
    compact = regex.sub(r"[ \t\n\x0b\f\r\x1c-\x1f]|\p{Z}", lambda m: m[0] if m[0] in "   " else "", s)
    runs = [r for r in regex.findall(rf"[\p{{Nd}}{re.escape(LOOK)}]+", compact) if digits(r) >= 2]
    return max(runs, key=len, default="").translate(AS)


@functools.cache
def mostly_digits(s):
    return len(digit_run(collapse(s))) >= 4 and letters(collapse(s)) <= 1


def explode(s):
    c = collapse(s)
    n = digit_run(c)
    if not c:
        return []
    if len(n) < 2 or n not in c:
        return [c]
    at = c.index(n)
    before, after = clean(c[:at]), clean(c[at + len(n) :])
    return [x for i, x in enumerate((before, n, after)) if i == 1 or letters(x) >= 2]


def mismatch(s, family):
    cyr, lat = cyrillic(s), latin(s)
    own, foreign = (cyr, lat) if family == "CYRILLIC" else (lat, cyr)
    return own == 0 and foreign >= 2 and letters(s) == cyr + lat and not is_initials(s) and not mostly_digits(s)


def unwanted(s):
    return mismatch(s, "LATIN") or gibberish(s) or mixed(s)


@functools.cache
def key(s):
    return regex.sub(r"[^\p{L}\p{Nd}]", "", s).lower()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
    return row[-1]


@functools.cache
def variant(a, b):
    short, long = sorted((len(a), len(b)))
    if a == b:
        return True
    return short >= 4 and short * 100 >= long * 70 and ((d := distance(a, b)) <= 1 or d * 6 <= long)


def similar(k, o):
    kd, od = (bool(regex.fullmatch(r"\p{Nd}+", x)) for x in (k, o))
    short, long = (k, o) if len(k) <= len(o) else (o, k)
    inside = len(short) >= 3 and short in long and len(short) * 100 >= len(long) * 55
    return len(k) >= 2 and len(o) >= 2 and (k == o or (not kd and not od and variant(k, o)) or (kd == od and inside))


def place_of(done, x):
    return next((i for i, d in enumerate(done) if similar(key(x), key(d))), -1)


def score(s, confidence):
    return 0 if s == "" else letters(s) * 4 + digits(s) * 3 + math.floor(confidence + 0.5) - (80 if math_noise(s) else 0)


def covered(line, k, other):
    return len(other) > len(k) and k in other and (is_initials(line) or len(k) <= 4 or variant(k, other))


Line = collections.namedtuple("Line", "text top left height confidence")


def same_row(a, b):
    height = min(max(a.height, 12), max(b.height, 12))
    return abs(a.top - b.top) <= max(8, height // 2)


def can_join(a, b):
    ka, kb = key(a.text), key(b.text)
    apart = abs(a.left - b.left) > max(12, min(a.height, b.height))
    return apart and ka != "" != kb and kb not in ka and ka not in kb and not variant(ka, kb) and not mostly_digits(a.text) and not mostly_digits(b.text)


def cluster(lines):
    done = []
    for x in lines:
        at = next((i for i, d in enumerate(done) if same_row(d, x)), None)
        if at is None:
            done.append(x)
            continue
        d = done[at]
        if can_join(d, x):
            one, two = (d, x) if d.left <= x.left else (x, d)
            done[at] = Line(initials(f"{one.text} {two.text}"), min(d.top, x.top), min(d.left, x.left), max(d.height, x.height), max(d.confidence, x.confidence))
        elif score(x.text, x.confidence) > score(d.text, d.confidence):
            done[at] = x
    return done


def recognise(rows):
    """rows of one page that are admitted: the final lines, the whole text and the options; None if there are no rows."""
    attempts = collections.defaultdict(list)
    for r in rows:
        attempts[r.attempt].append(r)
    if not attempts:
        return None

    def worth(rs):
        points, good = 0, 0
        for r in rs:
            bad, keep = unwanted(r.text), keepable(r.text)
            points += -20 if bad else 30 + letters(r.text) + math.floor(r.confidence / 2 + 0.5) if keep else 0
            good += keep and not bad
        return math.floor(sum(r.confidence for r in rs) / len(rs)) + points - (50 if not good else 0)

    best = min(attempts, key=lambda a: (-worth(attempts[a]), a))
    kept = sorted((r for r in attempts[best] if keepable(r.text)), key=lambda r: (r.top, r.left, -score(r.text, r.confidence), r.ordinal))
    texts = [t for r in cluster([Line(r.text, r.top, r.left, r.height, r.confidence) for r in kept]) if not unwanted(r.text) and keepable(t := initials(r.text))]
    merged = []
    for t in texts:
        if (at := place_of(merged, t)) < 0:
            merged.append(t)
        elif len(t) >= len(merged[at]) if mostly_digits(t) and mostly_digits(merged[at]) else alnum(t) > alnum(merged[at]):
            merged[at] = t
    parts = []
    for t in (initials(p) for m in merged for p in explode(m)):
        if keepable(t) and place_of(parts, t) < 0:
            parts.append(t)
    final = [t for t in parts if mostly_digits(t) or not any(covered(t, key(t), key(o)) for o in parts)]
    full = " ".join(final)
    return final, full, [] if not final else [full] if len(final) == 1 else list(dict.fromkeys([full, *final]))


Row = collections.namedtuple("Row", "attempt ordinal text top left height confidence")


def admitted(rows):
    out = collections.defaultdict(list)
    for r in rows:
        t = initials(r.text)
        if keepable(t) and (r.confidence >= 32 or letters(t) >= 6 or digits(t) >= 4):
            out[r.page_id].append(Row(r.attempt, r.ordinal, t, r.top, r.left, r.height, r.confidence))
    return out


#: Pages with fragments on one row, numbers, repeated and nearly equal lines, both scripts and formulas.
PAGES = [
    ["ТЕОРИЯ ВЕРОЯТНОСТЕЙ", "5 3 3 4 Шахматы", "А И Курак", "ШАХМАТЫ 5334 cl"], ["Calculus of variations", "Calculus of variation", "A. B. Author", "Volume 12 34 56"],
    ["left part", "right part", "ISBN 978 0 306 40615 7", "x = y + (z)"], ["1999 2000 OOOO", "Reader's digest", "Readers digest", "digest"], ["", None, "((", "|||"], ["12345", "12345 7", "name name name name", "nam"],
    ["Введение", "Введенне", "глава 1", "Глава 1 Введение"], ["a b c d e", "chapter one (first", "chapter one", "J K Rowling 1997 - 2007"],
]


def made(spark):
    rows = []
    for p, texts in enumerate(PAGES):
        for i in range(24):
            rows.append((p, i % 4, i, texts[(i * 5 + i // 4) % 4], i // 4 * 11 + p, i % 3 * 40, 10 + p * 3, float((p * 31 + i * 17) % 100)))
    return spark.createDataFrame(rows, "page_id long, attempt int, ordinal int, text string, top int, left int, height int, confidence float")


@pytest.mark.parametrize("source", ["documents", "made"])
def test_pages(spark, source):
    from shelfspark.operators import pages

    df = located(spark, SF) if source == "documents" else made(spark)
    got = QUERIES["page_result"](spark, SF) if source == "documents" else pages.recognise(df, "LATIN")
    got = {r.page_id: (list(r.lines), r.full_text, list(r.options)) for r in got.collect()}
    want = {p: recognise(rows) for p, rows in admitted(df.collect()).items()}
    assert got == {p: w for p, w in want.items() if w}
    assert any(len(w[0]) > 1 for w in got.values())


def test_lines_one_by_one(spark):
    """Flags, collapsed lines and numbers of the lines of all documents and of made ones."""
    df = located(spark, SF).select("text").union(made(spark).select("text")).distinct()
    s = F.col("text")
    rows = df.select(s, L.clean(s).alias("c"), L.initials(s).alias("i"), L.collapse_digits(s).alias("n"), L.explode_number(s).alias("e"), L.mostly_digits(s).alias("d"), L.key(s).alias("k")).collect()
    for r in rows:
        assert (r.c, r.i, r.n, r.e, r.d, r.k) == (clean(r.text), initials(r.text), collapse(r.text), explode(r.text), mostly_digits(r.text), key(r.text or "")), r.text
    c = L.clean(s)
    for r in df.select(c.alias("c"), L.gibberish(c).alias("g"), L.math_noise(c).alias("m"), L.mixed_scripts(c).alias("x"), L.keepable(c).alias("k"), L.script_mismatch(c, F.lit("LATIN")).alias("l"), L.script_mismatch(c, F.lit("CYRILLIC")).alias("y")).collect():
        assert (r.g, r.m, r.x, r.k, r.l, r.y) == (gibberish(r.c), math_noise(r.c), mixed(r.c), keepable(r.c), mismatch(r.c, "LATIN"), mismatch(r.c, "CYRILLIC")), r.c


def test_number_lines(spark):
    for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name").join(QUERIES["number_lines"](spark, SF), "p_partkey").collect():
        text = f"Vol {''.join(c + ' ' for c in str(r.p_partkey))} O {r.p_name}"
        assert (r.collapsed, r.parts) == (collapse(text), explode(text))


def test_long_lines_of_numbers(spark):
    """A line is put together in one pass, however many runs or tokens it has; lookalikes count beside digits only."""
    import time

    lines = ["x 12 " * 20_000, "1 l O 2 " * 20_000, "l l 5 O x l 7 8 lx 9 l", "l 5", "5 lx 6", "o O l", "12,5 l .", "- 3 4-5 l l l", "O 1 O 1 x O O 1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "k int, t string").repartition(1)
    df.select(L.collapse_digits(F.col("t"))).where("k > 1").collect()
    began = time.perf_counter()
    got = [r.c for r in df.orderBy("k").select(L.collapse_digits(F.col("t")).alias("c")).collect()]
    assert time.perf_counter() - began < 8 and got == [collapse(t) for t in lines]

"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from . import decontam, importance, mixing, sharding, spelling, urls

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (
    SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS t
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, m = x.n AND m = y.n AS same FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
e AS (SELECT a, count(*) AS n_links, count(*) FILTER (same) AS twins FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, (1 + coalesce(twins, 0))::BIGINT AS n_copies
FROM documents JOIN k ON k.a = doc_id LEFT JOIN e ON e.a = doc_id
"""

ARCHIVE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS intact
FROM f
"""

_W = decontam.WINDOW
CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t
    FROM (SELECT item_id, w, least({_W}, len(w)) AS n, unnest(range(1, len(w) - least({_W}, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)
),
dw AS (
    SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
),
m AS (SELECT dw.doc_id, dw.s, dw.n, win.item_id FROM dw JOIN win ON dw.t = win.t AND dw.n = win.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id),
t AS (SELECT item_id, unnest(list_distinct(w)) AS word, len(w) + {decontam.SLOP} AS reach, len(list_distinct(w)) AS n FROM b),
o AS (SELECT doc_id, item_id, pos, word, reach, n FROM t JOIN (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d) USING (word)),
a AS (SELECT doc_id, item_id FROM o GROUP BY ALL HAVING count(DISTINCT word) = any_value(n)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
    SELECT x.doc_id, x.item_id FROM o x JOIN a USING (doc_id, item_id) JOIN o y ON y.doc_id = x.doc_id AND y.item_id = x.item_id AND y.pos BETWEEN x.pos AND x.pos + x.reach - 1
    GROUP BY x.doc_id, x.item_id, x.pos HAVING count(DISTINCT y.word) = any_value(x.n)) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id LEFT JOIN near ON near.doc_id = d.doc_id
"""

MIX = rf"""
WITH q AS (SELECT doc_id AS k, CASE min(quality) WHEN 1 THEN {mixing.GOOD} WHEN 0 THEN {mixing.BAD} ELSE {mixing.UNKNOWN} END::DOUBLE AS w FROM labels GROUP BY doc_id),
d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        -ln((('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)!r}) / coalesce(w, {mixing.UNKNOWN})::DOUBLE AS key
    FROM documents LEFT JOIN q ON k = doc_id
),
p AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
s AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM p),
r AS (
    SELECT *, (sum(n) OVER () - coalesce(sum(3 * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
    FROM s WINDOW o AS (ORDER BY 3 * n / w, source NULLS LAST)
),
t AS (SELECT source, n, least((3 * n)::DOUBLE, max(rate) OVER () * w) AS target FROM r),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs FROM t),
u AS (SELECT d.*, n, target, epochs, target - epochs * n AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, n AS source_size, target, ((epochs + CASE WHEN rest > 0 AND upto - size / 2 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM u
"""

SHARDS = f"""
SELECT doc_id, slot::INT AS slot, no::INT AS shard_no, 'shard-' || lpad(no::VARCHAR, 3, '0') AS shard
FROM (SELECT doc_id, slot, (string_split('{",".join(map(str, sharding.fill(sharding.names())))}', ',')::INT[])[slot + 1] AS no
    FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT % {sharding.SLOTS} AS slot FROM documents))
"""


def _rule_case(value: str) -> str:
    arms = ""
    for say, text in sorted(urls.RULES, key=lambda r: -len(r[1])):
        host, _, rest = text.partition("/")
        arms += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}') THEN '{text if value == 'rule' else say}'"
    return f"CASE{arms} END"


def _url_model() -> str:
    k, prior = urls.ORDER, urls.PRIOR
    grams = f"unnest(list_transform(range(1, length(s) + 2), lambda i: substr(repeat(chr(1), {k}) || s || chr(2), i, {k + 1})))"
    out = f"""
WITH h AS (
    SELECT page_id, translate(CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)
),
u AS (SELECT *, host || path AS s, {_rule_case("rule")} AS rule, {_rule_case("say")} AS say FROM h),
x AS (SELECT DISTINCT s, host, path, say, substr(md5(s), 1, 1) IN ({", ".join(f"'{c}'" for c in urls.HELD_OUT)}) AS held FROM u),
seen AS (SELECT gram, sum(CASE WHEN say = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN say = 'allow' THEN 0 ELSE 1 END) AS r
    FROM (SELECT say, {grams} AS gram FROM x WHERE say IS NOT NULL AND NOT held) GROUP BY gram),
each AS (SELECT s, host, path, say, held, {grams} AS gram FROM x),
p0 AS (SELECT DISTINCT gram, {1 / urls.ALPHABET!r}::DOUBLE AS pa, {1 / urls.ALPHABET!r}::DOUBLE AS pr FROM each)"""
    for i in range(k + 1):
        full, head = f"substr(gram, {k + 1 - i}, {i + 1})", f"substr(gram, {k + 1 - i}, {i})"
        out += f""",
f{i} AS (SELECT {full} AS x, sum(a) AS a, sum(r) AS r FROM seen GROUP BY 1),
h{i} AS (SELECT {head} AS x, sum(a) AS a, sum(r) AS r FROM seen GROUP BY 1),
p{i + 1} AS (SELECT gram, (coalesce(f.a, 0) + {prior} * pa) / (coalesce(h.a, 0) + {prior}) AS pa, (coalesce(f.r, 0) + {prior} * pr) / (coalesce(h.r, 0) + {prior}) AS pr
    FROM p{i} LEFT JOIN f{i} f ON f.x = {full} LEFT JOIN h{i} h ON h.x = {head})"""
    return (
        out
        + f""",
sc AS (SELECT host, path, say, held, avg(CASE WHEN (SELECT sum(a) > 0 AND sum(r) > 0 FROM seen) THEN ln(pa) - ln(pr) END) AS score
    FROM each JOIN p{k + 1} USING (gram) GROUP BY s, host, path, say, held),
cut AS (SELECT (avg(score) FILTER (say = 'allow') + avg(score) FILTER (say = 'block')) / 2 AS t FROM sc WHERE say IS NOT NULL AND held)
SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.say, CASE WHEN coalesce(score >= coalesce((SELECT t FROM cut), 0), TRUE) THEN 'allow' ELSE 'block' END) AS verdict
FROM u LEFT JOIN sc ON u.say IS NULL AND sc.say IS NULL AND sc.host = u.host AND sc.path = u.path
"""
    )


#: Tables of a query that has k(s), distinct strings: c(s, h) with the unsigned crc32 of their UTF-8 bytes.
_CRC = """
o AS (SELECT list(v ORDER BY i) AS o FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(3988292384::BIGINT, x // 2) ELSE x // 2 END) AS v FROM range(256) r(i))),
y AS (SELECT s, list_transform(range(1, strlen(s) + 1), lambda k: ('0x' || substr(hex(encode(s)), 2 * k - 1, 2))::BIGINT) AS b FROM k),
c AS (SELECT s, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b), lambda x, e: xor(x // 256, o[xor(x % 256, e) + 1]))) AS h FROM y, o)
"""

_L = "A-Za-zÀ-ÿ"
VARIANTS = f"""
WITH RECURSIVE r AS (
    SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS s, w
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{_L}]+')) AS w FROM documents)
),
k AS (SELECT DISTINCT s FROM r), {_CRC},
d AS (SELECT CASE WHEN h % {spelling.DAMAGED} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM r JOIN c ON r.s = c.s),
v AS (SELECT word, count(*)::BIGINT AS n FROM d WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING count(*) >= {spelling.MIN_COUNT}),
l AS (SELECT DISTINCT unnest(string_split(word, '')) AS a FROM v),
p AS (SELECT word, unnest(range(0, length(word) + 1)) AS i FROM v),
g AS (
    SELECT word, substr(word, 1, i) || substr(word, i + 2) AS near FROM p WHERE i < length(word)
    UNION SELECT word, substr(word, 1, i) || a || substr(word, i + 2) FROM p, l WHERE i < length(word)
    UNION SELECT word, substr(word, 1, i) || a || substr(word, i + 1) FROM p, l
),
m AS (SELECT g.word, g.near, v.n FROM g JOIN v ON g.near = v.word WHERE g.word <> g.near),
b AS (SELECT word, count(*)::BIGINT AS n_near, max(n) AS most FROM m GROUP BY word),
e AS (SELECT m.word, min(m.near) AS near FROM m JOIN b ON m.word = b.word AND m.n = b.most GROUP BY m.word),
f AS (
    SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 2 * v.n THEN near END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n
    FROM v LEFT JOIN b ON b.word = v.word LEFT JOIN e ON e.word = v.word
),
w AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT w.word, f.form FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, w.root
FROM f JOIN w ON w.word = f.word JOIN f z ON z.word = w.root WHERE z.form IS NULL
"""

RESAMPLED = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
z AS (SELECT w FROM (SELECT {_WORDS} AS w FROM benchmark)),
u AS (SELECT doc_id, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS s FROM d),
q AS (SELECT unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS s FROM z),
k AS (SELECT s FROM u UNION SELECT s FROM q), {_CRC},
fd AS (SELECT doc_id, c.h % {importance.BUCKETS} AS bucket FROM u JOIN c ON u.s = c.s),
sn AS (SELECT bucket, count(*) AS n FROM fd GROUP BY bucket),
tn AS (SELECT c.h % {importance.BUCKETS} AS bucket, count(*) AS n FROM q JOIN c ON q.s = c.s GROUP BY 1),
ss AS (SELECT count(*) AS n FROM fd),
ts AS (SELECT coalesce(sum(n), 0)::BIGINT AS n FROM tn),
gain AS (
    SELECT i AS bucket, floor(1000 * ln((coalesce(tn.n, 0) + 1)::DOUBLE * (ss.n + {importance.BUCKETS})::DOUBLE / ((coalesce(sn.n, 0) + 1)::DOUBLE * (ts.n + {importance.BUCKETS})::DOUBLE)))::BIGINT AS g
    FROM range({importance.BUCKETS}) x(i) LEFT JOIN sn ON sn.bucket = i LEFT JOIN tn ON tn.bucket = i, ss, ts
),
wt AS (SELECT doc_id, count(*)::BIGINT AS n, sum(g)::BIGINT AS weight FROM fd JOIN gain ON fd.bucket = gain.bucket GROUP BY doc_id),
sc AS (
    SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || d.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score
    FROM d LEFT JOIN wt ON wt.doc_id = d.doc_id
),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM sc WHERE n_words >= {importance.MIN_WORDS})
SELECT sc.doc_id, n_features, weight, score, CASE WHEN r <= n * {importance.PERCENT} // 100 THEN r END::BIGINT AS rank FROM sc LEFT JOIN rk ON rk.doc_id = sc.doc_id
"""

ORACLE_SQL = {
    "op2_bayes_jaccard": NEAR_DUPLICATES,
    "op3_chunked_warc": ARCHIVE,
    "op4_positional_index": CONTAMINATION,
    "op6_url_model": _url_model(),
    "op7_epoch_mix": MIX,
    "op9_permutation_shards": SHARDS,
    "op11_spelling_variants": VARIANTS,
    "op12_importance_resampling": RESAMPLED,
}

"""The registered queries that SQL can express, for DuckDB."""

#: Measures of every document; ``rid`` tells repeated rows apart.
MEASURED = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
tri AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
tri2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i+1], ws[i+2]) AS c FROM tri),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM (SELECT rid, i, unnest([0, 1, 2]) AS j FROM tri2 WHERE c > 1) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.rid, doc_id, source, t, len(ws)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid) JOIN lines USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  10 * n_symbols > word_chars AS symbols_failed, 5 * n_dup_lines > n_words AS dup_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f1, sum(symbols_failed::INT) AS f2, sum(dup_failed::INT) AS f3
  FROM f GROUP BY source),
long AS (SELECT source, n, r, fr, lim FROM (SELECT source, n, unnest([1, 2, 3]) AS r, unnest([f1, f2, f3]) AS fr,
  unnest([0.5, 0.6, 0.6]) AS lim FROM h)),
mo AS (SELECT r, sum(n)::DOUBLE AS n, count(*) AS k, sum(n * n)::DOUBLE AS nn, sum(fr)::DOUBLE AS f, sum(fr * fr / n::DOUBLE) AS q
  FROM long GROUP BY r),
va AS (SELECT r, f / n AS mean, f / n * (1 - f / n) AS spread, CASE WHEN n - nn / n > 0
  THEN (q - n * (f / n) * (f / n) - greatest(k - 1, 0) * (f / n * (1 - f / n))) / (n - nn / n) ELSE 0 END AS v FROM mo),
pr AS (SELECT r, mean, least(greatest(CASE WHEN v > 0 AND spread > 0 THEN spread / v - 1 ELSE 1e6 END, 1), 1e6) AS s FROM va),
verdict AS (SELECT source, bool_or((fr + s * mean) / (n + s) > lim) AS rejected FROM long JOIN pr USING (r) GROUP BY source)
"""

HOST_RULES = f"""
WITH {MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected AS host_rejected,
  NOT base_failed AND NOT rejected AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""

#: Forty hex digits are 32 base32 digits of five bits.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
  (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS nth, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM q)
SELECT page_id, strlen(body) AS payload_bytes, payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN low END AS refers_to, true AS digest_matches, true AS has_request
FROM r
"""

CONTAINMENT = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
ds AS (SELECT DISTINCT rid, doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) > 4)),
bs AS (SELECT DISTINCT item_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM b WHERE len(ws) > 4)),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
x AS (SELECT rid, doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, k AS n_shared, k / n AS containment FROM x JOIN bn USING (item_id) WHERE k >= 0.8 * n
"""

#: CRC-32 (reflected polynomial) of the bytes of a text, by a table of 256 remainders.
CRC_TABLE = "crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce([n] || [-1, -1, -1, -1, -1, -1, -1, -1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"


def crc32(text: str, table: str = "tab") -> str:
    at = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {at}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


def _encoded(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


_SAME = [_encoded(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
_GROWN = [_encoded("n_chars + 1") if i == 3 else c for i, c in enumerate(_SAME)]
_UP = """SELECT f.rid, f.g, f.lvl + 1, f.pos // 2, sha256(CASE WHEN f.pos % 2 = 0 THEN f.cur || coalesce(s.d, '') ELSE s.d || f.cur END), f.sib || coalesce(s.d, '')
  FROM {0} f JOIN {1} h ON h.g = f.g LEFT JOIN {2} s ON s.g = f.g AND s.lvl = f.lvl AND s.pos = f.pos + 1 - 2 * (f.pos % 2) WHERE f.lvl < h.top"""
_LEVELS = """SELECT g, lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {0}) WHERE c > 1 GROUP BY g, lvl, pos // 2"""

MERKLE = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (SELECT row_number() OVER () AS rid, doc_id, lang, sha256({' || '.join(_SAME)}) AS leaf,
  CASE WHEN coalesce({crc32('doc_id::VARCHAR')} % 7 = 0, false) THEN sha256({' || '.join(_GROWN)}) END AS other FROM documents, crc),
p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low(g, lvl, pos, d) AS (SELECT g, 0, pos, leaf FROM p UNION ALL {_LEVELS.format('low')}),
low_top AS (SELECT g, max(lvl) AS top FROM low GROUP BY g),
high(g, lvl, pos, d) AS (SELECT -1, 0, low.g, d FROM low JOIN low_top h ON h.g = low.g AND h.top = lvl UNION ALL {_LEVELS.format('high')}),
high_top AS (SELECT g, max(lvl) AS top FROM high GROUP BY g),
f1(rid, g, lvl, pos, cur, sib) AS (SELECT rid, g, 0, pos, coalesce(other, leaf), '' FROM p UNION ALL {_UP.format('f1', 'low_top', 'low')}),
f2(rid, g, lvl, pos, cur, sib) AS (SELECT rid, -1, 0, f1.g, cur, sib FROM f1 JOIN low_top h ON h.g = f1.g AND h.top = lvl UNION ALL {_UP.format('f2', 'high_top', 'high')})
SELECT doc_id, leaf, sub.d AS subroot, root.d AS root, sha256(f2.sib) AS proof_sha256, f2.cur AS folded_root, f2.cur = root.d AS verified
FROM p JOIN f2 USING (rid) JOIN high_top h ON h.top = f2.lvl JOIN high root ON root.lvl = h.top JOIN high sub ON sub.lvl = 0 AND sub.pos = p.g
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def licenses_sql(phrases: list[tuple[str, str]], templates: list, threshold: float) -> str:
    """Every block against every template of its stride, and phrases by comparing words place by place."""
    texts = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    places = []
    for phrase, label in phrases:
        same = " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(phrase.split(), 1))
        places.append(f"SELECT rid, '{label}' AS label, unnest(list_filter(range(0, len(ws)), lambda i: {same})) AS place FROM w")
    rows = ", ".join(f"({t.number}, '{t.label}', {texts(t.words)}, {t.need}, {t.stride}, {len(t.words)})" for t in templates)
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM ({' UNION ALL '.join(places)}) GROUP BY rid),
t(template, label, own, need, stride, size) AS (VALUES {rows}),
b AS (SELECT rid, stride, k, ws[k * stride + 1 : (k + 2) * stride] AS held FROM (SELECT rid, stride, ws, unnest(range(0, greatest(0, (len(ws) - 1) // stride) + 1)) AS k FROM w, (SELECT DISTINCT stride FROM t))),
m AS (SELECT rid, stride, k, template, label, own, size, len(list_intersect(own, held)) AS n FROM b JOIN t USING (stride) WHERE len(list_intersect(own, held)) >= need),
best AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.rid = m.rid AND o.stride = m.stride AND o.k = m.k AND o.template <> m.template
  AND (len(list_intersect(o.own, m.own)) >= {threshold} * o.size - 1e-9 OR len(list_intersect(o.own, m.own)) >= {threshold} * m.size - 1e-9)
  AND (o.n / o.size > m.n / m.size OR (o.n / o.size = m.n / m.size AND o.size > m.size)))),
every AS (SELECT rid, label FROM best UNION SELECT rid, unnest(string_split(base_labels, ',')) FROM base),
l AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY rid),
s AS (SELECT rid, max(n / size) AS share FROM best GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)
"""


#: Pairs by what a word is without one letter: equal at the same place for a replacement, equal to a word for a deletion.
SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT id, run, count(*) AS k FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, k, {crc32("(id || ':' || run)")} AS h FROM runs, crc),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
gone AS (SELECT DISTINCT less.word, less.n, v.word AS other, v.n AS m FROM less JOIN v ON v.word = less.rest),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, other, m FROM gone UNION SELECT other, word, n FROM gone),
best AS (SELECT word, count(*) AS n_near, arg_max(other, m) AS any_best, max(m) AS m FROM near GROUP BY word),
chosen AS (SELECT best.word, n_near, best.m, min(near.other) AS other FROM best JOIN near ON near.word = best.word AND near.m = best.m GROUP BY ALL),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM v LEFT JOIN chosen ON chosen.word = v.word),
way(word, stop, hops) AS (SELECT word, word, 0 FROM f UNION ALL SELECT way.word, f.form, hops + 1 FROM way JOIN f ON f.word = way.stop WHERE f.form IS NOT NULL),
r AS (SELECT word, arg_max(stop, hops) AS root FROM way GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN r ON r.word = f.word
"""

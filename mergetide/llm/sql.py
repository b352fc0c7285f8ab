"""DuckDB equivalents of the llm queries that SQL can express."""

from __future__ import annotations

from mergetide.llm.quality import STOP_WORDS

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, text, {WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT row_number() OVER () AS rid, *, len(ws) AS n,
         list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS w3 FROM d),
p AS (SELECT rid, unnest(w3) AS w, unnest(range(1, len(w3) + 1)) AS i FROM g),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS k FROM p),
r AS (SELECT rid, count(DISTINCT i + o) AS n_repeat FROM c, (VALUES (0), (1), (2)) AS t(o) WHERE k > 1 GROUP BY rid),
f AS (
  SELECT doc_id, CAST(n AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(ws, lambda x: x IN ({", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))}))) AS BIGINT) AS n_stop_words,
         len(ls) AS nl
  FROM g LEFT JOIN r USING (rid)),
q AS (
  SELECT * EXCLUDE (nl), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_ratio,
         CASE WHEN nl > 0 THEN n_dup_lines / nl ELSE 0 END AS dup_line_ratio,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_ratio
  FROM f)
SELECT *, NOT base_failed AND mean_word_chars >= 2 AND mean_word_chars <= 12 AND symbol_ratio <= 0.1
       AND stop_word_ratio >= 0.06 AND dup_line_ratio <= 0.5 AND repeat_word_ratio <= 0.5 AS kept
FROM q
"""

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk, sum(source_size) OVER () AS everything FROM s0),
s2 AS (SELECT *, CASE rk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, everything * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
              sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM s2),
s4 AS (SELECT *, lft / wl AS lev, cap <= lft / wl * weight AS filled FROM s3),
s AS (SELECT source, source_size, n_docs, CASE WHEN filled THEN cap ELSE max(lev) FILTER (NOT filled) OVER () * weight END AS target FROM s4),
e AS (SELECT d.rid, d.doc_id, d.text, d.size, s.*, CASE WHEN 2 * d.size * n_docs < source_size THEN 0 WHEN d.size * n_docs > 2 * source_size THEN 2 ELSE 1 END AS stratum
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
t0 AS (SELECT source, stratum, any_value(target) AS target, CAST(sum(size) AS BIGINT) AS words, stratum + 1.0::DOUBLE AS sw FROM e GROUP BY source, stratum),
t1 AS (SELECT *, target - coalesce(sum(words * 2.0::DOUBLE) OVER (PARTITION BY source ORDER BY 2.0::DOUBLE / sw, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
              nullif(sum(sw * words) OVER (PARTITION BY source ORDER BY 2.0::DOUBLE / sw, stratum ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS wl FROM t0),
t2 AS (SELECT *, coalesce(lft / wl, 0) AS lev, words * 2.0::DOUBLE <= coalesce(lft / wl, 0) * (sw * words) AS filled FROM t1),
t3 AS (SELECT *, CASE WHEN filled THEN words * 2.0::DOUBLE ELSE max(lev) FILTER (NOT filled) OVER (PARTITION BY source) * (sw * words) END AS part FROM t2),
t4 AS (SELECT *, least(2.0::DOUBLE, round(coalesce(part / nullif(words, 0), 0), 9)) AS copies FROM t3),
t AS (SELECT source, stratum, floor(copies) AS whole, copies - floor(copies) AS p, target - sum(floor(copies) * words) OVER (PARTITION BY source) AS rest FROM t4),
r AS (
  SELECT e.rid, e.doc_id, e.size, e.source, e.source_size, e.target, t.whole, t.p, t.rest,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source AND e.stratum = t.stratum),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM r),
w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN p > 0 AND before < rest AND before + size - rest <= rest - before THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM w
"""

OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (
  SELECT page_id, octet_length(body) AS payload_bytes,
         sha1(body) AS h FROM p),
b AS (
  SELECT page_id, payload_bytes, h,
         array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda k:
             ((CAST('0x' || substr(h, 1 + (5 * i + k) // 4, 1) AS INTEGER) >> (3 - (5 * i + k) % 4)) & 1) << (4 - k))) AS INTEGER), 1)), '') AS payload_digest
  FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents),
w AS (
  SELECT rid, doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS win
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
f AS (SELECT rid, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT rid, list_distinct(flatten(list(range(i, i + 20)))) AS gone FROM f WHERE k > 1 GROUP BY rid),
k AS (SELECT doc_id, ws, coalesce(gone, []) AS gone, d.rid FROM d LEFT JOIN g ON d.rid = g.rid),
u AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
v AS (SELECT u.rid, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u
      LEFT JOIN (SELECT rid, unnest(gone) AS i FROM g) x ON u.rid = x.rid AND u.i = x.i WHERE x.rid IS NULL GROUP BY u.rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN v ON k.rid = v.rid
"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents),
w AS (
  SELECT rid, doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS win
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT rid, doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k, count(*) OVER (PARTITION BY win) AS n FROM w),
c AS (SELECT rid, doc_id, i, k > 1 AS late FROM f WHERE n > 1),
bo AS (SELECT rid, doc_id, i, false AS late FROM c UNION ALL SELECT rid, doc_id, i, true FROM c WHERE late),
b AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY rid, late ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY rid, late ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM bo),
s AS (SELECT *, sum(new) OVER (PARTITION BY rid, late ORDER BY i) AS g FROM b),
t AS (SELECT rid, doc_id, late, min(i) - 1 AS a, max(i) + 49 AS z FROM s GROUP BY rid, doc_id, late, g),
o AS (SELECT rid, doc_id, late, CAST(sum(z - a) AS BIGINT) AS n, string_agg(a || '-' || z, ',' ORDER BY a) AS spans FROM t GROUP BY rid, doc_id, late)
SELECT x.doc_id, x.n AS n_repeated, coalesce(y.n, 0) AS n_removable, x.spans, coalesce(y.spans, '') AS removable
FROM (SELECT * FROM o WHERE NOT late) x LEFT JOIN (SELECT * FROM o WHERE late) y ON x.rid = y.rid
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the crc32 of a byte, by eight shifts
CRC_STEPS = ", ".join(f"c{k} AS (SELECT i, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM c{k - 1})" for k in range(1, 9))

OP11 = rf"""
WITH RECURSIVE c0 AS (SELECT range AS i, range AS x FROM range(256)), {CRC_STEPS},
tab AS (SELECT list(x ORDER BY i) AS t FROM c8),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS m FROM r WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + CAST(unicode(c) AS BIGINT) // 64, 128 + CAST(unicode(c) AS BIGINT) % 64] END)) AS bytes FROM k),
h AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295, bytes), lambda acc, x: xor(acc >> 8, t[CAST((xor(acc, x) & 255) + 1 AS INTEGER)])), 4294967295) AS crc FROM b, tab),
w0 AS (SELECT CASE WHEN crc % 31 = 0 THEN left(run, CAST(crc % length(run) AS INTEGER)) || substr(run, CAST(crc % length(run) AS INTEGER) + 2) ELSE run END AS word, m FROM h),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM w0 WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
g AS (SELECT word, unnest(range(0, length(word))) AS p FROM w),
v AS (SELECT word, p, left(word, CAST(p AS INTEGER)) || substr(word, CAST(p AS INTEGER) + 2) AS less FROM g),
e AS (SELECT a.word, b.word AS near FROM v a JOIN v b ON a.less = b.less AND a.p = b.p AND a.word <> b.word
      UNION SELECT v.word, w.word FROM v JOIN w ON v.less = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.less = w.word),
s AS (SELECT e.word, e.near, w.n AS near_n, count(*) OVER (PARTITION BY e.word) AS n_near,
             row_number() OVER (PARTITION BY e.word ORDER BY w.n DESC, e.near) AS place FROM e JOIN w ON w.word = e.near),
f AS (SELECT w.word, w.n, coalesce(s.n_near, 0) AS n_near, CASE WHEN s.near_n >= 10 * w.n THEN s.near END AS form, CASE WHEN s.near_n >= 10 * w.n THEN s.near_n END AS form_n
      FROM w LEFT JOIN s ON s.word = w.word AND s.place = 1),
q(word, goal) AS (SELECT word, word FROM f UNION ALL SELECT q.word, f.form FROM q JOIN f ON f.word = q.goal WHERE f.form IS NOT NULL)
SELECT f.word, f.form, q.goal AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM f JOIN q ON q.word = f.word JOIN f z ON z.word = q.goal AND z.form IS NULL
"""

TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS ts FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM d WHERE len(ts) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) GROUP BY ALL),
i AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, c WHERE term IN (SELECT term FROM i) GROUP BY term, nn),
m AS (SELECT rid, doc_id, 50 + (50 * len(ts) * nn) // ll AS m FROM d, c),
s AS (SELECT item_id, doc_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50
"""

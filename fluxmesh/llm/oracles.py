"""DuckDB SQL of the training-data queries that SQL can express on whole tables.

The trained ones (1, 2, 6), the tokenizers (4, 8, 9) and the winnowed extension (10) have none; tests compare them with
brute force, the libraries and held-out labels.
"""

from __future__ import annotations

BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

OP3 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') h, strlen(coalesce(html, ''))::BIGINT n, sha1(coalesce(html, '')) d FROM pages),
 f AS (SELECT d, min(page_id) first FROM p GROUP BY d),
 g AS (SELECT p.*, first, [('0x' || substr(p.d, 5*i + 1, 5))::BIGINT for i in range(8)] q FROM p JOIN f ON p.d = f.d)
SELECT page_id, n AS payload_bytes,
 array_to_string([{BASE32}[1 + ((x >> 15) & 31)] || {BASE32}[1 + ((x >> 10) & 31)] || {BASE32}[1 + ((x >> 5) & 31)] || {BASE32}[1 + (x & 31)] for x in q], '') AS payload_digest,
 CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM g"""

OP5 = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') t, [x for x in regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+') if x <> ''] w,
   [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^ \x09-\x0D]')] l FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) i FROM t)),
 rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) c FROM win) WHERE c > 1),
 cov AS (SELECT doc_id, count(DISTINCT i + o) n FROM rep, range(8) r(o) GROUP BY doc_id),
 m AS (SELECT t.doc_id, source, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols,
   (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines, len(l)::BIGINT n_lines, coalesce(cov.n, 0)::BIGINT n_repeat_words FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id),
 r AS (SELECT *, n_words < 20 OR 100*n_repeat_words > 30*n_words base_failed, 100*n_symbols > 10*n_words OR 100*n_dup_lines > 30*n_lines OR word_chars < 2*n_words OR word_chars > 15*n_words soft FROM m),
 h AS (SELECT source, count(*) n, sum((base_failed OR soft)::INT)::DOUBLE f FROM r WHERE source IS NOT NULL GROUP BY source),
 s AS (SELECT sum(n)::DOUBLE n, sum(f) f, sum((f/n)*(f/n)*n) q, count(*)::DOUBLE k FROM h),
 a AS (SELECT *, least(greatest(f/n, 1e-4), 1 - 1e-4) mean FROM s),
 b AS (SELECT *, greatest(q/n - mean*mean - mean*(1 - mean)*k/n, 1e-6) spread FROM a),
 c AS (SELECT mean, least(greatest(mean*(1 - mean)/spread - 1, 1e0), 1e4) strength FROM b),
 v AS (SELECT source, (h.f + mean*strength)/(h.n + strength) rate FROM h, c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(rate > 0.5, false) AND soft) AS kept,
 coalesce(rate > 0.5, false) AS host_flagged, round(rate, 9) AS host_rate
FROM r LEFT JOIN v ON r.source = v.source"""

OP7 = r"""
WITH RECURSIVE t AS (SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+') if x <> ''] w FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i FROM t WHERE len(w) > 0)),
 n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
 o AS (SELECT a.doc_id a, b.doc_id b, count(*) o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*o >= 85*(x.n + y.n - o)),
 reach AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.low AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) low FROM reach GROUP BY a) c ON c.a = d.doc_id"""

OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') t, sha256('42:' || doc_id) h FROM documents),
 u AS (SELECT *, regexp_extract_all(t, '[ \x09-\x0D]*[^ \x09-\x0D]+|[ \x09-\x0D]+') w, [('0x' || substr(h, 8*i + 1, 8))::BIGINT for i in range(4)] d FROM t),
 c AS (SELECT *, len(w) n, least(d[1] % (len(w) + 1), d[2] % (len(w) + 1)) a, greatest(d[1] % (len(w) + 1), d[2] % (len(w) + 1)) b FROM u),
 p AS (SELECT doc_id, t, n, array_to_string(w[1:a], '') p, array_to_string(w[a+1:b], '') m, array_to_string(w[b+1:], '') s,
   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""

# The tables' pages share one template, whose article SQL can cut out; its last character reference to be decoded is the ampersand.
OP12 = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g') a FROM pages),
 b AS (SELECT *, regexp_split_to_array(replace(a, '<br>', ' '), '</?(?:p|h1)>') b FROM a),
 d AS (SELECT *, [trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(?:x27|39);', chr(39), 'g'), '&amp;?', '&', 'g'), '[\s\x0B\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+', ' ', 'g')) for x in b] x FROM b),
 t AS (SELECT *, [y for y in x if y <> ''] y FROM d)
SELECT page_id, url, array_to_string(y, chr(10) || chr(10)) AS text, length(array_to_string(y, chr(10) || chr(10)))::BIGINT AS n_chars, len(y)::BIGINT AS n_blocks FROM t"""

OP13 = r"""
WITH RECURSIVE z AS (SELECT i, i::BIGINT v, 0 k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END, k + 1 FROM z WHERE k < 8),
 tab AS (SELECT list(v ORDER BY i) tab FROM z WHERE k = 8),
 t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') w,
   xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]))) h FROM documents, tab),
 g AS (SELECT *, len(w) n, h % 10 = 0 AND len(w) > 0 planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END a, h // 10 g FROM t),
 v AS MATERIALIZED (SELECT doc_id, n, CASE WHEN planted THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] for i in range(n)] ELSE w END w FROM g),
 words AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) i, unnest(w) x FROM v),
 ids AS MATERIALIZED (SELECT doc_id, n, i, dense_rank() OVER (ORDER BY x) x FROM words),
 same AS (SELECT a.doc_id, a.n, a.i, b.i - a.i p FROM ids a JOIN ids b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i AND 3*(b.i - a.i) <= a.n),
 isle AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) k FROM same),
 s AS MATERIALIZED (SELECT doc_id, p, min(i) a, max(i) + 1 + p b FROM isle GROUP BY doc_id, p, k HAVING count(*) + p >= greatest(24, 3*p)),
 runs AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s q WHERE q.doc_id = s.doc_id AND q.p < s.p AND s.p % q.p = 0 AND q.a <= s.a AND q.b >= s.b)),
 listed AS (SELECT doc_id, count(*) c, string_agg(a || ',' || (b - a) || ',' || p || chr(10), '' ORDER BY a, p) l FROM runs GROUP BY doc_id),
 best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (b - a) / p DESC, a, p) = 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(a + p, b)) i FROM runs),
 rest AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) c FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT v.doc_id AS doc_id, coalesce(listed.c, 0)::BIGINT AS n_runs, best.a::BIGINT AS start, (b - best.a)::BIGINT AS length, p::BIGINT AS period, (1000*(b - best.a) // p)::BIGINT AS exponent_milli,
 sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(rest.c, '')) AS collapsed_sha256
FROM v LEFT JOIN listed USING (doc_id) LEFT JOIN best ON best.doc_id = v.doc_id LEFT JOIN rest ON rest.doc_id = v.doc_id"""

ORACLES: dict[str, str] = {"op3_splittable_warc": OP3, "op5_host_quality_rules": OP5, "op7_ngram_jaccard_join": OP7, "op11_fill_in_middle": OP11, "op12_tag_path_text": OP12, "op13_periodic_runs": OP13}

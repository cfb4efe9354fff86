"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from ..licenses import COPYRIGHT_LINE, DIGESTS, KNOWN, PUNCTUATION, SPELLINGS

_Q = lambda s: "'" + s.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_Q(COPYRIGHT_LINE)}, ' ', 'g')"
    out = f"(' ' || regexp_replace({out}, {_Q(PUNCTUATION)}, ' ', 'g') || ' ')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_Q(old)}, {_Q(new)})"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _digest(text: str) -> str:
    clean = _canonical(text)
    return f"CASE WHEN {clean} <> '' THEN sha256({clean}) END"


_DIGESTS = ", ".join(f"({_Q(d)}, 'text', {_Q(i)})" for i, d in DIGESTS)
_ROWS = ", ".join(f"({_Q(i)}, {_Q(k)}, {_Q(t)})" for i, k, t in KNOWN)

OP3 = f"""WITH known AS (SELECT {_digest('t')} digest, kind, min(id) license_id FROM (VALUES {_ROWS}) v(id, kind, t) GROUP BY ALL
  UNION ALL SELECT * FROM (VALUES {_DIGESTS}) w(digest, kind, license_id)),
 d AS (SELECT row_number() OVER () r, doc_id, text, {_digest('text')} digest FROM documents),
 l AS (SELECT r, {_digest('line')} digest FROM (SELECT r, unnest(string_split(text, chr(10))) line FROM d)),
 n AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) notices, count(*) n FROM l JOIN known USING (digest) WHERE kind = 'notice' GROUP BY r)
SELECT doc_id, d.digest, k.license_id, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notices
FROM d LEFT JOIN n USING (r) LEFT JOIN (SELECT * FROM known WHERE kind = 'text') k ON k.digest = d.digest"""

OP5 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) x FROM w WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
 e AS (SELECT a, b FROM (SELECT p.doc_id a, q.doc_id b, count(*) c FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
 r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 c AS (SELECT a, min(b) m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, m) AS component_id, d.doc_id = least(d.doc_id, m) AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON a = d.doc_id"""

OP7 = """WITH RECURSIVE c AS (SELECT conv_id, turn, any_value(text) ct, count(*) nc FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT conv_id, turn - 1 turn, any_value(text) rt, count(*) nr FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY 1, 2),
 j AS (SELECT *, length(ct) n, coalesce(CASE WHEN length(ct) % 7 = 0 THEN 'guess' WHEN length(ct) % 2 = 1 THEN 'count' END, 'reply') tool FROM c FULL JOIN r USING (conv_id, turn)),
 wants AS (SELECT conv_id, turn, unnest(CASE WHEN n % 13 = 0 THEN [turn] WHEN conv_id % 2 = 0 THEN CASE WHEN turn >= 2 THEN [turn - 2] ELSE [] END WHEN conv_id % 4 = 1 THEN [turn + 2] ELSE [turn + 2, turn + 4] END) need FROM j WHERE nc IS NOT NULL),
 links AS (SELECT w.* FROM wants w JOIN c ON c.conv_id = w.conv_id AND c.turn = w.need),
 late AS (SELECT DISTINCT conv_id FROM links WHERE need >= turn), sizes AS (SELECT conv_id, count(*) calls FROM c GROUP BY 1),
 cyc(conv_id, turn) AS (SELECT conv_id, turn FROM links WHERE need = turn UNION SELECT l.conv_id, l.turn FROM links l JOIN cyc ON l.conv_id = cyc.conv_id AND l.need = cyc.turn),
 depth(conv_id, turn, d) AS (SELECT conv_id, turn, 0 FROM c WHERE NOT EXISTS (SELECT 1 FROM cyc WHERE cyc.conv_id = c.conv_id AND cyc.turn = c.turn)
  UNION SELECT l.conv_id, l.turn, d + 1 FROM links l JOIN depth ON l.conv_id = depth.conv_id AND l.need = depth.turn WHERE NOT EXISTS (SELECT 1 FROM cyc WHERE cyc.conv_id = l.conv_id AND cyc.turn = l.turn)),
 lv AS (SELECT conv_id, turn, max(d) d FROM depth GROUP BY 1, 2),
 unknown AS (SELECT conv_id, turn, string_agg(DISTINCT 'unknown call c' || conv_id || '-' || need, '; ' ORDER BY 'unknown call c' || conv_id || '-' || need) u FROM wants w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = w.conv_id AND c.turn = w.need) GROUP BY 1, 2),
 k AS (SELECT j.*, u, d, calls, cyc.turn IS NOT NULL cycle, late.conv_id IS NOT NULL is_late FROM j LEFT JOIN unknown USING (conv_id, turn) LEFT JOIN lv USING (conv_id, turn) LEFT JOIN cyc ON cyc.conv_id = j.conv_id AND cyc.turn = j.turn LEFT JOIN late ON late.conv_id = j.conv_id LEFT JOIN sizes ON sizes.conv_id = j.conv_id)
SELECT conv_id, 'c' || conv_id || '-' || turn AS call_id, CAST(CASE WHEN nc IS NULL OR NOT is_late THEN 0 WHEN cycle THEN calls ELSE d END AS INTEGER) AS level, CASE WHEN nc IS NULL THEN turn + 1 ELSE turn END AS pos,
 CASE WHEN nc IS NULL THEN 'no call' WHEN nr IS NULL THEN 'no result' ELSE 'linked' END AS status,
 CASE WHEN nc IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN tool = 'guess' THEN 'no such tool' END, CASE WHEN ct IS NULL THEN 'missing prompt' END, CASE WHEN tool = 'count' AND n % 3 = 0 THEN 'not integer chars' END,
  CASE WHEN tool = 'count' AND n % 5 = 0 THEN 'unknown note' END, u, CASE WHEN cycle THEN 'cycle' END) END AS errors, coalesce(nc, 0) AS n_calls, coalesce(nr, 0) AS n_results,
 sha256('{"arguments":' || CASE WHEN nc IS NULL THEN 'null' WHEN tool = 'guess' THEN '{"turn":' || turn || '}' WHEN tool = 'count' THEN '{"chars":' || CASE WHEN n % 3 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END ||
   CASE WHEN n % 5 = 0 THEN ',"note":' || to_json(ct)::VARCHAR ELSE '' END || ',"turn":' || turn || '}' ELSE '{' || coalesce('"prompt":' || to_json(ct)::VARCHAR || ',', '') || '"turn":' || turn || '}' END ||
  ',"id":"c' || conv_id || '-' || turn || '","name":' || CASE WHEN nc IS NULL THEN 'null' ELSE '"' || tool || '"' END || ',"result":' || coalesce(to_json(rt)::VARCHAR, 'null') || '}') AS json_sha256 FROM k"""

OP9 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings),
 l AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) m FROM r GROUP BY 1), n AS (SELECT a, count(*) n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, m) AS component_id, v.vec_id = least(v.vec_id, m) AS kept FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

OP10 = r"""WITH p0 AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
 p1 AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path FROM p0),
 p AS (SELECT *, row_number() OVER () r, list_sort(list_distinct(list_concat(list_concat(
   list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x), list_transform(list_filter(regexp_split_to_array(lower(path), '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: 'p:' || x)),
   list_transform(list_filter(list_transform(string_split(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'q:' || x)))) tokens FROM p1),
 lab AS (SELECT p.r, tokens, CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 'block' ELSE 'allow' END v FROM p JOIN labels ON labels.doc_id = try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]{1,15})', 1) AS BIGINT)
   WHERE quality IS NOT NULL OR toxic IS NOT NULL),
 tot AS (SELECT count(*) n FROM lab), share AS (SELECT v, count(*) c FROM lab GROUP BY 1),
 one AS (SELECT row_number() OVER () k, * FROM lab), tk AS (SELECT k, v, unnest(tokens) t FROM one),
 fr AS (SELECT t FROM tk GROUP BY t HAVING count(*) >= ceil((SELECT least(1.0, greatest(0.005, 4.5 / n)) * n FROM tot) - 1e-9)),
 f AS (SELECT tk.* FROM tk JOIN fr USING (t)),
 sets AS (SELECT k, v, [t] s FROM f UNION ALL SELECT a.k, a.v, [a.t, b.t] FROM f a JOIN f b ON a.k = b.k AND a.t < b.t UNION ALL SELECT a.k, a.v, [a.t, b.t, c.t] FROM f a JOIN f b ON a.k = b.k AND a.t < b.t JOIN f c ON b.k = c.k AND b.t < c.t),
 cnt AS (SELECT s, count(*) n, count(*) FILTER (v = 'block') nb FROM sets GROUP BY s),
 rl AS (SELECT s, v, c / n::DOUBLE conf, c / (SELECT n FROM tot)::DOUBLE sup, (c / n::DOUBLE) / (share.c2 / (SELECT n FROM tot)::DOUBLE) lift FROM (SELECT s, n, 'block' v, nb c FROM cnt UNION ALL SELECT s, n, 'allow', n - nb FROM cnt) JOIN (SELECT v, c c2 FROM share) share USING (v)
   WHERE c >= ceil((SELECT least(1.0, greatest(0.005, 4.5 / n)) * n FROM tot) - 1e-9)),
 good AS (SELECT *, row_number() OVER (ORDER BY conf DESC, sup DESC, len(s), s, v) rk FROM rl WHERE conf >= 0.6 AND lift >= 1.1),
 hit AS (SELECT r, rk, s, v FROM p JOIN good ON list_has_all(tokens, s)), best AS (SELECT r, arg_min(v, rk) v, arg_min(array_to_string(s, ' & '), rk) m FROM hit GROUP BY r),
 rules(rule, rh, rp, rv) AS (VALUES ('org/','org','/','allow'), ('example.org/es/','example.org','/es/','block'), ('example.org/en/1','example.org','/en/1','block'), ('com/fr/','com','/fr/','allow'), ('com/de/','com','/de/','block')),
 st AS (SELECT r, arg_max(rule, length(rule)) rule, arg_max(rv, length(rule)) rv FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(rv, v, 'allow') AS verdict, CASE WHEN rv IS NULL THEN m END AS mined FROM p LEFT JOIN st USING (r) LEFT JOIN best USING (r)"""

OP11 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= 20"""

OP12 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u, sha256('7:' || doc_id) h FROM documents),
 n AS (SELECT *, len(u) n, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)) r FROM d),
 c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) a, greatest(r[1] % (n + 1), r[2] % (n + 1)) b,
   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END form FROM n),
 p AS (SELECT *, array_to_string(u[1:a], '') prefix, array_to_string(u[a + 1:b], '') middle, array_to_string(u[b + 1:], '') suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

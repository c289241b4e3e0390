"""SQL that gives the rows of those corpus queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
 s AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1)::BIGINT)) AS i, w FROM d),
 k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM s),
 gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS p FROM k WHERE r > 1),
 e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
 f AS (SELECT e.doc_id, count(g.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.p) FILTER (g.p IS NULL), '') AS kept FROM e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN f USING (doc_id)"""

QUALITY_RULES = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {WORDS} AS w,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
 s AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1)::BIGINT)) AS i, w FROM d),
 k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n FROM s),
 rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(5)) AS p FROM k WHERE n > 1) GROUP BY doc_id),
 l AS (SELECT doc_id, host, text, unnest(ls) AS line FROM d),
 l2 AS (SELECT doc_id, host, text, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm, length(line) AS chars FROM l),
 freq AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM l2 GROUP BY ALL) JOIN (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host) USING (host) WHERE n > 20 AND n > docs * 0.005),
 gone AS (SELECT doc_id, sum(chars) AS chars FROM l2 JOIN freq USING (host, norm) GROUP BY doc_id),
 m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS line_chars, coalesce(gone.chars, 0) AS gone_chars
 FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
 v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
 SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
 NOT base_failed AND line_chars - gone_chars >= 0.2 * line_chars AS kept FROM v"""

JACCARD_JOIN = f"""WITH RECURSIVE d AS (SELECT doc_id, list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2)::BIGINT)) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
 l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""

URL_FILTERS = r"""WITH p AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
 q AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM p),
 u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM q),
 rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) v(verdict, rh, rp)),
 f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
 SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host || path, 'casino|free-bets|cheap-pills|ads-track') THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN f USING (page_id)"""

FILTER_AUDIT = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
 b AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS bits FROM d),
 l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
 c AS (SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY ALL),
 f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, bit)),
 o AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bs, a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
 s AS (SELECT filter_order, step, bs[step] AS bit, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS prior FROM o, range(1, 6) r(step)),
 r AS (SELECT part, filter_order, step::INT AS step, bit, coalesce(sum(n) FILTER (bits & (prior | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bits & prior = 0 AND bits & bit > 0), 0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (bits & prior > 0 AND bits & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bits = bit), 0)::BIGINT AS unique_fails,
 coalesce(sum(good) FILTER (bits & prior = 0 AND bits & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (bits & prior = 0 AND bits & bit > 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY part, filter_order, step, bit)
 SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""

CONVERSATION_REPAIR = r"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS chars FROM conversations),
 h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(chars, lambda x: ascii(x)::BIGINT)), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384))), 4294967295) % 20 AS h FROM c),
 m AS (SELECT conv_id, turn, role0, text0, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy, CASE WHEN h = 4 THEN 'user' ELSE role0 END AS role,
 CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text FROM h),
 o AS (SELECT conv_id, turn, role, text, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0, copy) AS i FROM m),
 f AS (SELECT *, CASE WHEN tail = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
 coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
 w(conv_id, i, st, best) AS (
 SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'rows': []::VARCHAR[]} FROM f
 UNION ALL
 SELECT conv_id, i, e.st, min({'cost': e.cost, 'audit': e.audit, 'rows': e.rows}) FROM (
 SELECT k.conv_id, f.i, unnest(CASE WHEN fault IN (1, 2) THEN [{'st': k.st, 'cost': k.cost + 4, 'audit': k.audit || 'D', 'rows': k.rows}] ELSE
 [{'st': k.st, 'cost': k.cost + 4, 'audit': k.audit || 'D', 'rows': k.rows},
 {'st': CASE WHEN k.st = 2 THEN 3 ELSE 2 END, 'cost': k.cost + 3 + f.t, 'audit': k.audit || 'R', 'rows': list_append(k.rows, CASE WHEN k.st = 2 THEN 'assistant:' ELSE 'user:' END || f.text)},
 {'st': CASE role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'cost': k.cost + f.t + CASE WHEN (role[1] = 's' AND k.st = 0) OR (role[1] = 'u' AND k.st <> 2) OR (role[1] = 'a' AND k.st = 2) THEN 0 ELSE 1000000000 END,
 'audit': k.audit || 'K', 'rows': list_append(k.rows, role || ':' || f.text)}] END) AS e
 FROM (SELECT conv_id, i, g.st AS st, best.cost + 3 * g.n AS cost, best.audit || repeat('I', g.n) AS audit, best.rows || [CASE WHEN st0 = 2 THEN 'assistant:' ELSE 'user:' END, CASE WHEN st0 = 2 THEN 'user:' ELSE 'assistant:' END][1:g.n] AS rows
 FROM (SELECT conv_id, i, st AS st0, best, unnest([{'st': st, 'n': 0}, {'st': CASE WHEN st = 2 THEN 3 ELSE 2 END, 'n': 1}, {'st': CASE WHEN st = 2 THEN 2 ELSE 3 END, 'n': 2}]) AS g FROM w) y) k
 JOIN (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS t FROM f) f ON f.conv_id IS NOT DISTINCT FROM k.conv_id AND f.i = k.i + 1) x WHERE e.cost < 1000000000 GROUP BY conv_id, i, e.st),
 n AS (SELECT conv_id, max(i) AS n, sum((fault = 1)::INT) AS blank, sum((fault = 2)::INT) AS duplicate, sum((fault = 3)::INT) AS truncated, sum(illegal::INT) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
 z AS (SELECT w.conv_id, min({'cost': w.best.cost + CASE w.st WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': w.best.audit || CASE w.st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
 'rows': w.best.rows || CASE w.st WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END}) AS best FROM w JOIN n ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.i = n.n GROUP BY w.conv_id)
 SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.rows, chr(10)), '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id"""

EXACT_TOP_K = """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND (q.vec_id, q.v) IS DISTINCT FROM (c.vec_id, c.v)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
 SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""

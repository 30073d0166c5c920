"""DuckDB's SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from .common import WORD

_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: White space that parts words.
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_COSINE = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"
#: The smallest node that is reachable by links(a, b), for each node of nodes(id).
_REACH = "both AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(id, comp) AS (SELECT id, id FROM nodes UNION SELECT both_.b, reach.comp FROM reach JOIN both_ ON both_.a = reach.id), found AS (SELECT id, min(comp) AS component_id FROM reach GROUP BY id)".replace("both AS", "both_ AS")
_BITS = "array_to_string(list_transform(string_split(sha1(html), ''), lambda c: list_extract(['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'], CAST(strpos('0123456789abcdef', c) AS BIGINT))), '')"
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + " + " + ".join(f"{2 ** (4 - j)} * CAST(substring(bits, CAST(5 * k + {j + 1} AS BIGINT), 1) AS BIGINT)" for j in range(5)) + ", 1)), '')"

ORACLES = {
    "op1_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM e p JOIN e q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id HAVING 100 * count(*) >= 75 * (any_value(p.n) + any_value(q.n) - count(*))),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN found ON doc_id = id""",
    "op2_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html), b AS (SELECT page_id, first, strlen(html) AS payload_bytes, {_BITS} AS bits FROM p JOIN f USING (html))
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b""",
    "op5_mixing": f"""WITH w AS (SELECT doc_id, source, len({_WORDS}) AS size, ('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, 2 * sum(size)::BIGINT AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS wt FROM w GROUP BY source),
q AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS caps, sum(wt) OVER () - coalesce(sum(wt) OVER before, 0) AS open_w, sum(ss) OVER () AS total FROM s WINDOW before AS (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 2 * (caps * wt + cap * open_w) <= 3 * total * wt AS filled FROM q),
l AS (SELECT *, (total::DOUBLE * 1.5::DOUBLE - (sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ())::DOUBLE) / (sum(CASE WHEN filled THEN 0 ELSE wt END) OVER ())::DOUBLE AS level FROM f),
t AS (SELECT source, ss, CASE WHEN filled THEN cap::DOUBLE ELSE wt::DOUBLE * level END AS target FROM l),
g AS (SELECT *, coalesce(floor(target / nullif(ss, 0)), 0)::BIGINT AS copies FROM t),
k AS (SELECT source, key, s, sum(s) OVER (PARTITION BY source ORDER BY key) AS cum FROM (SELECT source, key, sum(size)::BIGINT AS s FROM w GROUP BY source, key)),
b AS (SELECT g.source, key + CASE WHEN s - (target - copies * ss - cum + s) < target - copies * ss - cum + s THEN 1 ELSE 0 END AS cut FROM g JOIN k ON k.source IS NOT DISTINCT FROM g.source WHERE cum > target - copies * ss AND cum - s <= target - copies * ss AND s > 0)
SELECT doc_id, size, ss AS source_size, target, (copies + CASE WHEN key < coalesce(cut, 0) THEN 1 ELSE 0 END) * size AS taken FROM w JOIN g ON g.source IS NOT DISTINCT FROM w.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM w.source""",
    "op6_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS low FROM g) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM h, range(13) r(j)),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op7_embedding_near_dedup": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings), v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id WHERE {_COSINE} >= 0.9), {_REACH}, c AS (SELECT a AS id, count(*) AS n FROM both_ GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM found LEFT JOIN c USING (id)""",
    "op9_quality_rules": f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, sum(c - 1) AS dup, sum(c) AS lines FROM (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id, line) GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + j) AS rep FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1), range(5) q(j) GROUP BY doc_id),
t AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS x FROM w) GROUP BY doc_id, x) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS worded, count_if(ltrim(line, {_BLANK})[1] IN ('-', '*')) AS bullets, count_if(rtrim(line, {_BLANK}) LIKE '%...') AS dots FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n, length(array_to_string(ws, '')) AS chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS sym, CAST(coalesce(dup, 0) AS BIGINT) AS dup, coalesce(lines, 0) AS lines, coalesce(rep, 0) AS rep, len(regexp_extract_all(text, '[0-9]')) AS digits, coalesce(top, 0) AS top, coalesce(worded, 0) AS worded, coalesce(bullets, 0) AS bullets, coalesce(dots, 0) AS dots FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, n AS n_words, chars AS word_chars, sym AS n_symbols, dup AS n_dup_lines, rep AS n_repeat_words, n < 10 OR 100 * rep > 20 * n AS base_failed, NOT (n < 10 OR 100 * rep > 20 * n OR 4 * sym > n OR 2 * dup > lines OR 2 * chars < 3 * n OR chars > 40 * n OR 10 * digits > 3 * chars OR worded >= 5 AND (10 * bullets > 9 * worded OR 10 * dots > 3 * worded) OR n >= 20 AND 10 * top > 4 * n) AS kept FROM m""",
    "op12_fill_in_middle": f"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS us, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(us) AS n, {", ".join(f"('0x' || substring(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))} FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:n], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p),
s AS (SELECT *, string_split_regex(output, '<[PSM]>') AS parts FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN parts[2] || parts[4] || parts[3] ELSE parts[3] || parts[4] || parts[2] END) AS restored_sha256 FROM s""",
    "op13_filter_audit": f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, doc_id, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
g AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS bits, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || letter FROM o, v WHERE NOT contains(filter_order, letter)),
s AS (SELECT filter_order, step::INT AS step, bit, (SELECT coalesce(sum(b.bit), 0)::INT FROM v b WHERE contains(filter_order[1:step - 1], b.letter)) AS gone FROM o, range(1, 6) r(step), v WHERE length(filter_order) = 5 AND letter = filter_order[step:step]),
e AS (SELECT part, bit, gone, sum(CASE WHEN bits & (gone | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN bits & gone = 0 AND bits & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN bits & gone > 0 AND bits & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN bits = bit THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN bits & gone = 0 AND bits & bit > 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN bits & gone = 0 AND bits & bit > 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM g, (SELECT DISTINCT bit, gone FROM s) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM s JOIN e USING (bit, gone)""",
}

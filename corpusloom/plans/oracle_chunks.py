"""DuckDB's SQL for chunking: rows for parts, running sums for packing, recursion from chunk to chunk."""

from __future__ import annotations

MAX, HARD, TINY, LEAD = 308, 393, 50, 38  # words that fit 400 tokens; words of a hard window; tokens of a tiny piece; words of overlap
WINDOW = 307
_W = "len(regexp_extract_all({}, '\\S+'))"
_TOKENS = "({}) * 13 // 10"


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^\\s+', '', 'g'), '\\s+$', '', 'g')"


def windows(words: str, size: int) -> str:
    """A list of texts of size words each."""
    return f"list_transform(range(0, (len({words}) + {size - 1}) // {size}), lambda k: array_to_string(({words})[k * {size} + 1:(k + 1) * {size}], ' '))"


def qa_sections(docs: str) -> str:
    """(doc_id, k, heading, content) of docs (doc_id, text): lines by heading, then by question."""
    lines = f"SELECT doc_id, i, ls[i] AS line, regexp_matches(ls[i], '^#{{1,6}}[ \\t]+[^\\n]') AS head FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {docs}))"
    title = strip("regexp_extract(line, '^#{1,6}[ \\t]+(.*)', 1)")
    under = f"SELECT *, coalesce(max(CASE WHEN head THEN {title} END) OVER (PARTITION BY doc_id, h), '') AS heading FROM (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM ({lines}))"
    asked = "line LIKE '%\U0001f534%'"
    opened = f"SELECT *, sum(CASE WHEN nth > 1 AND {asked} THEN 1 ELSE 0 END) OVER w AS opened, first_value(line) OVER w AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS nth FROM ({under}) WHERE NOT head) WINDOW w AS (PARTITION BY doc_id, h ORDER BY i)"
    grouped = f"SELECT *, CASE WHEN {asked.replace('line', 'top')} THEN opened ELSE greatest(opened, 1) END AS g FROM ({opened})"
    return f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY h, g) - 1 AS k, heading, content FROM (SELECT doc_id, h, g, any_value(heading) AS heading, string_agg(line, chr(10) ORDER BY i) AS content FROM ({grouped}) GROUP BY doc_id, h, g)"


def heading_sections(docs: str) -> str:
    parts = "string_split_regex(text, '(?m)^#{1,6}\\s+.+$')"
    titles = f"list_concat([''], list_transform(regexp_extract_all(text, '(?m)^#{{1,6}}\\s+(.+)$', 1), lambda h: {strip('h')}))"
    return f"SELECT doc_id, i - 1 AS k, hs[i] AS heading, bs[i] AS content FROM (SELECT doc_id, hs, bs, unnest(range(1, len(bs) + 1)) AS i FROM (SELECT doc_id, {titles} AS hs, list_transform({parts}, lambda b: {strip('b')}) AS bs FROM {docs})) WHERE hs[i] <> '' OR bs[i] <> ''"


def paragraphs(sections: str, tag: str = "") -> str:
    """CTEs up to split{tag} (doc_id, k, path, text), the pieces of sections (doc_id, k, heading, content) in the order of path."""
    t = tag
    out = [f"r{t}0 AS MATERIALIZED (SELECT doc_id, k, '' AS path, content AS text, {_TOKENS.format(_W.format('content'))} > 400 AS big FROM {sections} WHERE {strip('content')} <> '')"]
    for n in range(4):
        sentences = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
        parts = f"CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split_regex(text, '\\n\\n+') WHEN contains(text, chr(10)) THEN string_split(text, chr(10)) ELSE {sentences} END"
        by_words = "NOT (contains(text, chr(10)) OR regexp_matches(text, '[.!?]\\s'))"
        out += [
            f"u{t}{n} AS MATERIALIZED (SELECT doc_id, k, path, i, p, {_W.format('p')} AS w FROM (SELECT doc_id, k, path, i, {strip('ps[i]')} AS p FROM (SELECT doc_id, k, path, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, k, path, {parts} AS ps FROM r{t}{n} WHERE big AND NOT ({by_words})))) WHERE p <> '')",
            f"c{t}{n} AS MATERIALIZED (SELECT doc_id, k, path, p, w, row_number() OVER x AS i, sum(w) OVER x AS c FROM u{t}{n} WINDOW x AS (PARTITION BY doc_id, k, path ORDER BY i))",
            f"e{t}{n} AS MATERIALIZED (SELECT a.doc_id, a.k, a.path, a.i, greatest(a.i, coalesce(max(b.i), 0)) AS e FROM c{t}{n} a LEFT JOIN c{t}{n} b ON a.doc_id = b.doc_id AND a.k = b.k AND a.path = b.path AND b.i >= a.i AND b.c - a.c + a.w <= {MAX} GROUP BY a.doc_id, a.k, a.path, a.i)",
            f"o{t}{n}(doc_id, k, path, i, e) AS (SELECT doc_id, k, path, i, e FROM e{t}{n} WHERE i = 1 UNION ALL SELECT e.doc_id, e.k, e.path, e.i, e.e FROM o{t}{n} o JOIN e{t}{n} e ON e.doc_id = o.doc_id AND e.k = o.k AND e.path = o.path AND e.i = o.e + 1)",
            f"r{t}{n + 1} AS MATERIALIZED (SELECT * FROM r{t}{n} WHERE NOT big UNION ALL SELECT o.doc_id, o.k, o.path || lpad(o.i::VARCHAR, 6, '0'), string_agg(c.p, chr(10) || chr(10) ORDER BY c.i), max(c.w) > {MAX} FROM o{t}{n} o JOIN c{t}{n} c ON c.doc_id = o.doc_id AND c.k = o.k AND c.path = o.path AND c.i BETWEEN o.i AND o.e GROUP BY o.doc_id, o.k, o.path, o.i"
            f" UNION ALL SELECT doc_id, k, path || lpad(i::VARCHAR, 6, '0'), ts[i], false FROM (SELECT doc_id, k, path, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, k, path, {windows("regexp_extract_all(text, '\\S+')", WINDOW)} AS ts FROM r{t}{n} WHERE big AND ({by_words}))))",
        ]
    return ", ".join([*out, f"split{t} AS (SELECT doc_id, k, path, text FROM r{t}4)"])


def merge_pass(n: int) -> str:
    """CTEs from items m{n} (doc_id, i, h, c, n) to m{n + 1}: tiny ones join the one before, or wait for the next."""
    item = "STRUCT(h VARCHAR, c VARCHAR, n BIGINT)"
    both = lambda a, b, h: f"{{'h': {h}, 'c': {a}.c || chr(10) || chr(10) || {b}.c, 'n': {a}.n + {b}.n}}::{item}"
    fits = lambda a, b: f"coalesce(({a}.n + {b}.n) * 13 // 10 <= 400, false)"
    put = lambda out, x: f"CASE WHEN {x} IS NULL THEN {out} ELSE list_append({out}, {x}) END"
    joined = both("wait", "item", "CASE WHEN wait.h <> '' THEN wait.h ELSE item.h END")
    tiny = f"x.n * 13 // 10 < {TINY}"
    return f"""f{n}(doc_id, i, o, last, wait) AS (SELECT DISTINCT doc_id, 0::BIGINT, []::{item}[], NULL::{item}, NULL::{item} FROM m{n} UNION ALL
SELECT doc_id, i, CASE WHEN {tiny} THEN o ELSE {put('o', 'last')} END, CASE WHEN {tiny} AND {fits('last', 'x')} THEN {both('last', 'x', 'last.h')} WHEN {tiny} THEN last ELSE x END, CASE WHEN {tiny} AND NOT {fits('last', 'x')} THEN x END FROM (
SELECT doc_id, i, CASE WHEN wait IS NOT NULL AND NOT taken THEN {put('o', 'last')} ELSE o END AS o, CASE WHEN wait IS NOT NULL AND NOT taken THEN wait ELSE last END AS last, CASE WHEN taken THEN {joined} ELSE item END AS x FROM (
SELECT f.doc_id, m.i, f.o, f.last, f.wait, {{'h': m.h, 'c': m.c, 'n': m.n}}::{item} AS item, f.wait IS NOT NULL AND {fits('f.wait', 'm')} AS taken FROM f{n} f JOIN m{n} m ON m.doc_id = f.doc_id AND m.i = f.i + 1))),
m{n + 1} AS MATERIALIZED (SELECT doc_id, j AS i, o[j].h AS h, o[j].c AS c, o[j].n AS n FROM (SELECT doc_id, o, unnest(range(1, len(o) + 1)) AS j FROM (SELECT doc_id, {put('(' + put('o', 'last') + ')', 'wait')} AS o FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS back FROM f{n}) WHERE back = 1)))"""


def overlapped(rows: str) -> str:
    """rows (doc_id, i, h, c) with the last words of the one before."""
    before = "lag(ws) OVER (PARTITION BY doc_id ORDER BY i)"
    return f"SELECT doc_id, i, h, CASE WHEN len(b) > {LEAD} THEN array_to_string(b[len(b) - {LEAD - 1}:], ' ') || chr(10) || chr(10) || c ELSE c END AS c FROM (SELECT *, {before} AS b FROM (SELECT *, regexp_extract_all(c, '\\S+') AS ws FROM {rows}))"


def capped(rows: str) -> str:
    """rows (doc_id, i, h, c) in windows where they are too long, as (doc_id, i, j, h, c)."""
    cut = windows("regexp_extract_all(c, '\\S+')", HARD)
    return f"SELECT doc_id, i, j, CASE WHEN j > 1 AND h <> '' THEN h || ' (cont.)' ELSE h END AS h, cs[j] AS c FROM (SELECT doc_id, i, h, cs, unnest(range(1, len(cs) + 1)) AS j FROM (SELECT doc_id, i, h, CASE WHEN {_TOKENS.format(_W.format('c'))} > 512 THEN {cut} ELSE [c] END AS cs FROM {rows}))"


def chunks(prepared: str) -> str:
    """WITH ... up to chunks, from prepared, the CTE d (doc_id, source_file, raw, cleaned, reason, author, date, content_type)."""
    numbered = f"m0 AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, path) AS i, CASE WHEN nth > 1 AND heading <> '' THEN heading || ' (cont.)' ELSE heading END AS h, {strip('text')} AS c, {_W.format('text')} AS n FROM (SELECT s.*, x.heading, row_number() OVER (PARTITION BY s.doc_id, s.k ORDER BY s.path) AS nth FROM split s JOIN sec x USING (doc_id, k)) WHERE {strip('text')} <> '')"
    return f"""{prepared}, hd AS (SELECT doc_id, cleaned AS text FROM d WHERE reason IS NULL AND content_type <> 'qa'), qd AS (SELECT doc_id, cleaned AS text FROM d WHERE reason IS NULL AND content_type = 'qa'),
sec AS MATERIALIZED ({heading_sections('hd')} UNION ALL {qa_sections('qd')}), {paragraphs('sec')}, {numbered}, {', '.join(merge_pass(n) for n in range(5))}, ov AS MATERIALIZED ({overlapped('m5')}), cap AS MATERIALIZED ({capped('ov')}),
chunks AS MATERIALIZED (SELECT {strip('c')} AS content, source_file, source_file AS page_title, h AS section_heading, place - 1 AS chunk_index, total AS total_chunks, author, date, content_type, length({strip('c')}) AS char_count, {_TOKENS.format(_W.format('c'))} AS estimated_tokens
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS place, count(*) OVER (PARTITION BY doc_id) AS total FROM cap) JOIN d USING (doc_id) WHERE {strip('c')} <> '')"""

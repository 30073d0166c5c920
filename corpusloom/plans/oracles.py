"""DuckDB's SQL for the registered queries."""

from __future__ import annotations

from . import oracle_chunks as cut
from .tables import CHUNK, MARKDOWN, MIXED, PIECES, QUERY, wiki_sql

EMOJI = "\U0001f534\U0001f7e2"


def re(text: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{new}', 'g')"


def strip(text: str) -> str:
    return re(re(text, "^\\s+"), "\\s+$")


def tokens(text: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(lower({text}), '[a-z0-9_]+'), lambda t: CASE WHEN contains(t, '_') THEN list_concat([t], list_filter(string_split(t, '_'), lambda y: y <> '')) ELSE [t] END))"


def n_words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\S+'))"


def clean(text: str) -> str:
    text = re(text, "\\r\\n?", "\\n").replace("'\\n'", "chr(10)")
    text = re(text, "</?sticky>")
    text = re(text, '["\\s]*hideimg(?:right|left)=["\\s]*["}%]*')
    text = re(text, '["\\s]*start="hide\\s*"["\\s}%]*')
    text = re(text, '(?m)^["\\s]*\\}%\\s*$')
    text = re(text, "(?s)<!--.*?-->")
    text = f"regexp_replace({text}, '(?i)<br\\s*/?>', chr(10), 'g')"
    text = re(text, "(?i)</?center>")
    for tag in ("p", "span", "a"):
        text = re(text, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", "\\1")
    text = re(text, "(?i)<img[^>]*/?\\s*>")
    text = re(text, "<[^>]+>")
    for entity, plain in (("&rarr;", "->"), ("&larr;", "<-"), ("&radic;", "sqrt"), ("&mu;", "mu"), ("&ge;", ">="), ("&le;", "<="), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"), ("&nbsp;", " ")):
        text = f"replace({text}, '{entity}', '{plain}')"
    text = re(text, "&#x?[0-9a-fA-F]+;")
    text = re(text, '" role="presentation">[^<]*')
    text = f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(re(text, "(?m)[ \\t\\r\\f\\v]+$"))


def plain(cleaned: str) -> str:
    text = re(cleaned, "(?m)^#+\\s*")
    text = re(text, "[*_`~\\[\\](){}|#>!]")
    text = re(text, "https?://\\S+")
    text = re(text, "[\U0001f534\U0001f7e2\U0001f535ℹ️✅✔❌]")
    return strip(re(text, "\\s+", " "))


def full_lines(text: str) -> str:
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"


def kind(cleaned: str, plain_: str) -> str:
    lines = full_lines(cleaned)
    n = f"len({lines})"
    share = lambda hit: f"len(list_filter({lines}, lambda l: {hit})) / {n}"
    linked, barred = share("regexp_matches(l, 'https?://\\S+')"), share("starts_with(l, '|')")
    return f"CASE WHEN len(regexp_extract_all({cleaned}, '[{EMOJI}]')) >= 4 THEN 'qa' WHEN {n} > 10 AND {linked} > 0.5 THEN 'meeting_log' WHEN {n} > 0 AND {barred} > 0.6 THEN 'table' WHEN length({plain_}) < 200 THEN 'minimal' ELSE 'technical' END"


def reason(raw: str, plain_: str) -> str:
    lines = full_lines(raw)
    rest = strip(re(strip(re("l", "https?://\\S+")), "[*_`\\[\\]()#>!\\-|]"))
    linked = f"len(list_filter({lines}, lambda l: regexp_matches(l, 'https?://\\S+') AND length({rest}) < 30))"
    return f"CASE WHEN length({plain_}) < 50 THEN 'insufficient_content (' || length({plain_}) || ' chars)' WHEN len({lines}) > 10 AND {linked} / len({lines}) > 0.7 THEN 'mostly_links (' || CAST(round_even({linked} * 100 / len({lines}), 0) AS INTEGER) || '% link-only lines)' END"


PREPARED = f"p AS (SELECT doc_id, text AS raw, {clean('text')} AS cleaned FROM (SELECT doc_id, {{sql}} AS text FROM documents)), d AS (SELECT doc_id, raw, cleaned, {plain('cleaned')} AS plain FROM p)"
MIXED_DOCS = "WITH " + PREPARED.replace("{sql}", MIXED)
SIZES = f"SELECT {n_words('text')} * 13 // 10 AS t FROM documents"
CHUNKS = "c AS (SELECT " + ", ".join(CHUNK) + " FROM documents)"
#: The stand-in for an embedding model: of each token's hash the lowest bit is a sign, the next six a place.
def embedded(text: str) -> str:
    hashes = f"list_transform({tokens(text)}, lambda t: ('0x' || substring(md5(t), 1, 8))::BIGINT)"
    raw = f"list_transform(range(0, 64), lambda i: coalesce(list_sum(list_transform(list_filter({hashes}, lambda h: (h >> 1) % 64 = i), lambda h: CASE WHEN h % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)), 0.0::DOUBLE))"
    return f"list_transform({raw}, lambda x: x / greatest(sqrt(list_dot_product({raw}, {raw})), 1e-12::DOUBLE))"


PREFIX = "'Represent this sentence for searching relevant passages: '"
QUESTIONS = "q AS (SELECT q.query_id, q.query, e.embedding FROM (SELECT " + ", ".join(QUERY) + " FROM benchmark) q JOIN embeddings e ON e.vec_id = q.query_id)"
POSTINGS = f"t AS (SELECT id, seq, {tokens('content')} AS t FROM c), p AS (SELECT id, seq, term, len, count(*) AS tf FROM (SELECT id, seq, len(t) AS len, unnest(t) AS term FROM t) GROUP BY ALL)"
WEIGHTS = "s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t), w AS (SELECT term, count(*) AS df FROM p GROUP BY term), r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM w, s), i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r)"
LEXICAL = f"a AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM q) GROUP BY ALL), h AS (SELECT query_id, id, seq, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 10) AS score FROM a JOIN p USING (term) JOIN i USING (term), s GROUP BY query_id, id, seq), lexical AS (SELECT * FROM (SELECT query_id, id, seq, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) - 1 AS rank FROM h) WHERE rank < 30 AND score > 0)"
_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def dense(name: str, where: str = "true") -> str:
    d = lambda a, b: _DOT.format(a=a, b=b)
    cosine = f"{d('v.embedding', 'q.embedding')} / sqrt({d('v.embedding', 'v.embedding')} * {d('q.embedding', 'q.embedding')})"
    return f"{name} AS (SELECT * FROM (SELECT query_id, 'chunk_' || vec_id AS id, vec_id AS seq, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM (SELECT q.query_id, v.vec_id, round({cosine}, 10) AS score FROM embeddings v, q WHERE {where})) WHERE rank < 30)"


FUSED = "u AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank + 1) AS part, 0 AS list, rank FROM dense UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank + 1), 1, rank FROM lexical), f AS (SELECT query_id, id, round(sum(part), 10) AS score, min(list * 1000 + rank) AS first FROM u GROUP BY query_id, id), fused AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) - 1 AS rank FROM f) WHERE rank < 40)"
_Q, _D = f"list_distinct({tokens('query')})", tokens("content")
RERANKED = f"g AS (SELECT query_id, id, rank AS was, len(list_intersect(qt, dt)) AS shared, len(qt) AS nq, len(dt) AS nd FROM (SELECT fused.query_id, fused.id, fused.rank, {_Q} AS qt, {_D} AS dt FROM fused JOIN c USING (id) JOIN q USING (query_id))), ranked AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) - 1 AS rank FROM (SELECT query_id, id, was, shared / greatest(nq, 1) + shared / (nd + 1000.0::DOUBLE) AS score FROM g)) WHERE rank < 6)"
EXPANDED = """m AS (SELECT r.query_id, r.rank, n.id, n.seq - o.seq AS side, n.content FROM ranked r JOIN c o USING (id) JOIN c n ON abs(n.seq - o.seq) = 1 AND n.source_file = o.source_file AND abs(n.chunk_index - o.chunk_index) = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY rank, side) AS nth FROM m) WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM ranked b WHERE b.query_id = query_id AND false)),
l AS (SELECT k.query_id, k.rank, k.side, k.content FROM k LEFT JOIN ranked b ON b.query_id = k.query_id AND b.id = k.id AND b.rank < k.rank WHERE b.id IS NULL),
x AS (SELECT query_id, rank, list(content ORDER BY side) AS parts FROM l GROUP BY query_id, rank),
hits AS (SELECT r.query_id, r.rank, r.id, r.score, CASE len(x.parts) WHEN 2 THEN x.parts[1] || chr(10) || c.content || chr(10) || x.parts[2] WHEN 1 THEN x.parts[1] || chr(10) || c.content ELSE c.content END AS text, c.page_title, c.section_heading, c.source_file, c.date, c.author FROM ranked r JOIN c USING (id) LEFT JOIN x ON x.query_id = r.query_id AND x.rank = r.rank)""".replace(" AND NOT EXISTS (SELECT 1 FROM ranked b WHERE b.query_id = query_id AND false)", "")
CONTEXTS = "b AS (SELECT *, '[' || (rank + 1) || '] ' || page_title || CASE WHEN section_heading <> '' THEN ' - ' || section_heading ELSE '' END || CASE WHEN date <> '' THEN ' (last modified ' || date || ')' ELSE '' END || chr(10) || text AS block FROM hits), y AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM b), contexts AS (SELECT query_id, coalesce(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) FILTER (used <= 14000), '') AS context, count(*) FILTER (used <= 14000) AS n_sources FROM y GROUP BY query_id)"
BASE = f"WITH {CHUNKS}, {QUESTIONS}, {POSTINGS}, {WEIGHTS}, {LEXICAL}, {dense('dense')}, {FUSED}"
FULL = f"{BASE}, {RERANKED}, {EXPANDED}, {CONTEXTS}"
#: What phases make of a document's own text and of the faults behind it; elsewhere both stay as they are.
_PLAIN, _BOLD = ("replace(coalesce(text, ''), ' the ', ' " + mark + "the" + mark + " ')" for mark in ("*", "**"))
_LEFT = "CASE WHEN doc_id % 7 = 0 THEN '<nop' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN ' {}' ELSE '' END || chr(10)"
_BODIES = {"inline": {"body": _BOLD}, "wikiwords": {"faults": _LEFT.format("%AB% ")}, "cleanup": {"body": re(_PLAIN, "(?m)[ \\t]+$"), "faults": _LEFT.format("%!AB%")}, "full": {"body": re(_BOLD, "(?m)[ \\t]+$"), "faults": _LEFT.format("%AB%")}}


def phase(name: str, out: str = "text") -> str:
    text = wiki_sql(name, **_BODIES.get(name, {}))
    if name in ("cleanup", "full"):
        text = re(f"({text})", "\\n+$") + " || chr(10)"
    return f"SELECT doc_id, {text} AS {out} FROM documents"


STATUS = "WITH st AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Error' WHEN doc_id % 11 = 0 THEN 'Warning' ELSE 'Success' END AS status FROM documents)"
#: The rules that every wiki text needs; tables would need separators without spaces.
_RULES = ("META stripped", "Headings converted", "Verbatim → code blocks", "Links converted", "Bullet lists converted", "Numbered lists converted", "Colors stripped", "Variables processed", "Bold converted", "Italic converted", "Code spans converted", "BR tags normalized", "Nop tags stripped", "Noautolink stripped", "Signatures converted", "WikiWord escapes stripped")
RULES = "SELECT rule, n, 100.0::DOUBLE AS percent FROM (SELECT unnest([" + ", ".join(f"'{r}'" for r in _RULES) + "]) AS rule), (SELECT count(*) AS n FROM documents)"
SUMMARY = STATUS + ", n AS (SELECT count(*) AS total, count(*) FILTER (status = 'Success') AS success, count(*) FILTER (status = 'Warning') AS warning, count(*) FILTER (status = 'Error') AS error, 0::BIGINT AS exception FROM st) SELECT *, round(success * 100 / total, 1) AS success_rate FROM n"
_HEADINGS = "string_split_regex(text, '(?m)^#{1,6}\\s+.+$')"
SECTIONS = f"WITH m AS (SELECT doc_id, {MARKDOWN} AS text FROM documents), z AS (SELECT doc_id, list_concat([''], list_transform(regexp_extract_all(text, '(?m)^#{{1,6}}\\s+(.+)$', 1), lambda h: {strip('h')})) AS hs, list_transform({_HEADINGS}, lambda b: {strip('b')}) AS bs FROM m), e AS (SELECT doc_id, unnest(range(1, len(bs) + 1)) AS i, hs, bs FROM z) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, hs[i] AS heading, bs[i] AS content FROM e WHERE hs[i] <> '' OR bs[i] <> ''"
_SIGNATURE = "(?m)^(?:—|--)\\s*([A-Za-z][A-Za-z0-9_ ]*?)(?:\\s*[-,]\\s*(.+?))?\\s*$"
_READY = f"SELECT doc_id, source_file, raw, checked, cleaned, {plain('checked')} AS plain, {plain('cleaned')} AS cleaned_plain FROM (SELECT doc_id, source_file, raw, {clean('raw')} AS checked, {clean(re('raw', _SIGNATURE))} AS cleaned FROM (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS source_file, {MARKDOWN} AS raw FROM documents))"
READY = f"WITH RECURSIVE ready AS MATERIALIZED ({_READY}), d AS MATERIALIZED (SELECT doc_id, source_file, raw, checked, cleaned, strlen(raw) AS size, {reason('raw', 'plain')} AS reason, 'Writer ' || doc_id AS author, '2015-02-08' AS date, {kind('cleaned', 'cleaned_plain')} AS content_type FROM ready)"
CHUNKED = cut.chunks(READY)
_HEADED, _TAGS = "regexp_matches(checked, '(?m)^#{1,6}\\s+')", "len(regexp_extract_all(checked, '<[a-zA-Z][^>]*>'))"
_SAID = "'Chunk ' || (chunk_index + 1) || '/' || total_chunks || ' has '"
ISSUES = f"{CHUNKED} SELECT source_file, 'no_headings' AS issue_type, 'File has no markdown headings; chunked by paragraph/fallback' AS details FROM d WHERE reason IS NULL AND NOT {_HEADED} UNION ALL SELECT source_file, 'residual_html', {_TAGS} || ' HTML tags remain after cleaning' FROM d WHERE reason IS NULL AND {_TAGS} > 0 UNION ALL SELECT source_file, 'tiny_chunk', {_SAID} || 'only ~' || estimated_tokens || ' tokens' FROM chunks WHERE estimated_tokens < 10 UNION ALL SELECT source_file, 'large_chunk', {_SAID} || '~' || estimated_tokens || ' tokens (close to 512 limit)' FROM chunks WHERE estimated_tokens > 450"
COUNTS = f"{CHUNKED} SELECT count(*) AS n_files, count_if(reason IS NOT NULL)::BIGINT AS n_filtered, count_if(reason IS NULL)::BIGINT AS n_chunked, count_if(reason IS NULL AND NOT {_HEADED})::BIGINT AS n_no_headings, count_if(reason IS NULL AND {_TAGS} > 0)::BIGINT AS n_with_html, count_if(reason IS NULL AND content_type = 'qa')::BIGINT AS n_qa, (SELECT count(*) FROM chunks) AS n_chunks FROM d"
WHOLE = "whole AS (SELECT doc_id, 0 AS k, source AS heading, text AS content FROM documents)"
LINES = "lines AS (SELECT doc_id, i, '' AS h, ls[i] AS c FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"
CONVERSATIONS = "k AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts, count(*) AS n FROM conversations GROUP BY conv_id)"
_CUT = "CASE WHEN length(texts[i]) > 300 THEN substring(texts[i], 1, 300) || '...' ELSE texts[i] END"
CONTEXTUAL = f"WITH {CONVERSATIONS} SELECT conv_id, '[Previous conversation]' || chr(10) || array_to_string(list_transform(range(greatest(n - 5, 1), n + 1), lambda i: CASE WHEN roles[i] = 'user' THEN 'User: ' ELSE 'Assistant: ' END || {_CUT}), chr(10)) || chr(10) || chr(10) || '[Current question]' || chr(10) || 'what now' AS query FROM k"
TITLES = f"WITH {CONVERSATIONS} SELECT conv_id, coalesce(substring(texts[list_position(roles, 'user')], 1, 50), 'Untitled') AS title, n AS message_count FROM k"
TALKED = f"{CONVERSATIONS}, asked AS (SELECT b.item_id AS query_id, CASE WHEN n IS NULL THEN b.text ELSE '[Previous conversation]' || chr(10) || array_to_string(list_transform(range(greatest(n - 5, 1), n + 1), lambda i: CASE WHEN roles[i] = 'user' THEN 'User: ' ELSE 'Assistant: ' END || {_CUT}), chr(10)) || chr(10) || chr(10) || '[Current question]' || chr(10) || b.text END AS query FROM benchmark b LEFT JOIN k ON k.conv_id = b.item_id), q AS MATERIALIZED (SELECT query_id, query, {embedded(PREFIX + ' || query')} AS embedding FROM asked)"
HISTORY = f"WITH {CHUNKS}, {TALKED}, {POSTINGS}, {WEIGHTS}, {LEXICAL}, {dense('dense')}, {FUSED}, {RERANKED} SELECT query_id, rank, id, round(score, 8) AS score FROM ranked"
_AGO = "turn * turn * 700"
LOG = "log AS (SELECT event_id AS seq, user_id AS conversation_id, event_type AS title, value FROM events)"
RATED = "rated AS (SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' ELSE '' END AS rating FROM events)"
BUCKETS = "CASE WHEN t < 50 THEN '0-50' WHEN t < 100 THEN '50-100' WHEN t < 200 THEN '100-200' WHEN t < 300 THEN '200-300' WHEN t < 400 THEN '300-400' WHEN t < 512 THEN '400-512' ELSE '512+' END"
_LAST = "SELECT conversation_id, arg_max(title, seq) AS title, max(seq) AS seq, arg_max(value, seq) AS value FROM log GROUP BY conversation_id"

ORACLES = {
    "tok_estimate": f"SELECT doc_id, length(text) AS n_chars, {n_words('text')} AS n_words, {n_words('text')} * 13 // 10 AS est_tokens FROM documents",
    "tok_lexical": f"SELECT term, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS term FROM documents) GROUP BY term",
    "clean_pages": f"SELECT page_id, {clean('html')} AS cleaned FROM pages",
    "text_content": f"{MIXED_DOCS} SELECT doc_id, plain, length(plain) AS n_chars FROM d",
    "filter_docs": f"{MIXED_DOCS} SELECT doc_id, {reason('raw', 'plain')} AS reason FROM d",
    "filter_reasons": f"{MIXED_DOCS}, r AS (SELECT {reason('raw', 'plain')} AS reason FROM d) SELECT trim(split_part(reason, '(', 1)) AS category, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1",
    "content_type": f"{MIXED_DOCS} SELECT {kind('cleaned', 'plain')} AS content_type, count(*) AS n FROM d GROUP BY 1",
    "split_headings": SECTIONS,
    "chunk_documents": f"{CHUNKED} SELECT * FROM chunks",
    "chunk_ids": f"{CHUNKED} SELECT 'chunk_' || (row_number() OVER o - 1) AS id, row_number() OVER o - 1 AS seq, source_file, chunk_index FROM chunks WINDOW o AS (ORDER BY source_file, chunk_index)",
    "chunk_issues": ISSUES,
    "file_summary": f"{CHUNKED} SELECT source_file, size, author, date, content_type, num_chunks FROM d JOIN (SELECT source_file, count(*) AS num_chunks FROM chunks GROUP BY source_file) USING (source_file) WHERE reason IS NULL",
    "corpus_counts": COUNTS,
    "chunk_sizes": f"{CHUNKED} SELECT source_file, count(*) AS n, min(estimated_tokens) AS least, max(estimated_tokens) AS most FROM chunks GROUP BY source_file",
    "split_qa": f"WITH x AS (SELECT doc_id, {MIXED} AS text FROM documents) SELECT doc_id, k AS pos, heading, content FROM ({cut.qa_sections('x')})",
    "split_paragraphs": f"WITH RECURSIVE {WHOLE}, {cut.paragraphs('whole')} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS pos, text AS content FROM split",
    "split_overlap": f"WITH {LINES}, o AS ({cut.overlapped('lines')}) SELECT doc_id, i - 1 AS pos, c AS content FROM o",
    "split_hard_cap": f"WITH whole AS (SELECT doc_id, 1 AS i, source AS h, text AS c FROM documents), o AS ({cut.capped('whole')}) SELECT doc_id, j - 1 AS pos, h AS heading, c AS content FROM o",
    "size_stats": f"WITH z AS ({SIZES}) SELECT count(*) AS n, min(t) AS min_tokens, list_sort(list(t))[count(*) // 2 + 1] AS median_tokens, avg(t) AS mean_tokens, max(t) AS max_tokens, count(*) FILTER (t > 512) AS over_limit FROM z",
    "size_histogram": f"WITH z AS ({SIZES}) SELECT b AS bucket, count(t) AS n FROM (SELECT unnest(['0-50', '50-100', '100-200', '200-300', '300-400', '400-512', '512+']) AS b) LEFT JOIN z ON {BUCKETS} = b GROUP BY b",
    "largest_doc": "SELECT source AS source_file, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 1",
    "signature": f"SELECT doc_id, 'Writer ' || doc_id AS author, '2015-02-08' AS date, {re(MARKDOWN, _SIGNATURE)} AS rest FROM documents",
    **{f"convert_{name}": phase(name) for name in sorted({k for _, by, _ in PIECES for k in by})},
    "convert_full": phase("full", "markdown"),
    "applied_rules": RULES,
    "conversion_summary": SUMMARY,
    "conversion_observed": SUMMARY,
    "failed_documents": STATUS + " SELECT doc_id, status FROM st WHERE status <> 'Success'",
    "conversion_sheet": STATUS + f", i AS (SELECT doc_id, strlen({wiki_sql()}) AS n FROM documents), o AS ({phase('full', 'markdown')}) SELECT doc_id, status, round_even(i.n / 1024, 1) AS input_kb, round_even(strlen(markdown) / 1024, 1) AS output_kb FROM st JOIN i USING (doc_id) JOIN o USING (doc_id)",
    "largest_file": f"{CHUNKED} SELECT source_file, count(*) AS n FROM chunks GROUP BY source_file ORDER BY n DESC, source_file LIMIT 1",
    "chunk_previews": f"{CHUNKED} SELECT source_file, chunk_index, regexp_replace(replace(substring(content, 1, 200), chr(10), ' '), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', '', 'g') AS preview FROM chunks",
    "service_health": "SELECT count(*) AS chunks, false AS llm_reachable FROM documents",
    "page_files": f"SELECT 'web' || CAST(doc_id % 7 AS VARCHAR) AS folder, 'page' || CAST(doc_id AS VARCHAR) AS stem, markdown FROM ({phase('full', 'markdown')})",
    "conv_streamed": f"WITH {LOG} " + _LAST.replace("FROM log", "FROM log WHERE conversation_id % 5 <> 0"),
    "validate_status": f"{STATUS} SELECT doc_id, status FROM st",
    "status_counts": f"{STATUS} SELECT status, count(*) AS n FROM st GROUP BY status",
    "bm25_stats": f"WITH {CHUNKS}, {POSTINGS}, {WEIGHTS} SELECT term, df, round(idf, 6) AS idf FROM i",
    "bm25_topk": f"{BASE} SELECT query_id, id, rank, round(score, 5) AS score FROM lexical",
    "bm25_blocks": f"{BASE} SELECT query_id, id, rank, round(score, 5) AS score FROM lexical",
    "dense_topk": f"WITH {QUESTIONS}, {dense('dense')} SELECT query_id, id, rank, round(score, 5) AS score FROM dense",
    "dense_filtered": f"WITH {QUESTIONS}, {dense('dense', 'v.label = 3')} SELECT query_id, id, rank, round(score, 5) AS score FROM dense",
    "rrf": f"{BASE} SELECT query_id, id, rank, round(score, 8) AS score FROM fused",
    "rerank_topk": f"{FULL} SELECT query_id, id, rank, round(score, 8) AS score FROM ranked",
    "neighbours": f"{FULL} SELECT query_id, rank, side, id FROM m",
    "neighbours_table": f"{FULL} SELECT query_id, rank, side, id FROM m",
    "hybrid_search": f"{FULL} SELECT query_id, rank, id, round(score, 8) AS score, text, page_title, section_heading, source_file, date, author FROM hits",
    "hybrid_indexed": f"{FULL} SELECT query_id, rank, id, round(score, 8) AS score, text, page_title, section_heading, source_file, date, author FROM hits",
    "context": f"{FULL} SELECT query_id, context, n_sources FROM contexts",
    "prompt": f"{FULL} SELECT query_id, 'Sources:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query AS prompt FROM contexts JOIN q USING (query_id)",
    "bm25_large": f"{BASE} SELECT query_id, id, rank, round(score, 5) AS score FROM lexical",
    "dense_large": f"WITH {QUESTIONS}, {dense('dense')} SELECT query_id, id, rank, round(score, 5) AS score FROM dense",
    "ann_all_cells": f"WITH {QUESTIONS}, {dense('dense')} SELECT query_id, id, rank, round(score, 5) AS score FROM dense",
    "ann_filtered": f"WITH {QUESTIONS}, {dense('dense', 'v.label = 3')} SELECT query_id, id, rank, round(score, 5) AS score FROM dense",
    "hash_embedding": f"SELECT item_id, {embedded(PREFIX + ' || text')} AS embedding FROM benchmark",
    "search_with_history": HISTORY,
    "last_messages": f"SELECT conv_id, turn, CASE WHEN {_AGO} < 60 THEN 'Just now' WHEN {_AGO} // 60 < 60 THEN {_AGO} // 60 || ' min ago' WHEN {_AGO} // 3600 < 24 THEN {_AGO} // 3600 || 'h ago' ELSE strftime(make_timestamp((1700000000 - {_AGO}) * 1000000), '%Y-%m-%d') END AS shown FROM conversations",
    "conv_order": "SELECT conversation_id, row_number() OVER (ORDER BY updated_at DESC, conversation_id) AS place FROM (SELECT user_id AS conversation_id, max(ts) AS updated_at FROM events GROUP BY user_id)",
    "contextual_query": CONTEXTUAL,
    "conv_title": TITLES,
    "conv_latest": f"WITH {LOG} {_LAST}",
    "conv_first": f"WITH {LOG} SELECT conversation_id, arg_min(title, seq) AS title, min(seq) AS seq, arg_min(value, seq) AS value FROM log GROUP BY conversation_id",
    "conv_upsert": f"WITH {LOG}, base AS (SELECT * FROM log WHERE seq % 2 = 0), ch AS (SELECT * FROM log WHERE seq % 2 = 1), last AS (SELECT conversation_id, arg_max(title, seq) AS title, max(seq) AS seq, arg_max(value, seq) AS value FROM ch GROUP BY conversation_id) SELECT b.seq, b.conversation_id, b.title, b.value FROM base b ANTI JOIN last USING (conversation_id) UNION ALL SELECT l.seq, l.conversation_id, l.title, l.value FROM base b JOIN last l USING (conversation_id) UNION ALL SELECT l.seq, l.conversation_id, l.title, l.value FROM last l ANTI JOIN base USING (conversation_id)",
    "conv_delete": f"WITH {LOG} SELECT * FROM log WHERE conversation_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 3 = 0)",
    "feedback_stats": f"WITH {RATED}, a AS (SELECT count(*) AS total, count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down FROM rated) SELECT total, up, down, CAST(floor(up * 100 / total + 0.5) AS BIGINT) AS up_percent FROM a",
    "feedback_recent": f"WITH {RATED} SELECT * FROM rated ORDER BY seq DESC LIMIT 20",
    "length_batches": f"WITH {CHUNKS} SELECT id, (row_number() OVER (ORDER BY length(content) DESC, id) - 1) // 64 AS batch FROM c",
    "embed_resume": "SELECT 'chunk_' || doc_id AS id, length(coalesce(text, '')) AS n_chars, doc_id % 4 AS chunk_index FROM documents",
    "vector_upserts": "SELECT CAST(doc_id - doc_id % 4 AS VARCHAR) || '#' || CAST(doc_id % 4 AS VARCHAR) AS id, max(v) AS version, 2 + length(coalesce(any_value(text), '')) AS n_chars, any_value(doc_id) % 4 AS chunk_index FROM (SELECT doc_id, text, unnest([1, 3, 2]) AS v, unnest([doc_id % 3 = 0, doc_id % 3 <> 1, doc_id % 2 = 0]) AS named FROM documents) WHERE named GROUP BY doc_id",
}

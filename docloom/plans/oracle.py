"""DuckDB SQL for the rows of docloom.plans.queries."""

from __future__ import annotations


def _cell(x: str) -> str:
    x = f"coalesce(CAST({x} AS VARCHAR), '')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\\", "\\\\"), ("|", "\\|"), ("`", "\\`"), ("*", "\\*"), ("_", "\\_"), ("[", "\\["), ("]", "\\]")):
        x = f"replace({x}, '{a}', '{b}')"
    return rf"regexp_replace({x}, '\r\n|\r|\n', '<br>', 'g')"


def _fence(x: str, language: str) -> str:
    fence = f"repeat('`', CAST(greatest(3, coalesce(list_max(list_transform(regexp_extract_all({x}, '`+'), lambda r: length(r) + 1)), 3)) AS BIGINT))"
    return f"{fence} || '{language}' || chr(10) || {x} || chr(10) || {fence} || chr(10)"


def _heading(x: str) -> str:
    return f"replace({_cell(x)}, '<br>', ' ')"


_SPACE = r"[\x{9}-\x{D} \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_VISIBLE = f"regexp_replace(text, '{_SPACE}', '', 'g')"
_LETTERS = rf"len(regexp_extract_all({_VISIBLE}, '[\p{{L}}\p{{N}}]'))"
_USABLE = rf"({_LETTERS} >= 3 AND {_LETTERS} / greatest(length({_VISIBLE}) + len(regexp_extract_all({_VISIBLE}, '[\x{{10000}}-\x{{10FFFF}}]')), 1) >= 0.5 AND NOT contains(text, chr(65533)))"


def _name(x: str) -> str:
    base = rf"""left(regexp_replace(regexp_replace(regexp_replace({x}, '\.[^.]+$', ''), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '[ .]+$', ''), 100)"""
    base = f"CASE WHEN {base} = '' THEN 'document' ELSE {base} END"
    return rf"CASE WHEN regexp_full_match({base}, '(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])') THEN '_' ELSE '' END || {base} || '.md'"


_SEGMENT = r"regexp_extract(regexp_replace(url, '[?#].*', ''), '([^/]*)$', 1)"
_EXTENSION = f"CASE lower(regexp_extract({_SEGMENT}, '([^.]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{f}'" for e, f in (("html", "html"), ("htm", "html"), ("xlsx", "xlsx"), ("xls", "xls"), ("csv", "csv"), ("json", "json"), ("xml", "xml"), ("docx", "docx"), ("epub", "epub"), ("zip", "zip"), ("pdf", "pdf"), ("pptx", "pptx"), ("jpg", "image"), ("jpeg", "image"), ("png", "image"))) + " END"


def _unsafe(x: str) -> str:
    return rf"({x} = '' OR regexp_matches({x}, '(?i)\\|[\x00-\x1f]|^/|^[a-z]:|(^|/)\.\.(/|$)'))"


_FORMATS = "['html','xlsx','xls','csv','json','xml','docx','epub','zip','pdf','pptx','image','exif'][CAST(doc_id % 13 AS INT) + 1]"
_NEED = f"(CASE WHEN {_FORMATS} IN ('pdf','image','zip') THEN 320 WHEN {_FORMATS} IN ('xlsx','xls','docx','epub','pptx') THEN 96 ELSE 20 END * 1048576 + 8 * strlen(text))"
_NORM = r"trim(regexp_replace({x}, '[\x09-\x0D ]+', ' ', 'g'))"


def _row(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(_cell(c) for c in cells) + " || ' |'"


def _document(part: str, separator: str, before: str, fmt: str) -> str:
    """One document from a Markdown part of each region; part may use r_name, k (its number) and names, lines and rows (of its nations)."""
    return f"""WITH n AS (SELECT r_regionkey, r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i FROM region JOIN nation ON r_regionkey = n_regionkey),
        p AS (SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_regionkey) AS k, string_agg({_row('i', 'n_name')}, chr(10) ORDER BY i) AS rows,
              string_agg({_cell('n_name')}, chr(10) || chr(10) ORDER BY i) AS paragraphs, string_agg({_cell('n_name')}, chr(10) ORDER BY i) AS lines, string_agg('- ' || {_cell('n_name')}, chr(10) || chr(10) ORDER BY i) AS bullets FROM n GROUP BY 1, 2)
        SELECT 'nations.{fmt}' AS name, '{fmt}' AS format, 'done' AS state, {before} || string_agg({part}, {separator} ORDER BY k) AS markdown FROM p"""


_NL = "chr(10)"
_NUMBERED = "'| No | Name |' || chr(10) || '| --- | --- |' || chr(10) || rows || chr(10)"

ORACLE: dict[str, str] = {
    "docx_region_nation": _document(f"'# ' || r_name || {_NL} || {_NL} || {_NUMBERED}", _NL, "''", "docx"),
    "xlsx_region_nation": _document(f"'## ' || r_name || {_NL} || {_NL} || {_NUMBERED}", _NL, "''", "xlsx"),
    "pptx_region_nation": _document(f"'## Slide ' || k || {_NL} || {_NL} || '### ' || r_name || {_NL} || {_NL} || bullets || {_NL}", _NL, "''", "pptx"),
    "epub_region_nation": _document(f"'## Chapter ' || k || {_NL} || {_NL} || '# ' || r_name || {_NL} || {_NL} || paragraphs || {_NL}", _NL, f"'# Names' || {_NL} || {_NL}", "epub"),
    "pdf_region_nation": _document(f"'## Page ' || k || {_NL} || {_NL} || r_name || {_NL} || lines || {_NL}", _NL, "''", "pdf"),
    "exif_supplier": f"SELECT s_suppkey, 'done' AS state, '# Image metadata' || chr(10) || chr(10) || '| Group | Tag | Value |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| 0th | Make | ' || {_cell('s_name')} || ' |' || chr(10) AS markdown FROM supplier",
    "image_without_models": "SELECT 'image' AS format, 'error' AS state, 'MODEL_UNAVAILABLE' AS code, count(*) AS n FROM supplier",
    "md_cell_documents": f"SELECT doc_id, {_cell('text')} AS cell FROM documents",
    "md_heading_documents": f"SELECT doc_id, {_heading('text')} AS heading, replace({_cell('text')}, '<br>', chr(10)) AS body FROM documents",
    "md_fence_documents": f"SELECT doc_id, {_fence('text', 'xml')} AS block FROM documents",
    "sql_functions_documents": f"SELECT doc_id, {_cell('text')} AS cell, {_fence('text', 'text')} AS block, {_USABLE} AS usable FROM documents",
    "usable_text_documents": f"SELECT doc_id, {_USABLE} AS usable FROM documents",
    "output_name_pages": f"SELECT page_id, {_name('url')} AS whole_name, {_name(_SEGMENT)} AS file_name FROM pages",
    "detect_format_pages": f"SELECT page_id, {_SEGMENT} AS name, {_EXTENSION} AS by_name, coalesce({_EXTENSION}, CASE WHEN NOT contains({_SEGMENT}, '.') THEN 'html' END) AS with_mime FROM pages",
    "safe_path_pages": f"SELECT page_id, {_unsafe('url')} AS url_unsafe, {_unsafe('p')} AS path_unsafe, {_unsafe(chr(39) + '../' + chr(39) + ' || p')} AS up_unsafe FROM (SELECT *, regexp_replace(url, '^https?://', '') AS p FROM pages)",
    "has_entities_pages": rf"SELECT page_id, regexp_matches(html, '(?i)<!{_SPACE}*(?:DOCTYPE|ENTITY)\b') AS refused FROM pages",
    "decode_text_documents": "SELECT doc_id, text, true AS malformed FROM documents",
    "file_signature_documents": "SELECT doc_id, ['zip','ole','jpeg','png',NULL][CAST(doc_id % 5 AS INT) + 1] AS kind FROM documents",
    "sha_documents": "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents",
    "estimate_memory_documents": f"SELECT doc_id, {_FORMATS} AS format, CAST({_NEED} AS BIGINT) AS bytes, {_NEED} > 1073741824 AS over_budget FROM documents",
    "render_scale_part": "SELECT p_partkey, round(CASE WHEN w > 0 AND h > 0 AND greatest(w, h) <= 14400 THEN least(2.0, 2400 / greatest(w, h), sqrt(4e6 / (w * h))) END, 9) AS scale FROM (SELECT p_partkey, p_retailprice * 2 AS w, CAST(p_size * 60 AS DOUBLE) AS h FROM part)",
    "image_size_part": "WITH s AS (SELECT p_partkey, CAST(floor(p_retailprice * 4) AS BIGINT) AS w, CAST(p_size AS BIGINT) * 180 AS h FROM part), t AS (SELECT *, least(1.0, 2400.0::DOUBLE / greatest(w, h), sqrt(4e6 / (w * h))) AS f FROM s) SELECT p_partkey, CASE WHEN w < 1 OR h < 1 THEN 'INVALID_IMAGE' WHEN greatest(w, h) > 8192 OR w * h > 16000000 THEN 'IMAGE_LIMIT' ELSE 'ok' END AS verdict, CAST(greatest(1, floor(w * f)) AS BIGINT) AS width, CAST(greatest(1, floor(h * f)) AS BIGINT) AS height FROM t",
    "cer_conversations": rf"WITH t AS (SELECT conv_id, turn, {_NORM.format(x='plain')} AS plain, lag({_NORM.format(x='plain')}) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT *, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS plain FROM conversations)) SELECT conv_id, turn, round(levenshtein(before, plain) / length(before), 9) AS rate FROM t WHERE before IS NOT NULL",
    "json_pretty_events": "SELECT event_id, '```json' || chr(10) || '{' || chr(10) || '  \"k\": ' || (props->>'k') || chr(10) || '}' || chr(10) || '```' || chr(10) AS markdown FROM events",
    "md_table_nation": f"SELECT '| n\\_nationkey | n\\_name | n\\_regionkey |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg({_row('n_nationkey', 'n_name', 'n_regionkey')}, chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM nation",
    "md_table_region_nation": f"SELECT r_name, count(*) + 1 AS n_rows, '| Key | Name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg({_row('n_nationkey', 'n_name')}, chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name",
    "ragged_rows_conversations": f"""WITH l AS (SELECT conv_id, turn, list_transform(string_split(text, chr(10)), lambda x: string_split(x, ',')) AS rows FROM conversations),
        w AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS width FROM l),
        b AS (SELECT *, list_transform(rows, lambda r: '| ' || array_to_string(list_transform(range(1, width + 1), lambda i: {_cell('r[i]')}), ' | ') || ' |') AS lines FROM w)
        SELECT conv_id, turn, width, len(list_distinct(list_transform(rows, lambda r: len(r)))) > 1 AS ragged,
        array_to_string(lines[1:1] || ['| ' || array_to_string(list_transform(range(width), lambda i: '---'), ' | ') || ' |'] || lines[2:], chr(10)) || chr(10) AS markdown FROM b""",
    "md_sections_conversations": f"SELECT conv_id, string_agg('## Turn ' || turn || ' ' || {_heading('role')} || chr(10) || chr(10) || text || chr(10), chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id",
    "md_spine_orders": f"WITH l AS (SELECT l_orderkey, '## Chapter ' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) || chr(10) || chr(10) || l_partkey || chr(10) AS chapter, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem), s AS (SELECT l_orderkey, string_agg(chapter, chr(10) ORDER BY n) AS body FROM l GROUP BY 1) SELECT o_orderkey, '# ' || {_heading('o_orderpriority')} || chr(10) || CASE WHEN body IS NULL THEN '' ELSE chr(10) || body END AS markdown FROM orders LEFT JOIN s ON o_orderkey = l_orderkey",
    "page_numbers_conversations": "SELECT conv_id, turn, row_number() OVER w AS page, strlen(text) - lag(strlen(text)) OVER w AS gap, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "output_budget_documents": "WITH s AS (SELECT *, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents) SELECT source, CAST(max(upto) AS BIGINT) AS bytes, min(CASE WHEN upto > 65536 THEN doc_id END) AS breaks_at FROM s GROUP BY source",
    "distinct_warnings_labels": "WITH j AS (SELECT source, doc_id, 'quality ' || quality || ' toxic ' || toxic AS w FROM documents JOIN labels USING (doc_id)), f AS (SELECT source, w, min(doc_id) AS first, count(*) AS n FROM j GROUP BY 1, 2) SELECT source, string_agg(w, '; ' ORDER BY first) AS warnings, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY source",
    "warnings_append_documents": "SELECT warning, count(*) AS n FROM (SELECT 'lang ' || lang AS warning FROM documents UNION ALL SELECT 'quality ' || quality FROM labels) WHERE warning IN ('lang en', 'quality 0') GROUP BY warning",
    "dup_entries_documents": "SELECT sha256(text) AS entry, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "size_guard_pages": "SELECT count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes, count(*) FILTER (strlen(html) > 8192) AS too_large, count(*) FILTER (url IS NULL OR url = '') AS invalid FROM pages",
    "majority_direction_documents": "SELECT source, avg(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) > 0.5 AS mostly_en, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY source",
    "batch_status_conversations": "SELECT *, CASE WHEN finished = 0 THEN 'queued' WHEN finished < total THEN 'interrupted' ELSE 'done' END AS state FROM (SELECT conv_id, count(*) AS total, count(*) FILTER (role <> 'user') AS finished, count(*) FILTER (role = 'system') AS errors FROM conversations GROUP BY conv_id)",
    "cache_stats_documents": "SELECT count(*) AS count, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents",
    "ttl_filter_events": "WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS created_at FROM events), n AS (SELECT max(created_at) AS now FROM e) SELECT event_id, created_at, created_at < now - 43200000 AS old FROM e, n WHERE created_at + 86400000 > now",
    "cache_retain_events": "WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(floor(value * 1000) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id) AS rn FROM events), r AS (SELECT user_id, rn, event_id, bytes, CASE WHEN bytes <= 200000 THEN bytes ELSE 0 END AS used, bytes <= 200000 AS kept FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, e.event_id, e.bytes, CASE WHEN r.used + e.bytes <= 200000 THEN r.used + e.bytes ELSE r.used END, r.used + e.bytes <= 200000 FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) SELECT event_id, user_id, bytes FROM r WHERE kept",
    "model_evict_documents": "SELECT source, doc_id, bytes FROM (SELECT source, doc_id, strlen(text) AS bytes, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS upto FROM documents) WHERE upto + 5000 <= 40000",
    "runnable_anti_join": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "runnable_jobs_orders": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'queued' ELSE 'running' END AS state FROM orders WHERE o_orderstatus <> 'F'",
    "job_input_orders": "SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'error' ELSE 'done' END AS state, CASE WHEN l_orderkey IS NULL THEN 'INPUT_MISSING' END AS code FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey",
    "update_if_exists_customer": "SELECT c_custkey, coalesce(price, c_acctbal) AS value, price IS NOT NULL AS updated FROM customer LEFT JOIN (SELECT o_custkey, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS price FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "tag_names_lineitem": "SELECT CASE l_linenumber WHEN 1 THEN 'Make' WHEN 2 THEN 'Model' WHEN 3 THEN 'DateTime' ELSE 'Tag ' || l_linenumber END AS name, count(*) AS n FROM lineitem GROUP BY 1",
    "first_match_orders": "SELECT o_custkey, first(o_orderpriority ORDER BY o_orderkey) AS first_priority, min(o_orderkey) AS first_key FROM orders GROUP BY 1",
    "output_name_collisions": "SELECT doc_id, CASE WHEN n = 1 THEN source || '.md' WHEN n <= 1000 THEN source || ' (' || n || ').md' END AS file FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)",
    "error_messages_documents": "SELECT doc_id, left(text, 1000) AS message FROM documents",
    "html_links_pages": "SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links, len(regexp_extract_all(html, '<a href=')) AS rendered, false AS has_script, false AS has_style FROM pages",
    "csv_roundtrip_nation": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "zip_roundtrip_documents": f"SELECT doc_id, 'done' AS state, '## doc.xml' || chr(10) || chr(10) || {_fence('text', 'xml')} || chr(10) || '---' || chr(10) || chr(10) || '## sub/page.html' || chr(10) || chr(10) || '# Page' || chr(10) AS markdown, 'doc.xml: XML is preserved as source; syntax is not validated.; Skipped unsupported file: notes.txt' AS warnings FROM documents",
    "xml_source_conversations": f"SELECT conv_id, turn, {_fence('text', 'xml')} AS markdown FROM conversations",
    "convert_mixed_batch": "SELECT 'csv' AS format, 'done' AS state, CAST(NULL AS VARCHAR) AS code, count(*) AS n FROM nation UNION ALL SELECT 'json', 'done', NULL, count(*) FROM events UNION ALL SELECT 'json', 'error', 'INVALID_JSON', count(*) FROM documents UNION ALL SELECT 'xlsx', 'error', 'INVALID_SPREADSHEET', count(*) FROM documents UNION ALL SELECT 'html', 'done', NULL, count(*) FROM pages UNION ALL SELECT NULL, 'error', 'UNSUPPORTED_FORMAT', count(*) FROM documents",
}

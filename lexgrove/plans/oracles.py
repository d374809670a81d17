"""Equivalent SQL for the registered queries, over the same tables."""

from __future__ import annotations

from lexgrove.functions import fixed_values as fv
from lexgrove.functions.text import BLANKS
from lexgrove.plans.bindings import KNN_K, QUESTIONS, ROUTING

ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"trim({c}, {quoted(BLANKS)})"


def collapsed(c: str) -> str:
    return f"regexp_replace({strip(f'coalesce({c}, chr(32)||chr(32))')}, '\\s+', ' ', 'g')"


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


# ----------------------------------------------------------------- text columns
_NOISE = "(?i)(?:" + "|".join(f"(?:{p})" for p in fv.PAGE_LINE_PATTERNS) + ")"
add(
    "clean_lines",
    f"""
SELECT doc_id, {strip("array_to_string(kept, chr(10))")} AS clean_text FROM (
  SELECT doc_id, list_filter(string_split(text, chr(10)),
    lambda l: NOT regexp_matches({strip("l")}, {quoted(_NOISE)})
      AND NOT starts_with({strip("l")}, {quoted(fv.FORMAT_NOTE_PREFIX)})) AS kept
  FROM documents)
""",
)


def _re2(pattern: str) -> str:
    return pattern.replace(r"[\w\-]", r"[\p{L}\p{N}_\-]").replace(r"\/", "/")


def _first(source: str, patterns: list[str], group: int = 1) -> str:
    tries = [
        f"nullif(regexp_extract({source}, {quoted('(?i)' + _re2(p))}, {group}), '')"
        for p in patterns
    ]
    return "coalesce(" + ", ".join(tries) + ")"


def _iso(source: str, pattern: str) -> str:
    p = quoted("(?i)" + pattern)
    return (
        f"nullif(regexp_extract({source}, {p}, 3), '') || '-' || "
        f"lpad(regexp_extract({source}, {p}, 2), 2, '0') || '-' || "
        f"lpad(regexp_extract({source}, {p}, 1), 2, '0')"
    )


_SIGNED = "coalesce(" + ", ".join(
    _iso(f"substr(text, 1, {fv.SIGNING_CHARS})", p) for p in fv.SIGNING_DATE_PATTERNS
) + ")"
_DAYS = _first("text", [fv.EFFECTIVE_AFTER_DAYS])
add(
    "doc_metadata",
    f"""
WITH d AS (
  SELECT doc_id, text, {_SIGNED} AS signing_date,
    {collapsed("text")} AS clean
  FROM documents)
SELECT doc_id,
  coalesce({_first(f"substr(text, 1, {fv.DOC_NUMBER_CHARS})", fv.DOC_NUMBER_PATTERNS)}, '') AS doc_number,
  signing_date,
  CASE WHEN {_iso("text", fv.EFFECTIVE_EXPLICIT)} IS NOT NULL THEN {_iso("text", fv.EFFECTIVE_EXPLICIT)}
    WHEN regexp_matches(text, {quoted("(?i)" + fv.EFFECTIVE_AT_SIGNING)}) THEN signing_date
    ELSE strftime(try_cast(signing_date AS DATE) + try_cast({_DAYS} AS INTEGER), '%Y-%m-%d') END
    AS effective_date,
  CASE WHEN length(clean) > {fv.SNIPPET_CHARS}
    THEN rtrim(substr(clean, 1, {fv.SNIPPET_CHARS}), {quoted(BLANKS)}) || '...' ELSE clean END AS snippet
FROM d
""",
)


def _contains_any(c: str, needles) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(n)})" for n in needles) + ")"


def _typed(c: str, rules) -> str:
    return " ".join(
        f"WHEN {' AND '.join(_contains_any(c, g) for g in groups)} THEN {quoted(label)}"
        for groups, label in rules
    )


_TOP = f"upper(substr(html, 1, {fv.AGENCY_CHARS}))"
_AGENCY = " ".join(f"WHEN {_contains_any(_TOP, n)} THEN {quoted(a)}" for n, a in fv.AGENCIES)
add(
    "doc_type_route",
    f"""
SELECT page_id,
  CASE {_typed("lower(url)", fv.FILE_NAME_TYPES)}
    {_typed(f"lower(substr(html, 1, {fv.TYPE_HEADER_CHARS}))", fv.HEADER_TYPES)}
    ELSE {quoted(fv.DEFAULT_DOC_TYPE)} END AS doc_type,
  CASE {_AGENCY} ELSE NULL END AS issuing_agency,
  CASE WHEN contains(lower(url), '/fr/') THEN 'French' WHEN contains(lower(url), '/de/') THEN 'German'
    WHEN contains(lower(url), '/es/') THEN 'Spanish' ELSE 'English' END AS site_section
FROM pages
""",
)

# --------------------------------------------------------------------- chunking
CHUNK_ID = "substr(md5({owner} || '_' || {index} || '_' || {content}), 1, 16)"
_SECTIONS = f"""
  SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS chunk_index FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: {strip("p")}),
      lambda p: p <> '') AS parts FROM documents)
"""
_SECTION_ROWS = f"""
SELECT doc_id, chunk_index, content,
  {CHUNK_ID.format(owner="doc_id::VARCHAR", index="chunk_index::VARCHAR", content="content")} AS chunk_id
FROM ({_SECTIONS})
"""
add("section_chunks", _SECTION_ROWS)
add("stream_chunks", _SECTION_ROWS)
add(
    "page_records",
    r"""
WITH l AS (
  SELECT page_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS pos FROM (
    SELECT page_id, string_split(regexp_replace(html, '<(h1|h2|p|li|title)[ >/]',
      chr(10) || '\1' || chr(10), 'g'), chr(10)) AS p FROM pages)),
n AS (SELECT *, lead(line) OVER (PARTITION BY page_id ORDER BY pos) AS nxt FROM l WHERE trim(line) <> ''),
m AS (
  SELECT *, coalesce(nxt = 'h1', false) AS is_start,
    line IN ('h1', 'h2', 'p', 'li', 'title') AS is_label FROM n),
c AS (
  SELECT page_id, pos, line, is_label AND NOT is_start AS skip,
    last_value(CASE WHEN is_start THEN pos END IGNORE NULLS) OVER w AS record,
    last_value(CASE WHEN is_start THEN '_name' WHEN is_label THEN line END IGNORE NULLS) OVER w AS label
  FROM m WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT page_id, record,
  arg_min(line, pos) FILTER (WHERE label = '_name') AS lead,
  arg_min(line, pos) FILTER (WHERE label = 'h1') AS heading,
  arg_min(line, pos) FILTER (WHERE label = 'p') AS paragraph,
  arg_min(line, pos) FILTER (WHERE label = 'li') AS item
FROM c WHERE record IS NOT NULL AND NOT skip GROUP BY page_id, record
""",
)

_CHROME = " OR ".join(f"starts_with(line, {quoted(x)})" for x in fv.RESULT_PAGE_CHROME)
add(
    "trademark_cards",
    rf"""
WITH d AS (
  SELECT doc_id, 'Results view' || chr(10) || 'Owner' || chr(10) || array_to_string(list_transform(ls, lambda l, i:
    l || chr(10) || 'Owner' || chr(10) || l || ' (' || source || ')' || chr(10) || 'Nice class' || chr(10) || i || ', x ' || doc_id
    || chr(10) || '9' || CASE WHEN i % 2 = 1 THEN chr(10) || 'Status' || chr(10) || 'Registered (day ' || i || ')' || chr(10) || 'IPR'
    || chr(10) || 'Trademark' ELSE '' END || chr(10) || 'Number' || chr(10) || i || chr(10) || 'Filters' || chr(10)), chr(10)) AS page
  FROM (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)),
    lambda l: trim(regexp_replace(l, '[^\p{{L}} ]+', ' ', 'g'))), lambda l: l <> '') AS ls FROM documents)),
l AS (SELECT doc_id, unnest(string_split(page, chr(10))) AS line, generate_subscripts(string_split(page, chr(10)), 1) - 1 AS pos FROM d),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM l WHERE trim(line) <> ''),
m AS (
  SELECT *, coalesce(nxt = 'Owner', false) AND NOT ({_CHROME}) AS is_start,
    line IN ('Owner', 'Nice class', 'IPR', 'Country of filing', 'Status', 'Number') AS is_label FROM n),
c AS (
  SELECT doc_id, pos, line, is_label AND NOT is_start AS skip,
    last_value(CASE WHEN is_start THEN pos END IGNORE NULLS) OVER w AS record,
    last_value(CASE WHEN is_start THEN '_name' WHEN is_label THEN line END IGNORE NULLS) OVER w AS label
  FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
r AS (
  SELECT doc_id, record, arg_min(line, pos) FILTER (WHERE label = '_name') AS brand_name,
    arg_min(line, pos) FILTER (WHERE label = 'Owner') AS owner, arg_min(line, pos) FILTER (WHERE label = 'IPR') AS ipr_type,
    arg_min(line, pos) FILTER (WHERE label = 'Country of filing') AS country_of_filing,
    arg_min(line, pos) FILTER (WHERE label = 'Status') AS status, arg_min(line, pos) FILTER (WHERE label = 'Number') AS registration_number,
    string_agg(line, ',' ORDER BY pos) FILTER (WHERE label = 'Nice class') AS classes
  FROM c WHERE record IS NOT NULL AND NOT skip GROUP BY doc_id, record)
SELECT doc_id, record, brand_name, ipr_type, country_of_filing, status, registration_number,
  array_to_string(list_filter(regexp_split_to_array(classes, '[,\s]+'), lambda p: regexp_matches(p, '^\d+$')), ',') AS nice_classes,
  trim(regexp_extract(owner, '^(.*)\((.*)$', 1)) AS owner_name, trim(regexp_extract(owner, '^(.*)\((.*)$', 2), '() ') AS owner_country,
  nullif(regexp_extract(status, '\(([^)]*)\)', 1), '') AS status_date
FROM r
""".replace("\\\\", "\\"),
)

# -------------------------------------------------------------------- sequences
add(
    "carry_forward",
    """
SELECT conv_id, turn,
  last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER w AS last_system,
  last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS last_user_turn
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
""",
)
_TURNS = f"""
  SELECT *, {CHUNK_ID.format(owner="conv_id::VARCHAR", index="turn::VARCHAR", content="text")} AS chunk_id
  FROM conversations
"""
add(
    "next_edges",
    f"""
SELECT conv_id, chunk_id AS src, dst FROM (
  SELECT *, lead(chunk_id) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM ({_TURNS}))
WHERE dst IS NOT NULL
""",
)


def _context(window: int, where: str) -> str:
    sep = "chr(10) || '---' || chr(10)"
    before = " || ".join(
        f"coalesce(lag(text, {i}) OVER w || {sep}, '')" for i in range(window, 0, -1)
    )
    after = " || ".join(
        f"coalesce(lead(text, {i}) OVER w || {sep}, '')" for i in range(1, window + 1)
    )
    return f"""
SELECT conv_id, turn, nullif(b, '') AS context_before, nullif(a, '') AS context_after FROM (
  SELECT conv_id, turn, role, {before} AS b, {after} AS a
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) {where}
"""


add("context_window", _context(1, ""))
add("context_window_2", _context(2, "WHERE role = 'assistant'"))
_HISTORY_HEAD, _HISTORY_TAIL = fv.HISTORY_BLOCK.split("{history}")
add(
    "history_last5",
    f"""
SELECT conv_id, {quoted(_HISTORY_HEAD)} || string_agg(line, chr(10) ORDER BY turn) || {quoted(_HISTORY_TAIL)}
  AS history FROM (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'User: ' || text
      WHEN length(text) > 500 THEN 'Assistant: ' || substr(text, 1, 500) || '...'
      ELSE 'Assistant: ' || text END AS line,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= 5 GROUP BY conv_id
""",
)
add(
    "session_titles",
    f"""
SELECT conv_id, CASE WHEN length(f) > 30 THEN substr(f, 1, 30) || '...'
  ELSE coalesce(f, {quoted(fv.DEFAULT_SESSION_TITLE)}) END AS title FROM (
  SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS f FROM conversations GROUP BY conv_id)
""",
)
add(
    "typed_edges",
    f"""
SELECT DISTINCT chunk_id AS src, conv_id AS dst,
  CASE role WHEN 'user' THEN 'ASKS' WHEN 'assistant' THEN 'ANSWERS' END AS rel_type
FROM ({_TURNS}) WHERE role IN ('user', 'assistant')
""",
)
add(
    "doc_dimension",
    f"""
SELECT doc_id, doc_key, lang, first_chars FROM (
  SELECT s.doc_id, source || '/' || lang AS doc_key, lang, length(content) AS first_chars
  FROM ({_SECTIONS}) s JOIN documents d ON d.doc_id = s.doc_id WHERE chunk_index = 0)
QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY doc_id DESC) = 1
""",
)
add(
    "duplicate_keys",
    """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1
""",
)

# ---------------------------------------------------------------------- filters
add(
    "validity_filter",
    """
SELECT l_orderkey AS doc_id, count(*) AS chunks, sum(l_quantity) AS quantity
FROM lineitem WHERE l_orderkey IN (
  SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'
    AND (o_orderdate IS NULL OR strftime(o_orderdate, '%Y-%m-%d') <= '1998-06-30')
    AND o_orderpriority IN ('1-URGENT', '2-HIGH'))
GROUP BY l_orderkey
""",
)
add(
    "corpus_subset",
    "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
add(
    "resume_anti",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
add(
    "point_lookup",
    """
SELECT conv_id, turn, role, text, 1.0 AS score FROM conversations WHERE conv_id = (
  SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY count(*) DESC, conv_id DESC LIMIT 1)
""",
)
add(
    "related_rows",
    """
WITH f AS (SELECT n_nationkey AS k, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS m FROM nation),
d AS (SELECT k::VARCHAR AS doc_number, CASE WHEN k <> m THEN m::VARCHAR END AS amends,
  [(k + 1)::VARCHAR, (k + 2)::VARCHAR] AS amended_by FROM f)
SELECT a.doc_number, b.doc_number AS related_number, 'amends' AS relation
FROM d a JOIN d b ON b.doc_number = a.amends
UNION
SELECT a.doc_number, b.doc_number, 'amended_by' FROM d a JOIN d b ON list_contains(b.amended_by, a.doc_number)
""",
)

# --------------------------------------------------------------------- profiles
_PROFILED = ("lang", "source", "quality", "toxic")
add(
    "null_profile",
    "WITH j AS (SELECT d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count({c}) AS not_nulls, "
        f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS null_pct, "
        f"CASE WHEN (count(*) - count({c})) * 100.0 / count(*) < 10 THEN 'ok' "
        f"WHEN (count(*) - count({c})) * 100.0 / count(*) < 30 THEN 'warn' ELSE 'bad' END AS level FROM j"
        for c in _PROFILED
    ),
)
add(
    "type_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, coalesce({c}, 'unknown') AS value, count(*) AS rows, "
        f"round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 6) AS pct "
        f"FROM documents GROUP BY {c}"
        for c in ("lang", "source")
    ),
)
add(
    "store_stats",
    """
SELECT 'documents' AS metric, count(*) AS value FROM documents
UNION ALL SELECT 'english_documents', count(*) FROM documents WHERE lang = 'en'
UNION ALL SELECT 'labelled', count(*) FROM labels
UNION ALL SELECT 'good', count(*) FROM labels WHERE quality = 1
UNION ALL SELECT 'with_vector', count(embedding) FROM embeddings
UNION ALL SELECT 'turns', count(*) FROM conversations
""",
)
add(
    "daily_activity",
    """
WITH l AS (SELECT max(ts)::DATE AS last FROM events),
c AS (SELECT unnest([last - 6, last - 5, last - 4, last - 3, last - 2, last - 1, last]) AS day FROM l),
e AS (SELECT ts::DATE AS day, count(*) AS visits,
  count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewers FROM events GROUP BY 1)
SELECT c.day::DATE AS day, coalesce(visits, 0) AS visits, coalesce(viewers, 0) AS viewers
FROM c LEFT JOIN e ON e.day = c.day::DATE
""",
)
add(
    "stream_daily_activity",
    "SELECT ts::DATE AS day, count(*) AS visits FROM events GROUP BY 1",
)
add(
    "prefix_plan",
    f"""
WITH p AS (
  SELECT length(p_name) AS n, unnest(list_transform(range(1, length(p_name) + 1), lambda i: substr(lower(p_name), 1, i))) AS prefix
  FROM part),
c AS (SELECT prefix, count(*) AS rows, count(*) FILTER (WHERE n = length(prefix)) AS ending FROM p GROUP BY 1),
s AS (SELECT * FROM c WHERE rows > {fv.PREFIX_CAP})
SELECT c.prefix, 'leaf' AS kind, c.rows
FROM c WHERE c.rows <= {fv.PREFIX_CAP}
  AND (length(c.prefix) = 1 OR substr(c.prefix, 1, length(c.prefix) - 1) IN (SELECT prefix FROM s))
UNION ALL SELECT prefix, 'ends', ending FROM s WHERE ending > 0
""",
)
add(
    "page_listing",
    """
SELECT o_custkey, o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total,
  coalesce(c_name, 'Unknown') AS username
FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 20)
LEFT JOIN customer ON c_custkey = o_custkey
""",
)
add(
    "retention",
    """
SELECT event_type, count(*) AS kept, min(ts) AS oldest FROM events
WHERE ts >= (SELECT max(ts)::DATE - 10 FROM events) GROUP BY event_type
""",
)
add(
    "cascade_delete",
    """
SELECT conv_id, count(*) AS turns FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id
""",
)


# ---------------------------------------------------------------------- vectors
_ASKED_VECTORS = "(SELECT * FROM embeddings WHERE vec_id % 50 = 0)"


def _top(k: int, pool: str = "embeddings", skip_self: bool = True, queries: str = _ASKED_VECTORS) -> str:
    other = "AND q.vec_id <> v.vec_id" if skip_self else ""
    return f"""
  SELECT * FROM (
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(
        q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score
      FROM {queries} q, {pool} v WHERE true {other}))
  WHERE rank <= {k}
"""


_GOOD = "(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1))"


def _boosted(top: str, k: int) -> str:
    return f"""
  SELECT query_id, id, section_type, score, row_number() OVER (
      PARTITION BY query_id ORDER BY score DESC, first_rank) AS rank FROM (
    SELECT t.query_id, t.id, t.rank AS first_rank, e.label AS section_type,
      t.score * CASE e.label WHEN 1 THEN 1.3::DOUBLE WHEN 2 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS score
    FROM ({top}) t JOIN embeddings e ON e.vec_id = t.id)
  QUALIFY rank <= {k}
"""


add("knn_topk", f"SELECT query_id, rank, id, round(score, 6) AS score FROM ({_top(KNN_K, queries='embeddings')})")
add(
    "knn_filtered",
    f"SELECT query_id, rank, id, round(score, 6) AS score FROM ({_top(KNN_K, _GOOD, queries='embeddings')})",
)
add(
    "boosted_rerank",
    "SELECT query_id, rank, id, section_type, round(score, 6) AS score "
    f"FROM ({_boosted(_top(2 * KNN_K, queries='embeddings'), KNN_K)})",
)
add(
    "hydrate_hits",
    f"""
SELECT query_id, rank, doc_id, round(score, 6) AS score, lang, source, n_chars
FROM ({_top(KNN_K, queries="embeddings")}) t JOIN documents ON doc_id = t.id
""",
)
add(
    "hits_per_query",
    f"""
SELECT vec_id AS query_id, count(l.doc_id) AS total_found FROM embeddings
LEFT JOIN ({_top(KNN_K, queries="embeddings")}) t ON t.query_id = vec_id
LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = t.id GROUP BY vec_id
""",
)
add(
    "retrieval_metrics",
    f"""
WITH t AS ({_top(max(fv.EVAL_KS), queries="embeddings")}),
j AS (SELECT t.query_id, t.rank, h.label = q.label AS rel
  FROM t JOIN embeddings h ON h.vec_id = t.id JOIN embeddings q ON q.vec_id = t.query_id),
n AS (SELECT vec_id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n FROM embeddings),
k AS (SELECT unnest({list(fv.EVAL_KS)}) AS k),
m AS (SELECT n.query_id, k.k, count(*) FILTER (WHERE rel AND rank <= k.k) AS found, any_value(n.n) AS n,
    min(rank) FILTER (WHERE rel) AS first
  FROM n CROSS JOIN k LEFT JOIN j ON j.query_id = n.query_id GROUP BY n.query_id, k.k)
SELECT k, round(avg(found::DOUBLE / k), 6) AS precision,
  round(avg(CASE WHEN n > 0 THEN found::DOUBLE / n ELSE 0 END), 6) AS recall,
  round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, count(*) AS queries
FROM m GROUP BY k
""",
)
add(
    "complete_sections",
    f"""
WITH t AS ({_TURNS}),
h AS (SELECT conv_id, role, chunk_id FROM t
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1)
SELECT t.conv_id AS query_id, t.conv_id, t.turn, t.role, t.chunk_id, 0.5 AS score,
  row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn, t.chunk_id) AS extra_rank
FROM t JOIN h ON h.conv_id = t.conv_id AND h.role <> t.role
WHERE t.role IN ('user', 'assistant') AND t.chunk_id <> h.chunk_id
""",
)


def _filled(template: str, **values: str) -> str:
    out, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            out.append(quoted(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        out.append(values[name])
    return " || ".join(out)


_BLOCK = _filled(
    fv.STATUTE_BLOCK,
    index="t.rank::VARCHAR",
    doc_name="source",
    doc_number="doc_id::VARCHAR",
    doc_type="lang",
    dieu="'N/A'",
    dieu_title="''",
    effective_date="'N/A'",
    content="text",
)
_PROMPT = _filled(fv.STATUTE_PROMPT, query="'vector ' || query_id", context="context")
add(
    "prompt_blocks",
    f"""
WITH h AS (SELECT t.query_id, t.rank, source, {_BLOCK} AS block
  FROM ({_top(KNN_K, queries="embeddings")}) t JOIN documents ON doc_id = t.id),
c AS (SELECT query_id, string_agg(block, chr(10) ORDER BY rank) AS context FROM h GROUP BY 1),
s AS (SELECT query_id, string_agg(source, ', ' ORDER BY first) AS case_list FROM (
  SELECT query_id, source, min(rank) AS first FROM h GROUP BY ALL) GROUP BY 1),
p AS (SELECT vec_id AS query_id, CASE WHEN context IS NULL THEN {quoted(fv.NO_STATUTE)}
    ELSE chr(10) || {_PROMPT} END AS prompt
  FROM (SELECT vec_id, vec_id AS query_id, context FROM embeddings LEFT JOIN c ON c.query_id = vec_id))
SELECT query_id, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars, case_list
FROM p LEFT JOIN s USING (query_id)
""",
)
_LABEL = "CASE label " + " ".join(
    f"WHEN {i} THEN {quoted(text)}" for i, (_, text) in enumerate(fv.SECTION_LABELS)
) + " ELSE 'other' END"
_VERDICT_BLOCK = _filled(
    fv.VERDICT_BLOCK,
    index="t.rank::VARCHAR",
    case_number="coalesce(nullif(cn, ''), 'N/A')",
    court_name="lang",
    judgment_date="'N/A'",
    trial_level="'N/A'",
    ip_types="'nhãn hiệu, ' || lang",
    plaintiff="'N/A'",
    defendant="'N/A'",
    section_label=_LABEL,
    section_detail="CASE WHEN t.rank % 2 = 0 THEN ' | Luận điểm [2]' WHEN t.rank = 3 THEN ' | bị đơn' "
    "WHEN t.rank > 1 THEN ' | Khoản 1.' ELSE '' END",
    content="CASE WHEN t.rank = 1 THEN '[Context trước]' || chr(10) || 'trước' || chr(10) ELSE '' END || text"
    " || CASE WHEN t.rank = 5 THEN chr(10) || '[Context sau]' || chr(10) || 'sau' ELSE '' END",
)
add(
    "verdict_blocks",
    f"""
WITH h AS (SELECT t.query_id, t.rank, cn, {_VERDICT_BLOCK} AS block
  FROM ({_top(KNN_K, queries="embeddings")}) t JOIN embeddings e ON e.vec_id = t.id
  JOIN (SELECT *, CASE WHEN lang <> 'fr' THEN source ELSE '' END AS cn FROM documents) ON doc_id = t.id),
s AS (SELECT query_id, string_agg(cn, ', ' ORDER BY first) AS case_list FROM (
  SELECT query_id, cn, min(rank) AS first FROM h WHERE cn <> '' GROUP BY ALL) GROUP BY 1)
SELECT query_id, md5(string_agg(block, chr(10) ORDER BY rank)) AS context_md5, any_value(case_list) AS case_list
FROM h LEFT JOIN s USING (query_id) GROUP BY query_id
""",
)
add(
    "evaluation_run",
    """
WITH q AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING
    coalesce(arg_min(substr(text, 1, 50), turn) FILTER (WHERE role = 'user'), '') <> ''
    AND count(*) FILTER (WHERE role = 'assistant') > 0),
h AS (SELECT conv_id, role = 'assistant' AS rel,
  row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations),
n AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1),
m AS (SELECT q.conv_id, k, any_value(n.n) AS n, count(*) FILTER (WHERE rel AND rank <= least(k, 5)) AS found,
    min(rank) FILTER (WHERE rel AND rank <= 5) AS first
  FROM q JOIN n USING (conv_id) JOIN h USING (conv_id) CROSS JOIN (SELECT unnest([1, 3, 5]) AS k) GROUP BY ALL)
SELECT k, round(avg(found::DOUBLE / k), 6) AS precision, round(avg(found::DOUBLE / n), 6) AS recall,
  round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, count(*) AS queries FROM m GROUP BY k
""",
)
add(
    "unit_vectors",
    """
WITH n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v,
  sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings)
SELECT id, round(list_sum(list_transform(v, lambda x: (x / norm) * (x / norm))), 6) AS square,
  round(v[1] / norm, 6) AS first FROM n
""",
)

# ------------------------------------------------------------------ name search
_REGISTER = "SELECT p_partkey AS key, p_name AS name, p_type FROM part"
_WORDS = "SELECT DISTINCT string_split(p_name, ' ')[1] AS query_id FROM part"
_NAMES = "SELECT DISTINCT p_name AS query_id FROM part"


def _contains_tier(queries: str) -> str:
    return f"""
  SELECT query_id, key, name, p_type,
    CASE WHEN lower(name) = lower(query_id) THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score,
    'exact' AS match_type, row_number() OVER (PARTITION BY query_id
      ORDER BY CASE WHEN lower(name) = lower(query_id) THEN 0 ELSE 1 END, name, key) AS rank
  FROM ({queries}) JOIN ({_REGISTER}) ON contains(lower(name), lower(query_id))
  QUALIFY rank <= {fv.NAME_LIMIT}
"""


_GRAMS = """list_distinct(flatten(list_transform(list_filter(
    string_split_regex(lower(n), '[^a-z0-9]+'), lambda w: w <> ''),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""
_PAIRS = f"""
  WITH g AS (SELECT n, {_GRAMS} AS grams FROM (SELECT DISTINCT lower(p_name) AS n FROM part))
  SELECT a.n AS query_name, b.n AS lower_name,
    len(list_intersect(a.grams, b.grams))::DOUBLE
      / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))) AS similarity
  FROM g a, g b WHERE similarity > {fv.NAME_SIMILARITY_THRESHOLD}
"""


def _fuzzy_tier(queries: str) -> str:
    return f"""
  SELECT query_id, key, name, p_type,
    round(least(similarity, {fv.NAME_FUZZY_CAP}), 4)::DOUBLE AS score, 'fuzzy' AS match_type,
    row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, name, key) AS rank
  FROM ({queries}) JOIN ({_PAIRS}) ON query_name = lower(query_id)
  JOIN ({_REGISTER}) ON lower(name) = lower_name
  QUALIFY rank <= {fv.NAME_LIMIT}
"""


add(
    "name_contains",
    f"SELECT query_id, rank, key, name, score, match_type FROM ({_contains_tier(_WORDS)})",
)
add("name_fuzzy", f"SELECT query_id, rank, key, name, score, match_type FROM ({_fuzzy_tier(_NAMES)})")
add(
    "name_pairs",
    f"""
SELECT query_id, lower_name, round(similarity, 6) AS similarity
FROM ({_NAMES}) JOIN ({_PAIRS}) ON query_name = lower(query_id)
""",
)
add(
    "name_search",
    f"""
WITH u AS (SELECT *, 0 AS tier FROM ({_contains_tier(_NAMES)})
  UNION ALL BY NAME SELECT *, 1 AS tier FROM ({_fuzzy_tier(_NAMES)})),
f AS (SELECT *, min(tier * 1000 + rank) OVER (PARTITION BY query_id, key) AS place,
    row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, tier, rank) AS best FROM u),
w AS (SELECT p_name AS query_id, arg_min(p_type, (p_retailprice, p_partkey)) AS wanted FROM part GROUP BY 1)
SELECT query_id, key, name, score, match_type,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank
FROM f JOIN w USING (query_id) WHERE best = 1 AND p_type = wanted
QUALIFY rank <= {fv.NAME_LIMIT}
""",
)

add(
    "trademark_blocks",
    f"""
SELECT query_id, string_agg('[' || rank || '] Nhãn hiệu: ' || name || chr(10)
  || '    Chủ sở hữu: ' || p_brand || ' (VN)' || chr(10) || '    Số đăng ký: ' || key || chr(10)
  || CASE WHEN p_size > 20 THEN '    ST13: ' || p_size || chr(10) ELSE '' END
  || '    Nhóm Nice: ' || CASE WHEN p_size > 10 THEN t.p_type ELSE 'N/A' END || chr(10)
  || '    Loại: ' || CASE WHEN p_size > 30 THEN t.p_type ELSE 'N/A' END || chr(10)
  || '    Nước đăng ký: N/A' || chr(10) || '    Trạng thái: ' || chr(10)
  || '    Mức giống: ' || CASE WHEN score = 1 THEN '100' ELSE '80' END || '% (exact)',
  chr(10) || chr(10) ORDER BY rank) AS context
FROM ({_contains_tier(_WORDS)}) t JOIN part ON p_partkey = key WHERE rank <= 5 GROUP BY query_id
""",
)

# ----------------------------------------------------------------------- merges
_CHANGES = """
  SELECT o_custkey AS key, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS amount,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS segment, o_orderdate, o_orderkey FROM orders
"""
add(
    "merge_overwrite",
    f"""
WITH s AS (SELECT key, amount, segment, true AS hit FROM ({_CHANGES})
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT coalesce(s.key, c_custkey) AS key, CASE WHEN hit THEN amount ELSE c_acctbal END AS amount,
  CASE WHEN hit THEN segment ELSE c_mktsegment END AS segment
FROM customer FULL JOIN s ON s.key = c_custkey
""",
)
add(
    "merge_coalesce",
    f"""
WITH s AS (SELECT key,
    arg_max(amount, (o_orderdate, o_orderkey)) FILTER (WHERE amount IS NOT NULL) AS amount,
    arg_max(segment, (o_orderdate, o_orderkey)) FILTER (WHERE segment IS NOT NULL) AS segment
  FROM ({_CHANGES}) GROUP BY key)
SELECT coalesce(s.key, c_custkey) AS key, coalesce(amount, c_acctbal) AS amount,
  coalesce(segment, c_mktsegment) AS segment
FROM customer FULL JOIN s ON s.key = c_custkey
""",
)
add(
    "dedupe_first",
    f"""
SELECT doc_id, lang, length(text) AS chars FROM documents
QUALIFY {strip("text")} = '' OR row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
""",
)
add(
    "bridge_build",
    """
SELECT p_partkey, string_agg(word, ',' ORDER BY word) AS words FROM (
  SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part
  UNION SELECT p_partkey, lower(p_type) FROM part) GROUP BY p_partkey
""",
)
_SHEET = """
  SELECT p_brand AS file, p_partkey AS row, p_name AS brand_name, p_brand AS owner_name,
    lower(p_type) AS owner_country, CASE WHEN p_size > 10 THEN p_name || '-' || p_size ELSE '' END AS st13,
    CASE WHEN p_type = 'SMALL' THEN 'VN' ELSE 'US' END AS ip_office,
    p_size || '|' || (p_size + 1) AS nice_classes FROM part
"""
_MERGED = f"""
  SELECT * FROM ({_SHEET})
  QUALIFY st13 = '' OR row_number() OVER (PARTITION BY st13 ORDER BY file, row) = 1
"""
add("sheet_records_merged", _MERGED)
add(
    "sheet_report",
    f"""
SELECT count(*) AS total_records, count(*) FILTER (WHERE ip_office = 'VN') AS office_records,
  (SELECT count(*) FROM part) - count(*) AS duplicates FROM ({_MERGED})
""",
)
add(
    "trademark_merge",
    """
WITH r AS (SELECT p_partkey AS o, p_name AS brand_name, CASE WHEN p_size > 25 THEN 'S' || p_size END AS st13,
    p_brand AS registration_number, CASE WHEN p_type <> 'SMALL' THEN p_type END AS status FROM part),
k AS (SELECT st13, arg_max(struct_pack(b := brand_name, n := registration_number, s := status), o) AS x
  FROM r WHERE st13 IS NOT NULL GROUP BY st13),
b AS (SELECT CASE WHEN k.st13 IS NULL THEN s_name ELSE x.b END AS brand_name,
    coalesce(k.st13, 'S' || s_suppkey) AS st13,
    CASE WHEN k.st13 IS NULL THEN 'Brand#' || s_nationkey ELSE x.n END AS registration_number,
    CASE WHEN k.st13 IS NULL THEN NULL ELSE x.s END AS status
  FROM supplier FULL JOIN k ON k.st13 = 'S' || s_suppkey),
l AS (SELECT registration_number, arg_max(brand_name, o) AS brand_name,
    arg_max(status, o) FILTER (WHERE status IS NOT NULL) AS status
  FROM r WHERE st13 IS NULL GROUP BY 1),
w AS (SELECT registration_number, min(st13) AS st13 FROM b GROUP BY 1)
SELECT coalesce(l.brand_name, b.brand_name) AS brand_name, b.st13, b.registration_number,
  coalesce(l.status, b.status) AS status
FROM b LEFT JOIN w ON w.registration_number = b.registration_number AND w.st13 = b.st13
LEFT JOIN l ON l.registration_number = w.registration_number
UNION ALL
SELECT brand_name, NULL, registration_number, status FROM l
WHERE registration_number NOT IN (SELECT registration_number FROM b)
""",
)


#: The same with the order of arrival first, then the order inside an arrival.
add(
    "stream_trademarks",
    ORACLES["trademark_merge"].replace(
        "p_partkey AS o", "CASE p_partkey % 3 WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END * 1000000000000 + p_partkey AS o"
    ),
)


# ----------------------------------------------------------- routing, benchmark
def _score(patterns) -> str:
    return " + ".join(
        f"regexp_matches({strip('text')}, {quoted('(?i)' + p)})::INTEGER" for p in patterns
    )


def _any(patterns) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return f"regexp_matches({strip('text')}, {quoted('(?i)(?:' + joined + ')')})"


def _routed(rows: str, rules) -> str:
    return f"""
  SELECT *, CASE WHEN {strip("text")} = '' THEN 'legal' WHEN t >= 2 THEN 'trademark'
    WHEN t >= 1 AND v <= 2 AND l <= 1 THEN 'trademark' WHEN a AND v >= 1 THEN 'combined'
    WHEN v >= 2 AND l >= 2 THEN 'combined' WHEN v > l AND v >= 2 THEN 'verdict'
    WHEN l > v AND l >= 1 THEN 'legal' WHEN v >= 1 THEN 'combined' ELSE 'legal' END AS route
  FROM (SELECT *, {_score(rules["verdict"])} AS v, {_score(rules["legal"])} AS l,
    {_score(rules["trademark"])} AS t, {_any(rules["advisory"])} AS a FROM {rows})
"""


_RULES = {
    name: getattr(ROUTING, name) for name in ("verdict", "legal", "trademark", "advisory")
}
_ASKED = "(SELECT * FROM conversations WHERE role = 'user')"
add(
    "route_queries",
    f"""
SELECT conv_id, turn, v AS verdict_score, l AS legal_score, t AS trademark_score,
  a::INTEGER AS advisory, route FROM ({_routed(_ASKED, _RULES)})
""",
)
_DEFAULT_RULES = {
    "verdict": fv.VERDICT_KEYWORDS,
    "legal": fv.LEGAL_KEYWORDS,
    "trademark": fv.TRADEMARK_KEYWORDS,
    "advisory": fv.ADVISORY_PATTERNS,
}
add(
    "route_defaults",
    f"""
SELECT route, count(*) AS documents, sum(v + l + t) AS score
FROM ({_routed("documents", _DEFAULT_RULES)}) GROUP BY route
""",
)
_QUESTIONS = (
    "(SELECT doc_id, CASE WHEN q = ' ' THEN q ELSE q || ' ' || source END AS text FROM (SELECT *, "
    f"[{', '.join(quoted(q) for q in QUESTIONS)}][(doc_id % {len(QUESTIONS)} + 1)::INTEGER] AS q FROM documents))"
)
add(
    "route_questions",
    f"""
SELECT doc_id, v AS verdict_score, l AS legal_score, t AS trademark_score, a::INTEGER AS advisory, route
FROM ({_routed(_QUESTIONS, _DEFAULT_RULES)})
""",
)
_NEIGHBOURS = """
  SELECT doc_id AS chunk_id, source, lang, md5(text) AS content_md5,
    md5(lag(text) OVER w || chr(10) || '---' || chr(10)) AS context_before_md5,
    md5(lead(text) OVER w || chr(10) || '---' || chr(10)) AS context_after_md5
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)
"""
add(
    "legal_search",
    f"""
WITH c AS ({_NEIGHBOURS}),
n AS (SELECT DISTINCT source, regexp_extract(source, '(\\d+)', 1)::INTEGER AS n FROM documents),
s AS (
  SELECT source, n, CASE WHEN n % 4 = 0 THEN 'code' WHEN n % 2 = 0 THEN 'law' ELSE 'decree' END AS doc_type,
    CASE WHEN n % 5 <> 4 THEN '20' || lpad((n + 5)::VARCHAR, 2, '0') || '-01-01' END AS effective_date FROM n),
pool AS (
  SELECT e.* FROM embeddings e JOIN c ON c.chunk_id = e.vec_id JOIN s USING (source)
  WHERE n % 3 <> 2 AND (effective_date IS NULL OR effective_date <= '2015-06-30') AND doc_type IN ('law', 'decree'))
SELECT query_id, rank, chunk_id, round(score, 6) AS score, source AS doc_id, upper(source) AS doc_name,
  'QD ' || n AS doc_number, doc_type, effective_date, lang AS dieu, upper(lang) AS dieu_title, chunk_id AS chunk_index,
  content_md5, context_before_md5, context_after_md5
FROM ({_top(5, "pool", False, _ASKED_VECTORS)}) t JOIN c ON c.chunk_id = t.id JOIN s USING (source)
""",
)
add(
    "verdict_search",
    f"""
WITH c AS (
  SELECT *, regexp_extract(source, '([0-9]+)', 1)::INTEGER AS n,
    CASE lang WHEN 'en' THEN 'reasoning' WHEN 'fr' THEN 'decision_item' ELSE 'facts' END AS section_type
  FROM ({_NEIGHBOURS})),
pool AS (SELECT e.* FROM embeddings e JOIN c ON c.chunk_id = e.vec_id WHERE n % 3 IN (0, 1) AND n % 2 = 0),
h AS (
  SELECT query_id, id, source, section_type, t.score * CASE section_type WHEN 'reasoning' THEN 1.3::DOUBLE
      WHEN 'decision_item' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY t.score * CASE section_type WHEN 'reasoning' THEN 1.3::DOUBLE
      WHEN 'decision_item' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END DESC, t.rank) AS place
  FROM ({_top(16, "pool", False, _ASKED_VECTORS)}) t JOIN c ON c.chunk_id = t.id QUALIFY place <= 8),
missing AS (
  SELECT DISTINCT query_id, source, section_type FROM (
    SELECT DISTINCT query_id, source, unnest(['reasoning', 'decision_item']) AS section_type FROM h)
  EXCEPT SELECT query_id, source, section_type FROM h),
added AS (
  SELECT m.query_id, c.chunk_id AS id, 0.5::DOUBLE AS score, row_number() OVER (
    PARTITION BY m.query_id ORDER BY c.n || '/KDTM', c.chunk_id) + last AS rank
  FROM missing m JOIN c ON c.source = m.source AND c.section_type = m.section_type
  JOIN (SELECT query_id, max(place) AS last FROM h GROUP BY query_id) l ON l.query_id = m.query_id
  WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = m.query_id AND h.id = c.chunk_id)),
r AS (SELECT query_id, id, score, place AS rank FROM h UNION ALL SELECT query_id, id, score, rank FROM added)
SELECT query_id, rank, id AS vchunk_id, round(score, 6) AS score, source AS verdict_id, n || '/KDTM' AS case_number,
  upper(source) AS court_name, 'first' AS trial_level, section_type, id AS chunk_index,
  content_md5, context_before_md5, context_after_md5
FROM r JOIN c ON c.chunk_id = r.id
""",
)
_ROUTE = "CASE query_id // 50 % 3 WHEN 0 THEN 'legal' WHEN 1 THEN 'verdict' ELSE 'combined' END"
add(
    "fan_out_search",
    f"""
SELECT query_id, {_ROUTE} AS route, 'legal' AS source, rank, chunk_id AS id, score, doc_id AS owner, doc_type, NULL AS trial_level,
  content_md5, context_before_md5, context_after_md5 FROM ({ORACLES["legal_search"]}) WHERE query_id // 50 % 3 <> 1
UNION ALL SELECT query_id, {_ROUTE}, 'verdict', rank, vchunk_id, score, verdict_id, NULL, trial_level,
  content_md5, context_before_md5, context_after_md5 FROM ({ORACLES["verdict_search"]}) WHERE query_id // 50 % 3 <> 0
""",
)
add(
    "search_evaluation",
    f"""
WITH h AS (
  SELECT 'legal' AS source, query_id, rank, chunk_id AS id FROM ({ORACLES["legal_search"]})
  UNION ALL SELECT 'verdict', query_id, rank, vchunk_id FROM ({ORACLES["verdict_search"]})),
q AS (
  SELECT doc_id AS query_id, label, n FROM documents JOIN embeddings ON vec_id = doc_id
  JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)
  WHERE doc_id % 50 = 0 AND coalesce(text, '') <> '' ORDER BY doc_id LIMIT 30),
m AS (
  SELECT s.source, q.query_id, k, n, count(*) FILTER (WHERE e.label = q.label AND rank <= k) AS found,
    min(rank) FILTER (WHERE e.label = q.label) AS first
  FROM q CROSS JOIN (SELECT unnest(['legal', 'verdict']) AS source) s CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k)
  LEFT JOIN h ON h.query_id = q.query_id AND h.source = s.source LEFT JOIN embeddings e ON e.vec_id = h.id GROUP BY ALL),
a AS (
  SELECT source, k, avg(found::DOUBLE / k) AS precision, avg(found::DOUBLE / n) AS recall, avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr,
    count(*) AS queries FROM m GROUP BY source, k)
SELECT source, k, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, queries,
  (max(precision + recall + mrr) OVER (PARTITION BY source) = 0)::INTEGER AS all_zero FROM a
""",
)
_ROUTED_QUERIES = (
    f"(SELECT conv_id * 1000 + turn AS vec_id, embedding, route FROM ({_routed(_ASKED, _RULES)}) "
    "JOIN embeddings ON embeddings.vec_id = conv_id)"
)
_LEGAL_TOP = _top(fv.LEGAL_TOP_K, "embeddings", False, "rq")
_VERDICT_TOP = _boosted(_top(2 * fv.VERDICT_TOP_K, "embeddings", False, "rq"), fv.VERDICT_TOP_K)
add(
    "routed_search",
    f"""
WITH rq AS (SELECT * FROM {_ROUTED_QUERIES}),
s AS (SELECT query_id, rank, id, score FROM ({_LEGAL_TOP})),
v AS (SELECT query_id, rank, id, score FROM ({_VERDICT_TOP}))
SELECT query_id, route, CASE WHEN route = 'combined' THEN 'legal' ELSE route END AS source, rank, id,
  round(score, 6) AS score
FROM s JOIN rq ON rq.vec_id = query_id WHERE route <> 'verdict'
UNION ALL
SELECT query_id, route, 'verdict', rank, id, round(score, 6) FROM v JOIN rq ON rq.vec_id = query_id
WHERE route IN ('verdict', 'combined')
""",
)
_ARTICLES = """
  SELECT doc_id, CASE WHEN lang <> 'es' THEN ' QD ' || upper(source) END AS doc_number,
    CASE WHEN n_chars > 100 THEN 'Điều ' || (n_chars % 50) || 'A' END AS dieu,
    CASE WHEN lang = 'fr' THEN substr(text, 1, 30) END AS dieu_title,
    CASE WHEN lang = 'de' THEN source END AS doc_name, text AS content FROM documents
"""
_CORPUS_ID = (
    "nullif(replace(lower(trim(doc_number)), ' ', ''), '') || '+' || "
    "nullif(regexp_extract(lower(dieu), '(\\d+[a-z]?)', 1), '')"
)
add("corpus_ids", f"SELECT doc_id, {_CORPUS_ID} AS corpus_id FROM ({_ARTICLES})")
_UNIQUE = f"""
  SELECT *, {_CORPUS_ID} AS corpus_id FROM ({_ARTICLES}) WHERE corpus_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY corpus_id ORDER BY doc_id) = 1
"""


def _questions(seed: int) -> str:
    title, content = collapsed("dieu_title"), collapsed("content")
    cut = (
        f"CASE WHEN length({content}) > 180 THEN rtrim(substr({content}, 1, 180), {quoted(BLANKS)})"
        f" || '...' ELSE {content} END"
    )
    values = {
        "dieu_title": title,
        "dieu": collapsed("dieu"),
        "doc_name": collapsed("doc_name"),
        "doc_number": collapsed("doc_number"),
        "snippet": f"({cut})",
    }
    needs = {
        "title_how": f"{title} <> ''",
        "title_what": f"{title} <> ''",
        "article_in": "doc_name IS NOT NULL",
        "article_of": "doc_name IS NOT NULL",
        "article_number": "true",
        "content": f"{content} <> ''",
    }
    items = ", ".join(
        f"CASE WHEN {needs[n]} THEN {_filled(t, **values)} END"
        for n, t in fv.QUESTION_TEMPLATES.items()
    )
    return f"""
  SELECT corpus_id, list_filter([{items}], lambda q: q IS NOT NULL) AS qs,
    row_number() OVER (ORDER BY md5('{seed}' || corpus_id), corpus_id) AS position FROM ({_UNIQUE})
"""


def _fitting(words) -> str:
    tests = " OR ".join(f"contains(q, {quoted(w)})" for w in words)
    return f"coalesce(list_filter(qs, lambda q: {tests})[1], qs[1])"


add(
    "bench_queries",
    f"""
SELECT printf('int_%06d', position) AS query_id, {_fitting(fv.QUESTION_STYLE_WORDS["title"])} AS query_text,
  corpus_id FROM ({_questions(42)})
""",
)
add(
    "bench_queries_mixed",
    f"""
SELECT printf('int_%06d', position) AS query_id,
  qs[(('0x' || substr(md5('7' || corpus_id), 1, 8))::BIGINT % len(qs)) + 1] AS query_text, corpus_id
FROM ({_questions(7)}) WHERE position <= 100
""",
)
add(
    "bench_manifest",
    f"""
WITH a AS (SELECT *, {_CORPUS_ID} AS corpus_id FROM ({_ARTICLES})),
g AS (SELECT DISTINCT corpus_id FROM a
  WHERE corpus_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT count(*) AS total_points_scanned, count(*) FILTER (WHERE corpus_id IS NULL) AS payloads_missing_doc_or_dieu,
  count(*) FILTER (WHERE corpus_id IS NOT NULL AND corpus_id NOT IN (SELECT corpus_id FROM g))
    AS payloads_filtered_inactive,
  least(1000, (SELECT count(*) FROM g)) AS queries_generated FROM a
""",
)
add(
    "seeded_sample",
    """
SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42' || doc_id), doc_id) AS position
FROM documents QUALIFY position <= 200
""",
)
add(
    "seeded_order",
    """
SELECT o_orderkey, row_number() OVER (ORDER BY md5('42' || o_orderkey), o_orderkey) AS position FROM orders
""",
)
add(
    "stream_rolling_messages",
    """
SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns,
  md5(string_agg(text, chr(10) ORDER BY turn)) AS contents_md5 FROM (
  SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5)
GROUP BY conv_id
""",
)

"""Equivalent SQL for the chunkers: recursive split as list folds, derived documents."""

from __future__ import annotations

from lexgrove.functions import fixed_values as fv
from lexgrove.plans.bindings import STATUTE_HEADS, STATUTE_LINES, STATUTE_TAIL
from lexgrove.plans.oracles import CHUNK_ID, quoted, strip

CHUNKING_ORACLES: dict[str, str] = {}


def _cut(text: str, separator: str) -> str:
    if separator == "":
        return f"string_split({text}, '')"
    pattern = quoted("(" + separator + ")")
    marked = f"regexp_replace({text}, {pattern}, chr(65535) || '\\1', 'g')"
    return f"list_filter(string_split({marked}, chr(65535)), lambda y: y <> '')"


def _split(
    rows: str, key: str, separators, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP
) -> str:
    """``(key, content, chunk_index)`` of a recursive split of ``rows(key, text)``."""
    stages = [
        f"s0 AS (SELECT {key}, list_transform({_cut('text', separators[0])}, "
        f"lambda x: {{'t': x, 'o': false}}) AS ps FROM ({rows}))"
    ]
    mark = (
        "list_transform(ps, lambda p, i: {'t': p.t, 'o': p.o OR "
        f"(i > 1 AND coalesce(length(ps[i - 1].t), 0) >= {size})}})"
    )
    for n, separator in enumerate(separators[1:]):
        fresh = f"list_transform({_cut('p.t', separator)}, lambda x, i: {{'t': x, 'o': i = 1}})"
        cut = (
            "flatten(list_transform(ps, lambda p: "
            f"CASE WHEN length(p.t) >= {size} THEN {fresh} ELSE [p] END))"
        )
        stages.append(f"m{n} AS (SELECT {key}, {mark} AS ps FROM s{n})")
        stages.append(f"s{n + 1} AS (SELECT {key}, {cut} AS ps FROM m{n})")
    stages.append(f"ready AS (SELECT {key}, {mark} AS ps FROM s{len(separators) - 1})")
    joined = strip("array_to_string(a.open, '')")
    flush = f"CASE WHEN {joined} <> '' THEN list_append(a.out, {joined}) ELSE a.out END"
    over = f"(a.chars + length(p.t) > {size})"
    room = f"greatest(least({overlap}, {size} - length(p.t)), 0)"

    def chars(texts: str) -> str:
        return f"coalesce(list_sum(list_transform({texts}, lambda z: length(z))), 0)"

    tail = (
        "a.open[list_filter(range(1, len(a.open) + 2), "
        f"lambda j: {chars('a.open[j:]')} <= {room})[1]:]"
    )
    base = f"CASE WHEN p.o THEN []::VARCHAR[] WHEN {over} THEN {tail} ELSE a.open END"
    step = (
        f"{{'out': CASE WHEN p.o OR {over} THEN {flush} ELSE a.out END, "
        f"'open': list_append({base}, p.t), 'chars': {chars(base)}::BIGINT + length(p.t)}}"
    )
    start = "{'out': []::VARCHAR[], 'open': []::VARCHAR[], 'chars': 0::BIGINT}"
    return f"""
  WITH {", ".join(stages)},
  folded AS (SELECT {key}, list_reduce(ps, lambda a, p: {step}, {start}) AS a FROM ready),
  lists AS (SELECT {key}, {flush} AS parts FROM folded)
  SELECT {key}, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS chunk_index FROM lists
"""


def _chunk_id(owner: str) -> str:
    return CHUNK_ID.format(owner=owner, index="chunk_index::VARCHAR", content="content")


CHUNKING_ORACLES["packed_chunks"] = f"""
SELECT doc_id, chunk_index, content, {_chunk_id("doc_id::VARCHAR")} AS chunk_id
FROM ({_split("SELECT doc_id, text FROM documents", "doc_id", fv.PLAIN_SEPARATORS)})
"""

_PLAIN_LINES = r"""list_filter(list_transform(string_split(text, chr(10)),
    lambda l: trim(regexp_replace(l, '[^\p{L} ]+', ' ', 'g'))), lambda l: l <> '')"""

_DECREE_TEXT = """
  'CHÍNH PHỦ' || chr(10) || 'Nghị định số: ' || doc_id || '/2020/NĐ-CP' || chr(10)
  || 'Hà Nội, ngày 5 tháng 6 năm 2020' || chr(10) || array_to_string(list_transform(ls, lambda l, i:
    CASE WHEN (i - 1) % 7 = 0 THEN 'Chương ' || i || chr(10) || 'Tiêu đề ' || i || chr(10) ELSE '' END
    || 'Điều ' || i || '. ' || l), chr(10))"""
_DECREES = f"""
  SELECT doc_id || '/2020/NĐ-CP' AS doc, {strip(_DECREE_TEXT)} AS text
  FROM (SELECT doc_id, {_PLAIN_LINES} AS ls FROM documents)
"""
_AT_START, _ANYWHERE = quoted(fv.ARTICLE_AT_START), quoted(fv.ARTICLE_ANYWHERE)
_CHAPTER = quoted(fv.CHAPTER_PATTERNS[2])
CHUNKING_ORACLES["statute_articles"] = f"""
WITH c AS ({_split(_DECREES, "doc", fv.STATUTE_SEPARATORS)}),
o AS (SELECT *, nullif(regexp_extract(content, {_AT_START}, 1), '') AS a1,
    nullif(regexp_extract(substr(content, 1, 1000), {_ANYWHERE}, 1), '') AS a4,
    trim(regexp_extract(content, {_AT_START}, 2)) AS t1,
    trim(regexp_extract(substr(content, 1, 1000), {_ANYWHERE}, 2)) AS t4,
    nullif(regexp_extract(content, {_CHAPTER}, 1), '') AS ch,
    trim(regexp_extract(content, {_CHAPTER}, 2)) AS cht,
    upper(content) LIKE 'CHƯƠNG%' OR upper(content) LIKE 'CHÍNH PHỦ%' AS headed FROM c),
w AS (SELECT *, coalesce(a1, a4) AS own,
    last_value(coalesce(a1, a4) IGNORE NULLS) OVER p AS carried,
    last_value(ch IGNORE NULLS) OVER p AS chuong,
    last_value(CASE WHEN ch IS NOT NULL THEN cht END IGNORE NULLS) OVER p AS chuong_title
  FROM o WINDOW p AS (PARTITION BY doc ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, own IS NULL AND carried IS NOT NULL AND NOT headed AS cont FROM w)
SELECT {_chunk_id("doc")} AS chunk_id, doc AS doc_id, content, chunk_index,
  CASE WHEN chunk_index = 0 THEN 'header' ELSE 'content' END AS chunk_type, chuong, chuong_title,
  CASE WHEN cont THEN carried ELSE own END AS dieu,
  CASE WHEN cont THEN '(tiếp theo ' || carried || ')'
    WHEN a1 IS NOT NULL THEN CASE WHEN length(t1) >= 3 THEN t1 END
    WHEN a4 IS NOT NULL AND (t4 = '' OR length(t4) >= 3) THEN t4 END AS dieu_title,
  cont AS is_continuation, 'Nghị định' AS doc_type, 'Chính phủ' AS issuing_agency,
  '2020-06-05' AS signing_date
FROM x
"""


def _texts(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def _any(c: str, needles) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(n)})" for n in needles) + ")"


# what each head of a written-out statute says: type, number, title, issuer, day of signing, day of effect
_TOLD = """(VALUES
  (0, 'Luật', '/2005/QH11', 'Luật Sở Hữu Trí Tuệ', 'Quốc hội', '2005-11-29', '2006-07-01'),
  (1, 'Thông tư liên tịch', '/2011/TTLT', NULL, 'Bộ Tài chính', '2011-04-03', '2011-05-18'),
  (2, 'Thông tư', '/2012/TT-BYT', NULL, 'Bộ Y Tế', '2012-08-07', '2012-08-07'),
  (3, 'Bộ luật', '/2015/QH13', 'Luật Dân Sự', 'Quốc hội', NULL, NULL),
  (4, 'Quyết định', '/2016/QĐ-BVH', NULL, 'Bộ Văn hóa, Thể thao và Du lịch', '2016-10-09', NULL),
  (5, 'Văn bản pháp luật', NULL, NULL, NULL, NULL, NULL),
  (6, 'Nghị định', '/2013/NĐ-CP', NULL, 'Chính phủ', '2013-02-01', NULL)
) AS told(form, doc_type, ending, title, issuing_agency, signing_date, effective_date)"""
_FORMS = f"""
  SELECT doc_id, {strip(f"""array_to_string(list_concat([replace(replace(({_texts(STATUTE_HEADS)})[doc_id % {len(STATUTE_HEADS)} + 1],
      'Trang 12' || chr(10), ''), '{{id}}', doc_id::VARCHAR)],
    [array_to_string(list_transform(ls, lambda l, i: replace(({_texts(STATUTE_LINES)})[(i - 1) % {len(STATUTE_LINES)} + 1],
      '{{n}}', i::VARCHAR) || l), chr(10))], [{quoted(STATUTE_TAIL)}]), chr(10))""")} AS text
  FROM (SELECT doc_id, {_PLAIN_LINES} AS ls FROM documents)
"""
CHUNKING_ORACLES["statute_forms"] = rf"""
WITH c AS ({_split(_FORMS, "doc_id", fv.STATUTE_SEPARATORS, 250, 40)}),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total, upper(substr(content, 1, 800)) AS top,
    nullif(regexp_extract(content, '^(Điều\s+\d+[a-z]?)\.?\s*([^
]*)', 1), '') AS a1,
    trim(regexp_extract(content, '^(Điều\s+\d+[a-z]?)\.?\s*([^
]*)', 2)) AS t1,
    nullif(regexp_extract(substr(content, 1, 500), '(\d+)\.\s*(Điều\s+\d+[a-z]?)\s+được\s+sửa\s+đổi', 2), '') AS a2,
    nullif(regexp_extract(substr(content, 1, 500), '^["'']?(Điều\s+\d+[a-z]?)\.?\s*([^"''
]*)["'']?', 1), '') AS a3,
    trim(regexp_extract(substr(content, 1, 500), '^["'']?(Điều\s+\d+[a-z]?)\.?\s*([^"''
]*)["'']?', 2)) AS t3,
    nullif(regexp_extract(substr(content, 1, 1000), '(Điều\s+\d+[a-z]?)\.?\s*([^
]{{0,100}})', 1), '') AS a4,
    trim(regexp_extract(substr(content, 1, 1000), '(Điều\s+\d+[a-z]?)\.?\s*([^
]{{0,100}})', 2)) AS t4,
    nullif(regexp_extract(content, '(?i)(PHẦN THỨ\s+[\p{{L}}\p{{N}}_]+)', 1), '') AS phan,
    nullif(regexp_extract(content, '(?i)(Mục\s+\d+)', 1), '') AS muc,
    [{{'c': regexp_extract(content, '(Chương\s+[IVXLC]+)[:\s]*
', 1), 't': 'TÊN CHƯƠNG'}},
     {{'c': regexp_extract(content, '(CHƯƠNG\s+[IVXLC]+)[:\s]*
', 1), 't': 'PHẠM VI'}},
     {{'c': regexp_extract(content, '(Chương\s+\d+)[:\s]*
\s*[^
]+', 1), 't': 'Tiêu đề'}}] AS forms
  FROM c),
o AS (SELECT *, coalesce(a1, a2, a3, a4) AS dieu, list_filter(forms, lambda f: f.c <> '')[1] AS chapter,
    CASE WHEN a1 IS NOT NULL THEN CASE WHEN length(t1) >= 3 THEN t1 END
      WHEN a2 IS NOT NULL THEN 'sửa đổi, bổ sung' WHEN a3 IS NOT NULL THEN nullif(t3, '')
      WHEN a4 IS NOT NULL AND (t4 = '' OR (length(t4) >= 3 AND NOT starts_with(t4, 'của') AND NOT starts_with(t4, 'và')))
      THEN t4 END AS own_title,
    regexp_matches(upper(content), '^(CHƯƠNG|PHẦN|MỤC|QUỐC HỘI|CHÍNH PHỦ|BỘ )') AS headed
  FROM n),
w AS (SELECT * EXCLUDE (phan, muc), last_value(phan IGNORE NULLS) OVER p AS phan, last_value(muc IGNORE NULLS) OVER p AS muc,
    last_value(chapter IGNORE NULLS) OVER p AS held, last_value(dieu IGNORE NULLS) OVER p AS carried
  FROM o WINDOW p AS (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)),
x AS (SELECT w.*, told.*, source || '-' || w.doc_id AS stem, w.doc_id || ending AS number,
    dieu IS NULL AND carried IS NOT NULL AND NOT headed AS cont
  FROM w JOIN documents USING (doc_id) JOIN {_TOLD} ON form = w.doc_id % 7),
y AS (SELECT * EXCLUDE (doc_id), coalesce(number, stem || '.txt') AS doc FROM x)
SELECT {_chunk_id("doc")} AS chunk_id, doc AS doc_id, stem || '.txt' AS filename, content, chunk_index,
  CASE WHEN chunk_index = 0 OR (chunk_index < 3 AND NOT regexp_matches(content, 'Điều\s+\d+') AND
      {_any("top", ["QUỐC HỘI", "CHÍNH PHỦ", "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "ĐỘC LẬP - TỰ DO - HẠNH PHÚC", "NƯỚC CỘNG HÒA"])}) THEN 'header'
    WHEN {_any("top", ["PHỤ LỤC", "BIỂU MẪU", "MẪU SỐ", "DANH MỤC"])} THEN 'appendix'
    WHEN chunk_index >= total - 3 AND regexp_matches(content, '(?i)TM\.|T\.M\.|THAY MẶT|CHỦ TỊCH|BỘ TRƯỞNG|THỦ TƯỚNG|Nơi nhận') THEN 'signature'
    ELSE 'content' END AS chunk_type,
  phan, held.c AS chuong, held.t AS chuong_title, muc, CASE WHEN cont THEN carried ELSE dieu END AS dieu,
  CASE WHEN cont THEN '(tiếp theo ' || carried || ')' ELSE own_title END AS dieu_title, cont AS is_continuation,
  coalesce(title, stem) AS doc_name, doc_type, coalesce(number, '') AS doc_number, issuing_agency, signing_date,
  effective_date, 'active' AS status
FROM y
"""

CHUNKING_ORACLES["verdict_items"] = f"""
WITH j AS (SELECT doc_id || '/2020/DS-ST' AS id, source, {_PLAIN_LINES} AS ls FROM documents),
l AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM j),
t AS (
  SELECT id, n, (n - 1) % 3 AS part, CASE (n - 1) % 3
    WHEN 0 THEN 'Nguyên đơn A trình bày: ' || line WHEN 1 THEN '[' || n || '] ' || line
    ELSE n || '. ' || line END AS content, count(*) OVER (PARTITION BY id, (n - 1) % 3) AS same,
    max(n) OVER (PARTITION BY id, (n - 1) % 3) AS last FROM l),
r AS (
  SELECT id, 0 AS s, 0 AS n, 'TÒA ÁN NHÂN DÂN TỈNH A' || chr(10) || 'Bản án số: ' || id || chr(10)
    || 'Ngày 3 tháng 4 năm 2020' || chr(10) || 'V/v: Tranh chấp nhãn hiệu' || chr(10)
    || '- Nguyên đơn: Ông ' || source || chr(10) || '- Bị đơn: Bà B;' AS content,
    'header' AS section_type, '' AS party_role, '' AS point_number, '' AS item_number FROM j
  UNION ALL SELECT id, 1, n, content, 'fact', 'nguyên đơn', '', '' FROM t WHERE part = 0
  UNION ALL SELECT id, 2, n, content || CASE WHEN n = last THEN chr(10) || 'Vì các lẽ trên,' ELSE '' END,
    'reasoning', '', '[' || n || ']', '' FROM t WHERE part = 1
  UNION ALL SELECT id, 2, 0, 'Vì các lẽ trên,', 'reasoning', '', '', '' FROM j
    WHERE id NOT IN (SELECT id FROM t WHERE part = 1)
  UNION ALL SELECT id, 3, n, content, 'decision_item', '', '',
    CASE WHEN same > 1 THEN n || '.' ELSE '' END FROM t WHERE part = 2),
k AS (SELECT *, regexp_replace(content, ' {{3,}}', '  ', 'g') AS body,
    row_number() OVER (PARTITION BY id ORDER BY s, n) - 1 AS chunk_index FROM r)
SELECT 'v_' || substr(md5('v_' || id || '_' || chunk_index || '_' || body), 1, 16) AS vchunk_id,
  id AS verdict_id, chunk_index, body AS content, section_type, party_role, point_number, item_number,
  'TÒA ÁN NHÂN DÂN TỈNH A' AS court_name, '2020-04-03' AS judgment_date, 'sơ thẩm' AS trial_level,
  'Ông ' || source AS plaintiff, 'Bà B' AS defendant, 'nhãn hiệu' AS ip_types,
  'Bản án số ' || id || ', Tranh chấp nhãn hiệu, giữa Ông ' || source
    || ' và Bà B, cấp sơ thẩm, tại TÒA ÁN NHÂN DÂN TỈNH A' AS summary
FROM k JOIN j USING (id)
"""

_RELATION = "CASE section_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fv.SECTION_RELATIONS) + " END"


def _tables(rows: str, corpus: str, chunk: str, doc: str, label: str) -> str:
    return f"""
SELECT '{corpus}' AS corpus, 'document' AS kind, {doc} AS src, NULL AS dst, {label} AS label FROM {rows} GROUP BY ALL
UNION ALL SELECT '{corpus}', 'chunk', {chunk}, {doc}, (row_number() OVER w - 1)::VARCHAR FROM {rows} WINDOW w AS (PARTITION BY {doc} ORDER BY chunk_index)
UNION ALL SELECT * FROM (
  SELECT '{corpus}', 'next', {chunk}, lead({chunk}) OVER (PARTITION BY {doc} ORDER BY chunk_index) AS dst, NULL FROM {rows}) WHERE dst IS NOT NULL
UNION ALL SELECT '{corpus}', 'broken', NULL, NULL, (count(*) - count(DISTINCT {chunk}))::VARCHAR FROM {rows}"""


CHUNKING_ORACLES["corpus_tables"] = f"""
WITH legal AS ({CHUNKING_ORACLES["statute_articles"]}), verdict AS ({CHUNKING_ORACLES["verdict_items"]})
{_tables("legal", "legal", "chunk_id", "doc_id", "concat_ws('|', doc_type, issuing_agency, signing_date, 'active')")}
UNION ALL {_tables("verdict", "verdict", "vchunk_id", "verdict_id", "concat_ws('|', court_name, judgment_date, plaintiff, ip_types)")}
UNION ALL SELECT 'verdict', 'typed', vchunk_id, verdict_id, {_RELATION} FROM verdict WHERE {_RELATION} IS NOT NULL
"""

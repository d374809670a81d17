"""SQL of the queries on cutting, ranking and licences."""

from __future__ import annotations

import re

from lexgrove.llm.license_templates import PHRASES, TEMPLATES

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _pattern(template: str) -> tuple[str, int]:
    """A template as a pattern over words that are each followed by a blank, and its mandatory words."""
    pieces, depth, n = ["(?:^| )"], 0, 0
    for piece in re.findall(r"<<[^>]*>>|[a-z0-9]+", template.lower().replace("beginoptional", "(").replace("endoptional", ")")):
        if piece == "<<(>>":
            pieces.append("(?:")
            depth += 1
        elif piece == "<<)>>":
            pieces.append(")?")
            depth -= 1
        elif piece.startswith("<<var"):
            low, high = re.findall(r"\d+", piece)
            pieces.append(f"(?:[^ ]+ ){{{low},{high}}}")
        else:
            pieces.append(f"{piece} ")
            n += depth == 0
    return "".join(pieces), n


def _license_sql() -> str:
    wordings = [(label, text) for named in (PHRASES, TEMPLATES) for label, texts in named.items() for text in texts]
    cases, scores = [], []
    for label, text in wordings:
        pattern, n = _pattern(text)
        cases.append(f"CASE WHEN regexp_matches(joined, '{pattern}') THEN '{label}' END")
        scores.append(f"CASE WHEN regexp_matches(joined, '{pattern}') THEN {n} / {n + 1}.0::DOUBLE ELSE 0 END")
    leads = ", ".join(f"lead(word, {i}) OVER o AS w{i}" for i in range(1, 3))
    starts = []
    for label, texts in PHRASES.items():
        for text in texts:
            words = text.split()
            test = " AND ".join(f"{f'w{i}' if i else 'word'} = '{w}'" for i, w in enumerate(words))
            starts.append(f"CASE WHEN {test} THEN '{label}' END")
    return f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents),
        w AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS n FROM d),
        l AS (SELECT row, n, word, {leads} FROM w WINDOW o AS (PARTITION BY row ORDER BY n)),
        p AS (SELECT row, n, unnest([{", ".join(starts)}]) AS label FROM l WHERE word IN ('mit', 'apache', 'general')),
        b AS (
            SELECT row, count(*) AS n_base, min(n) AS first_word, max(n) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
            FROM p WHERE label IS NOT NULL GROUP BY row),
        j AS (SELECT row, doc_id, len(words) AS n_words, array_to_string(words, ' ') || ' ' AS joined FROM d)
        SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_filter([{", ".join(cases)}], lambda x: x IS NOT NULL))), ','), '')
                   AS labels,
               greatest({", ".join(scores)}) AS score
        FROM j LEFT JOIN b USING (row)"""


LATER_ORACLES = {
    "op11_fill_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
                   sha256('7:' || doc_id) AS hex FROM documents),
        h AS (
            SELECT *, len(lines) AS n, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
                   ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM d),
        c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR regexp_matches(text, '<P>|<S>|<M>') THEN 'plain'
                        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
        s AS (
            SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
                   array_to_string(lines[b + 1:n], '') AS suffix FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM s""",
    "op12_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents),
        q AS (SELECT item_id, unnest(list_distinct({_WORDS})) AS word FROM benchmark),
        t AS (SELECT count(*) AS total, sum(len(words))::BIGINT AS length FROM d WHERE len(words) > 0),
        w AS (SELECT row, doc_id, len(words) AS n, unnest(words) AS word FROM d),
        f AS (
            SELECT row, doc_id, n, word, count(*) AS tf FROM w WHERE word IN (SELECT word FROM q) GROUP BY row, doc_id, n, word),
        i AS (
            SELECT word, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
            FROM f, t GROUP BY word, total),
        s AS (
            SELECT item_id, row, doc_id,
                   sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * total) // length))))::BIGINT AS score
            FROM f JOIN i USING (word) JOIN q USING (word), t GROUP BY item_id, row, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op13_license_scan": _license_sql(),
}

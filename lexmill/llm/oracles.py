"""DuckDB counterparts of queries whose definition SQL can express; they share no method with the operators."""

from __future__ import annotations

from lexmill.llm.lookalike import GUJARATI_LIKE, fold_table
from lexmill.plans.sql import WS


def folded(texts: str) -> str:
    """CTE ``folded(text, s)``: what the distinct texts of a CTE ``texts`` look like, by a table of code points."""
    rows = ",".join(f"({ord(ch)},[{','.join(str(ord(c)) for c in to)}]::INT[])" for ch, to in sorted(fold_table().items()))
    composed = "nfc_normalize(string_agg(chr(c), '' ORDER BY pos, sub))"
    for whole, parts in GUJARATI_LIKE.items():
        composed = f"replace({composed}, '{parts}', '{whole}')"
    return f"""fold(cp, parts) AS (VALUES {rows}),
    chars AS (SELECT text, unnest(range(len(a))) AS pos, ord(unnest(a)) AS cp FROM (SELECT text, regexp_extract_all(text, '(?s).') AS a FROM (SELECT DISTINCT text FROM {texts} WHERE text <> ''))),
    points AS (SELECT text, pos, unnest(parts) AS c, unnest(range(len(parts))) AS sub FROM (SELECT text, pos, coalesce(parts, [cp]) AS parts FROM chars LEFT JOIN fold USING (cp))),
    looks AS (SELECT text, {composed} AS s FROM points GROUP BY text),
    folded AS (SELECT t.text, coalesce(regexp_replace(regexp_replace(s, ' +', ' ', 'g'), '^ | $', '', 'g'), '') AS s FROM (SELECT DISTINCT text FROM {texts} WHERE text IS NOT NULL) t LEFT JOIN looks USING (text))"""


#: Pairs of different texts of a field that look the same.
P4_FOUND = f"""WITH rows AS (SELECT id, 'sentence_a' AS field, sentence_a AS text FROM items UNION ALL SELECT id, 'sentence_b', sentence_b FROM items),
    {folded('rows')}, shown AS (SELECT id, field, text, s FROM rows JOIN folded USING (text))
    SELECT DISTINCT a.id AS id_1, b.id AS id_2, a.field FROM shown a JOIN shown b ON a.field = b.field AND a.s = b.s AND a.id < b.id AND a.text <> b.text"""

_BREAK = rf"[-\x{{2010}}\x{{2011}}\x{{ad}}]{WS}*[\r\n\x{{2028}}\x{{2029}}]{WS}*"
#: Documents that hold eight words in a row of a test sentence.
P5_FOUND = rf"""WITH sentences AS (SELECT test_id, sentence_a AS raw FROM en_sts_test UNION ALL SELECT test_id, sentence_b FROM en_sts_test),
    texts AS (SELECT regexp_replace(raw, '{_BREAK}', '', 'g') AS text FROM (SELECT raw FROM sentences UNION ALL SELECT text FROM documents) WHERE raw IS NOT NULL),
    {folded('texts')},
    worded AS (SELECT text, list_filter(string_split(regexp_replace(regexp_replace(lower(s), '[-''’`\x{{2011}}]', '', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM folded),
    windows AS (SELECT text, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')))) AS win FROM worded WHERE len(w) >= 8),
    asked AS (SELECT DISTINCT test_id, win FROM sentences JOIN windows ON text = regexp_replace(raw, '{_BREAK}', '', 'g'))
    SELECT DISTINCT doc_id, test_id FROM (SELECT doc_id, regexp_replace(text, '{_BREAK}', '', 'g') AS text FROM documents) JOIN windows USING (text) JOIN asked USING (win)"""

#: The mode of the annotators that agree with the plain majority on most of their whole labels.
P2_FOUND = """WITH last AS (SELECT item_id, annotator_id, arg_max(label, (coalesce(created_at, TIMESTAMP '1900-01-01'), id)) AS label FROM annotations
      WHERE item_id IS NOT NULL AND annotator_id IS NOT NULL GROUP BY 1, 2),
    given AS (SELECT item_id, annotator_id, label FROM last WHERE label BETWEEN 0 AND 5 AND label * 2 = floor(label * 2)),
    votes AS (SELECT item_id, label, count(*) AS n FROM given WHERE label = floor(label) GROUP BY 1, 2),
    majority AS (SELECT item_id, arg_max(label, n) AS label FROM votes GROUP BY item_id HAVING count(*) = 1 OR max(n) > list_sort(list(n), 'DESC')[2]),
    rates AS (SELECT annotator_id, avg(CASE WHEN g.label = m.label THEN 1.0 ELSE 0.0 END) AS rate FROM given g JOIN majority m USING (item_id) GROUP BY annotator_id),
    best AS (SELECT item_id, label, count(*) AS n FROM given JOIN rates USING (annotator_id) WHERE rate >= 0.6 AND label = floor(label) GROUP BY 1, 2),
    rated AS (SELECT item_id FROM given GROUP BY item_id HAVING count(*) >= 3)
    SELECT item_id, arg_max(label, n)::INT AS label FROM rated JOIN best USING (item_id) GROUP BY item_id"""

"""Pieces of DuckDB SQL that several oracle queries share."""

from __future__ import annotations

WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"\p{L}\p{M}\p{N}\p{Pc}"
PRETOKEN = rf"[{WORD}]+|[^{WORD}{WS[1:-1]}]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def normalize(x: str) -> str:
    return collapse(f"nfc_normalize({x})")


def _lines(x: str) -> str:
    return rf"regexp_split_to_array({x}, '\r\n|\r|\n')"


LINES = f"""
raw_lines AS (SELECT doc_id, source, lang, unnest(range(len(a)))::BIGINT AS pos, unnest(a) AS raw
              FROM (SELECT doc_id, source, lang, {_lines("nfc_normalize(text)")} AS a FROM documents WHERE text IS NOT NULL)),
lines AS (SELECT * FROM (SELECT doc_id, source, lang, pos, {collapse("raw")} AS text FROM raw_lines) WHERE text <> '')"""

_KEPT = f"list_filter(list_transform({_lines('nfc_normalize(text)')}, lambda x: {strip('x')}), lambda x: x <> '' AND NOT regexp_full_match(x, '\\p{{Nd}}+'))"
_FOLDED = f"regexp_replace(replace(replace(array_to_string({_KEPT}, chr(10)), '-' || chr(10), ''), chr(10), ' '), '{WS}{{2,}}', ' ', 'g')"
_CUT = f"""string_split(regexp_replace({_FOLDED}, '([.!?…]){WS}+([A-ZА-ЯЁ«"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"""
SENTENCES = f"""
cut AS (SELECT doc_id, list_filter(list_transform({_CUT}, lambda x: {strip('x')}), lambda x: length(x) >= 20) AS a FROM documents WHERE text IS NOT NULL),
sentences AS (SELECT doc_id, unnest(range(len(a)))::BIGINT AS pos, unnest(a) AS text FROM cut)"""

HELD_OUT = f"held_out AS (SELECT DISTINCT {normalize('t')} AS text FROM (SELECT sentence_a AS t FROM en_sts_test UNION ALL SELECT sentence_b FROM en_sts_test) WHERE t IS NOT NULL)"

DISTINCT_TEXTS = f"texts AS (SELECT t AS text, min(doc_id) AS id FROM (SELECT doc_id, {normalize('text')} AS t FROM documents) WHERE t <> '' GROUP BY t)"
SHINGLES = """
worded AS (SELECT id, text, string_split(text, ' ') AS w FROM texts),
shingles AS (SELECT id, unnest(CASE WHEN len(w) < 5 THEN [text] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS s FROM worded)"""

LAST_LABEL = "last_label AS (SELECT item_id, annotator_id, arg_max(label, id) AS label FROM annotations GROUP BY 1, 2)"
MEANS = "means AS (SELECT item_id, count(*) AS n_labels, avg(label) AS mean_label FROM annotations WHERE label IS NOT NULL GROUP BY item_id)"


def hash_number(seed: str, key: str) -> str:
    return f"('0x' || substr(sha1('{seed}|' || {key}), 1, 12))::BIGINT"


INDEXED = f"{LINES}, indexed AS (SELECT text, row_number() OVER (ORDER BY doc_id, pos) - 1 AS idx, count(*) OVER () AS n FROM lines)"


def random_pairs(n_pairs: int, seed: int) -> str:
    return f"""
places AS (SELECT pair, {hash_number(f"{seed}i", "pair")} % n AS i, {hash_number(f"{seed}j", "pair")} % (n - 1) AS shift, n
           FROM (SELECT unnest(range({n_pairs})) AS pair), (SELECT max(n) AS n FROM indexed)),
random_pairs AS (SELECT pair, a.text AS a, b.text AS b FROM places JOIN indexed a ON a.idx = i JOIN indexed b ON b.idx = (i + 1 + shift) % places.n)"""

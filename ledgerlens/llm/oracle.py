"""The registered queries of this folder as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from ledgerlens.llm.licenses import SPELLINGS, known_digests


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_ESC = "replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), ']', '&rsqb;')"

OP4 = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESC.format('role')}) + length({_ESC.format('text')}) + 9)::BIGINT AS formatted_chars
FROM rows_ WHERE conv_id IS NOT NULL GROUP BY conv_id
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_spell = "map_from_entries([" + ", ".join(f"({_text(a)}, {_text(b)})" for a, b in SPELLINGS.items()) + "])"
_known = ", ".join(
    f"({_text(d)}, {_text(i)})" for d, i in sorted({d: min(j for j, e in known_digests() if e == d) for _, d in known_digests()}.items())
)
_no, _end = r"[^\p{L}\p{N}]*", r"($|[^\p{L}\p{N}_])"
_copyright = f"^{_no}(copyright{_no}(©|c{_end}|[0-9]{{4}}|by{_end}|year{_end})|\\(c\\){_no}[0-9]{{4}}|©|all rights reserved{_end})"
OP10 = rf"""
WITH known(digest, license_id) AS (VALUES {_known}),
spelling AS (SELECT {_spell} AS m),
lines AS (
  SELECT doc_id, list_filter(string_split(lower(coalesce(text, '')), chr(10)),
    lambda l: NOT regexp_matches(l, '{_copyright}')) AS raw
  FROM documents
), words AS (
  SELECT doc_id, list_filter(list_transform(raw, lambda l: list_transform(regexp_extract_all(l, '[\p{{L}}\p{{N}}]+'),
    lambda w: coalesce(m[w], w))), lambda x: len(x) > 0) AS lines
  FROM lines, spelling
), hashed AS (
  SELECT doc_id, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(flatten(lines), ' ')) END AS digest,
    list_distinct(list_transform(lines, lambda x: sha256(array_to_string(x, ' ')))) AS each FROM words
), found AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses
  FROM (SELECT doc_id, unnest(each) AS digest FROM hashed) JOIN known USING (digest) GROUP BY doc_id
)
SELECT h.doc_id, h.digest, k.license_id, coalesce(f.line_licenses, '') AS line_licenses
FROM hashed h LEFT JOIN known k USING (digest) LEFT JOIN found f ON f.doc_id = h.doc_id
"""

#: Dense: every kept term against every group of its lang, without collapsing copies or leaving out absent terms.
OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' .', '[^\x00-\x40\x5B-\x60\x7B-\x7F]+|[.]$')) AS term
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM d WHERE term <> '.' GROUP BY ALL HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY ALL),
uses AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM d JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM uses GROUP BY ALL),
of_lang AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM uses GROUP BY ALL),
q AS (
  SELECT lang, term, 1 + (1000000000 * (c + 1)) // (n + v) AS q
  FROM of_lang JOIN (SELECT lang, sum(c)::HUGEINT AS n FROM of_lang GROUP BY ALL) USING (lang) JOIN v USING (lang)),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 1)) // (coalesce(n, 0) + v) AS p
  FROM groups g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN uses USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms
QUALIFY rank <= 200
"""

OP13 = r"""
WITH d AS (
  SELECT i, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, * FROM documents)),
item AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
tf AS (SELECT i, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
size AS (SELECT i, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM size),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term),
scored AS (
  SELECT item_id, i, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // len)))))::BIGINT AS score
  FROM item JOIN tf USING (term) JOIN w USING (term) JOIN size USING (i), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 10
"""

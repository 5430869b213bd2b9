"""SQL counterparts of the registered queries, for DuckDB."""

from pairforge.llm.license_scan import CONTAINED, SHINGLE, TEMPLATES

OP1_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS pos FROM split WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM split
  UNION
  SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a
),
comp AS (SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN sizes USING (doc_id)
"""

OP9_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
),
item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[pos:pos + size - 1], ' ') AS gram
  FROM (
    SELECT item_id, words, least(10, len(words)) AS size,
      unnest(range(1, greatest(len(words) - 8, 2))) AS pos
    FROM item_words WHERE len(words) > 0
  )
),
doc_words AS (
  SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
doc_windows AS (
  SELECT doc_id, size, pos, array_to_string(words[pos:pos + size - 1], ' ') AS gram
  FROM (
    SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos
    FROM doc_words, (SELECT DISTINCT size FROM item_windows) WHERE len(words) >= size
  )
),
hits AS (
  SELECT doc_id, pos, size, item_id FROM doc_windows JOIN item_windows USING (size, gram)
),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS pos FROM hits) GROUP BY doc_id
),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP10_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
word AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM split
),
starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM split WHERE len(words) >= 13
),
windows AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS gram FROM starts),
firsts AS (SELECT gram, min(doc_id) AS first_id FROM windows GROUP BY gram),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos
  FROM windows JOIN firsts USING (gram) WHERE first_id < doc_id
),
judged AS (
  SELECT word.doc_id, word.pos, word.word, gone.pos IS NOT NULL AS cut FROM word LEFT JOIN gone USING (doc_id, pos)
),
kept AS (
  SELECT doc_id, count(*) FILTER (cut) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT cut), '') AS kept_text
  FROM judged GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept_text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

_NOTICES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
OP5_SQL = rf"""
WITH notices(license, text) AS (VALUES {_NOTICES}),
doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS words
  FROM documents
),
notice_words AS (
  SELECT license, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS words FROM notices
),
doc_grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos:pos + {SHINGLE - 1}], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {SHINGLE - 2})) AS pos FROM doc_words WHERE len(words) >= {SHINGLE})
),
notice_grams AS (
  SELECT DISTINCT license, array_to_string(words[pos:pos + {SHINGLE - 1}], ' ') AS gram
  FROM (SELECT license, words, unnest(range(1, len(words) - {SHINGLE - 2})) AS pos FROM notice_words)
),
wanted AS (SELECT license, count(*) AS n FROM notice_grams GROUP BY license),
shared AS (SELECT doc_id, license, count(*) AS n FROM doc_grams JOIN notice_grams USING (gram) GROUP BY 1, 2),
found AS (
  SELECT doc_id, count(*) AS n_licenses, string_agg(license, ',' ORDER BY license) AS licenses
  FROM shared JOIN wanted USING (license) WHERE 100 * shared.n >= {CONTAINED} * wanted.n GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses
FROM doc_words LEFT JOIN found USING (doc_id)
"""

_ANY_CASE = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")
)
_SECRET_PATTERNS = {
    "assign": rf"(?:{_ANY_CASE})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "github": "gh[pousr]_[A-Za-z0-9]{36}",
    "npm": "npm_[A-Za-z0-9]{36}",
    "nostr": "nsec1[ac-hj-np-z02-9]{58}",
    "age": "AGE-SECRET-KEY-1[AC-HJ-NP-Z02-9]{58}",
}
_SECRET_HITS = " UNION ALL ".join(
    rf"""
  SELECT doc, {code} AS code, '{kind}' AS kind, hits[i] AS hit,
    CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
      + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS start
  FROM (
    SELECT doc, gaps, hits, unnest(range(1, len(hits) + 1)) AS i
    FROM (SELECT doc, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits FROM docs)
  )"""
    for code, (kind, pattern) in enumerate(_SECRET_PATTERNS.items())
)
# Checksums: CRC-32 byte by byte from its table, six digits of base 62; the code of BIP 173 symbol by symbol.
OP11_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8),
    lambda acc, step: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END)) AS entries
),
hits AS ({_SECRET_HITS}
),
judged AS (
  SELECT hits.*, CASE
    WHEN kind = 'assign' THEN length(regexp_extract(hit, '{_SECRET_PATTERNS["assign"]}', 1)) >= 8
    WHEN kind = 'access' THEN length(hit) >= 16
    WHEN kind = 'hex' THEN length(hit) >= 32
    WHEN kind IN ('github', 'npm') THEN hit[-6:] = array_to_string(list_transform([5, 4, 3, 2, 1, 0],
      lambda place: '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'[
        CAST(xor(list_reduce([4294967295] || list_transform(string_split(hit[-36:-7], ''), lambda c: CAST(ascii(c) AS BIGINT)),
          lambda acc, b: xor(acc >> 8, entries[(xor(acc, b) & 255) + 1])), 4294967295)
        // CAST(pow(62, place) AS BIGINT) % 62 AS INT) + 1]), '')
    ELSE 1 = list_reduce([1::BIGINT]
        || list_transform(string_split(lower(hit)[:-60], ''), lambda c: CAST(ascii(c) >> 5 AS BIGINT)) || [0::BIGINT]
        || list_transform(string_split(lower(hit)[:-60], ''), lambda c: CAST(ascii(c) & 31 AS BIGINT))
        || list_transform(string_split(lower(hit)[-58:], ''), lambda c: CAST(position(c IN 'qpzry9x8gf2tvdw0s3jn54khce6mua7l') - 1 AS BIGINT)),
      lambda acc, v: xor(xor(xor(xor(xor(xor((acc & 33554431) << 5, v),
        996825010 * (acc >> 25 & 1)), 642813549 * (acc >> 26 & 1)), 513874426 * (acc >> 27 & 1)),
        1027748829 * (acc >> 28 & 1)), 705979059 * (acc >> 29 & 1)))
    END AS good
  FROM hits, crc
),
spans AS (
  SELECT doc, code, start, kind, kind || ':' || start || ':' || (start + length(hit)) AS span FROM judged WHERE good
),
found AS (
  SELECT doc, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, code) FILTER (code < 3) AS base,
    string_agg(span, ',' ORDER BY start, code) AS spans
  FROM spans GROUP BY doc
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (doc)
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, false) AS copied
  FROM documents
),
told AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN copied THEN 16 ELSE 0 END AS fails
  FROM docs LEFT JOIN told USING (doc_id)
),
counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM judged GROUP BY part, fails
),
letter(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps AS (
  SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
  FROM (SELECT filter_order, bits, unnest([1, 2, 3, 4, 5]) AS step FROM orders)
),
outcome AS (
  SELECT part, filter_order, step, own, n, n_good, n_toxic, fails, fails & own <> 0 AS failing, fails & before <> 0 AS gone
  FROM counts, steps
),
audit AS (
  SELECT part, filter_order, step, own,
    CAST(coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (failing AND gone), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n_good) FILTER (failing AND NOT gone), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n_toxic) FILTER (failing AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM outcome GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM audit
"""

# CRC-32 by its table, as in the query before; a node is told by the digest of its turns' digests.
OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8),
    lambda acc, step: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END)) AS entries
),
turns AS (
  SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos
  FROM (
    SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL
  )
),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
grafts AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda acc, b: xor(acc >> 8, entries[(xor(acc, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM sizes, crc
),
rebuilt AS (
  SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth
  FROM (
    SELECT g.conv_id, t.digest, t.size, t.pos, false AS own FROM grafts g JOIN turns t ON t.conv_id = g.base AND t.pos < g.h
    UNION ALL
    SELECT g.conv_id, t.digest, t.size, t.pos, true FROM grafts g JOIN turns t ON t.conv_id = g.conv_id AND t.pos >= g.h
  )
),
places AS (
  SELECT conv_id, depth, size, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM sizes
),
ends AS (
  SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM places GROUP BY conv_id) GROUP BY node
),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n, any_value(size) AS size FROM places GROUP BY node
),
linked AS (
  SELECT nodes.*, above.node AS parent, up.conv_id AS parent_conv_id
  FROM nodes
  LEFT JOIN places above ON above.conv_id = nodes.conv_id AND above.depth = nodes.depth - 1
  LEFT JOIN nodes up ON up.node = above.node
),
kids AS (SELECT parent AS node, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT top.node, CAST(count(*) FILTER (kids.node IS NULL) AS BIGINT) AS n_leaves, CAST(sum((nodes.n - 1) * nodes.size) AS BIGINT) AS saved_tokens
  FROM nodes JOIN places top ON top.conv_id = nodes.conv_id AND top.depth <= nodes.depth LEFT JOIN kids ON kids.node = nodes.node
  GROUP BY top.node
)
SELECT conv_id, depth, parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM linked JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node)
"""

ORACLES: dict[str, str] = {
    "op1_minhash_dedup": OP1_SQL,
    "op5_license_scan": OP5_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_secret_scan": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}

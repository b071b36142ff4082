"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from coverset.llm.licenses import OWN, PHRASES, SPELLINGS, known_digests
from coverset.llm.sharding import KEYS, MULTIPLIERS, PRIME

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9
), reach(id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id)::BIGINT AS n_links,
       c.comp AS component_id, c.comp = v.vec_id AS kept
FROM v JOIN (SELECT id, min(other) AS comp FROM reach GROUP BY id) c ON c.id = v.vec_id
"""

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)
),
hits AS (SELECT dw.doc_id, dw.s, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
marked AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(m.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(m.n, 0) > 0 AND 20 * coalesce(m.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN marked m USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


def _mix(x: str, key: int) -> str:
    for m in MULTIPLIERS:
        x = f"(((pow(((({x}) % {PRIME}) * {m} + {key}) % {PRIME}, 2))::BIGINT + {key}) % {PRIME})"
    return x


def _feistel() -> str:
    steps = []
    for k, key in enumerate(KEYS):
        if k % 2 == 0:
            steps.append(f"r{k + 1} AS (SELECT * REPLACE ((l + {_mix('r', key)} % a) % a AS l) FROM r{k})")
        else:
            steps.append(f"r{k + 1} AS (SELECT * REPLACE ((r + {_mix('l', key)} % b) % b AS r) FROM r{k})")
    return ", ".join(steps)


# Unsigned crc32 of the bytes whose hex digits are h; ``crc`` holds the table t.
_CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, list_transform(range(8), lambda z: z::BIGINT)),
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"""

OP8 = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, list_transform(range(8), lambda z: z::BIGINT)),
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), e AS (
  SELECT doc_id, (length(h) // 2 + 16)::BIGINT AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc
), n AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, size, text_crc32) - 1 AS row_no, count(*) OVER () AS n FROM e
), s AS (
  SELECT *, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM n
), f AS (
  SELECT *, (n + a - 1) // a AS b FROM s
), dom AS (
  SELECT unnest(range(max(a) * max(b))) AS x, max(a) AS a, max(b) AS b, max(n) AS n FROM f
), r0 AS (SELECT x, a, b, n, x // b AS l, x % b AS r FROM dom), {_feistel()},
step AS (SELECT x, l * b + r AS y, n FROM r{len(KEYS)}),
walk(x, y, n) AS (
  SELECT x, y, n FROM step WHERE x < n UNION ALL
  SELECT w.x, s.y, w.n FROM walk w JOIN step s ON s.x = w.y WHERE w.y >= w.n
)
SELECT doc_id, size, text_crc32, row_no, y AS place, 'rows' AS law, (y % 40)::INT AS shard, y // 40 AS slot, NULL::INT AS grown_shard
FROM f JOIN walk w ON w.x = f.row_no AND w.y < w.n
"""

# The copyright lines in RE2, which knows no look-around: what may not follow the keyword is tested on the rest of the line.
_KEY = r"^[^\w\n]*(?i:copyright|©|\(c\)[ \t]*copyright)"
_SEP = r"(?:[ \t,:;-]|(?i:\(c\)|©|by\b))*"
_SURE = "|".join(
    [
        r"^[^\w\n]*©[ \t]*\S", _KEY + _SEP + r"(?i:\(c\)|©)[ \t]*\S", _KEY + _SEP + r"[<\[{]", _KEY + _SEP + r"[12]\d{3}\b", _KEY + _SEP + r"B[yY]\b",
        r"^[^\w\n]*(?i:\(c\))[ \t]*[12]\d{3}\b", r"^[^\w\n]*(?i:all rights reserved)[^\w\n]*$",
    ]
)
_WORD = r"^[^\w\n]*(?i:(?:\(c\)[ \t]*)?copyright)" + _SEP


def _holds(line: str) -> str:
    """Whether a line names a holder or a year."""
    rest = f"regexp_extract({line}, '{_WORD}((?:[A-Z]|[^\\x00-\\x7f]).*)$', 1, 's')"
    return f"(regexp_matches({line}, '{_SURE}') OR ({rest} <> '' AND NOT regexp_matches({rest}, '^(?i:{OWN})\\b')))"


def _digest(text: str) -> str:
    """sha256 of the canonical form of a text, null if nothing is left."""
    bare = f"array_to_string(list_filter(string_split(coalesce({text}, ''), chr(10)), lambda l: NOT {_holds('l')}), chr(10))"
    found = _WORDS.replace("coalesce(text, '')", bare)
    spelt = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items()) + " ELSE x END"
    joined = f"' ' || array_to_string(list_transform({found}, lambda x: {spelt}), ' ') || ' '"
    for phrase, one in PHRASES.items():
        joined = f"replace({joined}, ' {phrase} ', ' {one} ')"
    return f"(SELECT CASE WHEN c <> '' THEN sha256(c) END FROM (SELECT trim({joined}) AS c))"


OP7 = f"""
WITH known(license_id, digest) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in known_digests())}),
d AS (SELECT doc_id, {_digest("text")} AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
marks AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT doc_id, {_digest("line")} AS digest FROM lines) JOIN known USING (digest) GROUP BY doc_id
)
SELECT d.doc_id, d.digest, k.license_id, coalesce(m.notices, '') AS notices
FROM d LEFT JOIN (SELECT digest, min(license_id) AS license_id FROM known GROUP BY digest) k ON k.digest = d.digest
LEFT JOIN marks m ON m.doc_id = d.doc_id
"""

OP12 = f"""
WITH {_CRC_TABLE}, c AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''),
         md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), k AS (
  SELECT conv_id, w, {_CRC} % 6 AS keep FROM (SELECT *, hex(encode(conv_id::VARCHAR)) AS h FROM c), crc
), r AS (
  SELECT k.conv_id, list_concat(list_slice(coalesce(b.w, []), 1, keep), list_slice(k.w, keep + 1, len(k.w))) AS w
  FROM k LEFT JOIN c b ON b.conv_id = k.conv_id - k.conv_id % 100
), m AS (
  SELECT conv_id, d, list_slice(w, 1, d) AS p, len(w) AS n FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM r)
), nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM m GROUP BY p, d
), kids AS (
  SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), own AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(p[d].text) ELSE 0 END AS saved
  FROM nodes LEFT JOIN kids USING (p)
), sums AS (
  SELECT list_slice(p, 1, a) AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own) GROUP BY 1
)
SELECT o.conv_id, o.d AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
FROM own o JOIN sums s ON s.p = o.p LEFT JOIN nodes u ON o.d > 0 AND u.d = o.d - 1 AND u.p = list_slice(o.p, 1, o.d - 1)
"""

OP13 = f"""
WITH {_CRC_TABLE}, d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM d) GROUP BY ALL),
g AS (SELECT f, count(*) AS n FROM (SELECT unnest({_WORDS}) AS f FROM benchmark) GROUP BY f),
bucket AS (
  SELECT f, {_CRC} % 10000 AS b FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f UNION SELECT f FROM g)), crc
),
s AS (SELECT b, sum(n) AS s FROM f JOIN bucket USING (f) GROUP BY b),
t AS (SELECT b, sum(n) AS t FROM g JOIN bucket USING (f) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE)
                  / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (b)
),
weight AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM f JOIN bucket USING (f) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (doc_id)
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

ORACLE = {"op12_prefix_trie": OP12, "op13_resample": OP13, "op7_licenses": OP7, "op3_embedding_dedup": OP3, "op5_decontaminate": OP5, "op8_sharding": OP8}

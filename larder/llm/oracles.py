"""DuckDB statements for the operators that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
e AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
x AS (SELECT w.doc_id, list_sort(list(s.g)) AS k FROM w JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
k AS (SELECT doc_id, count(*) OVER (PARTITION BY k) AS class_size FROM x)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, coalesce(k.class_size, 1) AS class_size
FROM n JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = n.doc_id
LEFT JOIN k ON k.doc_id = n.doc_id
"""

DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, least(13, len(w)) AS m,
    unnest([array_to_string(w[i:i + least(13, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(13, len(w)) + 2)]) AS g
  FROM b WHERE len(w) > 0),
m AS (SELECT DISTINCT m FROM p),
t AS (
  SELECT r, m, unnest(range(1, len(w) - m + 2)) AS i, unnest([array_to_string(w[k:k + m - 1], ' ') FOR k IN range(1, len(w) - m + 2)]) AS g FROM d JOIN m ON len(w) >= m),
h AS (SELECT t.r, t.i, t.m, p.item FROM t JOIN p ON p.m = t.m AND p.g = t.g),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM h) GROUP BY r),
q AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY r)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN q ON q.r = d.r
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x, role, text FROM c),
e AS (
  SELECT *, regexp_replace(r, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS er,
    regexp_replace(x, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS ex FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN x END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(er) + length(ex) + 22) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

# crc32 of a text in SQL: the table follows from the reversed polynomial, one fold a byte.
_CRC_TABLE = """[list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
    FOR i IN range(256)]"""


def _crc32(text: str, table: str = "crc.t") -> str:
    codes = f"[CAST('0x' || hex(encode({text}))[2 * k + 1:2 * k + 2] AS BIGINT) FOR k IN range(strlen({text}))]"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])))"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _levels(name: str) -> str:
    """The recursion of a tree table (k, l, d): next level's digests, three children each."""
    return f"""SELECT k, l + 1, [sha256(array_to_string(d[3 * i + 1:3 * i + 3], '')) FOR i IN range((len(d) + 2) // 3)] FROM {name} WHERE len(d) > 1"""


def _climb(walk: str, levels: str) -> str:
    """The recursion of a walk (r, k, l, i, node, proof): the run's other digests join the proof."""
    run = "v.d[3 * (w.i // 3) + 1:w.i]", "v.d[w.i + 2:3 * (w.i // 3) + 3]"
    left, right = (f"array_to_string({x}, '')" for x in run)
    return f"""SELECT w.r, w.k, w.l + 1, w.i // 3, sha256({left} || w.node || {right}), w.proof || {left} || {right}
  FROM {walk} w JOIN {levels} v ON v.k = w.k AND v.l = w.l WHERE len(v.d) > 1"""


MANIFEST = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
c AS (
  SELECT row_number() OVER () AS r, *, coalesce('1' || source, '') AS k, {_leaf('text')} AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen FROM documents, crc),
n AS (SELECT *, {_leaf('seen')} AS changed, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM c),
v(k, l, d) AS (SELECT k, 0, list(leaf ORDER BY i) FROM n GROUP BY k UNION ALL {_levels('v')}),
s AS (SELECT k, d[1] AS subroot, row_number() OVER (ORDER BY encode(k)) - 1 AS i FROM v WHERE len(d) = 1),
u(k, l, d) AS (SELECT '', 0, list(subroot ORDER BY i) FROM s UNION ALL {_levels('u')}),
w(r, k, l, i, node, proof) AS (SELECT r, k, 0, i, changed, '' FROM n UNION ALL {_climb('w', 'v')}),
a AS (SELECT r, k, node, proof FROM (SELECT *, max(l) OVER (PARTITION BY r) AS top FROM w) WHERE l = top),
x(r, k, l, i, node, proof) AS (SELECT a.r, '', 0, s.i, a.node, a.proof FROM a JOIN s ON s.k = a.k UNION ALL {_climb('x', 'u')}),
b AS (SELECT r, node, proof FROM (SELECT *, max(l) OVER (PARTITION BY r) AS top FROM x) WHERE l = top)
SELECT n.doc_id, n.leaf, s.subroot, u.d[1] AS root, sha256(b.proof) AS proof_sha256, b.node AS folded_root, b.node = u.d[1] AS verified
FROM n JOIN s ON s.k = n.k JOIN b ON b.r = n.r JOIN u ON len(u.d) = 1
"""

RESAMPLING = rf"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT r, unnest(w) AS g FROM d),
y AS (SELECT unnest(w) AS g FROM b),
h AS (SELECT g, {_crc32("g")} % 10000 AS k FROM (SELECT g FROM x UNION SELECT g FROM y), crc),
s AS (SELECT k, count(*) AS n FROM x JOIN h USING (g) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM y JOIN h USING (g) GROUP BY k),
z AS (SELECT (SELECT count(*) FROM x) AS s, (SELECT count(*) FROM y) AS t),
e AS (
  SELECT k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (z.s + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (z.t + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT k FROM h) LEFT JOIN s USING (k) LEFT JOIN t USING (k) CROSS JOIN z),
m AS (SELECT r, CAST(sum(gain) AS BIGINT) AS q FROM x JOIN h USING (g) JOIN e USING (k) GROUP BY r),
f AS (SELECT r, doc_id, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 ELSE (q - ((q % len(w)) + len(w)) % len(w)) // len(w) END AS weight FROM d LEFT JOIN m USING (r)),
v AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296))) AS BIGINT) AS score FROM f),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n DESC) AS rank FROM v WHERE n >= 20)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM p) // 100 THEN rank END AS rank
FROM v LEFT JOIN p USING (r)
"""

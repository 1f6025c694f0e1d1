"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from tidewatch.llm.secrets import RULES


def op10() -> str:
    """Matches by position: gaps and hits of a split, lengths summed up in order."""
    parts, names = [], []
    for i, r in enumerate(RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        keep = f"length(kept[i]) >= {r.least}" if r.least else "true"
        parts.append(f"""s{i} AS (SELECT doc_id, rn, list_transform(list_filter(range(1, len(hit) + 1), lambda i: {keep}), lambda i: {{
            'start': CAST(coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hit[1:i-1], lambda x: length(x))), 0) AS BIGINT),
            'ord': {i},
            'stop': CAST(coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hit[1:i], lambda x: length(x))), 0) AS BIGINT),
            'kind': '{r.kind}'}}) AS spans
          FROM (SELECT doc_id, rn, regexp_split_to_array(text, {p}) AS gap, regexp_extract_all(text, {p}, 0) AS hit, regexp_extract_all(text, {p}, {r.group}) AS kept FROM d))""")
        names.append(f"s{i}.spans")
    joins = " ".join(f"JOIN s{i} USING (rn)" for i in range(1, len(RULES)))
    text = "array_to_string(list_transform({}, lambda s: s.kind || ':' || s.start || ':' || s.stop), ',')"
    n_base = sum(r.base for r in RULES)
    counts = ", ".join(f"CAST(len(list_filter(a, lambda s: s.ord = {i})) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(RULES) if r.base)
    lists = names[0]
    for n in names[1:]:
        lists = f"list_concat({lists}, {n})"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rn FROM documents),
{', '.join(parts)},
al AS (SELECT s0.doc_id AS doc_id, list_sort({lists}) AS a FROM s0 {joins})
SELECT doc_id, {counts},
  sha256({text.format(f'list_filter(a, lambda s: s.ord < {n_base})')}) AS base_sha256,
  {text.format('a')} AS spans
FROM al"""


OP8 = """WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 20 = 0 AND q.id <> c.id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


OP2 = r"""WITH l AS (
  SELECT doc_id, pos, trim(x, ' ' || chr(9) || chr(13) || chr(160)) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)),
e AS (SELECT *, length(line) AS n FROM l WHERE length(line) > 0),
u AS (SELECT line, n, min((doc_id, pos)) AS first FROM e GROUP BY 1, 2),
able AS (SELECT * FROM u WHERE n >= 20 OR regexp_matches(line, '^(\S+\s+){4}\S')),
k AS (SELECT line, n AS n0, first, n - m.less AS n, left(line, (n - m.less) // 2) AS front, right(line, (n - m.less) - (n - m.less) // 2) AS back FROM able, (VALUES (0), (1)) m(less)),
c AS (SELECT a.line AS a, b.line AS b, b.first FROM k a JOIN k b ON a.n = b.n AND a.front = b.front AND a.line <> b.line AND b.first < a.first
  UNION SELECT a.line, b.line, b.first FROM k a JOIN k b ON a.n = b.n AND a.back = b.back AND a.line <> b.line AND b.first < a.first),
p AS (SELECT *, coalesce(list_position(list_transform(range(1, greatest(length(a), length(b)) + 1), lambda i: substring(a, i, 1) = substring(b, i, 1)), false), 0) AS q FROM c WHERE abs(length(a) - length(b)) <= 1),
near AS (SELECT a AS line, min(first) AS first FROM p WHERE
  (length(a) = length(b) AND substring(a, q + 1) = substring(b, q + 1)) OR (length(a) + 1 = length(b) AND substring(a, q) = substring(b, q + 1)) OR (length(a) = length(b) + 1 AND substring(a, q + 1) = substring(b, q)) GROUP BY 1),
gone AS (SELECT e.doc_id, e.pos FROM e JOIN u USING (line) LEFT JOIN near USING (line) WHERE (e.doc_id, e.pos) > least(u.first, coalesce(near.first, u.first))),
kept AS (SELECT d.doc_id, count(*) AS n_lines, count(*) - count(g.pos) AS left_, count(g.pos) AS n_removed, string_agg(d.x, chr(10) ORDER BY d.pos) FILTER (g.pos IS NULL) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) d LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.pos = g.pos GROUP BY 1)
SELECT doc_id, coalesce(text, '') AS text, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed FROM kept"""


OP7 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT r.d, g.b FROM r JOIN g ON r.c = g.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, min(r.c) = n.doc_id AS kept FROM n JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.n"""


#: crc32 by bits: a byte's eight bits come from its two hexadecimal digits, lower half first.
CRC = """list_reduce(list_concat([4294967295], list_transform(range(CAST(8 * strlen({x}) AS BIGINT)), lambda t:
  ((instr('0123456789ABCDEF', substr(hex(encode({x})), 2 * (t // 8) + CASE WHEN t % 8 < 4 THEN 2 ELSE 1 END, 1)) - 1) >> (t % 4)) & 1)),
  lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384))"""

OP11 = r"""WITH RECURSIVE o AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT run, length(run) AS l, CAST(count(*) AS BIGINT) AS n, xor({crc}, 4294967295) AS h FROM (SELECT *, id || ':' || run AS x FROM o WHERE length(run) >= 6) GROUP BY id, run, x),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % l AS BIGINT)) || substr(run, CAST(h % l AS BIGINT) + 2) ELSE run END AS word, n FROM c) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, a.n AS n_a, b.word AS b, b.n AS n_b FROM k a JOIN k b ON a.less = b.less AND a.i = b.i AND a.word < b.word
  UNION SELECT k.word, k.n, w.word, w.n FROM k JOIN w ON k.less = w.word),
b AS (SELECT a AS word, n_a AS own, b AS near, n_b AS near_n FROM p UNION ALL SELECT b, n_b, a, n_a FROM p),
f AS (SELECT word, count(*) AS n_near, CASE WHEN max(near_n) >= 5 * max(own) THEN min(near) FILTER (near_n = most) END AS form, CASE WHEN max(near_n) >= 5 * max(own) THEN max(near_n) END AS form_n
  FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS most FROM b) GROUP BY word),
r AS (SELECT word, word AS root, 0 AS steps FROM w UNION ALL SELECT r.word, f.form, steps + 1 FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(root, steps) AS root FROM r GROUP BY 1)
SELECT w.word, f.form, e.root, w.n, CAST(coalesce(f.n_near, 0) AS BIGINT) AS n_near, f.form_n FROM w JOIN e USING (word) LEFT JOIN f USING (word)""".replace("{crc}", CRC.format(x="x"))


OP12 = """WITH r AS (
  SELECT CAST(vec_id AS BIGINT) AS id, len(embedding) AS dim, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS BIGINT) AS score FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id AND a.dim = b.dim),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

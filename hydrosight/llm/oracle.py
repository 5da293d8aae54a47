"""DuckDB statements for the corpus queries that SQL can express, written from
the contracts, not from the Spark plans."""

from __future__ import annotations

from hydrosight.llm.queries import WEIGHTS

#: one expression for the white space of the contracts
_SPACE = r"[\x20\x09-\x0D]"

OP7 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT a.doc_id, a.pos, a.line, c.k IS NOT NULL AND a.doc_id <> c.keeper AS gone
  FROM keyed a LEFT JOIN common c ON a.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP9 = rf"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT t.doc_id, g.keep_id, g.group_size::BIGINT AS group_size, t.doc_id = g.keep_id AS kept,
       t.h AS text_sha256
FROM t JOIN g ON t.h = g.h
"""

OP3 = """
WITH t AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (
  SELECT h, list_aggregate([lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')
                            for c in string_split(h, '')], 'string_agg', '') AS b
  FROM (SELECT DISTINCT h FROM t)),
names AS (
  SELECT h, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
             + 16 * substr(b, i * 5 + 1, 1)::INT + 8 * substr(b, i * 5 + 2, 1)::INT
             + 4 * substr(b, i * 5 + 3, 1)::INT + 2 * substr(b, i * 5 + 4, 1)::INT
             + substr(b, i * 5 + 5, 1)::INT, 1) for i in range(32)], 'string_agg', '') AS name
  FROM bits),
latest AS (SELECT h, max(page_id) AS latest FROM t GROUP BY h)
SELECT t.page_id, octet_length(encode(t.p))::BIGINT AS payload_bytes, n.name AS payload_digest,
       CASE WHEN t.page_id = l.latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN t.page_id = l.latest THEN NULL ELSE l.latest END AS refers_to
FROM t JOIN names n ON t.h = n.h JOIN latest l ON t.h = l.h
"""

def _weight(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"


def _share(name: str, nodes: str, parents: str, keys: list[str], own: str) -> str:
    """Water filling of one level: tables ``nodes`` (keys, own, w, s) and ``parents`` (keys, b)."""
    k = ", ".join(keys)
    on = " AND ".join(f"n.{x} = p.{x}" for x in keys)
    return f"""
{name}_1 AS (
  SELECT n.*, p.b, coalesce(sum(n.s) OVER (PARTITION BY {", ".join("n." + x for x in keys)} ORDER BY n.s / n.w, n.{own}
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb,
         sum(n.w) OVER (PARTITION BY {", ".join("n." + x for x in keys)} ORDER BY n.s / n.w, n.{own}
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wo
  FROM {nodes} n JOIN {parents} p ON {on}),
{name}_2 AS (SELECT *, s * wo <= w * (b - sb) AS f FROM {name}_1),
{name} AS (
  SELECT {k}, {own}, CASE WHEN f THEN s ELSE (w * (b - sum(CASE WHEN f THEN s ELSE 0 END) OVER (PARTITION BY {k})))
           // greatest(sum(CASE WHEN f THEN 0 ELSE w END) OVER (PARTITION BY {k}), 1) END AS b FROM {name}_2)"""


OP2 = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s0,
         'd' || coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INT) % 4, 0) AS dom,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::HUGEINT AS t
  FROM documents),
leaf AS (SELECT 0 AS root, dom, l, s0, sum(t) AS t, sum(t) * 4 AS s, 1 AS w FROM d GROUP BY ALL),
n1 AS (SELECT root, dom, sum(s) AS s, {_weight("dom", WEIGHTS["domain"])} AS w FROM leaf GROUP BY ALL),
n2 AS (SELECT root, dom, l, sum(s) AS s, {_weight("l", WEIGHTS["lang"])} AS w FROM leaf GROUP BY ALL),
p0 AS (SELECT 0 AS root, sum(t) AS b FROM leaf),
{_share("a1", "n1", "p0", ["root"], "dom")},
{_share("a2", "n2", "a1", ["root", "dom"], "l")},
{_share("a3", "leaf", "a2", ["root", "dom", "l"], "s0")},
plan AS (SELECT x.*, a3.b // x.t AS k, a3.b % x.t AS rest FROM leaf x JOIN a3 USING (root, dom, l, s0) WHERE x.t > 0),
o AS (SELECT d.*, p.k, p.rest, md5('7:' || p.k || ':' || coalesce(d.doc_id::VARCHAR, '')) AS h
      FROM d JOIN plan p ON d.dom = p.dom AND d.l = p.l AND d.s0 = p.s0),
c AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY dom, l, s0 ORDER BY h
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
e AS (SELECT *, max(h) FILTER (WHERE before < rest AND before + t >= rest) OVER (PARTITION BY dom, l, s0) AS last FROM c)
SELECT doc_id, lang, source, unnest(range(k::BIGINT)) AS epoch, t::BIGINT AS tokens, t::BIGINT AS take FROM e
UNION ALL
SELECT doc_id, lang, source, k::BIGINT AS epoch, t::BIGINT AS tokens, least(t, rest - before)::BIGINT AS take
FROM e WHERE h <= last
"""

OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct([list_aggregate(ws[i:i + 4], 'string_agg', ' ')
           FOR i IN range(1, greatest(len(ws) - 3, 2))]) AS sh FROM w WHERE len(ws) > 0),
n AS (SELECT w.doc_id, coalesce(len(s.sh), 0)::BIGINT AS n_shingles FROM w LEFT JOIN s ON w.doc_id = s.doc_id),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * c >= 75 * (p.n_shingles + q.n_shingles - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN sym l ON r.b = l.a)
SELECT n.doc_id, n.n_shingles, min(r.b) AS component_id
FROM n JOIN reach r ON n.doc_id = r.a GROUP BY n.doc_id, n.n_shingles
"""

OP10 = """
WITH RECURSIVE u AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.a LEFT JOIN k ON e.vec_id = k.a
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, count(w.r) AS c FROM g JOIN kept k ON g.lang = k.lang
      LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term GROUP BY ALL),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER s + 5 * count(*) OVER s)::HUGEINT AS p
      FROM c WINDOW s AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER s + 5 * count(*) OVER s)::HUGEINT AS q
      FROM kept WINDOW s AS (PARTITION BY lang)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
term AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
both_parts AS (SELECT * FROM pair UNION ALL SELECT * FROM term)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
          'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'), 'E': first < d.doc_id} AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM letters a, letters b, letters c, letters e, letters g
  WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
m AS (
  SELECT part, good, toxic, (CASE WHEN fails['A'] THEN 'A' ELSE '' END) || (CASE WHEN fails['B'] THEN 'B' ELSE '' END)
         || (CASE WHEN fails['C'] THEN 'C' ELSE '' END) || (CASE WHEN fails['D'] THEN 'D' ELSE '' END)
         || (CASE WHEN fails['E'] THEN 'E' ELSE '' END) AS failed, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
r AS (
  SELECT m.part, s.filter_order, s.step, s.filter_order[s.step] AS x,
         sum(CASE WHEN translate(failed, filter_order[1:step], '') = failed THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN contains(failed, filter_order[step]) AND translate(failed, left(filter_order, step - 1), '') = failed
             THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(failed, filter_order[step]) AND translate(failed, left(filter_order, step - 1), '') <> failed
             THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(failed, filter_order[step]) AND translate(failed, left(filter_order, step - 1), '') = failed
             THEN n * good ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(failed, filter_order[step]) AND translate(failed, left(filter_order, step - 1), '') = failed
             THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM r
"""

OP13 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, sha256(list_aggregate(ws[i:i + 49], 'string_agg', ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
dup AS (SELECT w.doc_id, w.i FROM win w JOIN first f ON w.h = f.h WHERE f.lo < w.doc_id),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
marked AS (
  SELECT p.doc_id, p.i, p.word, coalesce(p.i - max(dup.i) OVER (PARTITION BY p.doc_id ORDER BY p.i
           ROWS UNBOUNDED PRECEDING) < 50, false) AS gone
  FROM pos p LEFT JOIN dup ON p.doc_id = dup.doc_id AND p.i = dup.i),
kept AS (SELECT doc_id, sum(gone::INT) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

ORACLE_SQL = {"op2_mixing": OP2, "op3_warc": OP3, "op5_jaccard": OP5, "op7_line_dedup": OP7, "op9_exact_dedup": OP9,
              "op10_embeddings": OP10, "op11_source_audit": OP11, "op12_filter_audit": OP12,
              "op13_substring_dedup": OP13}

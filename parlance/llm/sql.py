"""DuckDB SQL for the queries of this subpackage that SQL can express. The
others are tested against brute force (tests/llm)."""

from __future__ import annotations

from . import mixing, vector_codes

_WORD = r"[^\x20\x09-\x0D]+"

# -- 4: shingles, all pairs that share one, and components by reachability ------

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: list_slice(ws, i, i + 4)) END) AS sh FROM w),
n AS (SELECT w.doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2"""

# -- 5: all pairs ---------------------------------------------------------------

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
       AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN k ON k.a = v.vec_id"""

# -- 7: the derived tool traffic, its checks and its order ------------------------

CHAT = """
WITH c AS (SELECT conv_id, turn, role, text, coalesce(length(text), 0) AS n, 'c' || conv_id || '-' || turn AS id,
                  'c' || conv_id || '-' || (turn - 1) AS before FROM conversations),
ask AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'browse' WHEN n % 2 = 0 THEN 'search' ELSE 'lookup' END AS tool
        FROM c WHERE role = 'assistant'),
say AS (SELECT * FROM c WHERE role = 'user' AND turn > 0),
a AS (SELECT ask.*, EXISTS (SELECT 1 FROM say WHERE say.conv_id = ask.conv_id AND say.turn = ask.turn + 1) AS has_a,
             EXISTS (SELECT 1 FROM say WHERE say.conv_id = ask.conv_id AND say.turn = ask.turn + 1 AND say.n % 2 = 0) AS has_b
      FROM ask),
rows AS (
  SELECT conv_id, turn AS t, 0 AS step, 0 AS lvl, 0 AS no, '' AS by_id, 0 AS after, 'message' AS kind,
         NULL::VARCHAR AS call_id, '' AS problems,
         '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json
  FROM c
  UNION ALL
  SELECT conv_id, turn, 1, 0, 1, id || '-a', 0, 'call', id || '-a',
         array_to_string(list_filter([
           CASE WHEN tool <> 'browse' AND (n % 5 = 0 OR text IS NULL) THEN 'missing query' END,
           CASE WHEN (tool = 'search' AND n % 120 NOT BETWEEN 1 AND 100) OR (tool = 'lookup' AND n % 120 > 50) THEN 'range limit' END,
           CASE WHEN NOT has_a THEN 'unanswered' END,
           CASE WHEN tool = 'lookup' AND n % 3 = 0 THEN 'unknown exact' END,
           CASE WHEN tool = 'browse' THEN 'unknown tool' END], lambda x: x IS NOT NULL), '; '),
         '{"arguments":{' || array_to_string(list_filter([
           CASE WHEN n % 3 = 0 THEN '"exact":' || CAST(n % 2 = 0 AS VARCHAR) END,
           '"limit":' || CAST(n % 120 AS VARCHAR),
           CASE WHEN n % 5 <> 0 AND text IS NOT NULL THEN '"query":' || to_json(text)::VARCHAR END], lambda x: x IS NOT NULL), ',')
         || '},"id":"' || id || '-a","name":"' || tool || '","type":"function"}'
  FROM a
  UNION ALL
  SELECT conv_id, turn, 1, 1, 0, id || '-b', 0, 'call', id || '-b', CASE WHEN has_b THEN '' ELSE 'unanswered' END,
         '{"arguments":{"text":"$' || id || '-a"},"id":"' || id || '-b","name":"summarise","type":"function"}'
  FROM a WHERE n % 3 = 0
  UNION ALL
  SELECT r.conv_id, CASE WHEN placed THEN turn - 1 ELSE turn END, CASE WHEN placed THEN 1 ELSE 2 END,
         CASE WHEN placed AND letter = 'b' THEN 1 ELSE 0 END, CASE WHEN placed AND letter = 'a' THEN 1 ELSE 0 END,
         before || '-' || letter, 1, 'result', before || '-' || letter, CASE WHEN placed THEN '' ELSE 'orphan result' END,
         '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":"tool","tool_call_id":"' || before || '-' || letter || '"}'
  FROM (SELECT say.*, letter, EXISTS (SELECT 1 FROM ask WHERE ask.conv_id = say.conv_id AND ask.turn = say.turn - 1
               AND (letter = 'a' OR ask.n % 3 = 0)) AS placed
        FROM say, (VALUES ('a'), ('b')) l(letter) WHERE letter = 'a' OR say.n % 2 = 0) r)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY t, step, lvl, no, by_id, after, json) - 1 AS seq,
       kind, call_id, problems = '' AS valid, problems, json FROM rows"""


# -- 10: raking spelled out round by round ------------------------------------------

def mixing_sql() -> str:
    steps, last = [], "r0"
    for k in range(mixing.ROUNDS):
        for margin in mixing.TEMPER:
            total = f"sum(raked) OVER (PARTITION BY {margin})"
            name = f"r{k}_{margin}"
            steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN {total} > 0 THEN raked * to_{margin} / {total} ELSE 0 END"
                         f" AS raked) FROM {last})")
            last = name
    margins = [f"m_{m} AS (SELECT {m}, s / sum(s) OVER () AS to_{m} FROM (SELECT {m}, pow(CAST(sum(tokens) AS DOUBLE), {p})"
               f" AS s FROM cells GROUP BY 1))" for m, p in mixing.TEMPER.items()]
    joins = " ".join(f"JOIN m_{m} ON cells.{m} IS NOT DISTINCT FROM m_{m}.{m}" for m in mixing.TEMPER)
    factors = [f"f0 AS (SELECT {mixing.BUDGET} * t / m AS f, t, m FROM (SELECT CAST(sum(tokens) AS DOUBLE) AS t, sum(raked) AS m FROM q))"]
    for k in range(mixing.CAP_ROUNDS):
        factors.append(f"""f{k + 1} AS (SELECT CASE WHEN free > 0 THEN greatest(f, ({mixing.BUDGET} * t - fixed) / free) ELSE f END AS f, t, m
  FROM (SELECT any_value(f) AS f, any_value(t) AS t, any_value(m) AS m,
               coalesce(sum(CASE WHEN ratio * f >= 1 THEN tokens END), 0) AS fixed,
               coalesce(sum(CASE WHEN ratio * f < 1 THEN raked END), 0) AS free FROM q, f{k}))""")
    return rf"""
WITH w AS (SELECT doc_id, source, lang, CASE WHEN contains(coalesce(text, ''), 'Licensed under') THEN 'licence'
             WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
             WHEN contains(coalesce(text, ''), '!!') THEN 'shout' ELSE 'prose' END AS topic,
           CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS n_tokens FROM documents),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM w GROUP BY ALL),
{", ".join(margins)},
r0 AS (SELECT cells.*, CAST(tokens AS DOUBLE) AS raked, {", ".join(f"to_{m}" for m in mixing.TEMPER)} FROM cells {joins}),
{", ".join(steps)},
q AS (SELECT *, CASE WHEN tokens > 0 THEN raked / tokens ELSE 0 END AS ratio FROM {last}),
{", ".join(factors)},
g AS (SELECT source, lang, topic, ratio * (t / m) AS weight, least(1.0, ratio * f) AS probability FROM q, f{mixing.CAP_ROUNDS})
SELECT doc_id, w.source, w.lang, w.topic, n_tokens, round(weight, 9) AS weight, round(probability, 9) AS probability,
       CAST('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13) AS BIGINT) / {float(16 ** 13)!r} < g.probability AS selected
FROM w JOIN g ON w.source IS NOT DISTINCT FROM g.source AND w.lang IS NOT DISTINCT FROM g.lang AND w.topic = g.topic"""


# -- 13: every distance of every round -----------------------------------------------

def vector_codes_sql() -> str:
    """Parts as lists of whole numbers; a codebook after each round, and all
    entries compared with all parts."""
    v = vector_codes
    steps = []
    for k in range(v.ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, label, p, x, arg_min(struct_pack(e := e, d := d), (d, e)) AS near FROM (
  SELECT vec_id, label, cut.p, cut.x, e, list_sum(list_transform(list_zip(cut.x, b{k}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM cut JOIN b{k} ON cut.p = b{k}.p) GROUP BY 1, 2, 3, 4)""")
        if k < v.ROUNDS:
            steps.append(f"""s{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM (
  SELECT p, near.e AS e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{k}, range(1, len(x) + 1) t(j) GROUP BY 1, 2, 3)
  GROUP BY 1, 2),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(s{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN s{k} USING (p, e))""")
    last = v.ROUNDS
    return f"""
WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * {v.SCALE}) AS BIGINT)) AS y
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cut AS MATERIALIZED (SELECT vec_id, label, p, list_slice(y, p * len(y) // {v.PARTS} + 1, (p + 1) * len(y) // {v.PARTS}) AS x
  FROM w, range({v.PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM cut
  WHERE vec_id IN (SELECT vec_id FROM w ORDER BY vec_id LIMIT {v.ENTRIES})),
{", ".join(steps)},
found AS (SELECT vec_id, label, string_agg(printf('%02x', near.e), '' ORDER BY p) AS code, CAST(sum(near.d) AS BIGINT) AS error
  FROM a{last} GROUP BY 1, 2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{last}) AS codebooks_sha256
FROM found"""


ORACLE = {
    "op4_ngram_jaccard_join": NGRAM_JOIN,
    "op5_embedding_near_dedup": EMBEDDINGS,
    "op7_chat_formatting": CHAT,
    "op10_source_mixing": mixing_sql(),
    "op13_vector_codes": vector_codes_sql(),
}

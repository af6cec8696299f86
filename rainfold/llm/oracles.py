"""DuckDB SQL for the training-data queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

TOP_K = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::HUGEINT AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, TRY_CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
"""

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(length(text), 0) AS chars FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
    / greatest(0.25::DOUBLE, 1.0::DOUBLE - abs(chars::DOUBLE / greatest(size, 1) - 6.0::DOUBLE) / 12.0::DOUBLE) AS key FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sized GROUP BY source),
ranked AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM ranked WINDOW before AS (ORDER BY ratio, source COLLATE "C" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT source, source_size, round(least(3.0::DOUBLE * source_size, coalesce((SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio), 'inf'::DOUBLE) * weight), 6) AS target FROM levels),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_epochs FROM plan),
placed AS (
  SELECT k.doc_id, k.source, k.size, e.source_size, e.target, e.full_epochs, round(e.target - e.full_epochs * e.source_size)::BIGINT AS part,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN epochs e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, (full_epochs * size + greatest(0, least(size, part - before)))::BIGINT AS taken FROM placed
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
made AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)::BIGINT + length(role) + length('### :') + 1 + length('</turn>') + 1 AS n,
    lag(role) OVER w AS before FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
checked AS (
  SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role IN ('user', 'tool') WHEN before = 'tool' THEN role = 'assistant' ELSE FALSE END AS fine FROM made)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars,
  bool_and(fine) AND arg_max(role, (turn, role, text)) = 'assistant' AS order_ok
FROM checked GROUP BY conv_id
"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Each round as two more tables: assignments to its codebooks, and the next codebooks."""
    made = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
cells AS MATERIALIZED (SELECT rn, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, rn - 1 AS e, x AS c FROM cells WHERE rn <= {entries})"""]
    for n in range(rounds + 1):
        made.append(f"""far{n} AS MATERIALIZED (
  SELECT rn, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT rn, c.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cells c JOIN book{n} b ON c.p = b.p) GROUP BY rn, p)""")
        if n < rounds:
            made.append(f"""book{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN (
    SELECT p, e, list((s - ((s % k) + k) % k) // k ORDER BY i) AS c FROM (
      SELECT p, e, i, sum(x[i]) AS s, count(*)::HUGEINT AS k FROM (SELECT f.p, f.e, x, unnest(range(1, len(x) + 1)) AS i FROM far{n} f JOIN cells c ON c.rn = f.rn AND c.p = f.p) GROUP BY p, e, i)
    GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH {", ".join(made)},
coded AS (SELECT rn, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM far{rounds} GROUP BY rn)
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (rn)
"""


WINNOWING = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT t.rn, t.i, t.n, x.item_id FROM (
    SELECT rn, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT rn, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM texts, lengths WHERE len(w) >= n)) t
  JOIN windows x ON x.n = t.n AND x.s = t.s),
hit AS (SELECT rn, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS q FROM (SELECT DISTINCT rn, i, n FROM found)) GROUP BY rn),
named AS (SELECT rn, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id COLLATE "C") AS ids FROM (SELECT DISTINCT rn, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (rn) LEFT JOIN named USING (rn)
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) t(k) WHERE len(w) >= k) GROUP BY ALL),
totals AS (SELECT lang, sum(a)::HUGEINT AS n FROM grams WHERE k = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT lang, k, phrase, a FROM grams WHERE a >= 100),
cuts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM frequent WHERE k > 1),
scores AS (
  SELECT u.lang, u.k, u.phrase, u.a, u.c, l.a AS l, r.a AS r, n, (1000 * u.a * n) // (l.a * r.a) AS score FROM cuts u JOIN totals t ON t.lang = u.lang
  JOIN frequent l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1 : u.c], ' ') JOIN frequent r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[u.c + 1 : u.k], ' ')),
worst AS (SELECT lang, k, phrase, a, n, min(score) AS score, arg_min(l, (score, c)) AS l, arg_min(r, (score, c)) AS r FROM scores GROUP BY lang, k, phrase, a, n),
free AS (
  SELECT * FROM worst s WHERE NOT EXISTS (SELECT 1 FROM frequent x WHERE x.lang = s.lang AND x.k > s.k AND 100 * x.a >= 100 * s.a AND contains(' ' || x.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM free)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_threshold_topk": TOP_K, "op6_mix_sources": MIX, "op7_chat_format": CHAT, "op11_vector_codes": vector_codes(), "op12_winnowing": WINNOWING, "op13_collocations": COLLOCATIONS}

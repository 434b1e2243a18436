"""SQL for DuckDB that states the rows of those queries here that SQL can express; windows are compared whole."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
s AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
hit AS (SELECT r, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM hit),
kept AS (SELECT d.r, string_agg(d.x, ' ' ORDER BY d.p) AS t FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) AS d ANTI JOIN gone AS g ON g.r = d.r AND g.p = d.p GROUP BY d.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r LEFT JOIN n ON n.r = d.r"""

OP5 = """WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, i, md5(hex(b[i : i + 399])) AS k FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
hit AS (SELECT r, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
isle AS (SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY r, g),
cut AS (SELECT r, lo, hi, lag(hi) OVER (PARTITION BY r ORDER BY lo) AS before FROM isle),
part AS (SELECT c.r, c.lo AS p, CASE WHEN coalesce(c.before, 1) < c.lo THEN hex(d.b[coalesce(c.before, 1) : c.lo - 1]) ELSE '' END AS h FROM cut AS c JOIN d ON d.r = c.r
  UNION ALL SELECT e.r, e.hi, CASE WHEN e.hi <= octet_length(d.b) THEN hex(d.b[e.hi : octet_length(d.b)]) ELSE '' END FROM (SELECT r, max(hi) AS hi FROM isle GROUP BY r) AS e JOIN d ON d.r = e.r),
kept AS (SELECT r, string_agg(h, '' ORDER BY p) AS h FROM part GROUP BY r), n AS (SELECT r, sum(hi - lo) AS n, count(*) AS m FROM isle GROUP BY r)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(n.n, 0)::BIGINT AS n_removed, coalesce(n.m, 0)::BIGINT AS n_spans, sha256(CASE WHEN kept.r IS NULL THEN d.b ELSE unhex(kept.h) END) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r LEFT JOIN n ON n.r = d.r"""

_ESCAPED = lambda x, more: f"length({x}) + len(regexp_extract_all({x}, '\\\\|###|</turn>{more}'))"

OP6 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(14 + {_ESCAPED('role', '|:')} + {_ESCAPED('text', '')})::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""

_FINE = "label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

OP9 = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e, {_FINE} AS fine FROM embeddings),
link AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE a.fine AND b.fine AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
c AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a), n AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id IS NOT DISTINCT FROM c.component_id AS kept FROM v JOIN c ON c.r = v.r LEFT JOIN n ON n.r = v.r"""

SQL = {"op1_substring_dedup": OP1, "op5_suffix_array_dedup": OP5, "op6_chat_formatting": OP6, "op9_embedding_near_dedup": OP9}

"""SQL for the queries of corpus operators that SQL can express, each by a plain method of its own."""

from __future__ import annotations

TOP_K = """
    WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS d, unnest(embedding) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
         fit AS (SELECT vec_id FROM e GROUP BY vec_id HAVING count(*) FILTER (WHERE x IS NULL OR NOT isfinite(x)) = 0),
         c AS (SELECT e.vec_id, d, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM e JOIN fit ON e.vec_id = fit.vec_id),
         s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(sum(q.v * r.v) AS BIGINT) AS score
               FROM c q JOIN c r ON q.d = r.d AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
         n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 5"""

#: All windows of 200 bytes, as hexadecimal digits; texts are parted first, as a substring is sought from the start.
REPEATS = """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
         parts AS (SELECT r, s, substr(h, 2 * s + 1, 2 * 399) AS part FROM (SELECT r, h, unnest(range(0, greatest(length(h) // 2 - 199, 0), 200)) AS s FROM d)),
         places AS (SELECT r, s, part, unnest(range(0, least(200, length(part) // 2 - 199))) AS i FROM parts),
         windows AS (SELECT r, s + i AS p, md5_number(substr(part, 2 * i + 1, 400)) AS k FROM places),
         twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
         starts AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM windows JOIN twice USING (k)),
         numbered AS (SELECT r, p, sum(CASE WHEN p - q <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS run FROM starts),
         runs AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY r, run),
         cut AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS b FROM runs GROUP BY r),
         gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t FROM runs
                  UNION ALL SELECT d.r, coalesce(b, 0), length(h) // 2 FROM d LEFT JOIN cut USING (r)),
         kept AS (SELECT r, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS x FROM gaps JOIN d USING (r) GROUP BY r)
    SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256
    FROM d JOIN kept USING (r) LEFT JOIN cut USING (r)"""

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_LONG = r"[A-Za-z0-9+/_-]"
#: Kinds of spans in their order: pattern (of a part of one group), what a part must be.
_KINDS = [
    ("assign", r"(?i:password|passwd|secret|token|api_?key)" + _VALUE + r"([A-Za-z0-9+/_.=-]+)", "length(v) >= 6"),
    ("access", r"(AKIA[A-Z0-9]+)", "length(v) >= 20"),
    ("hex", r"([0-9a-f]+)", "length(v) >= 24"),
    ("weak_id", r"(?:\b(?i:access_?key_?id|access_?key|client_?id|account|login|username|user)" + _VALUE + r"|\bA[A-Z]IA)([A-Za-z0-9@+/_.-]+)", "length(v) >= 4"),
    ("weak_secret", rf"({_LONG}+)=*", "length(v) >= 32 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')"),
    ("weak_endpoint", r"(?:(?i:https?|postgres|postgresql|mysql|redis|mongodb|amqp|s3)://|\b(?i:host|endpoint|server)" + _VALUE + r""")([^\x09-\x0D\x20"'<>,;]+)""", "length(v) >= 4"),
]


def _found(number: int, pattern: str, fit: str) -> str:
    """Parts of one kind: what lies before a match since the last one, the match and its value, whose lengths add up to places."""
    each = [rf"regexp_extract_all(t, '([\s\S]*?)({pattern.replace(chr(39), chr(39) * 2)})', {g})" for g in (1, 2, 3)]
    return f"""
        SELECT r, {number} AS kind, e - length(m) AS s, e, v
        FROM (SELECT r, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY n ROWS UNBOUNDED PRECEDING) AS e
              FROM (SELECT r, unnest({each[0]}) AS gap, unnest({each[1]}) AS m, unnest({each[2]}) AS v, unnest(range(len({each[0]}))) AS n FROM d))
        WHERE {fit}"""


def _listed(which: str) -> str:
    names = ", ".join(f"'{k}'" for k, _, _ in _KINDS)
    return f"coalesce(string_agg([{names}][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind, e) FILTER (WHERE {which}), '')"


#: Weak parts are completed by parts that lie beside them, found by a join on the distance; identifiers
#: are kinds 1 and 3, secrets 0, 2 and 4, and those that overlap have the value of the first of them.
SECRETS = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
         parts AS ({" UNION ALL ".join(_found(i, p, fit) for i, (_, p, fit) in enumerate(_KINDS))}),
         valued AS (SELECT *, max(e) OVER (PARTITION BY r ORDER BY s, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM parts WHERE kind < 5),
         numbered AS (SELECT *, sum(CASE WHEN s < reach THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s, kind ROWS UNBOUNDED PRECEDING) AS run FROM valued),
         held AS (SELECT r, kind, s, e, first_value(v) OVER (PARTITION BY r, run ORDER BY s, kind) AS v FROM numbered),
         weak AS (SELECT * FROM held WHERE kind >= 3 UNION ALL SELECT * FROM parts WHERE kind = 5),
         beside AS (SELECT w.r, w.kind, w.s, w.e,
                           count(*) FILTER (WHERE h.kind IN (1, 3) AND h.v <> w.v) AS ids, count(*) FILTER (WHERE h.kind IN (0, 2, 4) AND h.v <> w.v) AS secrets, count(DISTINCT h.v) AS many
                    FROM weak w JOIN held h ON w.r = h.r AND (h.e BETWEEN w.s - 400 AND w.s OR h.s BETWEEN w.e AND w.e + 400) GROUP BY ALL),
         complete AS (SELECT r, kind, s, e FROM beside WHERE CASE kind WHEN 3 THEN secrets > 0 WHEN 4 THEN ids > 0 ELSE ids > 0 AND secrets > 0 AND many > 1 END),
         spans AS (SELECT r, kind, s, e FROM parts WHERE kind < 3
                   UNION ALL SELECT c.* FROM complete c WHERE NOT EXISTS (SELECT 1 FROM parts b WHERE b.r = c.r AND b.kind < 3 AND b.s <= c.s AND b.e > c.s))
    SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
           sha256({_listed("kind < 3")}) AS base_sha256, {_listed("kind IS NOT NULL")} AS spans
    FROM d LEFT JOIN spans USING (r) GROUP BY d.r, doc_id"""

ORACLE_SQL = {"op2_top_k": TOP_K, "op6_secret_scan": SECRETS, "op10_suffix_dedup": REPEATS}

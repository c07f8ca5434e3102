"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm.quality_rules import RULES, STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_RULES = " AND ".join(
    f"(n_words < {r.from_words} OR ({r.measure} >= {r.least if r.least is not None else '-1e300'} AND {r.measure} <= {r.most if r.most is not None else '1e300'}))" for r in RULES
)

ORACLES: dict[str, str] = {
    "op8_topk_search": """
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS query_id, b.vec_id,
               CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
        FROM (SELECT vec_id, min(q) AS q FROM whole WHERE vec_id % 50 = 0 GROUP BY vec_id) a
        JOIN whole b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
    ), ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op5_quality_rules": r"""
    WITH w AS (
        SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[ \t\n\x0B\x0C\r]', '', 'g') <> '') AS l
        FROM documents
    ), places AS (
        SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5
    ), windows AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n FROM places
    ), covered AS (
        SELECT doc_id, count(DISTINCT i + k) AS c FROM windows, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY doc_id
    ), base AS (
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \t\n\x0B\x0C\r]', '', 'g')) AS BIGINT) AS word_chars,
               CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words,
               len(list_filter(w, lambda x: lower(x) IN (""" + _STOPS + r"""))) AS stops
        FROM w LEFT JOIN covered USING (doc_id)
    ), ratios AS (
        SELECT *, coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS symbol_ratio,
               coalesce(stops::DOUBLE / nullif(n_words, 0), 0) AS stop_ratio, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_ratio,
               coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS repeat_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
        FROM base
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND """ + _RULES + """ AS kept FROM ratios
    """,
}

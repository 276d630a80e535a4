"""Query of the quality rules and its SQL twin."""

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm.common import documents, durable
from sensorloom.llm.quality_rules import DIGITS, FEW, REACH, RULES, judged, measured


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = durable(measured(documents(spark, folder), keep=["doc_id", "lang", "source"]))
    out = judged(rows)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WIDE = ", ".join(
    f"coalesce(CAST(floor(1000 * {r.part} / nullif({r.whole}, 0)) AS BIGINT), 0) AS v_{r.name}" for r in RULES
)
_LONG = " UNION ALL ".join(
    f"SELECT lang, source, '{r.name}' AS rule, v_{r.name} AS v, {r.floor} AS floor_, {r.low} AS two FROM m" for r in RULES
)
_BROKEN = " OR ".join(
    f"(f.rule = '{r.name}' AND (v_{r.name} > f.high OR v_{r.name} < f.low))" for r in RULES
)


def _quartiles(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""SELECT {by}rule, max(n) AS n, {', '.join(f'min(b) FILTER (upto * 4 >= n * {q}) AS q{q}' for q in (1, 2, 3))}
        FROM (SELECT {by}rule, b, sum(count(*)) OVER (PARTITION BY {by}rule ORDER BY b) AS upto,
                sum(count(*)) OVER (PARTITION BY {by}rule) AS n FROM s GROUP BY {by}rule, b) GROUP BY {by}rule"""


QUERIES = {"op6_quality_rules": op6_quality_rules}
SQL = {
    "op6_quality_rules": f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
    e AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
    t AS (SELECT r, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM e WINDOW o AS (PARTITION BY r ORDER BY i)),
    u AS (SELECT r, i, z IS NOT NULL AND count(*) OVER (PARTITION BY r, x, y, z) > 1 AS twice FROM t),
    c AS (SELECT r, count(*) FILTER (hit) AS n_repeat_words FROM (
            SELECT r, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit
            FROM u WINDOW o AS (PARTITION BY r ORDER BY i)) GROUP BY r),
    n AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
    m AS (SELECT *, {_WIDE} FROM (SELECT d.doc_id, d.r, d.lang, d.source, len(w.ws) AS n_words,
          length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
          length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
          coalesce(n.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words,
          coalesce(n.n_lines, 0) AS n_lines
        FROM d JOIN w USING (r) LEFT JOIN c USING (r) LEFT JOIN n USING (r))),
    s AS (SELECT lang, source, rule, floor_, two,
            (v >> greatest(length(bin(v)) - {DIGITS}, 0)) << greatest(length(bin(v)) - {DIGITS}, 0) AS b FROM ({_LONG})),
    o AS ({_quartiles('lang, source')}), l AS ({_quartiles('lang')}), a AS ({_quartiles('')}),
    k AS (SELECT DISTINCT rule, floor_, two FROM s),
    p AS (SELECT o.lang, o.source, o.rule, k.floor_, k.two,
            {', '.join(f'CASE WHEN o.n >= {FEW} THEN o.q{q} WHEN l.n >= {FEW} THEN l.q{q} ELSE a.q{q} END AS q{q}' for q in (1, 2, 3))}
        FROM o JOIN k USING (rule) LEFT JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule
        LEFT JOIN a ON o.rule = a.rule),
    f AS (SELECT lang, source, rule, q3 + {REACH} * greatest(q3 - q2, floor_) AS high,
            CASE WHEN two THEN q1 - {REACH} * greatest(q2 - q1, floor_) ELSE -1 END AS low FROM p),
    x AS (SELECT m.r, count(*) AS broken FROM m JOIN f ON m.lang IS NOT DISTINCT FROM f.lang
        AND m.source IS NOT DISTINCT FROM f.source AND ({_BROKEN}) GROUP BY m.r)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
      CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
      CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
      (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
      NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(x.broken, 0) = 0 AS kept
    FROM m LEFT JOIN x USING (r)"""
}

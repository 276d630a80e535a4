"""Query of the repair of conversations and its SQL twin, which takes turn after turn."""

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm.op12 import crc32_sql
from sensorloom.llm.structure import Repair, damaged


def op11_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows, dropped = damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    return Repair(rows, gone=dropped).conversations()


QUERIES = {"op11_structure_repair": op11_structure_repair}
SQL = {
    "op11_structure_repair": f"""
    WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS lot FROM conversations),
    d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
          CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM (SELECT *, unnest(CASE WHEN lot = 3 THEN [0, 1] ELSE [0] END) FROM raw WHERE lot <> 0)),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i,
          trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM d),
    f AS (SELECT *, CASE WHEN seen = '' THEN 'blank'
          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
          WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
          left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM o),
    ins(q, p, letters, lines, paid) AS (VALUES ('', '', '', '', 0), ('', 'u', 'I', chr(10) || 'user:', 2),
        ('', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 4), ('s', 's', '', '', 0), ('s', 'u', 'I', chr(10) || 'user:', 2),
        ('s', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 4), ('u', 'u', '', '', 0), ('u', 'a', 'I', chr(10) || 'assistant:', 2),
        ('u', 'u', 'II', chr(10) || 'assistant:' || chr(10) || 'user:', 4), ('a', 'a', '', '', 0), ('a', 'u', 'I', chr(10) || 'user:', 2),
        ('a', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 4)),
    edit(p, e, initial, q, role) AS (VALUES ('', 'K', 's', 's', ''), ('', 'K', 'u', 'u', ''), ('s', 'K', 'u', 'u', ''), ('u', 'K', 'a', 'a', ''),
        ('a', 'K', 'u', 'u', ''), ('', 'R', '', 'u', 'user'), ('s', 'R', '', 'u', 'user'), ('u', 'R', '', 'a', 'assistant'),
        ('a', 'R', '', 'u', 'user'), ('', 'D', '', '', ''), ('s', 'D', '', 's', ''), ('u', 'D', '', 'u', ''), ('a', 'D', '', 'a', '')),
    ways AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS q, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM raw
        UNION ALL SELECT conv_id, i, q, cost, audit, lines FROM (
          SELECT w.conv_id, f.i, edit.q, w.cost + ins.paid + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
              + CASE WHEN fault = 'truncated' AND e <> 'D' THEN 1 ELSE 0 END AS cost, w.audit || ins.letters || e AS audit,
            w.lines || ins.lines || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || text
              ELSE chr(10) || edit.role || ':' || text END AS lines
          FROM ways w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN ins ON ins.q = w.q
          JOIN edit ON edit.p = ins.p AND (e = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (e <> 'K' OR initial = left(f.role, 1)))
        QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
    n AS (SELECT conv_id, max(i) AS n FROM ways GROUP BY conv_id),
    best AS (SELECT w.conv_id, w.cost + ins.paid AS cost, w.audit || ins.letters AS audit, w.lines || ins.lines AS lines
        FROM ways w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i JOIN ins ON ins.q = w.q AND ins.p IN ('', 'a')
        QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + ins.paid, w.audit || ins.letters) = 1),
    c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
    SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
      sha256(substr(lines, 2)) AS repaired_sha256
    FROM best LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM best.conv_id"""
}

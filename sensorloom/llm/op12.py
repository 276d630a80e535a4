"""Query of the prefix trie of conversations and its SQL twin."""

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm.trie import prefix_nodes, with_shared_beginnings


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_nodes(with_shared_beginnings(spark.read.parquet(f"{folder}/conversations.parquet")))


def _crc_table() -> list[int]:
    """Fixed rule: the reflected polynomial of CRC-32."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters in DuckDB's SQL."""
    octets = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    step = f"lambda a, x: xor(a >> 8, list_extract(CAST({_crc_table()} AS BIGINT[]), (xor(a, x) & 255) + 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295)"


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
SQL = {
    "op12_prefix_trie": f"""
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS i, r, x
        FROM (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
    c AS (SELECT conv_id AS c, conv_id - conv_id % 20 AS b, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    a AS (SELECT c, 0 AS o, i, r, x FROM c JOIN t ON conv_id = b AND i <= h
        UNION ALL SELECT c, 1, i, r, x FROM c JOIN t ON conv_id = c AND i > h),
    s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY o, i) AS d,
        md5(length(r) || ':' || r || x) AS k, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w FROM a),
    p AS (SELECT c, d, w, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS n,
          coalesce(md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 'root') AS up,
          d = max(d) OVER (PARTITION BY c) AS ended FROM s
        UNION ALL SELECT c, 0, 0, 'root', NULL, NOT EXISTS (SELECT 1 FROM s WHERE s.c = c.c) FROM c),
    n AS (SELECT n, d, up, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256 FROM p GROUP BY n, d, up),
    k AS (SELECT up, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
    m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON k.up = n.n),
    j AS (SELECT DISTINCT x.n AS a, y.n AS z FROM p x JOIN p y ON x.c = y.c AND x.d <= y.d),
    z AS (SELECT a, sum((n_convs - 1) * w) AS saved, count(*) FILTER (kids = 0) AS leaves FROM j JOIN m ON j.z = m.n GROUP BY a)
    SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs, CAST(m.kids AS BIGINT) AS n_children,
      CAST(z.leaves AS BIGINT) AS n_leaves, CAST(z.saved AS BIGINT) AS saved_tokens, m.ends_sha256
    FROM m JOIN z ON z.a = m.n LEFT JOIN n u ON u.n = m.up"""
}

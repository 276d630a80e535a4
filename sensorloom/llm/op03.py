"""Query of the exact top-k search and its SQL twin."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.bitslice import top_k

EVERY, K, SCALE = 50, 5, 256


def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % EVERY == 0, K, scale=SCALE)


QUERIES = {"op3_exact_top_k": op3_exact_top_k}
SQL = {
    "op3_exact_top_k": f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
        FROM embeddings WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    c AS (SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS d FROM v),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
        FROM c q JOIN c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0 GROUP BY 1, 2)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    WHERE rank <= {K}"""
}

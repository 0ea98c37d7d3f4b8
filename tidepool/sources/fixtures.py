"""Views over the driver's tables that give every operator an input of its shape; the same text runs in DuckDB."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the clock of every query, 2024-02-01 in ms.
NOW = 1706745600000
DAY = 86400000

#: Queries over {table}; tags are two columns, for arrays are written differently.
VIEWS = {
    "memories": """SELECT concat('m', lpad(CAST(doc_id AS STRING), 8, '0')) AS id, doc_id AS seq, text, source AS scope,
        concat('client', CAST(doc_id % 7 AS STRING)) AS source_client, CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS importance,
        1704067200000 + doc_id * 600000 AS created_at, 1704067200000 + doc_id * 600000 + (doc_id % 3) * 60000 AS updated_at,
        CASE WHEN doc_id % 3 = 0 THEN 1704067200000 + doc_id * 600000 + (doc_id % 11) * 3600000 END AS last_accessed,
        CASE WHEN doc_id % 3 = 0 THEN 1 + doc_id % 17 ELSE 0 END AS access_count,
        1704067200000 + doc_id * 600000 AS valid_from,
        CASE WHEN doc_id % 13 = 0 THEN 1704067200000 + doc_id * 600000 + (1 + doc_id % 5) * 86400000 END AS valid_until,
        CASE WHEN doc_id % 13 = 0 THEN concat('m', lpad(CAST(doc_id + 1 AS STRING), 8, '0')) END AS superseded_by,
        CASE WHEN doc_id % 4 <> 0 THEN concat('e', lpad(CAST(doc_id AS STRING), 8, '0')) END AS episode_id,
        CASE WHEN doc_id % 19 = 0 THEN 1704067200000 + doc_id * 600000 + 172800000 END AS deleted_at,
        doc_id % 23 = 0 AS redacted,
        CASE WHEN doc_id % 5 = 0 THEN 'import' WHEN doc_id % 5 = 1 THEN 'unknown' ELSE 'user' END AS origin,
        doc_id % 10 = 0 AS approved, lang AS tag1, concat('b', CAST(doc_id % 6 AS STRING)) AS tag2 FROM {documents}""",
    "vectors": "SELECT 'fixture-64' AS model_id, 64 AS dim, vec_id AS seq, embedding FROM {embeddings}",
    "queries": "SELECT concat('q', CAST(b.item_id AS STRING)) AS query_id, b.text AS query, e.embedding FROM {benchmark} b LEFT JOIN {embeddings} e ON e.vec_id = b.item_id",
    "audit": """SELECT event_id AS id, ts AS event_time, CASE event_type WHEN 'view' THEN 'recall' WHEN 'click' THEN 'get_context'
        WHEN 'purchase' THEN 'remember' WHEN 'signup' THEN 'update_memory' ELSE 'privacy_mode' END AS action,
        concat('m', lpad(CAST(event_id % 200 AS STRING), 8, '0')) AS memory_id, concat('client', CAST(user_id % 30 AS STRING)) AS source_client,
        event_id % 11 = 0 AS refused, CAST(floor(value) AS BIGINT) AS result_count FROM {events}""",
    "clients": """SELECT concat('client', CAST(user_id % 30 AS STRING)) AS id, min(ts) AS first_seen, max(ts) AS last_seen, (user_id % 30) % 9 <> 0 AS enabled
        FROM {events} WHERE user_id % 30 < 25 GROUP BY user_id % 30""",
    "planted": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text || ' AKIA' || lpad(CAST(doc_id AS STRING), 16, 'A')
        WHEN 1 THEN text || ' sk-ant-' || lpad(CAST(doc_id AS STRING), 24, 'a') || ' end'
        WHEN 2 THEN text || ' postgres://u:pw' || CAST(doc_id AS STRING) || '@db'
        WHEN 3 THEN text || ' bearer ' || lpad(CAST(doc_id AS STRING), 20, 'x')
        WHEN 4 THEN text || chr(10) || 'export API_KEY=' || lpad(CAST(doc_id AS STRING), 16, 'k') ELSE text END AS text FROM {documents}""",
}
TABLES = ("documents", "embeddings", "benchmark", "events", "conversations")


def duckdb_view(name: str) -> str:
    return VIEWS[name].format(**{t: t for t in TABLES})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **used)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "memories").withColumn("tags", F.array_sort(F.array("tag1", "tag2"))).drop("tag1", "tag2")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with `ts` in ms."""
    return view(spark, sf_dir, "audit").withColumn("ts", F.unix_millis(F.col("event_time").cast("timestamp"))).drop("event_time")


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).alias(c)
    return view(spark, sf_dir, "clients").select("id", F.concat(F.lit("name of "), "id").alias("name"), ms("first_seen"), ms("last_seen"), "enabled")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the scope, liveness and time of their memories."""
    m = memories(spark, sf_dir).select("seq", "scope", (F.col("deleted_at").isNull() & F.col("valid_until").isNull()).alias("live"), "created_at")
    return view(spark, sf_dir, "vectors").join(m, "seq")

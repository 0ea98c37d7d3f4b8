"""Schemas of the stored tables, reading and appending."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "memories": (
        "id STRING, seq BIGINT, text STRING, scope STRING, source_client STRING, importance DOUBLE, created_at BIGINT, updated_at BIGINT, "
        "last_accessed BIGINT, access_count BIGINT, valid_from BIGINT, valid_until BIGINT, superseded_by STRING, episode_id STRING, "
        "deleted_at BIGINT, redacted BOOLEAN, content_hash STRING, origin STRING, approved BOOLEAN, tags ARRAY<STRING>"
    ),
    "episodes": "id STRING, content STRING, scope STRING, source_client STRING, metadata STRING, created_at BIGINT, forgotten BOOLEAN",
    "vectors": "model_id STRING, dim INT, seq BIGINT, embedding ARRAY<FLOAT>, scope STRING, live BOOLEAN, created_at BIGINT",
    "audit": "id BIGINT, ts BIGINT, action STRING, memory_id STRING, scope STRING, source_client STRING, query STRING, result_count BIGINT, details STRING, refused BOOLEAN",
    "clients": "id STRING, name STRING, first_seen BIGINT, last_seen BIGINT, enabled BOOLEAN",
    "findings": "ts BIGINT, memory_id STRING, episode_id STRING, scope STRING, source_client STRING, kind STRING, start INT, `end` INT, preview STRING, action STRING",
}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table with its fixed columns."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def append(rows: DataFrame, path: str, name: str, time: str = "ts") -> None:
    """Appends to a log table, by day."""
    day = F.to_date(F.timestamp_millis(F.col(time)))
    rows.withColumn("day", day).write.mode("append").partitionBy("day").parquet(f"{path}/{name}")

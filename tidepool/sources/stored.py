"""Intermediate tables in the folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: so many narrow rows may be sent to every task; more of them are joined by a shuffle.
FEW = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder, on a local master only, for other machines would not see it."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        top = context.getCheckpointDir()
    return top


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/q-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df written and read back: what follows reads it, however often, and a lost executor loses nothing."""
    path = f"{scratch(df.sparkSession)}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(rows: DataFrame) -> DataFrame:
    """Stored rows: sent to every task while they are no more than FEW, so that the table they are joined with stays where it
    is, texts above all."""
    return F.broadcast(rows) if rows.count() <= FEW else rows

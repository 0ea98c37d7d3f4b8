"""Vectors of memories: embedding, checks, the incremental index, liveness, spaces."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import vector
from tidepool.operators.filters import live

Provider = Callable[[list[str]], list[list[float]]]


def embed(rows: DataFrame, provider: Provider | None, model_id: str, dim: int, batch: int = 32) -> DataFrame:
    """rows (seq, text, ...) with model_id, dim and embedding. provider: a function from texts to vectors, called with up to
    `batch` (1 to 256) texts at a time on the workers; None is the hash embedding, inside the JVM."""
    size = max(1, min(batch, 256))
    if provider is None:
        vectors = vector.hash_embedding(F.col("text"), dim)
    else:

        @F.pandas_udf("array<float>")
        def call(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in series:
                texts = s.tolist()
                yield pd.Series([v for at in range(0, len(texts), size) for v in provider(texts[at : at + size])])

        vectors = call(F.col("text"))
    return rows.withColumns({"model_id": F.lit(model_id), "dim": F.lit(dim), "embedding": vectors})


def check(rows: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(vectors that can be stored, those refused with their flaw)."""
    judged = rows.withColumn("flaw", vector.flaw(F.col("embedding"), dim))
    return judged.where("flaw is null").drop("flaw"), judged.where("flaw is not null")


def in_space(vectors: DataFrame, model_id: str, dim: int) -> DataFrame:
    """One model's vectors; the table is partitioned by (model_id, dim), so others are not read."""
    return vectors.where((F.col("model_id") == model_id) & (F.col("dim") == dim))


def backlog(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Live memories without a vector; a new model's space starts with all of them."""
    return live(memories).join(vectors.select("seq"), "seq", "left_anti")


def index_step(memories: DataFrame, vectors: DataFrame, provider: Provider | None, model_id: str, dim: int, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new vectors, refused ones, progress): embeds the backlog of a space, oldest first if limited.

    progress is one row (embedded, failed, remaining).
    """
    todo = backlog(memories, in_space(vectors, model_id, dim)).select("seq", "text", "scope", "created_at")
    now = todo if limit is None else todo.orderBy("seq").limit(limit)
    good, bad = check(embed(now, provider, model_id, dim), dim)
    rows = good.join(live(memories).select("seq"), "seq", "left_semi").select("model_id", "dim", "seq", "embedding", "scope", F.lit(True).alias("live"), "created_at")
    progress = rows.agg(F.count("*").alias("embedded")).join(bad.agg(F.count("*").alias("failed"))).join(todo.agg(F.count("*").alias("_all"))).select("embedded", "failed", (F.col("_all") - F.col("embedded") - F.col("failed")).alias("remaining"))
    return rows, bad, progress


def sync_liveness(vectors: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors whose `live` follows their memories, one row (demoted, promoted))."""
    both = vectors.join(live(memories).select("seq", F.lit(True).alias("_alive")), "seq", "left").withColumn("_alive", F.coalesce("_alive", F.lit(False)))
    counts = both.agg(F.count_if(F.col("live") & ~F.col("_alive")).alias("demoted"), F.count_if(~F.col("live") & F.col("_alive")).alias("promoted"))
    return both.withColumn("live", F.col("_alive")).select(vectors.columns), counts


def delete_vectors(vectors: DataFrame, seqs: DataFrame) -> DataFrame:
    return vectors.join(seqs.select("seq"), "seq", "left_anti").select(vectors.columns)


def set_live(vectors: DataFrame, seqs: DataFrame, value: bool) -> DataFrame:
    named = seqs.select("seq", F.lit(value).alias("_to")).distinct()
    return vectors.join(named, "seq", "left").withColumn("live", F.coalesce("_to", "live")).select(vectors.columns)


def fetch_vectors(vectors: DataFrame, seqs: DataFrame) -> DataFrame:
    return vectors.join(seqs.select("seq").distinct(), "seq", "left_semi").select(vectors.columns)

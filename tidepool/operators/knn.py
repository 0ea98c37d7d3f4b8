"""Exact nearest vectors for a batch of queries.

Both sides are packed into blocks (one row, one matrix); every block of queries meets every block of vectors of its space
through an equi-join on block numbers, and a block pair returns at most k rows for each query. So what is shuffled beyond
the vectors themselves is queries x k for each block, whatever the corpus size, and nothing is broadcast or collected.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 200  # fixed value: more neighbours than this are never returned


def _packed(rows: DataFrame, size: int, key: str) -> DataFrame:
    """(space, block, n_blocks, keys, matrix): rows (space, key, embedding) dealt by hash."""
    n = rows.groupBy("space").agg(F.ceil(F.count("*") / size).cast("int").alias("n_blocks"))  # a row for each space
    dealt = rows.join(n, "space").withColumn("block", F.pmod(F.xxhash64(key), "n_blocks").cast("int"))
    return dealt.groupBy("space", "block", "n_blocks").agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), "embedding"))).alias("rows"))


def _block(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a block and its vectors as rows of length one, zero vectors as they are; no value becomes a Python object but string keys."""
    keys, vectors = (cell.values.field(name) for name in ("key", "embedding"))
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return keys.to_numpy(zero_copy_only=False), np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def knn(queries: DataFrame, vectors: DataFrame, k: int, max_distance: float = 2.0, query_block: int = 512, vector_block: int = 8192) -> DataFrame:
    """(query_id, seq, distance, rank): the k nearest by cosine distance (9 decimals), ties to the smaller seq.

    queries (query_id, embedding[, scope, model_id, dim]) and vectors (seq, embedding[, scope, live, model_id, dim]): a
    query sees live vectors of its own length, of its model if both tables have one, and of its scope if it names one.
    Queries without a vector find nothing. All filters hold before the k nearest are taken.
    """
    k = max(1, min(k, MOST))
    vectors = vectors.where("live") if "live" in vectors.columns else vectors
    parts = [F.size("embedding").cast("string")]
    if "model_id" in vectors.columns and "model_id" in queries.columns:
        parts.append(F.col("model_id"))
    usable = lambda df: df.where("embedding is not null and size(embedding) > 0").withColumn("space", F.concat_ws("/", *parts))
    asked, known = usable(queries), usable(vectors)
    if "scope" in queries.columns:  # a scoped query meets the vectors of its scope only
        scoped = F.struct("space", "scope")
        found = [_search(asked.where("scope is null"), known, k, query_block, vector_block), _search(asked.where("scope is not null").withColumn("space", scoped.cast("string")), known.withColumn("space", scoped.cast("string")), k, query_block, vector_block)]
        best = found[0].unionByName(found[1])
    else:
        best = _search(asked, known, k, query_block, vector_block)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "seq"))
    return best.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("distance") <= max_distance))


def _search(queries: DataFrame, vectors: DataFrame, k: int, query_block: int, vector_block: int) -> DataFrame:
    v = _packed(vectors.select("space", "seq", "embedding"), vector_block, "seq")
    q = _packed(queries.select("space", "query_id", "embedding"), query_block, "query_id").select("space", F.col("rows").alias("asked"))
    n = vectors.groupBy("space").agg(F.ceil(F.count("*") / vector_block).cast("int").alias("n"))
    pairs = q.join(n, "space").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).join(v.select("space", "block", "rows"), ["space", "block"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asked, rows in zip(b.column(0), b.column(1)):
                (ids, q), (seqs, v) = _block(asked), _block(rows)
                d, best = np.round(1 - q @ v.T, 9), []
                for row in d:
                    near = np.argpartition(row, k - 1)[:k] if len(row) > k else np.arange(len(row))
                    near = np.flatnonzero(row <= row[near].max())  # ties at the edge, then cut by seq
                    best.append(near[np.lexsort((seqs[near], row[near]))][:k])
                at, col = np.repeat(np.arange(len(d)), [len(x) for x in best]), np.concatenate(best)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.string()), pa.array(seqs[col], pa.int64()), pa.array(d[at, col])], ["query_id", "seq", "distance"])

    return pairs.select("asked", "rows").mapInArrow(nearest, "query_id string, seq long, distance double")

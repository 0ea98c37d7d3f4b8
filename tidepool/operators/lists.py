"""Inverted lists of vectors: approximate neighbours by probing few lists, and all pairs above a threshold, exactly.

Centroids are trained by k-means on unit vectors, from a bounded sample; every vector is then put on the list of its nearest
centroid. Two uses:

- `knn_approximate`: a query meets the vectors of the `probes` lists nearest to it only. What it finds is scored exactly, so
  errors are omissions; `recall` measures them against the exact search. More probes, fewer omissions; all probes, none.
- `similar_pairs`: every pair with a cosine of `least` or more. On the unit sphere a cosine is a distance, r = sqrt(2 - 2 cos).
  If y lies within r of x and on another list, with centroid p, then d(x, p) <= d(x, own centroid) + 2 r by the triangle
  inequality, so x visits those lists alone, and inside a list only texts whose distances to the centroid differ by r at most
  are multiplied. That is exact whatever the centroids are; good ones leave few visits.

Equal vectors are told first: pairs are of different vectors, each named by its smallest seq, and `copies` says which rows
share one, so a vector that fills much of the table brings no pairs of copies.

Vectors that are null, empty, zero or hold null or non-finite components are on no list. Lists of any size are cut into
blocks, and blocks meet by an equi-join, so a hot list is spread; a block pair returns what it found, nothing is collected.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import vector
from tidepool.operators.knn import MOST, _search, knn
from tidepool.sources.stored import stored


MOST_TASKS = 20_000  # fixed value: more partitions than this cost more than they spread


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding is finite and not zero."""
    finite = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return vectors.where(finite & (F.coalesce(F.size("embedding"), F.lit(0)) > 0)).where(vector.norm(F.col("embedding")) > 0)


def centroids(vectors: DataFrame, n: int, sample: int = 20_000, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """n unit centroids of usable vectors (seq, embedding) of one length, trained on at most `sample` of them, chosen by a
    hash of seq; fewer if there are fewer different vectors. The sample is brought to the driver: sample x length numbers."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("seq"), "seq").limit(sample).toPandas()["embedding"]
    if not len(rows):
        return np.zeros((0, 0))
    x = np.unique(np.stack([np.asarray(v, np.float64) for v in rows]), axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), c)
    return c


def _unit(cell: pa.Array) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in cell.to_numpy(zero_copy_only=False)])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def assign(vectors: DataFrame, c: np.ndarray, probes: int = 1, key: str = "seq", within: float | None = None) -> DataFrame:
    """(key, embedding, list, near, home): each usable vector with the `probes` nearest centroids, or with those at most
    `within` farther than the nearest; near is its distance to them, home the nearest. Vectors of another length are left
    out. The centroids travel with the task: their number is chosen, not grown."""
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = np.sqrt(np.maximum(0, 2 - 2 * _unit(b.column(1)) @ c.T))
                if within is None:
                    at = np.argsort(d, axis=1, kind="stable")[:, :probes]
                    rows, at = np.repeat(np.arange(len(d)), at.shape[1]), at.ravel()
                else:
                    rows, at = np.nonzero(d <= d.min(axis=1, keepdims=True) + within)
                home = d.argmin(axis=1)[rows]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array(d[rows, at]), pa.array(home.astype(np.int32))], names=[key, "embedding", "list", "near", "home"])

    rows = usable(vectors).where(F.size("embedding") == (c.shape[1] if len(c) else -1))
    return rows.select(key, F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, f"{key} {kind}, embedding array<float>, list int, near double, home int")


def knn_approximate(queries: DataFrame, lists: DataFrame, c: np.ndarray, k: int, probes: int = 8, max_distance: float = 2.0, query_block: int = 512, vector_block: int = 8192) -> DataFrame:
    """(query_id, seq, distance, rank) like knn, over the lists nearest to each query. lists (seq, embedding, list) come from
    assign, kept as a table parted by list if they are to be searched again. Queries without a usable vector find nothing."""
    k = max(1, min(k, MOST))
    asked = assign(queries, c, probes, "query_id").select("query_id", "embedding", F.col("list").cast("string").alias("space"))
    known = lists.select("seq", "embedding", F.col("list").cast("string").alias("space"))
    best = _search(stored(asked, "probes"), known, k, query_block, vector_block)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "seq"))
    return best.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("distance") <= max_distance))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: (n, hit, recall), the share of the exact neighbours (query_id, seq) that were found."""
    both = exact.select("query_id", "seq").join(found.select("query_id", "seq", F.lit(True).alias("hit")), ["query_id", "seq"], "left")
    return both.agg(F.count("*").alias("n"), F.count("hit").alias("hit")).withColumn("recall", F.try_divide("hit", "n"))


def probes_for(vectors: DataFrame, lists: DataFrame, c: np.ndarray, k: int, target: float = 0.95, sample: int = 256) -> int:
    """How many lists to probe for that recall of k neighbours: `sample` vectors (seq, embedding), chosen by a hash of seq, are
    searched exactly, and the lists of their neighbours ranked as a probe would reach them."""
    asked = usable(vectors).orderBy(F.xxhash64("seq"), "seq").limit(sample).select(F.col("seq").cast("string").alias("query_id"), "embedding")
    asked = stored(asked, "asked")
    near = knn(asked, vectors.select("seq", "embedding"), k).select("query_id", "seq").join(lists.select("seq", "list"), "seq")
    reached = assign(asked, c, len(c), "query_id").withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("near", "list")))
    turn = near.join(reached.select("query_id", "list", "turn"), ["query_id", "list"]).agg(F.percentile("turn", F.lit(target))).first()[0]
    return len(c) if turn is None else int(np.ceil(turn))


def copies(vectors: DataFrame) -> DataFrame:
    """(seq, first) of every usable row: first is the smallest seq of its vector."""
    rows = usable(vectors).select("seq", F.transform("embedding", lambda x: x.cast("float") + F.lit(0.0).cast("float")).alias("embedding"))  # -0.0 is 0.0
    first = rows.groupBy("embedding").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    shared = stored(first.where("n > 1").select("embedding", "first"), "shared")
    return rows.join(shared, "embedding", "left").select("seq", F.coalesce("first", "seq").alias("first"))


def similar_pairs(vectors: DataFrame, least: float, n_lists: int = 64, sample: int = 20_000, block: int = 2048) -> DataFrame:
    """(a, b, cosine): all pairs a < b of different vectors of one length with a cosine of `least` or more; a and b are the
    smallest seqs of their vectors, see `copies`. Cosines are of double precision, rounded to 9 decimals before they are compared."""
    same = stored(copies(vectors), "copies")
    distinct = stored(usable(vectors).join(same.where("seq = first").select("seq"), "seq", "left_semi").select("seq", "embedding"), "distinct")
    c = centroids(distinct, n_lists, sample)
    r = float(np.sqrt(max(0.0, 2 - 2 * (least - 1e-9)))) + 1e-9
    if not len(c):
        return distinct.select(F.col("seq").alias("a"), F.col("seq").alias("b"), F.lit(0.0).alias("cosine"))
    visits = assign(distinct, c, within=2 * r + 1e-9)
    if visits.count() ** 2 >= len(c) * distinct.count() ** 2:  # so many visits that the lists together multiply more than one would
        visits = assign(distinct, c[:1])
    rows = stored(visits, "visits")
    sizes = stored(rows.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("g")), "sizes")  # a row for each list
    dealt = rows.join(F.broadcast(sizes), "list").withColumn("own", F.pmod(F.xxhash64("seq"), "g").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    blocks = dealt.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "seq", "embedding", "near", "home")
    # the work is that of the pairs of blocks, which grows faster than their bytes: as many partitions as pairs, so a task has a few
    n_pairs = sizes.agg(F.sum(F.col("g") * (F.col("g") + 1) / 2)).first()[0] or 1
    spread = blocks.repartition(int(min(n_pairs, MOST_TASKS)), "list", "i", "j")
    packed = spread.groupBy("list", "i", "j").agg(F.collect_list(F.struct("own", "seq", "embedding", "near", "home")).alias("rows"))  # two blocks at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for here, cell in zip(b.column(0).to_pylist(), b.column(1)):
                block, seq, near, home = (cell.values.field(x).to_numpy(zero_copy_only=False) for x in ("own", "seq", "near", "home"))
                order = np.argsort(near, kind="stable")
                block, seq, near, home = block[order], seq[order], near[order], home[order]
                x = _unit(cell.values.field("embedding"))[order]
                split = len(np.unique(block)) > 1
                out = []
                for at in range(0, len(seq), 256):
                    end = min(at + 256, len(seq))
                    stop = int(np.searchsorted(near, near[end - 1] + r, "right"))
                    cos = np.round(x[at:end] @ x[at:stop].T, 9)
                    i, j = np.nonzero(cos >= least)
                    keep = (j > i) & ((home[at + i] == here) | (home[at + j] == here))
                    keep &= np.minimum(home[at + i], home[at + j]) == here  # a pair of two lists is told on the smaller one
                    if split:
                        keep &= block[at + i] != block[at + j]
                    i, j = i[keep], j[keep]
                    out.append((seq[at + i], seq[at + j], cos[i, j]))
                a, z, cos = (np.concatenate([o[k] for o in out]) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, z), pa.int64()), pa.array(np.maximum(a, z), pa.int64()), pa.array(cos)], names=["a", "b", "cosine"])

    return packed.select("list", "rows").mapInArrow(run, "a long, b long, cosine double")

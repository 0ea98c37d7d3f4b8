"""Exact top-k inner products by distributed histogram selection.

Every query is scored against every candidate, block against block. Instead of sorting scores, the kth best score of each
query is located: each round counts scores in 1024 bins of the range that still holds the kth value, the counts of all
blocks are added, and the range shrinks to the bin in which the count from above passes k. Scores are integers, so a bin
of width one is the kth value itself. A last round keeps scores at or above it; ties go to the smaller vec_id.

Blocks meet in groups, a few of queries with a few of candidates, and travel to a group in a shuffle: a task holds one group,
whatever the number of blocks, and no block is copied for each block that it meets.

A group reports only its k best scores (the global kth value cannot lie below), and a block, of its ties at the kth value, only
the k smallest ids. So a group returns at most k counts, then a block at most 2k rows, for each query.

Vectors travel as 16-bit integers where their components have room in them, and are multiplied in single precision where no
product of two blocks can reach 2^24, in double precision elsewhere; both are exact.

Vectors that are null, empty or hold null, NaN or infinite components take no part, nor do rows with a null vec_id. Vectors
of different lengths are never compared. Every row is a candidate, and every row with a queried vec_id a query of its own:
rows that share a vec_id find each other, but no row finds itself. An empty table gives no rows; fewer than k candidates give
all of them. Components must leave inner products below 2^53.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import save, sorted_groups

BINS = 1024
#: So many blocks of queries and of candidates are a group's at most.
QUERIES, CANDIDATES = 16, 4
BLOCK = pa.schema([("d", pa.int32()), ("block", pa.int32()), ("n_blocks", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("m", pa.binary())])


def _whole(batches):
    for b in batches:
        size = np.array([len(x) for x in b.column(2).to_pylist()])
        for d in np.unique(size):
            g = b.filter(pa.array(size == d))
            v = np.floor(256 * np.stack(g.column(2).to_numpy(zero_copy_only=False)).astype(np.float64))
            raw = [x.astype("<i2" if abs(x).max() < 1 << 15 else "<f8").tobytes() for x in v]
            yield pa.RecordBatch.from_arrays([g.column(0), g.column(1), pa.array(np.full(len(v), d, np.int32)), pa.array(np.sqrt((v * v).sum(axis=1))), pa.array(raw, pa.binary())], names=["row", "vec_id", "d", "norm", "v"])


def whole(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, d, norm, v binary): floor(256 x) of every vector that takes part."""
    v = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    usable = v.where("vec_id is not null and x is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    return usable.mapInArrow(_whole, "row long, vec_id long, d int, norm double, v binary")


def matrix(raw: list[bytes], d: int) -> np.ndarray:
    """Vectors as rows of the narrower type that holds them all."""
    if all(len(x) == 2 * d for x in raw):
        return np.frombuffer(b"".join(raw), "<i2").reshape(-1, d)
    return np.stack([np.frombuffer(x, "<i2" if len(x) == 2 * d else "<f8").astype("<f8") for x in raw])


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows dealt by hash into blocks of about `size`: one row a block with row numbers, ids and vectors as bytes."""
    counts = rows.groupBy("d").agg(F.ceil(F.count("*") / size).cast("int").alias("n_blocks"))  # a row for each length of vectors
    dealt = rows.join(F.broadcast(counts), "d").select("d", F.pmod(F.xxhash64("row"), "n_blocks").cast("int").alias("block"), "n_blocks", "row", "vec_id", "v").repartition("d", "block").sortWithinPartitions("d", "block", "vec_id", "row")

    def run(batches):
        for t, starts in sorted_groups(batches, ["d", "block"]):
            for s, e in zip(starts, [*starts[1:], t.num_rows]):
                x = t.slice(s, e - s)
                yield pa.RecordBatch.from_pylist([{"d": x["d"][0].as_py(), "block": x["block"][0].as_py(), "n_blocks": x["n_blocks"][0].as_py(), "rows": x["row"].to_numpy().tobytes(), "ids": x["vec_id"].to_numpy().tobytes(), "m": matrix(x["v"].to_pylist(), x["d"][0].as_py()).tobytes()}], BLOCK)

    return save(dealt.mapInArrow(run, "d int, block int, n_blocks int, rows binary, ids binary, m binary"), name)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, candidate_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose vec_id is in queries, itself left out."""
    every = save(whole(vectors), "whole")
    cands = blocks(every, candidate_block, "candidates")
    asked = every.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    asks = blocks(asked, query_block, "queries")
    against = grouped(cands, asks, CANDIDATES, QUERIES).select("d", F.col("other").alias("qg"), F.col("own").alias("cg"), F.col("rows").alias("c_rows"), F.col("ids").alias("c_ids"), F.col("m").alias("c_m"))

    def meet(state: DataFrame, run, schema: str) -> DataFrame:
        own = grouped(asks.join(by_block(state), ["d", "block"]), cands, QUERIES, CANDIDATES)
        own = own.select("d", F.col("own").alias("qg"), F.col("other").alias("cg"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), "lo", "width")
        return own.groupBy("d", "qg", "cg").cogroup(against.groupBy("d", "qg", "cg")).applyInArrow(lambda q, c: run(q, c, k), schema)

    largest = every.groupBy("d").agg(F.max("norm").alias("c_norm"))
    nq = asks.groupBy("d").agg(F.max("n_blocks").alias("nq"))
    state = (
        asked.join(F.broadcast(largest), "d")
        .join(F.broadcast(nq), "d")
        .select("d", F.pmod(F.xxhash64("row"), "nq").cast("int").alias("block"), "vec_id", "row", (F.ceil(F.col("norm") * F.col("c_norm")) + 1).cast("long").alias("far"))
        .select("d", "block", "vec_id", "row", (-F.col("far")).alias("lo"), (2 * F.col("far") + 1).alias("width"), F.lit(k).cast("long").alias("need"))
    )
    state = save(state, "state")
    while (state.agg(F.max("width")).first()[0] or 1) > 1:
        counts = meet(state, _count, "row long, bin int, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("bin")))
        found = counts.join(state.select("row", "need"), "row").withColumn("above", above).groupBy("row").agg(F.min(F.when(F.col("above") >= F.col("need"), F.struct(F.col("above"), "bin", "n"))).alias("hit"))
        step = F.ceil(F.col("width") / BINS).cast("long")
        # without a hit there are fewer than k candidates: the smallest value of the range keeps them all
        state = save(state.join(found, "row", "left").select(
            "d", "block", "vec_id", "row", (F.col("lo") + F.coalesce(F.col("hit.bin"), F.lit(0)) * step).alias("lo"),
            F.when(F.col("hit").isNull(), 1).otherwise(step).cast("long").alias("width"),
            F.when(F.col("hit").isNull(), F.col("need")).otherwise(F.col("need") - (F.col("hit.above") - F.col("hit.n"))).alias("need")), "state")
    kept = meet(state, _keep, "row long, query_id long, vec_id long, other long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def grouped(these: DataFrame, those: DataFrame, n_own: int, n_other: int) -> DataFrame:
    """Blocks with the number of their group of n_own (`own`), once for each group of n_other (`other`) of those."""
    n = those.groupBy("d").agg(F.max("n_blocks").alias("n_those"))  # a row for each length
    last = F.floor((F.col("n_those") - 1) / n_other).cast("int")
    return these.join(F.broadcast(n), "d").withColumns({"own": F.floor(F.col("block") / n_own).cast("int"), "other": F.explode(F.sequence(F.lit(0), last))})


def by_block(state: DataFrame) -> DataFrame:
    """The state of a block's queries (at most about a block's size) as one row, in the order of the block."""
    return state.groupBy("d", "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row", "lo", "width"))).alias("st")).select("d", "block", F.col("st.lo").alias("lo"), F.col("st.width").alias("width"))


def _scores(q: dict, c: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the queries and of the candidates, and their scores: whole numbers, exact."""
    q_rows, c_rows = np.frombuffer(q["q_rows"], "<i8"), np.frombuffer(c["c_rows"], "<i8")
    q, c = (np.frombuffer(x, "<i2" if len(x) == 2 * n * d else "<f8").reshape(n, -1) for x, n in ((q["q_m"], len(q_rows)), (c["c_m"], len(c_rows))))
    kind = np.float32 if d * max(float(abs(q.astype(float)).max()), 1) * max(float(abs(c.astype(float)).max()), 1) < 1 << 24 else np.float64
    s = q.astype(kind) @ c.astype(kind).T
    order = np.argsort(c_rows)
    at = np.searchsorted(c_rows, q_rows, sorter=order).clip(max=len(c_rows) - 1)
    own = np.flatnonzero(c_rows[order[at]] == q_rows)
    s[own, order[at[own]]] = -np.inf
    return q_rows, c_rows, s


def _rows(batches):
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _bound(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A column of bounds in the type of the scores; scores in single precision lie within 2^24, where it is exact."""
    return (x.clip(-(1 << 24), 1 << 24) if s.dtype == np.float32 else x).astype(s.dtype)[:, None]


def _best(s: np.ndarray, k: int) -> np.ndarray:
    return np.partition(s, -k, axis=1)[:, -k:] if s.shape[1] > k else s


def _count(asks: pa.Table, cands: pa.Table, k: int) -> pa.Table:
    d, out, others = asks["d"][0].as_py(), [], cands.to_pylist()
    for q in asks.to_pylist():
        lo, width = (np.array(q[x], np.int64) for x in ("lo", "width"))
        best = np.empty((len(lo), 0))
        for c in others:
            q_rows, _, s = _scores(q, c, d)
            s[s >= _bound(lo + width, s)] = -np.inf  # counted already
            best = _best(np.concatenate([best, _best(s, k)], axis=1), k)
        i, j = np.nonzero(best >= lo[:, None])
        bins = (best[i, j] - lo[i]) // -(-width // BINS)[i]
        key, n = np.unique(i * BINS + bins.astype(np.int64), return_counts=True)
        out.append(pa.table({"row": q_rows[key // BINS], "bin": (key % BINS).astype(np.int32), "n": n.astype(np.int64)}))
    return pa.concat_tables(out)


def _keep(asks: pa.Table, cands: pa.Table, k: int) -> pa.Table:
    d, out, others = asks["d"][0].as_py(), [], cands.to_pylist()
    for q in asks.to_pylist():
        q_ids, lo = np.frombuffer(q["q_ids"], "<i8"), np.array(q["lo"], np.int64)
        for c in others:
            q_rows, c_rows, s = _scores(q, c, d)
            c_ids, kth = np.frombuffer(c["c_ids"], "<i8"), _bound(lo, s)
            i, j = np.nonzero(s > kth)
            ti, tj = np.nonzero(s == kth)  # by query, then id: candidates are in the order of their ids
            nth = np.arange(len(ti)) - np.searchsorted(ti, ti)
            i, j = np.concatenate([i, ti[nth < k]]), np.concatenate([j, tj[nth < k]])
            out.append(pa.table({"row": q_rows[i], "query_id": q_ids[i], "vec_id": c_ids[j], "other": c_rows[j], "score": s[i, j].astype(np.int64)}))
    return pa.concat_tables(out)

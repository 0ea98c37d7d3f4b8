"""Inverted lists of vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import lists
from tidepool.operators.knn import knn


def clustered(n, dim=16, seed=1, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 40 + 1, dim))
    return (centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, dim))).astype(np.float32)


def frame(spark, rows, key="seq", kind="long"):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], "x") for k, v in rows], f"{key} {kind}, embedding array<float>, home string")


def odd(dim=16):
    return [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]


@pytest.mark.parametrize("least, n_lists, block", [(0.9, 12, 2048), (0.7, 5, 16), (0.99, 40, 50), (-1.0, 3, 64)])
def test_similar_pairs_are_all_pairs(spark, least, n_lists, block):
    n = 60 if least < 0 else 400
    x = clustered(n)
    rows = list(enumerate(x)) + [(n + k, x[k // 3]) for k in range(12)] + [(n + 50 + k, v) for k, v in enumerate(odd())] + [(n + 100, x[5] * 2)]
    got = {(r.a, r.b): r.cosine for r in lists.similar_pairs(frame(spark, rows), least, n_lists, 200, block).collect()}
    first = {}
    for k, v in rows:
        if v is not None and len(v) and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(v):
            first.setdefault(tuple(np.float32(v)), k)
    ids = sorted(first.values())
    u = np.stack([np.array(dict(rows)[k], np.float64) for k in ids])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 9)
    want = {(ids[i], ids[j]): cos[i, j] for i in range(len(ids)) for j in range(i + 1, len(ids)) if cos[i, j] >= least}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want) and len(want) > 0


def test_copies_are_told_once(spark):
    rows = [(k, [1.0, float(k % 4), -0.0 if k % 2 else 0.0]) for k in range(1000)] + [(2000, None), (2001, [0.0, 0.0, 0.0])]
    got = {r.seq: r.first for r in lists.copies(frame(spark, rows)).collect()}
    assert got == {k: k % 4 for k in range(1000)}
    assert lists.similar_pairs(frame(spark, [(k, [1.0, 2.0]) for k in range(50)]), 0.5).count() == 0


def test_recall_of_approximate_neighbours(spark):
    """Over 0.9 with the default probes, exactly the exact result with all of them."""
    x = clustered(3000, spread=0.9)
    v, q = frame(spark, enumerate(x)), frame(spark, [(f"q{k}", w + 0.1) for k, w in enumerate(x[::30])] + [("none", None), ("zero", [0.0] * 16)], "query_id", "string")
    c = lists.centroids(v, 40)
    kept = lists.assign(v, c)
    assert kept.count() == 3000 and kept.where("list <> home").count() == 0
    exact = knn(q.select("query_id", "embedding"), v.select("seq", "embedding"), 10).where(~F.col("query_id").isin("zero"))
    found = lists.knn_approximate(q, kept, c, 10, probes=8)
    share = lambda df: lists.recall(df, exact).first().recall
    assert share(found) >= 0.9 and share(found) > share(lists.knn_approximate(q, kept, c, 10, probes=1))
    rows = lambda df: sorted((r.query_id, r["rank"], r.seq, r.distance) for r in df.collect())
    assert rows(lists.knn_approximate(q, kept, c, 10, probes=40)) == rows(exact)


def test_probes_are_chosen_for_a_recall(spark):
    """Also where vectors are spread evenly, so that lists tell little."""
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((1500, 24)).astype(np.float32), rng.standard_normal((60, 24)).astype(np.float32)
    v, q = frame(spark, enumerate(x)), frame(spark, [(f"q{k}", w) for k, w in enumerate(y)], "query_id", "string")
    c = lists.centroids(v, 16)
    kept = lists.assign(v, c).cache()
    probes = lists.probes_for(v, kept, c, 10)
    found = lists.recall(lists.knn_approximate(q, kept, c, 10, probes), knn(q, v, 10)).first().recall
    assert 1 < probes < 16 and found >= 0.9


def test_lists_of_nothing(spark):
    none = frame(spark, [(0, None)])
    c = lists.centroids(lists.usable(none), 5)
    assert len(c) == 0 and lists.assign(none, c).count() == 0 and lists.similar_pairs(none, 0.5).count() == 0 and lists.copies(none).count() == 0
    assert lists.knn_approximate(frame(spark, [("q", [1.0])], "query_id", "string"), lists.assign(none, c), c, 5).count() == 0

"""Near-duplicate vectors by cosine: int8 tile products with error bounds, full precision only where the bound leaves doubt.

Unit vectors are written as scale * int8 + rest, with the length of the rest known for each vector. For unit x, y with
approximations x', y' the product errs by |x'||y - y'| + |x - x'||y| at most. The products of int8 components are summed
exactly (in single precision no sum of 1,024 of them leaves its 24 bits; longer vectors are summed in such stretches), and
scales are applied in double precision, so nothing but that bound and double rounding stands between x'y' and xy. A tile is up to `tile` vectors near one of a
few fixed directions; pairs of tiles whose centres and radii rule out the threshold are dropped before anything is shipped.
The first pass ships int8 tiles only: pairs surely above the threshold are counted, pairs surely below dropped, and the
rest named. The second pass ships double-precision tiles for the tile pairs that have such a rest and decides it.

Tiles have equal sizes whatever the data, and tasks return counts and spanning links instead of pairs, so thousands of
copies in one place stay linear in memory. The number of tile pairs grows with the square of the table where vectors are
spread evenly over all directions, for then no exact bound can drop any.

Vectors that are null, empty, zero, or hold null, NaN or infinite components link with nothing; so do vectors of different
lengths. Repeated rows link with each other. An empty table gives no rows. A null vec_id takes part; component_id is the
smallest vec_id that is not null.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import components, local_roots, save, sorted_groups
from tidepool.llm.topk import _rows

DIRECTIONS = 16
TILE = pa.schema([("d", pa.int32()), ("tile", pa.int32()), ("rows", pa.binary()), ("q", pa.binary()), ("se", pa.binary()), ("x", pa.binary()), ("centre", pa.list_(pa.float64())), ("far", pa.float64())])
PAIR = pa.schema([("d", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("links", pa.binary()), ("edges", pa.binary()), ("doubt", pa.binary())])
SLACK = 1e-9  # far above what double rounding adds to products and bounds of up to a million components
STRETCH = 1024  # 1024 * 127 * 127 < 2^24
STRIP, DOUBTS = 512, 1 << 20  # rows multiplied at once; positions in doubt that are given out at once


def quantised(batches):
    """Rows (row, d, cell, q, scale, err, x): int8 components, their scale, the length of what they miss, the unit vector."""
    for b in batches:
        for d in np.unique(b.column(2).to_numpy()):
            at = np.flatnonzero(b.column(2).to_numpy() == d)
            x = np.stack(b.column(1).take(pa.array(at)).to_numpy(zero_copy_only=False)).astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            scale = np.abs(x).max(axis=1) / 127
            q = np.rint(x / scale[:, None]).astype(np.int8)
            err = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
            cell = np.argmax(x @ np.random.default_rng(7).standard_normal((int(d), DIRECTIONS)), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), pa.array(err), pa.array([r.tobytes() for r in x], pa.binary())], names=["row", "d", "cell", "q", "scale", "err", "x"])


def tiled(batches):
    """One row a tile: its rows, int8 side, double side, centre and the largest angle to it."""
    for t, starts in sorted_groups(batches, ["d", "tile"]):
        for s, e in zip(starts, [*starts[1:], t.num_rows]):
            g = t.slice(s, e - s)
            join = lambda c, kind: np.frombuffer(b"".join(g[c].to_pylist()), kind).reshape(e - s, -1)  # noqa: B023, E731
            x = join("x", np.float64)
            centre = x.mean(axis=0)
            centre /= max(np.sqrt((centre**2).sum()), 1e-12)
            far = float(np.arccos(np.clip(x @ centre, -1, 1)).max()) if centre.any() else np.pi
            yield pa.RecordBatch.from_pylist([{"d": g["d"][0].as_py(), "tile": g["tile"][0].as_py(), "rows": g["row"].to_numpy().tobytes(), "q": join("q", np.int8).tobytes(), "se": np.stack([g["scale"].to_numpy(), g["err"].to_numpy()]).tobytes(), "x": x.tobytes(), "centre": centre.tolist(), "far": far}], TILE)


OUT = "d int, a int, b int, links binary, edges binary, doubt binary"


def _out(row: dict, ra, rb, count_a, count_b, edges, doubt) -> pa.RecordBatch:
    """links: (row, count) pairs; edges: (row, row) pairs; doubt: positions i * |b| + j."""
    n = np.concatenate([count_a, count_b])
    links = np.stack([np.concatenate([ra, rb]), n], axis=1)[n > 0]
    return pa.RecordBatch.from_pylist([{k: row[k] for k in ("d", "a", "b")} | {"links": links.astype("<i8").tobytes(), "edges": edges.astype("<i8").tobytes(), "doubt": doubt.astype("<i8").tobytes()}], PAIR)


class _Links:
    """Counts and spanning links of one tile pair, from strips of position pairs."""

    def __init__(self, na: int, nb: int, same: bool):
        self.na, self.shift = na, 0 if same else na
        self.count = np.zeros(na if same else na + nb, np.int64)
        self.i, self.j = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        j = j + self.shift
        self.count += np.bincount(i, minlength=len(self.count)) + np.bincount(j, minlength=len(self.count))
        root = local_roots(len(self.count), np.concatenate([self.i, i]), np.concatenate([self.j, j]))
        self.i = np.flatnonzero(root != np.arange(len(root)))
        self.j = root[self.i]

    def batch(self, row: dict, ra: np.ndarray, rb: np.ndarray, doubt: np.ndarray) -> pa.RecordBatch:
        rows = np.concatenate([ra, rb]) if self.shift else ra
        return _out(row, ra, rb if self.shift else rb[:0], self.count[: self.na], self.count[self.na :], np.stack([rows[self.i], rows[self.j]], axis=1), doubt)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers up to 127, as doubles."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], STRETCH):
        out += a[:, at : at + STRETCH] @ b[:, at : at + STRETCH].T
    return out


def _first(batches, threshold: float):
    for row in _rows(batches):
        d, same = row["d"], row["a"] == row["b"]
        ra, rb = (np.frombuffer(row[f"{k}_rows"], "<i8") for k in "ab")
        qa, qb = (np.frombuffer(row[f"{k}_q"], np.int8).reshape(-1, d).astype(np.float32) for k in "ab")
        (sa, ea), (sb, eb) = (np.frombuffer(row[f"{k}_se"], np.float64).reshape(2, -1) for k in "ab")
        links, doubt, n = _Links(len(ra), len(rb), same), [], 0
        for at in range(0, len(ra), STRIP):
            e = ea[at : at + STRIP]
            p = products(qa[at : at + STRIP], qb)
            p *= sa[at : at + STRIP, None]
            p *= sb[None, :]
            slack = (1 + e.max()) * eb.max() + e.max() + SLACK  # of the strip: cheap, and no smaller than any pair's
            i, j = np.nonzero(p >= threshold - slack)
            if same:
                i, j = i[i + at < j], j[i + at < j]
            bound = (1 + e[i]) * eb[j] + e[i] + SLACK
            v = p[i, j]
            sure, maybe = v - bound >= threshold, (v - bound < threshold) & (v + bound >= threshold)
            links.add(i[sure] + at, j[sure])
            doubt.append((i[maybe] + at) * len(rb) + j[maybe])
            n += len(doubt[-1])
            if n >= DOUBTS:
                yield _out(row, ra[:0], rb[:0], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2)), np.concatenate(doubt))
                doubt, n = [], 0
        yield links.batch(row, ra, rb, np.concatenate([np.zeros(0, np.int64), *doubt]))


def _second(batches, threshold: float):
    for row in _rows(batches):
        ra, rb = (np.frombuffer(row[f"{k}_rows"], "<i8") for k in "ab")
        xa, xb = (np.frombuffer(row[f"{k}_x"], np.float64).reshape(-1, row["d"]) for k in "ab")
        i, j = np.divmod(np.frombuffer(row["doubt"], "<i8"), len(rb))
        links = _Links(len(ra), len(rb), row["a"] == row["b"])
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            near = np.einsum("ij,ij->i", xa[x], xb[y]) >= threshold
            links.add(x[near], y[near])
        yield links.batch(row, ra, rb, np.zeros(0))


def _pairs(batches, column: str, names: list[str]):
    for row in _rows(batches):
        x = np.frombuffer(row[column], "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=names)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs with cosine >= threshold."""
    every = save(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").alias("e")), "vectors")
    usable = every.where("e is not null and size(e) > 0 and forall(e, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(e, c -> c <> 0)")
    q = save(usable.select("row", F.col("e").cast("array<double>").alias("e"), F.size("e").alias("d")).mapInArrow(quantised, "row long, d int, cell int, q binary, scale double, err double, x binary"), "quantised")
    cells = q.groupBy("d", "cell").agg(F.ceil(F.count("*") / tile).cast("long").alias("parts"))  # at most 16 rows for each length
    first = cells.alias("c").join(cells.alias("o"), (F.col("c.d") == F.col("o.d")) & (F.col("o.cell") < F.col("c.cell")), "left").groupBy("c.d", "c.cell", "c.parts").agg(F.coalesce(F.sum("o.parts"), F.lit(0)).alias("first"))
    dealt = q.join(F.broadcast(first), ["d", "cell"]).withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("row"), "parts")).cast("int"))
    tiles = save(dealt.select("d", "tile", "row", "q", "scale", "err", "x").repartition("d", "tile").sortWithinPartitions("d", "tile", "row").mapInArrow(tiled, "d int, tile int, rows binary, q binary, se binary, x binary, centre array<double>, far double"), "tiles")
    last = tiles.groupBy("d").agg(F.max("tile").alias("last"))  # a row for each length
    side = lambda k, *cols: tiles.select("d", F.col("tile").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in cols])
    dot = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("a_far") - F.col("b_far") <= float(np.arccos(threshold)) + 1e-6
    pairs = side("a", "centre", "far").join(last, "d").withColumn("b", F.explode(F.sequence("a", "last"))).join(side("b", "centre", "far"), ["d", "b"]).where(near).select("d", "a", "b")
    one = save(pairs.join(side("a", "rows", "q", "se"), ["d", "a"]).join(side("b", "rows", "q", "se"), ["d", "b"]).repartition("d", "a", "b").mapInArrow(lambda it: _first(it, threshold), OUT), "first-pass")
    rest = one.where("length(doubt) > 0").select("d", "a", "b", "doubt")
    two = save(rest.join(side("a", "rows", "x"), ["d", "a"]).join(side("b", "rows", "x"), ["d", "b"]).mapInArrow(lambda it: _second(it, threshold), OUT), "second-pass")
    both = one.select("links", "edges").unionByName(two.select("links", "edges"))
    counts = both.select("links").mapInArrow(lambda it: _pairs(it, "links", ["row", "n"]), "row long, n long").groupBy("row").agg(F.sum("n").alias("n_links"))
    roots = components(both.select("edges").mapInArrow(lambda it: _pairs(it, "edges", ["a", "b"]), "a long, b long"))
    named = save(every.select("row", "vec_id").join(roots, F.col("row") == F.col("node"), "left").join(counts, "row", "left").select("vec_id", "n_links", F.coalesce("root", "row").alias("root")), "named")
    smallest = save(named.groupBy("root").agg(F.min("vec_id").alias("component_id")), "smallest")
    return named.join(smallest, "root").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))

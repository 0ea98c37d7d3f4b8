"""What the operators of this subpackage share: tables, stored intermediate results, components."""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.sources.stored import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


class Memo(dict):
    """make(key), remembered for the last `most` to 2 * `most` keys that were asked for."""

    def __init__(self, make, most: int = 1 << 19):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions by the links (i[x], j[x])."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, root), root the smallest node of the component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014); every step is an aggregation and a join
    against a stored table, so a node with very many edges is split by the skew join.
    """
    links = save(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    mark = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
    before = mark(links)
    while before[0]:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = save(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        lower = save(large.groupBy("hi").agg(F.min("lo").alias("m")), "lower")
        rest = large.join(lower, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = save(rest.unionByName(lower.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        after = mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def sorted_groups(batches, keys: list[str]):
    """From record batches sorted by keys: tables of whole groups, each with the groups' start positions.

    Holds one batch and one unfinished group at a time.
    """
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        starts = _starts(now, keys)
        if len(starts) == 1:
            rest = now
            continue
        yield now.slice(0, starts[-1]), starts[:-1]
        rest = now.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest, _starts(rest, keys)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = rows[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)

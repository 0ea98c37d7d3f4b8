"""Exact duplicates by a persistent index of digests, bucketed and sorted by digest. DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z; of equal texts the row with the largest doc_id stays. A
text's digest is the SHA-256 of its lower-cased UTF-8.

`DigestIndex` is a folder of Parquet files, registered as an external table clustered by digest into a fixed number of
buckets, each file sorted by digest. `add` takes new digests in: they are reduced to one row for each digest in every task,
joined against the index by a sort-merge anti-join that shuffles the new rows only, and what the index lacks is appended, a
file for each bucket. A row that overtakes an indexed one (same digest, larger doc_id) is appended too; readers take the
largest doc_id of a digest, which needs no shuffle. Adding rows again changes nothing, so a load that died halfway is added
once more. One writer at a time. `compact` writes the next generation, one file a bucket, and publishes it by a rename.

Memory is bounded by Spark's sorts, which spill. A digest that many rows share is summed before it moves, and where rows
learn what stays for their digest, both sides of the join are shuffled from stored tables, so AQE splits a hot digest.

Null text counts as empty and equals it. A null doc_id is smaller than any other: it stays only where all ids of its text
are null. Rows that repeat a doc_id with an equal text carry the same answer; `deduplicate` returns one of them. An empty
table gives no rows. Texts of any length are digested whole. Further columns are ignored, whatever their names.
"""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import fresh, save

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """text with A-Z in lower case, other letters as they are; null is empty."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.length(t)  # there lower() does the same, faster
    return F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select("doc_id", digest(F.col("text")).alias("digest"))


class DigestIndex:
    """(digest, doc_id) of every text seen, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """Opens the index at path; buckets counts for a new one, an existing one keeps its own."""
        self.spark, self.path = spark, path
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets, self.generation = max(self._generations(), key=lambda x: x[1], default=(buckets, 0))
        self._register()

    def _generations(self) -> list[tuple[int, int]]:
        """(buckets, generation) of each published one: folders named g-<generation>-<buckets>."""
        top = self._path(self.path)
        names = [x.getPath().getName().split("-") for x in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return [(int(n[2]), int(n[1])) for n in names if len(n) == 3 and n[0] == "g"]

    def _folder(self, generation: int) -> str:
        return f"{self.path}/g-{generation}-{self.buckets}"

    def _create(self, name: str, folder: str) -> None:
        self._fs.mkdirs(self._path(folder))
        where = folder.replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, doc_id BIGINT) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{where}'")

    def _register(self) -> None:
        folder = self._folder(self.generation)
        self.name = f"digest_index_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"
        self._create(self.name, folder)

    def _append(self, rows: DataFrame, name: str) -> None:
        rows.select("digest", "doc_id").repartition(self.buckets, "digest").write.insertInto(name)  # dealt as the buckets are: a task writes one file

    def read(self) -> DataFrame:
        """(digest, doc_id) of every text, doc_id that of the row that stays."""
        return self.spark.table(self.name).groupBy("digest").agg(F.max("doc_id").alias("doc_id"))

    def add(self, rows: DataFrame) -> None:
        """Takes rows (doc_id, digest) in: appends what the index lacks."""
        new = rows.groupBy("digest").agg(F.max("doc_id").alias("doc_id"))
        known = self.spark.table(self.name).select(F.col("digest").alias("known"), F.col("doc_id").alias("known_id"))
        same = (F.col("digest") == F.col("known")) & (F.col("doc_id").isNull() | (F.col("known_id") >= F.col("doc_id")))
        self._append(save(new.join(known.hint("merge"), same, "left_anti"), "new-digests"), self.name)  # stored first: a table cannot be read and appended to at once
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> None:
        """Writes one sorted file for each bucket, without overtaken rows, as the next generation; the old folder stays for
        readers that began before."""
        folder = self._folder(self.generation + 1)
        draft = f"{self.path}/draft"
        self._fs.delete(self._path(draft), True)
        name = f"{self.name}_draft"
        self._create(name, draft)
        try:
            self._append(self.read(), name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")
        if self._fs.exists(self._path(folder)) or not self._fs.rename(self._path(draft), self._path(folder)):
            raise ValueError(f"another writer published {folder}")
        self.close()
        self.generation += 1
        self._register()

    def close(self) -> None:
        """Takes the table's name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def decisions(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of stored rows (doc_id, digest) that were added to the index; group_size
    counts those of rows."""
    own = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("largest"))
    both = own.join(index.read().withColumnRenamed("doc_id", "stays"), "digest")
    told = save(both.where((F.col("n") > 1) | ~F.col("stays").eqNullSafe(F.col("largest"))).select("digest", "n", "stays", F.lit(True).alias("told")), "groups")
    out = rows.join(told, "digest", "left")
    keep = F.when(F.col("told"), F.col("stays")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "digest", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"))


def exact_duplicates(docs: DataFrame, index: DigestIndex, loads: int = 2) -> DataFrame:
    """decisions on every row of docs, taken into the index in `loads` parts by a hash of doc_id; the result is the same for
    any number. A text is digested once; what is parted is the stored digests."""
    rows = save(digests(docs), "digests")
    for k in range(loads):
        index.add(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(loads)) == k))
    return decisions(rows, index)


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs that stay, all columns; docs are taken into the index first, so a text that it holds by a larger
    doc_id from an earlier table goes."""
    key, kept_key, kept_id = (fresh(docs, n) for n in ("text_digest", "kept_digest", "kept_id"))
    kept = exact_duplicates(docs, index, 1).where("kept").select(F.col("digest").alias(kept_key), F.col("doc_id").alias(kept_id)).distinct()
    rows = docs.withColumn(key, digest(F.col("text")))
    return rows.join(kept, (F.col(key) == F.col(kept_key)) & F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi").dropDuplicates(["doc_id", key]).select(*docs.columns)

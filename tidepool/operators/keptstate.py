"""The store's memories as a kept table: every mutation rewrites the buckets it touches, and tells what it changed.

A state is a folder. Rows lie in buckets by a hash of (scope, content_hash), so the live row that holds a text, if any, is in
one known bucket, and a hot scope is spread over all. A mutation reads the buckets that its changes touch, runs the operator
of `mutations` on those rows, writes the new buckets into a folder of the next version, compares the rows before and after by
id, writes the difference as change rows, and publishes the version last: a small manifest that names each bucket's folder,
created by a rename that one writer wins. Files of untouched buckets are neither read (but for the columns that find ids) nor
written. Readers keep the version that they began with; `vacuum` deletes folders that only older versions name.

A mutation may carry a source and a batch number, as a stream's batches do. The manifest keeps the last one of each source,
so a batch that is run again after a failure is taken in once. What a mutation logs is written into a folder named after its
version, so a repeated attempt overwrites it.
"""

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import text
from tidepool.operators import mutations, privacy
from tidepool.operators.filters import is_live
from tidepool.sources.stored import few, stored
from tidepool.sources.tables import SCHEMAS

CHANGES = f"version BIGINT, kind STRING, action STRING, memory_id STRING, scope STRING, before STRUCT<{SCHEMAS['memories'].replace(' ', ': ').replace(',: ', ', ')}>, after STRUCT<{SCHEMAS['memories'].replace(' ', ': ').replace(',: ', ', ')}>"


#: Fixed value: with more files than this for each bucket touched, a mutation deals its rows anew.
FILES = 64


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, memory_id, scope, before, after) of every id whose row is not the same: insert, update or delete. Ids with
    digests tell which rows may differ; those alone are moved and compared in full."""
    digest = lambda df, name: df.select(F.col("id").alias("memory_id"), F.sha2(F.to_json(F.struct(*before.columns)), 256).alias(name))
    odd = digest(before, "_was").join(digest(after, "_is"), "memory_id", "full_outer").where(~F.col("_was").eqNullSafe(F.col("_is")))
    odd = few(stored(odd.select("memory_id").distinct(), "odd"))
    whole = lambda df, name: df.select(F.col("id").alias("memory_id"), F.struct(*before.columns).alias(name)).join(odd, "memory_id", "left_semi")
    both = whole(before, "before").join(whole(after, "after"), "memory_id", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.select(kind.alias("kind"), "memory_id", F.coalesce("after.scope", "before.scope").alias("scope"), "before", "after")


def inserts(after: DataFrame) -> DataFrame:
    """differences(no rows, after)."""
    row = F.struct(*after.columns)
    return after.select(F.lit("insert").alias("kind"), F.col("id").alias("memory_id"), "scope", F.lit(None).cast(after.select(row.alias("r")).schema["r"].dataType).alias("before"), row.alias("after"))


class KeptState:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """Opens the state at path, or begins an empty one; buckets holds for a new one, an existing one keeps its own."""
        self.spark, self.path = spark, path
        self.schema = spark.createDataFrame([], SCHEMAS["memories"]).schema
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{path}/manifest"))
        self._fs.mkdirs(self._path(f"{path}/changes"))
        if not self.versions():
            self._publish(0, {"buckets": buckets, "folders": {}, "applied": {}})
        self.buckets = self.manifest()["buckets"]

    # -- versions

    def versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/manifest/v{self.versions()[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        draft, final = (self._path(f"{self.path}/manifest/{n}") for n in (f".draft-{uuid.uuid4().hex}", f"v{version:012d}.json"))
        out = self._fs.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ValueError(f"another writer published version {version}")

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the versions but the newest `keep`, and the data folders that none of those names; how many folders."""
        known = self.versions()
        named = {f for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = {f for v in known[:-keep] for f in self.manifest(v)["folders"].values()} - named
        for f in gone:
            self._fs.delete(self._path(f"{self.path}/data/{f}"), True)
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifest/v{v:012d}.json"), False)
        return len(gone)

    # -- reading

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The memories, or those of some buckets."""
        folders = self.manifest(version)["folders"]
        paths = [f"{self.path}/data/{f}" for b, f in folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def changes(self, stream: bool = False) -> DataFrame:
        """The change rows of all versions, as a table or as a stream that goes on with later versions."""
        reader = self.spark.readStream if stream else self.spark.read
        if not stream and not self._fs.listStatus(self._path(f"{self.path}/changes")):
            return self.spark.createDataFrame([], CHANGES)
        return reader.schema(CHANGES).parquet(f"{self.path}/changes/*")

    def bucket(self, scope: Column | str = "scope", content_hash: Column | str = "content_hash") -> Column:
        return F.pmod(F.xxhash64(scope, content_hash), F.lit(self.buckets)).cast("int")

    def _numbers(self, *rows: DataFrame) -> list[int]:
        """The distinct values of column b of the frames: at most as many as there are buckets."""
        every = rows[0]
        for r in rows[1:]:
            every = every.unionByName(r)
        return sorted(r.b for r in every.where("b is not null").distinct().collect())

    def _of_ids(self, ids: DataFrame, column: str = "id") -> DataFrame:
        """(b): the buckets of rows whose column is among ids (id); reads the columns that tell."""
        own = self.read().select(F.col(column).alias("id"), self.bucket().alias("b"))
        return own.join(ids.select("id").distinct(), "id", "left_semi").select("b").distinct()

    # -- writing

    def apply(self, action: str, touched: list[int], change: Callable[[DataFrame], DataFrame], source: str | None = None, batch: int = 0, logs: dict[str, DataFrame] | None = None, deal: bool = True) -> int | None:
        """Publishes the version in which the touched buckets' rows are change(rows); its number, or None if that batch of the
        source was taken in before. Without deal, rows are written by the tasks that read them, so none moves, until the
        buckets' files are many."""
        now = self.manifest()
        if source is not None and now["applied"].get(source, -1) >= batch:
            return None
        version = self.versions()[-1] + 1
        name = f"{version:012d}-{uuid.uuid4().hex[:12]}"
        before = self.read(touched)
        rows, at = change(before).withColumn("bucket", self.bucket()), f"{self.path}/data/{name}"
        held = [f"{self.path}/data/{f}" for b, f in now["folders"].items() if int(b) in touched]
        if deal or sum(len(self._fs.listStatus(self._path(f))) for f in held) > FILES * len(touched):
            rows = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
        rows.write.partitionBy("bucket").option("compression", "zstd").parquet(at)
        made = {n.split("=")[1]: f"{name}/{n}" for x in self._fs.listStatus(self._path(at)) if "=" in (n := x.getPath().getName())}
        strangers = sorted(made.keys() - {str(b) for b in touched})
        if strangers:
            self._fs.delete(self._path(at), True)
            raise ValueError(f"rows left the buckets touched: {strangers[:3]}")
        after = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in made.values()]) if made else self.spark.createDataFrame([], self.schema)
        told = (differences(before, after) if held else inserts(after)).select(F.lit(version).cast("long").alias("version"), "kind", F.lit(action).alias("action"), "memory_id", "scope", "before", "after")
        told.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/changes/.version-{version:012d}")
        for table, rows in (logs or {}).items():
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/log/{table}/version={version:012d}")
        folders = {b: f for b, f in now["folders"].items() if int(b) not in touched} | made
        self._publish(version, {"buckets": self.buckets, "folders": folders, "applied": now["applied"] | ({} if source is None else {source: batch})})
        self._reveal()
        return version

    def _reveal(self) -> None:
        """Lets the feed see the changes of published versions; a job that died in between is made up for by the next."""
        last = self.versions()[-1]
        for x in self._fs.listStatus(self._path(f"{self.path}/changes")):
            name = x.getPath().getName()
            if name.startswith(".version-") and int(name[9:]) <= last:
                self._fs.rename(x.getPath(), self._path(f"{self.path}/changes/{name[1:]}"))

    def ingest(self, clients: DataFrame, incoming: DataFrame, now: int, mode: str = "on", origin: str = "user", source: str | None = None, batch: int = 0) -> int | None:
        """bulk_ingest into the state; episodes, findings, audit and rejects are logged under log/."""
        if source is not None and self.manifest()["applied"].get(source, -1) >= batch:
            return None
        p = mutations.prepare_ingest(clients, incoming, now, mode, origin)
        touched = self._numbers(p.rows.select(self.bucket().alias("b")))
        return self.apply("remember", touched, lambda m: mutations.dedupe_merge(m, p.rows, now), source, batch, {"episodes": p.episodes, "findings": p.findings, "audit": p.audit, "rejects": p.rejects})

    def merge(self, rows: DataFrame, now: int, source: str | None = None, batch: int = 0) -> int | None:
        """mutations.dedupe_merge of rows that are redacted and hashed already; None if there are none."""
        if source is not None and self.manifest()["applied"].get(source, -1) >= batch:
            return None
        rows = stored(rows, "merge")  # a stream's batch is computed once
        touched = self._numbers(rows.select(self.bucket().alias("b")))
        return self.apply("remember", touched, lambda m: mutations.dedupe_merge(m, rows, now), source, batch) if touched else None

    def load(self, memories: DataFrame) -> int | None:
        """Takes rows as they are, for a first filling; their ids are new, their content_hash is set."""
        rows = memories.select(*self.schema.names)
        return self.apply("load", self._numbers(rows.select(self.bucket().alias("b"))), lambda m: m.unionByName(rows))

    def _mutate(self, action: str, touched: list[int], run: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
        """Applies run, which gives a state and outcomes; the outcomes, stored."""
        kept: list[DataFrame] = []

        def change(m: DataFrame) -> DataFrame:
            state, out = run(m)
            kept.append(stored(out, "outcomes"))
            return state

        self.apply(action, touched, change, deal=False)
        return kept[0]

    def update(self, patches: DataFrame, now: int, mode: str = "on") -> DataFrame:
        """mutations.update; outcomes (id, outcome)."""
        p = stored(privacy.redact(patches, mode), "patches")
        scopes = self.read().select("id", "scope").join(p.select("id", "text").where("text is not null"), "id")
        to = scopes.select(self.bucket("scope", text.content_hash(F.col("text"))).alias("b"))
        return self._mutate("update", self._numbers(self._of_ids(p), to), lambda m: mutations.update(m, p, now))

    def forget(self, ids: DataFrame, now: int) -> DataFrame:
        return self._mutate("forget", self._numbers(self._of_ids(ids)), lambda m: mutations.forget(m, ids, now))

    def restore(self, ids: DataFrame) -> DataFrame:
        return self._mutate("restore", self._numbers(self._of_ids(ids)), lambda m: mutations.restore(m, ids))

    def approve(self, ids: DataFrame, value: bool = True) -> DataFrame:
        return self._mutate("approve", self._numbers(self._of_ids(ids)), lambda m: mutations.approve(m, ids, value))

    def supersede(self, steps: DataFrame) -> DataFrame:
        """mutations.supersede; outcomes (id, new_id, outcome)."""
        scopes = self.read().where(is_live()).select("id", "scope").join(steps.select("id", "text"), "id")
        to = scopes.select(self.bucket("scope", text.content_hash(F.col("text"))).alias("b"))
        return self._mutate("supersede", self._numbers(self._of_ids(steps), to), lambda m: mutations.supersede(m, steps))

    def purge(self, ids: DataFrame) -> int | None:
        """mutations.purge: the rows go, and what they had superseded is current again."""
        touched = self._numbers(self._of_ids(ids), self._of_ids(ids, "superseded_by"))
        return self.apply("purge", touched, lambda m: mutations.purge(m, ids))

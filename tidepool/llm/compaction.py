"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder with `data/` (Parquet shards, never changed once written) and `manifest/` (one small JSON file for each
version, naming the live shards with their bytes). `append` writes arrivals as small shards and commits the next
version. `compact` groups live shards into tiers of similar size (each tier `ratio` times as large as the one below); a tier
with at least `run` shards is merged into files of about `target` bytes. Spark's own file packing does the merging: one read
task takes shards up to the target and writes one file, so nothing is shuffled. Shards of target size are left alone.

The manifest also holds the store's schema, the union of the schemas of all arrivals: shards are read with it, so a column
that a shard lacks is null there, and compaction keeps the columns of every arrival. Columns are told apart as Spark does
(by `spark.sql.caseSensitive`). An arrival that gives a known column another type is refused before anything is written.

A version is committed by giving a finished file its name, which fails if the name exists: by a hard link in local folders,
elsewhere by a rename, which HDFS refuses if the name exists; on file systems where a rename replaces, one writer at a time
is required. A writer that lost the race reads the newer version and tries again. Shards that no version names are
invisible, so a job that dies or repeats tasks leaves the store as it was. `vacuum` deletes shards that only old versions name,
`sweep` those that no version names and that are too old for a running job to commit them yet.

Rows are kept as they are: nulls, repeats, and any columns. An append of no rows commits a version without new shards, but
with its columns. A store without shards is read as no rows, of the columns that appends have brought.
"""

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from tidepool.llm.common import fresh


def union(a: DataType, b: DataType, exact: bool, name: str = "") -> DataType:
    """The type that holds both: structs field by field, first those of a. ValueError where other types differ."""
    if isinstance(a, StructType) and isinstance(b, StructType):
        key = lambda f: f.name if exact else f.name.lower()
        more, known = {key(f): f for f in b}, {key(f) for f in a}
        same = [StructField(f.name, union(f.dataType, more[key(f)].dataType, exact, f"{name}.{f.name}") if key(f) in more else f.dataType, True, f.metadata) for f in a]
        return StructType(same + [StructField(f.name, f.dataType, True, f.metadata) for f in b if key(f) not in known])
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(union(a.elementType, b.elementType, exact, name))
    if isinstance(a, MapType) and isinstance(b, MapType):
        return MapType(union(a.keyType, b.keyType, exact, name), union(a.valueType, b.valueType, exact, name))
    if a.simpleString() != b.simpleString():
        raise ValueError(f"column {name[1:]} is {a.simpleString()} in the store and {b.simpleString()} in the arrival")
    return a


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in ("data", "manifest"):
            self._fs.mkdirs(self._path(f"{path}/{name}"))

    def versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> dict:
        """What a version (the newest if None) holds."""
        known = self.versions()
        if not known:
            return {"shards": []}
        stream = self._fs.open(self._path(f"{self.path}/manifest/v{known[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[dict]:
        """The live shards of a version (the newest if None): path inside the store, bytes."""
        return self._manifest(version)["shards"]

    def _schema(self, manifest: dict) -> StructType:
        """That of the manifest; of one written before schemas were recorded, the union over its shards."""
        if "schema" in manifest:
            return StructType.fromJson(manifest["schema"])
        if not manifest["shards"]:
            return StructType()
        return self.spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{s['path']}" for s in manifest["shards"]]).schema

    def _with(self, manifest: dict, schema: StructType) -> StructType:
        return union(self._schema(manifest), schema, self.spark.conf.get("spark.sql.caseSensitive") == "true")

    def commit(self, added: list[dict], removed: set[str], schema: StructType | None = None) -> int:
        """The next version: the newest one with shards added (of that schema) and removed. Fails if another writer removed one of them."""
        while True:
            known = self.versions()
            version = known[-1] + 1 if known else 1
            newest = self._manifest(known[-1]) if known else {"shards": []}
            live = newest["shards"]
            if missing := removed - {s["path"] for s in live}:
                raise ValueError(f"merged away meanwhile: {sorted(missing)[:3]}")
            columns = self._with(newest, schema or StructType())
            body = json.dumps({"version": version, "schema": columns.jsonValue(), "shards": [s for s in live if s["path"] not in removed] + added})
            draft, final = (self._path(f"{self.path}/manifest/{n}") for n in (f".draft-{uuid.uuid4().hex}", f"v{version:012d}.json"))
            out = self._fs.create(draft, False)
            out.write(body.encode())
            out.close()
            won = self._claim(draft, final)
            self._fs.delete(draft, False)
            if won:
                return version

    def _claim(self, draft, final) -> bool:
        """Gives the draft its final name; whether no other writer had it first."""
        if self._fs.getUri().getScheme() != "file":
            return not self._fs.exists(final) and self._fs.rename(draft, final)
        try:
            os.link(draft.toUri().getPath(), final.toUri().getPath())
        except FileExistsError:
            return False
        return True

    def _written(self, run: str) -> list[dict]:
        """The files with rows that a finished write left under data/run."""
        root = f"/data/{run}/"
        out, files = [], self._fs.listFiles(self._path(self.path + root), True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString()
            if name.endswith(".parquet"):
                out.append({"path": root[1:] + name.split(root, 1)[1], "bytes": f.getLen()})
        return sorted(out, key=lambda s: s["path"])

    def append(self, rows: DataFrame, arrival: str | None = None) -> int:
        """Writes rows as new shards, each task's its own; `arrival`, a column's name, also parts them by its values."""
        self._with(self._manifest(), rows.schema)
        run = f"a-{uuid.uuid4().hex}"
        part = fresh(rows, "_arrival")
        out = rows if arrival is None else rows.withColumn(part, F.col(arrival))
        writer = out.write.option("compression", "zstd")
        (writer if arrival is None else writer.partitionBy(part)).parquet(f"{self.path}/data/{run}")
        return self.commit(self._written(run), set(), rows.schema)

    def _read(self, shards: list[dict], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{s['path']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self._manifest(version)
        if not manifest["shards"]:
            return self.spark.createDataFrame([], self._schema(manifest))
        return self._read(manifest["shards"], self._schema(manifest))

    def compact(self, target: int = 128 << 20, run: int = 4, ratio: int = 4) -> list[int]:
        """Merges every tier that is due, smallest first, and those that its results fill; the versions committed."""
        done, merged = [], set()
        while True:
            tiers: dict[int, list[dict]] = {}
            manifest = self._manifest()
            for s in manifest["shards"]:
                if s["bytes"] < target * 3 // 4 and s["path"] not in merged:
                    tier, top = 0, target
                    while top // ratio >= s["bytes"] and tier < 30:
                        tier, top = tier + 1, top // ratio
                    tiers.setdefault(tier, []).append(s)
            due = [shards for _, shards in sorted(tiers.items(), reverse=True) if len(shards) >= run]
            if not due:
                return done
            name = f"m-{uuid.uuid4().hex}"
            packing = {"spark.sql.files.maxPartitionBytes": str(target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
            before = {k: self.spark.conf.get(k, None) for k in packing}
            try:
                for k, v in packing.items():
                    self.spark.conf.set(k, v)
                self._read(due[0], self._schema(manifest)).write.option("compression", "zstd").parquet(f"{self.path}/data/{name}")
            finally:
                for k, v in before.items():
                    self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
            added = self._written(name)
            if len(added) >= len(due[0]):  # packing gains nothing here
                merged |= {s["path"] for s in [*due[0], *added]}
                self._fs.delete(self._path(f"{self.path}/data/{name}"), True)
                continue
            done.append(self.commit(added, {s["path"] for s in due[0]}))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the shards that none of the newest `keep` versions name, and the older versions; how many shards."""
        known = self.versions()
        live = {s["path"] for v in known[-keep:] for s in self.shards(v)}
        gone = {s["path"] for v in known[:-keep] for s in self.shards(v)} - live
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifest/v{v:012d}.json"), False)
        for p in gone:
            self._fs.delete(self._path(f"{self.path}/{p}"), False)
        return len(gone)

    def sweep(self, older_than_s: float = 7 * 24 * 3600.0) -> int:
        """Deletes what jobs that died left under data/: files of that age that no version names; how many."""
        live = {s["path"] for v in self.versions() for s in self.shards(v)}
        gone, files = 0, self._fs.listFiles(self._path(f"{self.path}/data"), True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString()
            if "data/" + name.split(f"{self._path(self.path).toUri().getPath()}/data/", 1)[1] not in live and f.getModificationTime() <= (time.time() - older_than_s) * 1000:
                gone += bool(self._fs.delete(f.getPath(), False))
        return gone

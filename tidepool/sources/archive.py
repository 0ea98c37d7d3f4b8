"""Archives: JSON lines of memories and episodes with a manifest of checksums."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.filters import list_memories

VERSION = 1
#: The fields of a record and the columns they come from; caps on one file.
MEMORY_FIELDS = {"id": "id", "text": "text", "scope": "scope", "tags": "tags", "sourceClient": "source_client", "importance": "importance", "createdAt": "created_at", "updatedAt": "updated_at", "lastAccessed": "last_accessed", "accessCount": "access_count", "validFrom": "valid_from", "validUntil": "valid_until", "supersededBy": "superseded_by", "deletedAt": "deleted_at"}
EPISODE_FIELDS = {"id": "id", "content": "content", "scope": "scope", "sourceClient": "source_client", "metadata": "metadata", "createdAt": "created_at"}
FILE_BYTES, FILE_LINES = 64 << 20, 100_000
#: Fixed value: a file of less than this part of the cap on bytes is small.
SMALL = 64


def records(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(f) for f, c in fields.items()])


def _written(rows: DataFrame, path: str, most_bytes: int, most_lines: int) -> None:
    """rows as JSON lines in files under both caps. A task writes the rows that it reads and begins a new file after as many
    lines as the longest record allows. Where a few long records would make such files SMALL, rows are dealt by a hash of their
    id instead, into so many parts that a part is expected to fill a quarter of the bytes."""
    sized = rows.withColumn("_size", F.octet_length(F.to_json(F.struct(*rows.columns))) + 1)
    n, total, longest = sized.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    if longest > most_bytes:
        raise ValueError(f"a record of {longest} bytes is above the cap on a file")
    lines = min(most_lines, most_bytes // longest) if n else most_lines
    if not n or lines < most_lines and lines * total * SMALL < n * most_bytes:
        rows, lines = rows.repartition(int(-(-4 * total // most_bytes)) or 1, F.xxhash64("id")), most_lines
    rows.write.option("maxRecordsPerFile", lines).json(path)


def export(memories: DataFrame, episodes: DataFrame, path: str, scope: str | None = None, include_deleted: bool = False, include_superseded: bool = True, most_bytes: int = FILE_BYTES, most_lines: int = FILE_LINES) -> None:
    """Writes both tables as JSON lines under path; episodes of forgotten memories stay out unless deleted
    rows go in. Files stay under the caps that an import puts on them."""
    rows = list_memories(memories, scope=scope, include_deleted=include_deleted, include_superseded=include_superseded)
    seen = episodes if include_deleted else episodes.where(~F.coalesce("forgotten", F.lit(False)))
    seen = seen if scope is None else seen.where(F.col("scope") == scope)
    _written(records(rows, MEMORY_FIELDS), f"{path}/memories", most_bytes, most_lines)
    _written(records(seen, EPISODE_FIELDS), f"{path}/episodes", most_bytes, most_lines)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of an archive's JSON files; a task reads one file at a time, which FILE_BYTES keeps small."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load([f"{path}/memories", f"{path}/episodes"])
    return raw.select(F.regexp_extract("path", "((?:memories|episodes)/[^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, line) of one of an archive's tables."""
    return spark.read.text(f"{path}/{name}").select(F.regexp_extract("_metadata.file_path", "((?:memories|episodes)/[^/]+)$", 1).alias("file"), F.col("value").alias("line"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes, rows, version) of what was written."""
    counts = lines(spark, path, "memories").unionByName(lines(spark, path, "episodes")).groupBy("file").agg(F.count("*").alias("rows"))
    return files(spark, path).join(counts, "file", "left").select("file", "sha256", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(VERSION).alias("version"))


def verify(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(file, status): ok, missing, unlisted, mismatch, or version. Anything but ok must stop an import."""
    r, f = recorded.select("file", F.col("sha256").alias("_want"), F.col("version").alias("_v")), found.select("file", F.col("sha256").alias("_got"))
    status = F.when(F.col("_got").isNull(), "missing").when(F.col("_want").isNull(), "unlisted").when(F.col("_v") != VERSION, "version").when(F.col("_want") != F.col("_got"), "mismatch").otherwise("ok")
    return r.join(f, "file", "full_outer").select("file", status.alias("status"))


def over_caps(found: DataFrame, text: DataFrame, most_bytes: int = FILE_BYTES, most_lines: int = FILE_LINES) -> DataFrame:
    """(file, reason) of files above a cap."""
    n = text.groupBy("file").agg(F.count("*").alias("n"))
    judged = found.join(n, "file", "left").select("file", F.when(F.col("bytes") > most_bytes, "too large").when(F.col("n") > most_lines, "too many lines").alias("reason"))
    return judged.where("reason is not null")


def _typed(v: Column, path: str, kinds: str, as_type: str) -> Column:
    """A field of a variant if its JSON type is right, else null: casts alone would take "7" for 7."""
    field = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(field).rlike(f"^(?:{kinds})"), F.try_variant_get(v, path, as_type))


NUMBER, TEXT = "BIGINT|DOUBLE|DECIMAL", "STRING"


def read_memories(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) from lines (file, line): id and text must be strings; other fields of a wrong type take their defaults."""
    v = text.withColumn("v", F.try_parse_json("line")).withColumns({"id": _typed(F.col("v"), "$.id", TEXT, "string"), "text": _typed(F.col("v"), "$.text", TEXT, "string")})
    good, bad = _split(v, "text")
    number = lambda f: _typed(F.col("v"), f"$.{f}", NUMBER, "double").cast("long")
    strings = F.transform(F.filter(F.try_variant_get("v", "$.tags", "array<variant>"), lambda t: F.schema_of_variant(t) == "STRING"), lambda t: F.try_variant_get(t, "$", "string"))
    cols = {
        "scope": F.coalesce(_typed(F.col("v"), "$.scope", TEXT, "string"), F.lit("default")), "source_client": _typed(F.col("v"), "$.sourceClient", TEXT, "string"),
        "tags": F.coalesce(F.array_sort(F.array_distinct(strings)), F.array().cast("array<string>")), "importance": F.coalesce(_typed(F.col("v"), "$.importance", NUMBER, "double"), F.lit(0.5)),
        "created_at": number("createdAt"), "updated_at": number("updatedAt"), "last_accessed": number("lastAccessed"), "access_count": F.coalesce(number("accessCount"), F.lit(0)),
        "valid_from": number("validFrom"), "valid_until": number("validUntil"), "superseded_by": _typed(F.col("v"), "$.supersededBy", TEXT, "string"), "deleted_at": number("deletedAt"),
    }
    return good.select("file", "id", "text", *[c.alias(k) for k, c in cols.items()]), bad


def read_episodes(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) from lines (file, line), as read_memories."""
    v = text.withColumn("v", F.try_parse_json("line")).withColumns({"id": _typed(F.col("v"), "$.id", TEXT, "string"), "content": _typed(F.col("v"), "$.content", TEXT, "string")})
    good, bad = _split(v, "content")
    created = _typed(F.col("v"), "$.createdAt", NUMBER, "double").cast("long")
    return good.select("file", "id", "content", F.coalesce(_typed(F.col("v"), "$.scope", TEXT, "string"), F.lit("default")).alias("scope"), _typed(F.col("v"), "$.sourceClient", TEXT, "string").alias("source_client"), _typed(F.col("v"), "$.metadata", "OBJECT|STRING", "string").alias("metadata"), created.alias("created_at")), bad


def _split(v: DataFrame, body: str) -> tuple[DataFrame, DataFrame]:
    why = F.when(F.col("v").isNull(), "not JSON").when(~F.schema_of_variant("v").startswith("OBJECT"), "not an object").when(F.col("id").isNull(), "id missing").when(F.col(body).isNull(), f"{body} missing")
    judged = v.withColumn("flaw", why)
    return judged.where("flaw is null"), judged.where("flaw is not null").select("file", "flaw")

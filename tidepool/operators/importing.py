"""Import of an archive as one operation: it is checked whole before any of it is taken in."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import mutations, privacy, stats
from tidepool.sources import archive
from tidepool.sources.stored import few, stored


class ArchiveRefused(ValueError):
    """The archive is not taken in; nothing has changed."""


class Imported(NamedTuple):
    memories: DataFrame
    episodes: DataFrame
    outcomes: DataFrame  # (table, id, outcome)
    counts: DataFrame  # (table, outcome, n)


def _stop(flaws: DataFrame, what: str) -> None:
    if found := flaws.limit(3).collect():
        raise ArchiveRefused(f"{what}: " + "; ".join(", ".join(map(str, r)) for r in found))


def import_archive(spark: SparkSession, path: str, recorded: DataFrame, memories: DataFrame, episodes: DataFrame, now: int, mode: str = "on", order: Column | None = None, most_bytes: int = archive.FILE_BYTES, most_lines: int = archive.FILE_LINES) -> Imported:
    """The store after the archive at path, whose manifest is recorded.

    ArchiveRefused is raised, and the store stays as it was, if a file is missing, unlisted, changed, of another version or
    above a cap, or if any line is no proper record. Then episodes whose id is new and memories (as import_memories has it)
    come in. `order`, of a memory's columns, says which of equal memories counts as the first; else the order of reading.
    """
    found = archive.files(spark, path)
    _stop(archive.verify(recorded, found).where("status <> 'ok'"), "files differ from the manifest")
    lines = {name: archive.lines(spark, path, name) for name in ("memories", "episodes")}
    _stop(archive.over_caps(found, lines["memories"].unionByName(lines["episodes"]), most_bytes, most_lines), "files are above a cap")
    rows, bad_rows = archive.read_memories(lines["memories"])
    told, bad_told = archive.read_episodes(lines["episodes"])
    _stop(bad_rows.unionByName(bad_told), "lines are no records")

    told = privacy.redact(told.withColumn("pos", F.monotonically_increasing_id()).withColumnRenamed("content", "text"), mode)
    safe = stored(told, "episodes")
    known = episodes.select("id", F.lit(True).alias("_known")).distinct()
    seen = mutations.first_in_batch(safe.select("pos", "id", "blocked"), ("id",)).join(known, "id", "left")  # texts stay where they are
    outcome = F.when(F.col("_known").isNotNull() | ~F.col("first"), "duplicate_id").when(F.col("blocked"), "refused").otherwise("imported")
    seen = stored(seen.select("pos", "id", outcome.alias("outcome")), "episodes")
    new = few(seen.where("outcome = 'imported'").select("pos"))
    taken = safe.join(new, "pos", "left_semi").withColumnRenamed("text", "content").withColumn("forgotten", F.lit(False))
    all_episodes = episodes.unionByName(taken.select(*[F.col(f.name).cast(f.dataType) for f in episodes.schema]))

    last = memories.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))  # one row
    extra = {"pos": F.monotonically_increasing_id() if order is None else order, "episode_id": F.lit(None).cast("string"), "redacted": F.lit(False), "content_hash": F.lit(None).cast("string"), "origin": F.lit("import"), "approved": F.lit(False)}
    rows = rows.join(F.broadcast(last)).withColumns(extra).withColumn("seq", F.col("_last") + 1 + F.monotonically_increasing_id()).drop("_last", "file")
    state, outcomes = mutations.import_memories(memories, all_episodes, rows, now, mode)
    both = stored(outcomes.select(F.lit("memories").alias("table"), "id", "outcome").unionByName(seen.select(F.lit("episodes").alias("table"), "id", "outcome")), "outcomes")
    return Imported(state, all_episodes, both, stats.import_counts(both.select("table", "outcome")))

"""Streaming forms of the operators: transformations of a streaming DataFrame, and a runner that drains one.

State is bounded by watermarks; what must never be wrong (one live row for each text) is decided again by the batch merge
inside foreachBatch, for a watermark remembers only its span.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text
from tidepool.operators import privacy, stats
from tidepool.operators.keptstate import KeptState


def drain(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs batch over all that has arrived, then stops; the checkpoint says what was done before."""
    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def clean_arrivals(stream: DataFrame, mode: str = "on", time: str = "event_time", late: str = "1 hour") -> DataFrame:
    """Arriving texts (id, text, scope, event_time, ...) redacted, their metadata too, hashed, without repeats inside the
    watermark; blocked rows are left out. Rows later than the watermark are dropped by Spark: `remember` loses none."""
    rows = privacy.redact(stream, mode).where(~F.col("blocked"))
    rows = privacy.redact_metadata(rows) if "metadata" in rows.columns and mode != "off" else rows
    return rows.withColumn("content_hash", text.content_hash(F.col("text"))).withWatermark(time, late).dropDuplicatesWithinWatermark(["scope", "content_hash"])


def remember(stream: DataFrame, state: KeptState, now: int, checkpoint: str, mode: str = "on", late: str = "1 hour", source: str = "arrivals") -> None:
    """Takes all texts that have arrived (what dedupe_merge takes but for redacted and content_hash) into the state, batch after
    batch: cleaned, without repeats that arrive within `late`, merged with the live row of the same text, however long ago
    that came. The watermark is on the time of arrival, so no text is late; the tags of a repeat within it go with it (`ingest`
    merges them)."""
    rows = clean_arrivals(stream.withColumn("_arrived", F.current_timestamp()), mode, "_arrived", late)
    drain(rows, lambda df, k: state.merge(df.drop("_arrived"), now, source, k) and None, checkpoint)


def activity_windows(calls: DataFrame, period: str = "1 day", time: str = "event_time", late: str = "1 day") -> DataFrame:
    """(start, source_client, reads, writes) for each period."""
    rows = calls.where(~F.col("refused") & F.col("action").isin(*stats.READS, *stats.WRITES)).withWatermark(time, late)
    return rows.groupBy(F.window(time, period).alias("w"), "source_client").agg(*stats.activity_counts()).select(F.col("w.start").alias("start"), "source_client", "reads", "writes")


def findings_windows(findings: DataFrame, period: str = "1 day", time: str = "event_time", late: str = "1 day") -> DataFrame:
    """(start, kind, action, n) for each period."""
    return findings.withWatermark(time, late).groupBy(F.window(time, period).alias("w"), "kind", "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "action", "n")


def gated(calls: DataFrame, clients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls to carry out, calls to refuse): a stream joined with the table of clients."""
    state = clients.select(F.col("id").alias("_client"), F.col("enabled").alias("_enabled"))
    judged = calls.join(state, F.col("source_client") == F.col("_client"), "left").withColumn("_ok", F.coalesce("_enabled", F.lit(True))).drop("_client", "_enabled")
    return judged.where("_ok").drop("_ok"), judged.where("not _ok").drop("_ok")


def change_feed(changes: DataFrame, memory_ids: list[str] | None = None, scope: str | None = None) -> DataFrame:
    """What a subscriber of some memories or of a scope sees of the change log."""
    rows = changes if memory_ids is None else changes.where(F.col("memory_id").isin(memory_ids))
    return rows if scope is None else rows.where(F.col("scope") == scope)


def ingest(stream: DataFrame, state: KeptState, clients: DataFrame, now: int, checkpoint: str, mode: str = "on", source: str = "stream") -> None:
    """Takes all writes that have arrived into the state, batch after batch: limits, gate, redaction and the merge with the
    live row of the same text, however long ago it came, for the state itself remembers, not a watermark. A batch that is run
    again after a failure is taken in once."""
    drain(stream, lambda df, k: state.ingest(clients, df, now, mode, source=source, batch=k) and None, checkpoint)

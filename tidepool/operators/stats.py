"""Statistics of the store, of clients, findings and imports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.filters import is_live, live

DAY = 86400000
#: Which actions count as reads and as writes of a client.
READS = ("recall", "get_context", "list_memories", "export")
WRITES = ("remember", "update_memory", "forget", "restore", "import")


def store_stats(memories: DataFrame, now: int, days: int = 30) -> DataFrame:
    """One row; superseded rows that are also deleted count as deleted."""
    alive = is_live()
    return memories.agg(
        F.count_if(alive).alias("live"),
        F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"),
        F.count_if(F.col("deleted_at").isNull() & F.col("valid_until").isNotNull()).alias("superseded"),
        F.count_if(alive & F.col("redacted")).alias("redacted"),
        F.min(F.when(alive, F.col("created_at"))).alias("oldest"),
        F.max(F.when(alive, F.col("created_at"))).alias("newest"),
        F.count_if(alive & (F.col("created_at") >= now - days * DAY)).alias("recent"),
    )


def top_scopes(memories: DataFrame, limit: int = 10) -> DataFrame:
    return live(memories).groupBy("scope").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "scope").limit(limit)


def top_tags(memories: DataFrame, limit: int = 10) -> DataFrame:
    tags = live(memories).select(F.explode(F.array_distinct("tags")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def activity_counts() -> tuple[Column, Column]:
    return F.count_if(F.col("action").isin(*READS)).alias("reads"), F.count_if(F.col("action").isin(*WRITES)).alias("writes")


def counted(audit: DataFrame, since: int | None = None) -> DataFrame:
    """Calls that count as activity: reads and writes that were not refused."""
    rows = audit.where(~F.col("refused") & F.col("action").isin(*READS, *WRITES))
    return rows if since is None else rows.where(F.col("ts") >= since)


def client_activity(audit: DataFrame, since: int | None = None) -> DataFrame:
    return counted(audit, since).groupBy("source_client").agg(*activity_counts()).withColumn("total", F.col("reads") + F.col("writes")).orderBy(F.desc("total"), "source_client")


def clients_with_activity(clients: DataFrame, activity: DataFrame) -> DataFrame:
    """Registered clients and those that only the log knows (`known` false)."""
    a = activity.select(F.col("source_client").alias("client"), "reads", "writes")
    both = clients.join(a, F.col("id") == F.col("client"), "full_outer")
    return both.select(F.coalesce("id", "client").alias("id"), F.col("id").isNotNull().alias("known"), F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("reads", F.lit(0)).alias("reads"), F.coalesce("writes", F.lit(0)).alias("writes"))


def findings_by_kind(findings: DataFrame, since: int | None = None, limit: int | None = None) -> DataFrame:
    rows = findings if since is None else findings.where(F.col("ts") >= since)
    out = rows.groupBy("kind", "action").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "action")
    return out if limit is None else out.limit(limit)


def findings_per_write(findings: DataFrame, id: str = "memory_id") -> DataFrame:
    """(id, kinds array<struct(kind, n)>, summary): "n kind, n kind", the most frequent first."""
    each = findings.groupBy(id, "kind").agg(F.count("*").alias("n"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind"))), lambda x: F.struct(x.kind.alias("kind"), (-x.m).alias("n")))
    return each.groupBy(id).agg(kinds.alias("kinds")).withColumn("summary", F.array_join(F.transform("kinds", lambda x: F.concat_ws(" ", x.n.cast("string"), x.kind)), ", "))


def live_count(memories: DataFrame, scope: str | None = None) -> DataFrame:
    rows = live(memories)
    return (rows if scope is None else rows.where(F.col("scope") == scope)).agg(F.count("*").alias("n"))


def touch(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """memories with accesses (memory_id, ts) counted in: access_count grows, last_accessed is the latest."""
    a = accesses.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("_n"), F.max("ts").alias("_last"))
    return memories.join(a, "id", "left").withColumns({"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed": F.greatest("last_accessed", "_last")}).select(*memories.columns)


def import_counts(outcomes: DataFrame) -> DataFrame:
    """outcomes (table, outcome) of every row of an import."""
    return outcomes.groupBy("table", "outcome").agg(F.count("*").alias("n"))

"""Filters, snapshots, pages and row validation.

`now` and every instant are milliseconds since the epoch and always passed in. Nulls follow SQL: a row whose tested column
is null fails the test unless said otherwise.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The largest row that is stored.
LIMITS = {"text": 65536, "tags": 32, "tag": 64, "scope": 128, "metadata": 4096}


def is_live() -> Column:
    return F.col("deleted_at").isNull() & F.col("valid_until").isNull()


def live(memories: DataFrame) -> DataFrame:
    return memories.where(is_live())


def eligible(origin: Column | None = None, approved: Column | None = None) -> Column:
    """Whether a memory may be put into a context unasked: the user's own, or approved; null counts as no."""
    origin, approved = F.col("origin") if origin is None else origin, F.col("approved") if approved is None else approved
    return F.coalesce(origin == "user", F.lit(False)) | F.coalesce(approved, F.lit(False))


def has_all_tags(required: list[str] | Column, tags: Column | None = None) -> Column:
    need = F.array(*map(F.lit, required)).cast("array<string>") if isinstance(required, list) else required
    return F.size(F.array_except(need, F.col("tags") if tags is None else tags)) == 0


def list_memories(memories: DataFrame, scope: str | None = None, source_client: str | None = None, since: int | None = None, until: int | None = None, tags: list[str] | None = None, include_deleted: bool = False, include_superseded: bool = False) -> DataFrame:
    """since <= created_at < until."""
    tests = [
        F.col("deleted_at").isNull() if not include_deleted else None,
        F.col("valid_until").isNull() if not include_superseded else None,
        F.col("scope") == scope if scope is not None else None,
        F.col("source_client") == source_client if source_client is not None else None,
        F.col("created_at") >= since if since is not None else None,
        F.col("created_at") < until if until is not None else None,
        has_all_tags(tags) if tags else None,
    ]
    for test in tests:
        memories = memories if test is None else memories.where(test)
    return memories


def valid_at(at: Column | int) -> Column:
    """Deleted rows never come back, whenever they were deleted."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.col("deleted_at").isNull() & (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at))


def as_of(memories: DataFrame, at: int, scope: str | None = None, limit: int | None = None) -> DataFrame:
    """The rows that held at an instant, newest first if limited."""
    rows = memories.where(valid_at(at))
    rows = rows if scope is None else rows.where(F.col("scope") == scope)
    return rows if limit is None else rows.orderBy(F.desc("valid_from"), F.desc("id")).limit(limit)


def timeline(memories: DataFrame, instants: list[int]) -> DataFrame:
    """The rows that held at each of a few instants: (at, memory columns), in one pass over memories."""
    held = F.filter(F.array(*[F.lit(at).cast("long") for at in instants]), lambda at: (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))
    return memories.where(F.col("deleted_at").isNull()).select(F.explode(held).alias("at"), "*")


def _span(instants: DataFrame, levels: int) -> tuple[int, int] | None:
    """The first instant and the width of a bucket, for 2^levels buckets over all instants."""
    low, high = instants.agg(F.min("at"), F.max("at")).first()
    return None if low is None else (low, (high - low >> levels) + 1)


def _cover(first: Column, end: Column, levels: int) -> Column:
    """array<struct<level, node>>: buckets first to end - 1 as the fewest nodes of a binary tree, two a level at most."""
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    at = lambda level, node: F.struct(level.cast("int").alias("level"), node.cast("bigint").alias("node"))

    def climb(acc, level):
        inside = acc["l"] < acc["r"]
        left, right = inside & (acc["l"] % 2 == 1), inside & (acc["r"] % 2 == 1)
        out = F.concat(acc["out"], F.when(left, F.array(at(level, acc["l"]))).otherwise(none), F.when(right, F.array(at(level, acc["r"] - 1))).otherwise(none))
        return F.struct(F.shiftright(acc["l"] + left.cast("bigint"), 1).alias("l"), F.shiftright(acc["r"] - right.cast("bigint"), 1).alias("r"), out.alias("out"))

    start = F.struct(first.cast("bigint").alias("l"), end.cast("bigint").alias("r"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, climb)["out"]


def _parts(memories: DataFrame, low: int, width: int, levels: int, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of rows not deleted: (columns, level, node) for the buckets that they hold throughout, and (columns, node, valid_from,
    valid_until) for those in which they begin or end."""
    rows = memories.where("deleted_at is null and valid_from is not null and (valid_until is null or valid_until > valid_from)")
    bucket = lambda t: F.floor((t - low) / width).cast("bigint")
    most = F.lit(1 << levels).cast("bigint")
    begin, end = bucket(F.col("valid_from")), F.when(F.col("valid_until").isNull(), most).otherwise(bucket(F.col("valid_until")))
    own = [c for c in ("valid_from", "valid_until") if c not in columns]
    rows = rows.select(*columns, *own, begin.alias("_b"), end.alias("_e")).where((F.col("_b") < most) & (F.col("_e") >= 0))
    whole = rows.select(*columns, F.explode(_cover(F.greatest(F.col("_b") + 1, F.lit(0)), F.least("_e", most), levels)).alias("x")).select(*columns, "x.level", "x.node")
    edge = rows.select(*columns, *own, F.explode(F.array_distinct(F.array("_b", "_e"))).alias("node")).where((F.col("node") >= 0) & (F.col("node") < most))
    return whole, edge


def _nodes(instants: DataFrame, low: int, width: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """(at, level, node) for every node of the tree above an instant, and (at, node) of its bucket."""
    bucket = F.floor((F.col("at") - low) / width).cast("bigint")
    own = instants.select("at", bucket.alias("node"))
    up = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.floor(F.col("node") / F.pow(F.lit(2.0), k)).cast("bigint")))
    return own.select("at", up.alias("level", "node")), own


def timeline_at(memories: DataFrame, instants: DataFrame, columns: list[str] | None = None, levels: int = 16) -> DataFrame:
    """(at, columns): the rows that held at each of any number of instants (at); all of memories' columns, if none are named.

    An interval join by equality: time is cut into 2^levels buckets, an interval becomes the few nodes of the binary tree over
    them that it holds throughout, and an instant looks up every node above it. Where an interval begins or ends inside a
    bucket, it meets that bucket's instants and is tested. Equal instants are one.
    """
    columns, asked = columns or memories.columns, instants.where("at is not null").select(F.col("at").cast("bigint").alias("at")).distinct()
    if (span := _span(asked, levels)) is None:
        return asked.join(memories.select(*columns).limit(0), F.lit(False))
    whole, edge = _parts(memories, *span, levels, columns)
    nodes, own = _nodes(asked, *span, levels)
    inside = nodes.join(whole, ["level", "node"]).select("at", *columns)
    holds = (F.col("_from") <= F.col("at")) & (F.col("_until").isNull() | (F.col("_until") > F.col("at")))
    at_ends = edge.withColumnsRenamed({} if "valid_from" in columns else {"valid_from": "_from", "valid_until": "_until"})
    at_ends = at_ends.withColumns({"_from": F.col("valid_from"), "_until": F.col("valid_until")}) if "valid_from" in columns else at_ends
    return inside.unionByName(own.join(at_ends, "node").where(holds).select("at", *columns))


def timeline_sizes(memories: DataFrame, instants: DataFrame, by: str = "scope", levels: int = 16) -> DataFrame:
    """(at, by, n): how many rows held at each instant; none where none did. Intervals are counted by node before they meet the
    instants, so neither the pairs of rows and instants nor a long list of either is ever made."""
    asked = instants.where("at is not null").select(F.col("at").cast("bigint").alias("at")).distinct()
    if (span := _span(asked, levels)) is None:
        return asked.join(memories.select(by).limit(0), F.lit(False)).withColumn("n", F.lit(0).cast("bigint"))
    whole, edge = _parts(memories, *span, levels, [by])
    nodes, own = _nodes(asked, *span, levels)
    counted = whole.groupBy(by, "level", "node").agg(F.count("*").alias("n"))
    ends = edge.groupBy(by, "node", "valid_from", "valid_until").agg(F.count("*").alias("n"))
    holds = (F.col("valid_from") <= F.col("at")) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("at")))
    some = nodes.join(counted, ["level", "node"]).select("at", by, "n").unionByName(own.join(ends, "node").where(holds).select("at", by, "n"))
    return some.groupBy("at", by).agg(F.sum("n").alias("n"))


def by_ids(memories: DataFrame, ids: DataFrame, include_deleted: bool = False, include_superseded: bool = False) -> DataFrame:
    return list_memories(memories, include_deleted=include_deleted, include_superseded=include_superseded).join(ids.select("id").distinct(), "id", "left_semi")


def page(rows: DataFrame, limit: int, cursor: str | None = None, time: str = "created_at", id: str = "id") -> DataFrame:
    """A page, newest first, of `limit` rows, with next_cursor on every row if more follow.

    A cursor names the last row of the page before, so pages do not shift when rows arrive.
    """
    if cursor is not None:
        t, i = _read_cursor(cursor)
        at = F.lit(i).cast(rows.schema[id].dataType)
        rows = rows.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(id) < at)))
    found = rows.orderBy(F.desc(time), F.desc(id)).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(F.desc(time), F.desc(id)))  # over limit + 1 rows
    plain = F.concat_ws(":", F.col(time).cast("string"), F.col(id).cast("string")).cast("binary")
    safe = F.translate(F.regexp_replace(F.base64(plain), "=+$", ""), "+/\r\n", "-_")
    last = F.max(F.when(F.col("_n") == limit, safe)).over(Window.partitionBy())
    more = F.max("_n").over(Window.partitionBy()) > limit
    return found.withColumn("_n", n).withColumn("next_cursor", F.when(more, last)).where(F.col("_n") <= limit).drop("_n")


def _read_cursor(cursor: str) -> tuple[int, str]:
    import base64

    time, _, id = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().partition(":")
    return int(time), id


def with_flaw(rows: DataFrame) -> DataFrame:
    """Adds `flaw`: why a row is refused, or null. Columns that rows lack are not tested."""
    has = set(rows.columns)
    tests = [
        ("text", lambda: F.col("text").isNull() | (F.length(F.trim(F.col("text"))) == 0), "text missing"),
        ("text", lambda: F.length("text") > LIMITS["text"], "text too long"),
        ("tags", lambda: F.size("tags") > LIMITS["tags"], "too many tags"),
        ("tags", lambda: F.exists("tags", lambda t: F.length(t) > LIMITS["tag"]), "tag too long"),
        ("scope", lambda: F.length("scope") > LIMITS["scope"], "scope too long"),
        ("metadata", lambda: F.length("metadata") > LIMITS["metadata"], "metadata too long"),
        ("importance", lambda: F.isnan("importance") | ~F.col("importance").between(0, 1), "importance outside [0, 1]"),
    ]
    return rows.withColumn("flaw", F.coalesce(*[F.when(test(), F.lit(why)) for c, test, why in tests if c in has]))


def validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that can be stored, rows refused with their flaw)."""
    judged = with_flaw(rows)
    return judged.where("flaw is null").drop("flaw"), judged.where("flaw is not null")


def visible_episodes(episodes: DataFrame, include_forgotten: bool = False) -> DataFrame:
    return episodes if include_forgotten else episodes.where(~F.coalesce(F.col("forgotten"), F.lit(False)))


def list_audit(audit: DataFrame, action: str | None = None, source_client: str | None = None, memory_id: str | None = None, since: int | None = None, until: int | None = None, refused: bool | None = None) -> DataFrame:
    """since <= ts <= until: both ends belong to the range."""
    for column, value in (("action", action), ("source_client", source_client), ("memory_id", memory_id), ("refused", refused)):
        audit = audit if value is None else audit.where(F.col(column) == value)
    audit = audit if since is None else audit.where(F.col("ts") >= since)
    return audit if until is None else audit.where(F.col("ts") <= until)


def list_findings(findings: DataFrame, action: str | None = None, memory_id: str | None = None, since: int | None = None) -> DataFrame:
    for column, value in (("action", action), ("memory_id", memory_id)):
        findings = findings if value is None else findings.where(F.col(column) == value)
    return findings if since is None else findings.where(F.col("ts") >= since)


def list_clients(clients: DataFrame) -> DataFrame:
    return clients.orderBy(F.desc("last_seen"), "id")


def vector_spaces(vectors: DataFrame) -> DataFrame:
    return vectors.select("model_id", "dim").distinct()

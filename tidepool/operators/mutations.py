"""Changes to the store as jobs from snapshot to snapshot: every operator takes a state and a table of changes and returns a
new state with one outcome row for each change. Nothing is written here; callers write a new snapshot and publish it last.

`now` is passed in. Where several changes of one batch name the same row, the last by `pos` counts, the others get the
outcome `superseded_in_batch`.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import ids, text
from tidepool.operators import privacy
from tidepool.operators.filters import is_live, with_flaw
from tidepool.sources.stored import few, stored


class Ingested(NamedTuple):
    memories: DataFrame
    episodes: DataFrame
    findings: DataFrame
    audit: DataFrame
    rejects: DataFrame


def gate(calls: DataFrame, clients: DataFrame) -> DataFrame:
    """calls with `refused`: those of disabled clients; a client nobody registered counts as enabled."""
    state = clients.select(F.col("id").alias("_client"), F.col("enabled").alias("_enabled"))
    return calls.join(state, F.col("source_client") == F.col("_client"), "left").withColumn("refused", ~F.coalesce("_enabled", F.lit(True))).drop("_client", "_enabled")


def upsert_clients(clients: DataFrame, seen: DataFrame) -> DataFrame:
    """seen (id, name, ts): first_seen is kept, last_seen and name are refreshed, enabled is left as it is."""
    new = seen.groupBy("id").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.max_by("name", "ts").alias("_name"))
    both = clients.join(new, "id", "full_outer")
    return both.select("id", F.coalesce("_name", "name").alias("name"), F.coalesce("first_seen", "_first").alias("first_seen"), F.greatest("last_seen", "_last").alias("last_seen"), F.coalesce("enabled", F.lit(True)).alias("enabled"))


def first_in_batch(rows: DataFrame, keys: tuple[str, ...] = ("scope", "content_hash"), pos: str = "pos") -> DataFrame:
    """Adds `first`: whether no earlier row of the batch has the same keys. The earliest position is aggregated before it is
    joined, so a text that fills much of the batch is summed in every task."""
    least = rows.groupBy(*keys).agg(F.min(pos).alias("_first"))
    return rows.join(least, list(keys), "left").withColumn("first", F.col(pos) == F.col("_first")).drop("_first")


def dedupe_merge(memories: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """The state after incoming rows: one live row for each (scope, content_hash).

    incoming: id, seq, pos, text, scope, source_client, importance (null if not supplied), episode_id, redacted, content_hash,
    origin, tags. A merge unites tags, raises importance only if one was supplied, keeps the first episode, and may make the
    origin `user` but never takes that back.
    """
    order = F.struct("pos", "id")
    batch = incoming.groupBy("scope", "content_hash").agg(
        F.min_by(F.struct("id", "seq", "text", "source_client", "redacted", "origin", "importance"), order).alias("r"),
        F.max("importance").alias("importance"),
        F.min_by("episode_id", F.when(F.col("episode_id").isNotNull(), order)).alias("episode_id"),
        F.bool_or(F.col("origin") == "user").alias("by_user"),
    )
    # one row for each tag of a text before any is gathered: a text written very often brings each of its tags once
    tagged = incoming.select("scope", "content_hash", F.explode("tags").alias("tag")).distinct().groupBy("scope", "content_hash").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    batch = batch.join(tagged, ["scope", "content_hash"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    live = memories.where(is_live())
    # a write without an importance that makes a row gives it 0.5, which later ones of the batch may raise
    batch = batch.withColumn("fresh_importance", F.greatest("importance", F.when(F.col("r.importance").isNull(), F.lit(0.5))))
    both = live.alias("m").join(batch.alias("b"), ["scope", "content_hash"], "left")
    hit = F.col("b.r").isNotNull()
    merged = both.select(
        *[F.col(c) if c in ("scope", "content_hash") else {
            "tags": F.when(hit, F.array_sort(F.array_union("m.tags", "b.tags"))).otherwise(F.col("m.tags")),
            "importance": F.greatest("m.importance", "b.importance"),
            "episode_id": F.coalesce("m.episode_id", "b.episode_id"),
            "origin": F.when(F.coalesce("b.by_user", F.lit(False)), F.lit("user")).otherwise(F.col("m.origin")),
            "updated_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("m.updated_at")),
        }.get(c, F.col(f"m.{c}")).alias(c) for c in memories.columns]
    )
    fresh = batch.join(live.select("scope", "content_hash"), ["scope", "content_hash"], "left_anti")
    values = {
        "id": F.col("r.id"), "seq": F.col("r.seq"), "text": F.col("r.text"), "source_client": F.col("r.source_client"), "importance": F.col("fresh_importance"),
        "created_at": F.lit(now), "updated_at": F.lit(now), "access_count": F.lit(0), "valid_from": F.lit(now), "redacted": F.col("r.redacted"), "approved": F.lit(False),
        "origin": F.when(F.col("by_user"), F.lit("user")).otherwise(F.col("r.origin")),
    }
    kept = ("scope", "content_hash", "episode_id", "tags")
    new = fresh.select(*[(F.col(f.name) if f.name in kept else values.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in memories.schema])
    return memories.where(~is_live()).unionByName(merged).unionByName(new)


class Prepared(NamedTuple):
    rows: DataFrame  # what dedupe_merge takes
    episodes: DataFrame
    findings: DataFrame
    audit: DataFrame
    rejects: DataFrame


def prepare_ingest(clients: DataFrame, incoming: DataFrame, now: int, mode: str = "on", origin: str = "user") -> Prepared:
    """Everything of bulk_ingest that needs no state: limits, the gate, redaction, hashes and the rows for the logs."""
    judged = gate(with_flaw(incoming), clients)
    if "metadata" not in judged.columns:
        judged = judged.withColumn("metadata", F.lit(None).cast("string"))
    refused = judged.where("flaw is not null or refused")
    open_rows = privacy.redact(judged.where("flaw is null and not refused"), mode)
    open_rows = open_rows if mode == "off" else privacy.redact_metadata(open_rows)
    kept = open_rows.withColumns({"episode_id": F.concat(F.lit("e-"), "id"), "text": F.when(~F.col("blocked"), F.col("text"))})  # a blocked text is written nowhere
    open_rows = stored(kept.withColumn("content_hash", text.content_hash(F.col("text"))), "ingest")  # five outputs read it
    written = open_rows.where(~F.col("blocked"))
    new_episodes = written.select(F.col("episode_id").alias("id"), F.col("text").alias("content"), "scope", "source_client", "metadata", F.lit(now).cast("long").alias("created_at"), F.lit(False).alias("forgotten"))
    call = lambda df, n, is_refused: df.select(F.lit(now).cast("long").alias("ts"), F.lit("remember").alias("action"), F.col("id").alias("memory_id"), "scope", "source_client", F.lit(n).cast("long").alias("result_count"), F.lit(is_refused).alias("refused"))
    audit = call(written, 1, False).unionByName(call(open_rows.where("blocked"), 0, False)).unionByName(call(refused.where("refused"), 0, True))
    rejects = refused.select("id", "scope", F.coalesce("flaw", F.lit("client disabled")).alias("reason")).unionByName(open_rows.where("blocked").select("id", "scope", F.lit("secret found").alias("reason")))
    return Prepared(written.withColumn("origin", F.lit(origin)), new_episodes, privacy.findings_rows(open_rows, F.lit(now).cast("long")), audit, rejects)


def bulk_ingest(memories: DataFrame, episodes: DataFrame, clients: DataFrame, incoming: DataFrame, now: int, mode: str = "on", origin: str = "user") -> Ingested:
    """Takes incoming writes (id, seq, pos, text, scope, source_client, importance, tags[, metadata]) into the store: rows that
    break a limit and writes of disabled clients are refused; secrets are redacted, or in mode "strict" block the write.

    findings, audit and rejects hold the rows to append to those logs. Everything is derived from ids and `now`, so a
    retried task gives the same rows.
    """
    p = prepare_ingest(clients, incoming, now, mode, origin)
    return Ingested(dedupe_merge(memories, p.rows, now), episodes.unionByName(p.episodes), p.findings, p.audit, p.rejects)


def _latest(changes: DataFrame, key: str = "id") -> DataFrame:
    """changes with `_last`: whether the batch names the row again later."""
    changes = changes if "pos" in changes.columns else changes.withColumn("pos", F.lit(0).cast("long"))
    return changes.withColumn("_last", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("pos"))) == 1)


def _outcomes(changes: DataFrame, outcome: Column) -> DataFrame:
    return changes.select("id", F.when(~F.col("_last"), "superseded_in_batch").otherwise(outcome).alias("outcome"))


def update(memories: DataFrame, patches: DataFrame, now: int, mode: str = "on") -> tuple[DataFrame, DataFrame]:
    """(state, outcomes) after patches (id, text, tags, importance[, pos]), nulls leaving a column as it is;
    patches that privacy.redact has been through already are taken as they are.

    Superseded rows refuse; a text that another live row of the scope holds, or that two patches of the batch claim, conflicts.
    """
    p = _latest(patches if "blocked" in patches.columns else privacy.redact(patches, mode))
    facts = memories.select("id", F.col("scope").alias("_scope"), F.col("deleted_at").alias("_del"), F.col("valid_until").alias("_until"), F.col("content_hash").alias("_old"))
    p = p.join(facts, "id", "left").withColumn("_hash", F.when(F.col("text").isNotNull(), text.content_hash(F.col("text"))))
    taken = memories.where(is_live()).select(F.col("scope").alias("_scope"), F.col("content_hash").alias("_hash"), F.lit(True).alias("_taken")).distinct()
    claims = p.where("_last and _hash is not null").groupBy("_scope", "_hash").agg(F.count("*").alias("_claims"))
    p = p.join(taken, ["_scope", "_hash"], "left").join(claims, ["_scope", "_hash"], "left")
    clash = F.col("_hash").isNotNull() & ~F.col("_hash").eqNullSafe(F.col("_old")) & (F.coalesce("_taken", F.lit(False)) | (F.coalesce("_claims", F.lit(1)) > 1))
    outcome = (
        F.when(F.col("_scope").isNull(), "not_found").when(F.col("_del").isNotNull(), "not_found").when(F.col("_until").isNotNull(), "superseded")
        .when(F.col("blocked"), "refused").when(clash, "conflict").otherwise("ok")
    )
    p = p.withColumn("_out", outcome)
    ok = p.where("_last and _out = 'ok'").select("id", F.col("text").alias("_text"), F.col("tags").alias("_tags"), F.col("importance").alias("_imp"), "_hash", F.col("redacted").alias("_red"))
    both = memories.join(few(stored(ok.withColumn("_ok", F.lit(True)), "ok")), "id", "left")
    state = both.withColumns({
        "text": F.coalesce("_text", "text"), "content_hash": F.coalesce("_hash", "content_hash"), "tags": F.coalesce(F.array_sort(F.array_distinct("_tags")), "tags"),
        "importance": F.coalesce("_imp", "importance"), "redacted": F.col("redacted") | F.coalesce("_red", F.lit(False)), "updated_at": F.when(F.col("_ok"), F.lit(now).cast("long")).otherwise(F.col("updated_at")),
    }).select(memories.columns)
    return state, _outcomes(p, F.col("_out"))


def forget_with_episodes(memories: DataFrame, episodes: DataFrame, changes: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, episodes, outcomes): forget, and flags on the episodes that have no memory left."""
    state, out = forget(memories, changes, now)
    return state, mark_episodes(episodes, state), out


def restore_with_episodes(memories: DataFrame, episodes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, episodes, outcomes): restore, and the flags taken off episodes that have a memory again."""
    state, out = restore(memories, changes)
    return state, mark_episodes(episodes, state), out


def forget(memories: DataFrame, changes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Soft-deletes the rows named; those deleted already stay as they were."""
    c = _latest(changes).join(memories.select("id", F.col("deleted_at").alias("_del"), F.lit(True).alias("_there")), "id", "left")
    out = _outcomes(c, F.when(F.col("_there").isNull() | F.col("_del").isNotNull(), "not_found").otherwise("ok"))
    named = changes.select("id", F.lit(now).cast("long").alias("_now")).distinct()
    return memories.join(few(stored(named, "named")), "id", "left").withColumn("deleted_at", F.coalesce("deleted_at", "_now")).select(memories.columns), out


def restore(memories: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undoes forget, unless a live row of the scope holds the text by now, or two of the batch do."""
    facts = memories.select("id", "scope", "content_hash", "deleted_at", "valid_until", F.lit(True).alias("_there"))
    c = _latest(changes).join(facts, "id", "left")
    taken = memories.where(is_live()).select("scope", "content_hash", F.lit(True).alias("_taken")).distinct()
    claims = c.where("_last and deleted_at is not null and valid_until is null").groupBy("scope", "content_hash").agg(F.count("*").alias("_claims"))
    c = c.join(taken, ["scope", "content_hash"], "left").join(claims, ["scope", "content_hash"], "left")
    clash = F.col("valid_until").isNull() & (F.coalesce("_taken", F.lit(False)) | (F.coalesce("_claims", F.lit(0)) > 1))
    c = c.withColumn("_out", F.when(F.col("_there").isNull() | F.col("deleted_at").isNull(), "not_found").when(clash, "conflict").otherwise("ok"))
    ok = c.where("_last and _out = 'ok'").select("id", F.lit(True).alias("_ok"))
    state = memories.join(ok, "id", "left").withColumn("deleted_at", F.when(F.col("_ok"), F.lit(None)).otherwise(F.col("deleted_at"))).select(memories.columns)
    return state, _outcomes(c, F.col("_out"))


def mark_episodes(episodes: DataFrame, memories: DataFrame) -> DataFrame:
    """An episode is forgotten while it has memories and all of them are deleted."""
    use = memories.where("episode_id is not null").groupBy(F.col("episode_id").alias("id")).agg(F.bool_and(F.col("deleted_at").isNotNull()).alias("_gone"))
    return episodes.join(use, "id", "left").withColumn("forgotten", F.coalesce("_gone", "forgotten")).select(episodes.columns)


def approve(memories: DataFrame, changes: DataFrame, value: bool = True) -> tuple[DataFrame, DataFrame]:
    c = _latest(changes).join(memories.where("deleted_at is null").select("id", F.lit(True).alias("_there")), "id", "left")
    ok = c.where("_there").select("id", F.lit(value).alias("_to")).distinct()
    state = memories.join(ok, "id", "left").withColumn("approved", F.coalesce("_to", "approved")).select(memories.columns)
    return state, _outcomes(c, F.when(F.col("_there").isNull(), "not_found").otherwise("ok"))


def chained(steps: DataFrame) -> DataFrame:
    """steps (id, start, given, pos, created_at, new_id, importance, ...) of each id in order of pos, with k (from 1), at, imp,
    and the following step's next_id and next_at.

    at is max(created_at, the at before + 1), from `start` on, and imp the last importance given, from `given` on. at - k is a
    running maximum of created_at - k, so the steps of an id are scanned in ranges of (id, pos): each range is summed up in a
    row, the rows of an id carry over what came before, and no task holds more than a range, however many steps an id has.
    """
    order = ("pos", "new_id")
    place = F.monotonically_increasing_id()  # the number of the range, and the place in it
    ranges = stored(steps.repartitionByRange("id", *order).sortWithinPartitions("id", *order).withColumn("_part", F.shiftright(place, 33)), "ranges")
    w = Window.partitionBy("id", "_part").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    lead = lambda c: F.lead(c).over(w)
    here = F.row_number().over(w)
    rows = ranges.withColumn("_here", here).withColumns({"_top": F.max(F.col("created_at") - F.col("_here")).over(upto), "_given": F.last("importance", ignorenulls=True).over(upto), "_next": lead(F.struct("new_id", "created_at"))})
    ordered = F.struct(*order)
    sums = ranges.withColumn("_here", here).groupBy("id", "_part").agg(
        F.count("*").alias("_n"), F.max(F.col("created_at") - F.col("_here")).alias("_most"), F.max_by("importance", F.when(F.col("importance").isNotNull(), ordered)).alias("_last"),
        F.min_by(F.struct("new_id", "created_at"), ordered).alias("_first"),
    )
    parts = Window.partitionBy("id").orderBy("_part")
    past = parts.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_off", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    carried = sums.select("id", "_part", "_off", F.max(F.col("_most") - F.col("_off")).over(past).alias("_carried"), F.last("_last", ignorenulls=True).over(past).alias("_carried_imp"), F.lead("_first").over(parts).alias("_later"))
    both = rows.join(stored(carried, "carried"), ["id", "_part"])  # a row for each range and id in it
    k = (F.col("_here") + F.col("_off")).alias("k")
    base = F.greatest("start", "_carried", F.col("_top") - F.col("_off"))
    told = both.select(*steps.columns, k, base.alias("_base"), F.coalesce("_given", "_carried_imp", "given").alias("imp"), F.coalesce("_next", "_later").alias("_next"))
    at = F.col("_base") + F.col("k")
    return told.select(*steps.columns, "k", at.alias("at"), "imp", F.col("_next.new_id").alias("next_id"), F.when(F.col("_next").isNotNull(), F.greatest("_next.created_at", at + 1)).alias("next_at"))


def supersede(memories: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, outcomes) after changes (id, pos, new_id, new_seq, text, source_client, importance, tags, created_at): old rows end where
    their replacements begin.

    Intervals stay adjacent, half-open and never empty: a step ends its predecessor at max(its created_at, predecessor's
    valid_from + 1) and starts there. Several steps for one id in a batch form a chain in order of pos. A replacement takes the
    importance of what it replaces unless it brings one; tags are its own; its origin is the user.
    """
    old = memories.where(is_live()).select("id", F.col("valid_from").alias("start"), F.col("importance").alias("given"), "scope")
    c = changes.join(old, "id", "left").withColumn("_ok", F.col("start").isNotNull())
    chain = stored(chained(c.where("_ok").drop("_ok")), "chain")
    ends = chain.where("k = 1").select("id", F.col("at").alias("_until"), F.col("new_id").alias("_by"))
    kept = memories.join(few(stored(ends, "ends")), "id", "left").withColumns({"valid_until": F.coalesce("valid_until", "_until"), "superseded_by": F.coalesce("superseded_by", "_by"), "updated_at": F.coalesce("_until", "updated_at")}).select(memories.columns)
    values = {
        "id": F.col("new_id"), "seq": F.col("new_seq"), "text": F.col("text"), "scope": F.col("scope"), "source_client": F.col("source_client"), "importance": F.col("imp"),
        "created_at": F.col("at"), "updated_at": F.col("at"), "access_count": F.lit(0), "valid_from": F.col("at"), "valid_until": F.col("next_at"), "superseded_by": F.col("next_id"),
        "redacted": F.lit(False), "content_hash": text.content_hash(F.col("text")), "origin": F.lit("user"), "approved": F.lit(False), "tags": F.coalesce(F.array_sort(F.array_distinct("tags")), F.array().cast("array<string>")),
    }
    new = chain.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in memories.schema])
    return kept.unionByName(new), c.select("id", "new_id", F.when(F.col("_ok"), "ok").otherwise("refused").alias("outcome"))


def purge_all(memories: DataFrame, episodes: DataFrame, vectors: DataFrame, confirm: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(no memories, no episodes, no vectors, one row of what went); audit and findings are other tables and stay."""
    if confirm is not True:
        raise ValueError("purging needs confirm=True")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return memories.limit(0), episodes.limit(0), vectors.limit(0), n(memories, "memories").join(n(episodes, "episodes")).join(n(vectors, "vectors"))


def purge(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The state without the rows named; what they had superseded is current again, with no end and no successor."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    rest = memories.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    both = rest.join(gone, F.col("superseded_by") == F.col("_gone"), "left")
    healed = F.col("_gone").isNotNull()
    return both.withColumns({"valid_until": F.when(~healed, F.col("valid_until")), "superseded_by": F.when(~healed, F.col("superseded_by"))}).select(memories.columns)


def linked(rows: DataFrame, episodes: DataFrame, memories: DataFrame) -> DataFrame:
    """rows whose episode_id and superseded_by are null unless their target exists; a row is never its own successor."""
    e = episodes.select(F.col("id").alias("_e")).distinct()
    m = memories.select(F.col("id").alias("_m")).unionByName(rows.select(F.col("id").alias("_m"))).distinct()
    both = rows.join(e, F.col("episode_id") == F.col("_e"), "left").join(m, (F.col("superseded_by") == F.col("_m")) & (F.col("superseded_by") != F.col("id")), "left")
    return both.withColumns({"episode_id": F.col("_e"), "superseded_by": F.col("_m")}).select(rows.columns)


def import_memories(memories: DataFrame, episodes: DataFrame, archived: DataFrame, now: int, mode: str = "on") -> tuple[DataFrame, DataFrame]:
    """(state, outcomes) after archived rows (schema of memories, pos): skipped if the id exists, then if a live row holds the text.

    The archive's word is not taken for origin, approval, redaction or creation: a row is an unapproved import, created
    when its id says, or now. Dead rows stay dead.
    """
    safe = privacy.redact(archived, mode).withColumns({"content_hash": text.content_hash(F.col("text")), "_row": F.monotonically_increasing_id()})
    # redacted and hashed once, for every step below and both results read it; what decides has no texts, so these stay where they are
    safe = stored(safe, "import")
    facts = linked(safe.select("_row", "id", "pos", "scope", "content_hash", "deleted_at", "valid_until", "blocked", "episode_id", "superseded_by"), episodes, memories)
    known = memories.select("id").distinct().withColumn("_known", F.lit(True))
    taken = memories.where(is_live()).select("scope", "content_hash", F.lit(True).alias("_taken")).distinct()
    first_id = first_in_batch(facts, ("id",)).withColumnRenamed("first", "_first_id")
    rows = first_id.join(known, "id", "left").join(taken, ["scope", "content_hash"], "left").withColumn("_new", F.col("_known").isNull() & F.col("_first_id"))
    alive = rows.where("_new and _taken is null and not blocked").where(is_live()).groupBy("scope", "content_hash").agg(F.min("pos").alias("_least"))
    rows = rows.join(alive, ["scope", "content_hash"], "left")
    outcome = (
        F.when(~F.col("_new"), "duplicate_id").when(F.col("blocked"), "refused").when(is_live() & F.coalesce("_taken", F.lit(False)), "duplicate_content")
        .when(is_live() & (F.col("pos") > F.col("_least")), "duplicate_content").otherwise("imported")
    )
    rows = stored(rows.select("_row", "id", "episode_id", "superseded_by", outcome.alias("outcome")), "judged")
    made = F.when(ids.plausible(F.col("id"), now), ids.id_ms(F.col("id"))).otherwise(F.lit(now).cast("long"))
    links = few(rows.where("outcome = 'imported'").select("_row", "episode_id", "superseded_by"))
    new = safe.drop("episode_id", "superseded_by").join(links, "_row").withColumns({"origin": F.lit("import"), "approved": F.lit(False), "created_at": made})
    return memories.unionByName(new.select(*[F.col(f.name).cast(f.dataType) for f in memories.schema])), rows.select("id", "outcome")


def preview_import(memories: DataFrame, entries: DataFrame, mode: str = "on", shown: int = 50) -> tuple[DataFrame, DataFrame]:
    """(one row of counts, the first entries as they would be stored) for entries (pos, text, scope): what would be refused in
    strict mode, skipped as a duplicate of a live row or of an earlier entry, imported."""
    found = privacy.redact(entries, "on" if mode == "strict" else mode)
    judged = found.withColumns({"would_refuse": (F.size("findings") > 0) & F.lit(mode == "strict"), "content_hash": text.content_hash(F.col("text"))})
    taken = memories.where(is_live()).select("scope", "content_hash", F.lit(True).alias("_taken")).distinct()
    rows = first_in_batch(judged).join(taken, ["scope", "content_hash"], "left")
    skip = ~F.col("would_refuse") & (F.coalesce("_taken", F.lit(False)) | ~F.col("first"))
    rows = rows.withColumn("outcome", F.when(F.col("would_refuse"), "refuse").when(skip, "skip").otherwise("import"))
    counts = rows.agg(*[F.count_if(F.col("outcome") == o).alias(f"would_{o}") for o in ("refuse", "skip", "import")])
    return counts, rows.orderBy("pos").limit(shown).select("pos", "text", "outcome")

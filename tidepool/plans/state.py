"""Queries on mutations, imports, indexing, streams and providers (M, J11, A09, E, K, T, S12)."""

from pyspark.sql import functions as F

from tidepool.functions.text import content_hash
from tidepool.operators import embedding, importing, mutations
from tidepool.operators.filters import is_live
from tidepool.operators.keptstate import KeptState
from tidepool.plans import retrieval, secretsql
from tidepool.plans.registry import SQL, query, scratch, stored
from tidepool.plans.tables import ACTIVE, LIVE, READ, episodes, exported
from tidepool.sources import archive, fixtures, imports
from tidepool.sources.fixtures import NOW
from tidepool.sources.stored import few
from tidepool.streaming import jobs

HASH = r"sha256(concat('v1', chr(10), lower(trim(regexp_replace(nfc_normalize({0}), '\s+', ' ', 'g')))))"


def incoming(spark, d, docs=None):
    """Every document as a write to the scope of its language."""
    docs = spark.read.parquet(f"{d}/documents.parquet") if docs is None else docs
    return docs.select(
        F.concat(F.lit("n"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("pos"), "text", F.col("lang").alias("scope"),
        F.concat(F.lit("client"), (F.col("doc_id") % 7).cast("string")).alias("source_client"),
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 10 / 10).alias("importance"), F.array(F.col("source")).alias("tags"),
    )


def hashed(memories):
    """Memories with their content hash, without NFKC's help where the text is ASCII."""
    return memories.withColumn("content_hash", content_hash(F.col("text")))


def unique_state(spark, d):
    """Memories of which no two live rows of a scope share a text."""
    m = hashed(fixtures.memories(spark, d)).withColumn("pos", F.col("seq"))
    return stored(mutations.first_in_batch(m).where("first").drop("first", "pos"), "state")


UNIQUE = f"state AS (SELECT * EXCLUDE (k) FROM (SELECT *, {HASH.format('text')} AS content_hash, row_number() OVER (PARTITION BY scope, {HASH.format('text')} ORDER BY seq) AS k FROM fx_memories) WHERE k = 1)"
#: Secrets are redacted before a text is hashed.
CLEAN = secretsql.found("documents")
WRITES = f"{CLEAN},\nwrites AS (SELECT d.doc_id, lang AS scope, source, {HASH.format('c.text')} AS h, CASE WHEN d.doc_id % 2 = 0 THEN d.doc_id % 10 / 10 END AS importance FROM documents d JOIN clean c ON c.doc_id = d.doc_id WHERE length(d.text) <= 65536 AND trim(d.text) <> '' AND d.doc_id % 7 NOT IN (0))"
MERGED = f"""{WRITES}, merged AS (SELECT scope, h, concat('n', lpad(CAST(min(doc_id) AS STRING), 8, '0')) AS id, greatest(max(importance), arg_min(coalesce(importance, 0.5), doc_id)) AS importance, string_agg(DISTINCT source, ',' ORDER BY source) AS tags, concat('e-n', lpad(CAST(min(doc_id) AS STRING), 8, '0')) AS episode_id FROM writes GROUP BY scope, h)"""


def ingest(spark, d):
    empty = fixtures.memories(spark, d).withColumn("content_hash", F.lit(None).cast("string")).limit(0)
    clients = fixtures.clients(spark, d).select("id", "name", "first_seen", "last_seen", (F.col("id") != "client0").alias("enabled"))
    return mutations.bulk_ingest(empty, episodes(spark, d).limit(0), clients, incoming(spark, d), NOW)


@query("M01", f"WITH {MERGED} SELECT id, scope, h AS content_hash, round(importance, 6) AS importance, tags, episode_id FROM merged")
def m01(spark, d):
    m = ingest(spark, d).memories
    return m.select("id", "scope", "content_hash", F.round("importance", 6).alias("importance"), F.array_join("tags", ",").alias("tags"), "episode_id")


@query("F09b", "SELECT concat('n', lpad(CAST(doc_id AS STRING), 8, '0')) AS id, CASE WHEN trim(text) = '' THEN 'text missing' WHEN length(text) > 65536 THEN 'text too long' ELSE 'client disabled' END AS reason FROM documents WHERE doc_id % 7 = 0 OR length(text) > 65536 OR trim(text) = ''")
def f09b(spark, d):
    """What an ingest refuses."""
    return ingest(spark, d).rejects.select("id", "reason")


@query("M02", f"""WITH {UNIQUE}, batch AS (SELECT source AS scope, {HASH.format('text')} AS h, max(CASE WHEN doc_id % 2 = 0 THEN doc_id % 10 / 10 END) AS importance, arg_min(CASE WHEN doc_id % 2 = 0 THEN doc_id % 10 / 10 ELSE 0.5 END, doc_id) AS given, min(doc_id) AS first, string_agg(DISTINCT lang, ',') AS lang FROM documents GROUP BY 1, 2)
SELECT coalesce(s.id, concat('n', lpad(CAST(b.first AS STRING), 8, '0'))) AS id, round(CASE WHEN s.id IS NULL THEN greatest(b.importance, b.given) WHEN b.h IS NULL THEN s.importance ELSE greatest(s.importance, b.importance) END, 6) AS importance,
CASE WHEN b.h IS NOT NULL THEN 'user' ELSE s.origin END AS origin FROM (SELECT * FROM state WHERE {LIVE}) s FULL JOIN batch b ON s.scope = b.scope AND s.content_hash = b.h
UNION ALL SELECT id, round(importance, 6), origin FROM state WHERE NOT ({LIVE})""", ("memories",))  # fmt: skip
def m02(spark, d):
    """All documents written again to the scopes they are in: live texts merge, those only dead rows hold come anew."""
    rows = hashed(incoming(spark, d)).select("id", "seq", "pos", "text", "source_client", "importance", "content_hash", F.col("tags")[0].alias("scope"), F.array("scope").alias("tags"))
    rows = rows.withColumns({"episode_id": F.lit(None).cast("string"), "redacted": F.lit(False), "origin": F.lit("user")})
    return mutations.dedupe_merge(unique_state(spark, d), rows, NOW).select("id", F.round("importance", 6).alias("importance"), "origin")


@query("M03", f"""WITH {UNIQUE} SELECT id, CASE WHEN deleted_at IS NOT NULL THEN 'not_found' WHEN valid_until IS NOT NULL THEN 'superseded' ELSE 'ok' END AS outcome,
CASE WHEN {LIVE} THEN concat('new text of ', id) ELSE text END AS text, round(CASE WHEN {LIVE} THEN 0.25 ELSE importance END, 6) AS importance FROM state""", ("memories",))  # fmt: skip
def m03(spark, d):
    state = unique_state(spark, d)
    patches = state.select("id", F.concat(F.lit("new text of "), "id").alias("text"), F.lit(None).cast("array<string>").alias("tags"), F.lit(0.25).alias("importance"))
    new, out = mutations.update(state, patches, NOW)
    return out.join(new.select("id", "text", F.round("importance", 6).alias("importance")), "id")


@query("M04", f"""WITH {UNIQUE}, e AS (SELECT episode_id AS id, bool_and(deleted_at IS NOT NULL) AS gone FROM state WHERE episode_id IS NOT NULL GROUP BY 1)
SELECT 'memory' AS kind, id, CASE WHEN deleted_at IS NOT NULL THEN 'ok' ELSE 'not_found' END AS restored, CASE WHEN deleted_at IS NULL THEN 'ok' ELSE 'not_found' END AS forgotten FROM state
UNION ALL SELECT 'episode', f.episode_id, CASE WHEN e.id IS NULL THEN CAST(f.deleted_at IS NOT NULL AS STRING) ELSE 'false' END, CASE WHEN e.id IS NULL THEN CAST(f.deleted_at IS NOT NULL AS STRING) ELSE 'true' END FROM fx_memories f LEFT JOIN e ON e.id = f.episode_id WHERE f.episode_id IS NOT NULL""", ("memories",))  # fmt: skip
def m04(spark, d):
    """Every row restored, and every row forgotten, each from the same state, and what becomes of the flags of episodes."""
    state, told = unique_state(spark, d), episodes(spark, d)
    _, back_told, back = mutations.restore_with_episodes(state, told, state.select("id"))
    _, gone_told, gone = mutations.forget_with_episodes(state, told, state.select("id"), NOW)
    rows = back.withColumnRenamed("outcome", "restored").join(gone.withColumnRenamed("outcome", "forgotten"), "id")
    flag = lambda df, name: df.select("id", F.col("forgotten").cast("string").alias(name))
    both = flag(back_told, "restored").join(flag(gone_told, "forgotten"), "id")
    return rows.select(F.lit("memory").alias("kind"), "id", "restored", "forgotten").unionByName(both.select(F.lit("episode").alias("kind"), "id", "restored", "forgotten"))


@query("M05", f"""WITH s AS (SELECT * FROM fx_memories WHERE {LIVE}),
one AS (SELECT id, seq, importance, valid_from, greatest(valid_from + 3600000, valid_from + 1) AS first, greatest(valid_from, greatest(valid_from + 3600000, valid_from + 1) + 1) AS second FROM s)
SELECT id, valid_from, valid_until, importance FROM (SELECT id, valid_from, first AS valid_until, importance FROM one UNION ALL SELECT concat(id, '-1'), first, second, 0.75 FROM one UNION ALL SELECT concat(id, '-2'), second, NULL, 0.75 FROM one
UNION ALL SELECT id, valid_from, valid_until, importance FROM fx_memories WHERE NOT ({LIVE}))""", ("memories",))  # fmt: skip
def m05(spark, d):
    """Two steps for every live row, the second with an earlier clock."""
    m = fixtures.memories(spark, d).withColumn("content_hash", F.lit(None).cast("string"))
    step = lambda k, at, imp: m.select("id", F.lit(k).alias("pos"), F.concat("id", F.lit(f"-{k}")).alias("new_id"), (F.col("seq") * 10 + k).alias("new_seq"), F.lit(f"step {k}").alias("text"), "source_client", F.lit(imp).cast("double").alias("importance"), F.array(F.lit("x")).alias("tags"), at.cast("long").alias("created_at"))
    changes = step(1, F.col("valid_from") + 3600000, 0.75).unionByName(step(2, F.col("valid_from"), None))
    return mutations.supersede(m, changes)[0].select("id", "valid_from", "valid_until", "importance")


@query("M06", "SELECT id, approved OR (seq % 2 = 0 AND deleted_at IS NULL) AS approved FROM fx_memories", ("memories",))
def m06(spark, d):
    m = fixtures.memories(spark, d)
    return mutations.approve(m, m.where("seq % 2 = 0").select("id"))[0].select("id", "approved")


@query("M07", f"{retrieval.LISTS.replace('coverage >= 0.2', 'coverage >= 0').replace('distance <= 1.0', 'distance <= 2').replace('strength >= 0.1', 'strength >= 0')}, named AS (SELECT DISTINCT id FROM scored) SELECT id, CASE WHEN id IN (SELECT id FROM named) THEN {NOW} ELSE deleted_at END AS deleted_at FROM fx_memories", retrieval.ALL)
def m07(spark, d):
    """Forgetting by query: what the queries find is soft-deleted."""
    m = fixtures.memories(spark, d)
    return mutations.forget(m, retrieval.r15(spark, d).select("id").distinct(), NOW)[0].select("id", "deleted_at")


@query("M08", "SELECT (SELECT count(*) FROM fx_memories) AS memories, (SELECT count(*) FROM fx_memories WHERE episode_id IS NOT NULL) AS episodes, (SELECT count(*) FROM fx_vectors) AS vectors", ("memories", "vectors"))
def m08(spark, d):
    return mutations.purge_all(fixtures.memories(spark, d), episodes(spark, d), fixtures.view(spark, d, "vectors"), confirm=True)[3]


@query("M09", "SELECT id, CASE WHEN superseded_by IN (SELECT id FROM fx_memories WHERE seq % 2 = 0) THEN NULL ELSE valid_until END AS valid_until, CASE WHEN superseded_by IN (SELECT id FROM fx_memories WHERE seq % 2 = 0) THEN NULL ELSE superseded_by END AS superseded_by FROM fx_memories WHERE seq % 2 = 1", ("memories",))
def m09(spark, d):
    m = fixtures.memories(spark, d)
    return mutations.purge(m, m.where("seq % 2 = 0").select("id")).select("id", "valid_until", "superseded_by")


def half_store(spark, d):
    """unique_state's rows of even seq. They are written where they were read; no text moves unless a caller asks for it."""
    m = stored(hashed(fixtures.memories(spark, d)).withColumn("_row", F.monotonically_increasing_id()), "state")
    first = mutations.first_in_batch(m.select("_row", "seq", "scope", "content_hash"), pos="seq").where("first and seq % 2 = 0")
    return m.join(few(stored(first.select("_row"), "half")), "_row", "left_semi").drop("_row")


def imported(spark, d):
    """The whole export taken into a store that has every other memory, with the episodes of those."""
    half, path = half_store(spark, d), exported(spark, d)
    told = episodes(spark, d).join(half.select(F.col("episode_id").alias("id")).distinct(), "id", "left_semi")
    order = F.substring("id", 2, 8).cast("long")
    return half, importing.import_archive(spark, path, archive.manifest(spark, path), half, told, NOW, order=order)


OUTCOMES = f"""{UNIQUE}, half AS (SELECT * FROM state WHERE seq % 2 = 0), arch AS (SELECT *, {HASH.format('text')} AS content_hash FROM fx_memories WHERE deleted_at IS NULL),
new AS (SELECT a.*, valid_until IS NULL AS alive, h.id IS NOT NULL AS taken FROM arch a LEFT JOIN (SELECT scope, content_hash, id FROM half WHERE {LIVE}) h ON h.scope = a.scope AND h.content_hash = a.content_hash WHERE a.id NOT IN (SELECT id FROM half)),
firsts AS (SELECT scope, content_hash, min(seq) AS first FROM new WHERE alive AND NOT taken GROUP BY 1, 2),
outcomes AS (SELECT 'memories' AS "table", n.id, CASE WHEN alive AND (taken OR seq > first) THEN 'duplicate_content' ELSE 'imported' END AS outcome FROM new n LEFT JOIN firsts f USING (scope, content_hash) UNION ALL SELECT 'memories', id, 'duplicate_id' FROM arch WHERE id IN (SELECT id FROM half))"""
TOLD = "SELECT 'episodes' AS \"table\", episode_id AS id, CASE WHEN episode_id IN (SELECT episode_id FROM half WHERE episode_id IS NOT NULL) THEN 'duplicate_id' ELSE 'imported' END AS outcome FROM fx_memories WHERE episode_id IS NOT NULL AND deleted_at IS NULL"


@query("M10", f"WITH {OUTCOMES} SELECT \"table\", id, outcome FROM outcomes UNION ALL {TOLD}", ("memories",))
def m10(spark, d):
    return imported(spark, d)[1].outcomes


@query("J11", f"WITH {OUTCOMES} SELECT id, 'import' AS origin, false AS approved, {NOW} AS created_at FROM outcomes WHERE outcome = 'imported'", ("memories",))
def j11(spark, d):
    """What an import adds: rows whose id and live text the store did not have, as unapproved imports."""
    half, got = imported(spark, d)
    return got.memories.join(half.select("id"), "id", "left_anti").select("id", "origin", "approved", "created_at")


@query("A09", f"WITH {OUTCOMES} SELECT \"table\", outcome, count(*) AS n FROM (SELECT \"table\", outcome FROM outcomes UNION ALL SELECT \"table\", outcome FROM ({TOLD})) GROUP BY 1, 2", ("memories",))
def a09(spark, d):
    return imported(spark, d)[1].counts


@query("M11", f"WITH {UNIQUE}, {CLEAN},\nhashes AS (SELECT d.doc_id, source, {HASH.format('c.text')} AS h FROM documents d JOIN clean c ON c.doc_id = d.doc_id), e AS (SELECT doc_id, source AS scope, h, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS k FROM hashes) SELECT 0 AS would_refuse, count(*) FILTER (k > 1 OR t.id IS NOT NULL) AS would_skip, count(*) FILTER (k = 1 AND t.id IS NULL) AS would_import FROM e LEFT JOIN (SELECT * FROM state WHERE seq % 2 = 0 AND {LIVE}) t ON t.scope = e.scope AND t.content_hash = e.h", ("memories",))
def m11(spark, d):
    entries = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("pos"), "text", F.col("source").alias("scope"))
    return mutations.preview_import(half_store(spark, d), entries)[0]


@query("M12", f"WITH p AS ({SQL['S09']}) SELECT count(DISTINCT {HASH.format('entry')}) AS n_memories, count(*) AS n_episodes, 'import' AS origin FROM p")
def m12(spark, d):
    """Lines pasted from conversations, committed into one scope."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    rows = imports.as_incoming(imports.parse_pasted(c), "paste", F.lit("pasted"), ["pasted-import"], 0)
    empty = fixtures.memories(spark, d).withColumn("content_hash", F.lit(None).cast("string")).limit(0)
    out = mutations.bulk_ingest(empty, episodes(spark, d).limit(0), fixtures.clients(spark, d), rows, NOW, origin="import")
    return out.memories.agg(F.count("*").alias("n_memories"), F.max("origin").alias("origin")).join(out.episodes.agg(F.count("*").alias("n_episodes")))


@query("M13", "SELECT coalesce(c.id, s.id) AS id, coalesce(c.first_seen, s.first) AS first_seen, greatest(c.last_seen, s.last) AS last_seen, coalesce(enabled, true) AS enabled FROM (SELECT id, epoch_us(first_seen) // 1000 AS first_seen, epoch_us(last_seen) // 1000 AS last_seen, enabled FROM fx_clients) c FULL JOIN (SELECT source_client AS id, min(epoch_us(event_time) // 1000) AS first, max(epoch_us(event_time) // 1000) AS last FROM fx_audit GROUP BY 1) s ON c.id = s.id", ("clients", "audit"))
def m13(spark, d):
    seen = fixtures.audit(spark, d).select(F.col("source_client").alias("id"), F.lit("renamed").alias("name"), "ts")
    return mutations.upsert_clients(fixtures.clients(spark, d), seen).select("id", "first_seen", "last_seen", "enabled")


@query("E01", SQL["X18"])
def e01(spark, d):
    """Every document embedded by the default provider."""
    v = embedding.embed(spark.read.parquet(f"{d}/documents.parquet"), None, "hash-32", 32)
    return v.select("doc_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("first"), F.round(F.col("embedding")[31].cast("double"), 4).alias("last"))


@query("E02", "SELECT vec_id, CASE WHEN vec_id % 4 = 1 THEN 'dimension' WHEN vec_id % 4 = 2 THEN 'not finite' WHEN vec_id % 4 = 3 THEN 'zero' END AS flaw FROM embeddings")
def e02(spark, d):
    e, k = F.col("embedding"), F.col("vec_id") % 4
    odd = F.when(k == 1, F.slice(e, 1, 63)).when(k == 2, F.transform(e, lambda x: F.lit(float("nan")).cast("float"))).when(k == 3, F.transform(e, lambda x: (x * 0).cast("float"))).otherwise(e)
    good, bad = embedding.check(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", odd.alias("embedding")), 64)
    return good.select("vec_id", F.lit(None).cast("string").alias("flaw")).unionByName(bad.select("vec_id", "flaw"))


@query("E03", f"SELECT count(*) AS embedded, 0 AS failed, 0 AS remaining FROM fx_memories WHERE {LIVE} AND seq NOT IN (SELECT seq FROM fx_vectors)", ("memories", "vectors"))
def e03(spark, d):
    v = fixtures.view(spark, d, "vectors").withColumn("model_id", F.lit("hash-64"))
    return embedding.index_step(fixtures.memories(spark, d), v, None, "hash-64", 64)[2]


@query("E04", f"SELECT seq, 'new-32' AS model_id, 32 AS dim FROM fx_memories WHERE {LIVE} UNION ALL SELECT seq, model_id, dim FROM fx_vectors", ("memories", "vectors"))
def e04(spark, d):
    """A provider switch: the new model's space fills with all live memories, the old space stays."""
    v = fixtures.view(spark, d, "vectors")
    new = embedding.index_step(fixtures.memories(spark, d), v, None, "new-32", 32)[0]
    return new.select("seq", "model_id", "dim").unionByName(v.select("seq", "model_id", "dim"))


@query("E05", "SELECT seq, seq % 5 <> 1 AS live FROM fx_vectors WHERE seq % 5 <> 0", ("vectors",))
def e05(spark, d):
    v = fixtures.view(spark, d, "vectors").withColumn("live", F.lit(True))
    rest = embedding.delete_vectors(v, v.where("seq % 5 = 0"))
    marked = embedding.set_live(rest, v.where("seq % 5 = 1"), False)
    return embedding.fetch_vectors(marked, v).select("seq", "live")


def _lengths(texts):
    return [[float(len(t)), 1.0] for t in texts]


@query("K01", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS first, 'lengths' AS model_id, 2 AS dim FROM documents")
def k01(spark, d):
    """A provider of the user's own."""
    v = embedding.embed(spark.read.parquet(f"{d}/documents.parquet"), _lengths, "lengths", 2)
    return v.select("doc_id", F.col("embedding")[0].cast("double").alias("first"), "model_id", "dim")


def arriving(spark, d, table):
    """A table as a stream, be it a file or a folder of files: a stream's path must be a folder or a pattern, and this pattern fits either."""
    return spark.readStream.schema(spark.read.parquet(f"{d}/{table}.parquet").schema).parquet(f"{d}/{table}.parque[t]")


def events_stream(spark, d):
    """The events table as a stream of calls."""
    e = arriving(spark, d, "events")
    return spark.sql(fixtures.VIEWS["audit"].replace("{events}", "{e}"), e=e).withColumn("event_time", F.col("event_time").cast("timestamp"))


def drained(spark, stream, mode):
    """What a stream's batches leave: all rows in append mode, the last result in complete mode. A batch has a folder of its
    own, so one that is run again replaces what it wrote."""
    path = scratch(spark)
    folder = (lambda k: f"{path}/out/last") if mode == "complete" else (lambda k: f"{path}/out/{k:09d}")
    spark.createDataFrame([], stream.schema).write.parquet(folder(0))  # for a stream without rows
    jobs.drain(stream, lambda df, k: df.write.mode("overwrite").parquet(folder(k)), f"{path}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{path}/out/*")


@query("T01", f"WITH {CLEAN} SELECT t.lang AS scope, {HASH.format('c.text')} AS content_hash, count(*) > 0 AS kept FROM texts t JOIN clean c ON c.line = t.line GROUP BY 1, 2")
def t01(spark, d):
    """Documents arriving as a stream, redacted, hashed, without near repeats, and merged into a kept state: one live row for each text."""
    rows, path = incoming(spark, d, arriving(spark, d, "documents")), scratch(spark)
    kept = KeptState(spark, f"{path}/state", 16)
    jobs.remember(rows.withColumns({"episode_id": F.lit(None).cast("string"), "origin": F.lit("user")}), kept, NOW, f"{path}/checkpoint")
    return kept.read().where(is_live()).select("scope", "content_hash", F.lit(True).alias("kept"))


@query("T01b", f"WITH {MERGED} SELECT id, scope, h AS content_hash, round(importance, 6) AS importance, tags, episode_id FROM merged")
def t01b(spark, d):
    """Documents arriving in four files, each a batch of its own, redacted and merged into a kept state: the same rows as one
    bulk ingest leaves, and repeats come as late as they like."""
    path, docs = scratch(spark), spark.read.parquet(f"{d}/documents.parquet")
    writes, last = incoming(spark, d), docs.agg(F.max("doc_id")).first()[0] or 0
    for k in range(4):  # one after the other, for files are taken by their time
        writes.where(F.floor(F.col("seq") * 4 / (last + 1)) == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    kept = KeptState(spark, f"{path}/state", 16)
    clients = fixtures.clients(spark, d).select("id", "name", "first_seen", "last_seen", (F.col("id") != "client0").alias("enabled"))
    jobs.ingest(stream, kept, clients, NOW, f"{path}/checkpoint")
    return kept.read().select("id", "scope", "content_hash", F.round("importance", 6).alias("importance"), F.array_join("tags", ",").alias("tags"), "episode_id")


@query("T02", f"SELECT seq, 'hash-32' AS model_id FROM fx_memories WHERE {LIVE}", ("memories",))
def t02(spark, d):
    """The index fed by a stream of documents."""
    m = stored(fixtures.memories(spark, d), "memories")
    stream = arriving(spark, d, "documents").select("doc_id")
    path = scratch(spark)
    none = spark.createDataFrame([], "model_id string, dim int, seq long, embedding array<float>, scope string, live boolean, created_at long")
    none.write.parquet(f"{path}/vectors")

    def step(df, k):
        known = spark.read.schema(none.schema).parquet(f"{path}/vectors")
        new = embedding.index_step(m.join(df.select(F.col("doc_id").alias("seq")), "seq", "left_semi"), known, None, "hash-32", 32)[0]
        new.write.mode("append").parquet(f"{path}/vectors")

    jobs.drain(stream, step, f"{path}/checkpoint")
    return spark.read.schema(none.schema).parquet(f"{path}/vectors").select("seq", "model_id")


@query("T03", f"SELECT CAST(date_trunc('day', event_time) AS TIMESTAMP) AS start, source_client, count(*) FILTER ({READ}) AS reads, count(*) FILTER (NOT {READ}) AS writes FROM fx_audit WHERE {ACTIVE} GROUP BY 1, 2", ("audit",))
def t03(spark, d):
    w = drained(spark, jobs.activity_windows(events_stream(spark, d)), "complete")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "source_client", "reads", "writes")


@query("T04", "SELECT CAST(date_trunc('day', event_time) AS TIMESTAMP) AS start, action AS kind, CASE WHEN refused THEN 'blocked' ELSE 'redacted' END AS action, count(*) AS n FROM fx_audit GROUP BY 1, 2, 3", ("audit",))
def t04(spark, d):
    f = events_stream(spark, d).select("event_time", F.col("action").alias("kind"), F.when(F.col("refused"), "blocked").otherwise("redacted").alias("action"))
    return drained(spark, jobs.findings_windows(f), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "action", "n")


@query("T05", "SELECT a.id, source_client, coalesce(enabled, true) AS allowed FROM fx_audit a LEFT JOIN fx_clients c ON c.id = source_client", ("audit", "clients"))
def t05(spark, d):
    yes, no = jobs.gated(events_stream(spark, d), fixtures.clients(spark, d))
    cols = lambda df, ok: drained(spark, df.select("id", "source_client"), "append").withColumn("allowed", F.lit(ok))
    return cols(yes, True).unionByName(cols(no, False))


@query("S12", "SELECT id, memory_id, action FROM fx_audit WHERE action IN ('remember', 'update_memory') AND memory_id IN ('m00000007', 'm00000011', 'm00000013')", ("audit",))
def s12(spark, d):
    """What a subscriber of three memories hears."""
    changes = events_stream(spark, d).where("action in ('remember', 'update_memory')").select("id", "memory_id", "action")
    return drained(spark, jobs.change_feed(changes, ["m00000007", "m00000011", "m00000013"]), "append")


LIVE_OF = LIVE.replace("deleted_at", "s.deleted_at").replace("valid_until", "s.valid_until")


@query("S12b", f"""WITH {UNIQUE} SELECT 2 AS version, 'update' AS kind, 'update' AS action, id AS memory_id, 'importance 0.25' AS what FROM state s WHERE seq % 5 = 1 AND {LIVE_OF}
UNION ALL SELECT 3, 'update', 'forget', id, 'deleted' FROM state WHERE seq % 5 = 2 AND deleted_at IS NULL
UNION ALL SELECT 4, 'update', 'supersede', id, concat('superseded by ', id, '-1') FROM state s WHERE seq % 5 = 3 AND {LIVE_OF}
UNION ALL SELECT 4, 'insert', 'supersede', concat(id, '-1'), 'new' FROM state s WHERE seq % 5 = 3 AND {LIVE_OF}""", ("memories",))
def s12b(spark, d):
    """The feed of a kept state: what updates, soft deletes and supersessions changed, row by row."""
    path, m = scratch(spark), unique_state(spark, d)
    kept = KeptState(spark, f"{path}/state", 16)
    kept.load(m)
    some = lambda k: m.where(F.col("seq") % 5 == k)
    kept.update(some(1).select("id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("tags"), F.lit(0.25).alias("importance")), NOW + 1)
    kept.forget(some(2).select("id"), NOW + 2)
    kept.supersede(some(3).select("id", F.lit(1).alias("pos"), F.concat("id", F.lit("-1")).alias("new_id"), (F.col("seq") + 10**9).alias("new_seq"), F.concat(F.lit("after "), "id").alias("text"), "source_client", F.lit(None).cast("double").alias("importance"), F.lit(None).cast("array<string>").alias("tags"), F.lit(NOW + 3).alias("created_at")))
    feed = jobs.change_feed(kept.changes(stream=True).where("action <> 'load'"))
    what = F.when(F.col("kind") == "insert", "new").when(F.col("action") == "update", F.concat(F.lit("importance "), F.col("after.importance").cast("string")))
    what = what.when(F.col("before.deleted_at").isNull() & F.col("after.deleted_at").isNotNull(), "deleted").when(F.col("before.superseded_by").isNull(), F.concat(F.lit("superseded by "), F.col("after.superseded_by")))
    return drained(spark, feed.select(F.col("version").cast("int").alias("version"), "kind", "action", "memory_id", what.alias("what")), "append")

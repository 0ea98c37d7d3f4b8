"""Queries on scans, filters, joins, aggregates, ranks and sets (S, F, J, A, W, U)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.operators import context, embedding, filters, mutations, search, stats
from tidepool.operators.knn import knn
from tidepool.plans.registry import query, scratch, stored
from tidepool.sources import archive, fixtures, imports, tables
from tidepool.sources.fixtures import DAY, NOW

LIVE = "deleted_at IS NULL AND valid_until IS NULL"
MID = 1704067200000 + 3 * DAY


def tag_text(c="tags"):
    return F.array_join(c, ",").alias("tags")


TAGS = "concat(least(tag1, tag2), ',', greatest(tag1, tag2)) AS tags"


@query("S01", f"SELECT id, seq, scope, importance, created_at, last_accessed, superseded_by, redacted, origin, {TAGS} FROM fx_memories", ("memories",))
def s01(spark, d):
    m = fixtures.memories(spark, d)
    path = scratch(spark)
    m.withColumn("content_hash", F.lit(None).cast("string")).write.parquet(f"{path}/memories")
    return tables.read(spark, path, "memories").select("id", "seq", "scope", "importance", "created_at", "last_accessed", "superseded_by", "redacted", "origin", tag_text())


@query("S02", f"SELECT id, text FROM fx_memories WHERE {LIVE}", ("memories",))
def s02(spark, d):
    return filters.live(fixtures.memories(spark, d)).select("id", "text")


def episodes(spark, d):
    """An episode for each memory that names one, forgotten if the memory was deleted."""
    m = fixtures.memories(spark, d).where("episode_id is not null")
    return m.select(F.col("episode_id").alias("id"), F.col("text").alias("content"), "scope", "source_client", F.to_json(F.struct("source_client")).alias("metadata"), "created_at", F.col("deleted_at").isNotNull().alias("forgotten"))


def exported(spark, d):
    path = scratch(spark)
    archive.export(fixtures.memories(spark, d), episodes(spark, d), path)
    return path


@query("S03", "SELECT id, text, scope, importance, created_at AS \"createdAt\", valid_until AS \"validUntil\" FROM fx_memories WHERE deleted_at IS NULL", ("memories",))
def s03(spark, d):
    return spark.read.schema("id string, text string, scope string, importance double, createdAt long, validUntil long").json(f"{exported(spark, d)}/memories")


@query("S04", "SELECT 'memories' AS part, count(*) AS n_rows, min(1) AS version FROM fx_memories WHERE deleted_at IS NULL UNION ALL SELECT 'episodes', count(*), min(1) FROM fx_memories WHERE deleted_at IS NULL AND episode_id IS NOT NULL", ("memories",))
def s04(spark, d):
    m = archive.manifest(spark, exported(spark, d))
    return m.groupBy(F.substring_index("file", "/", 1).alias("part")).agg(F.sum("rows").alias("n_rows"), F.min("version").alias("version"))


@query("S05", "SELECT DISTINCT part, status FROM (SELECT 'memories' AS part, 'mismatch' AS status FROM fx_memories UNION ALL SELECT 'episodes', 'ok' FROM fx_memories)", ("memories",))
def s05(spark, d):
    """An archive whose memory files were all changed after the manifest was made."""
    path = exported(spark, d)
    found = stored(archive.manifest(spark, path))
    tampered = found.withColumn("sha256", F.when(F.col("file").startswith("memories"), F.reverse("sha256")).otherwise(F.col("sha256")))
    return archive.verify(tampered, archive.files(spark, path)).select(F.substring_index("file", "/", 1).alias("part"), "status").distinct()


def odd_lines(spark, d):
    """Lines of which some have wrong types, no id, or are no JSON."""
    m = fixtures.memories(spark, d)
    k = F.col("seq") % 8
    imp = F.when(k == 0, F.concat(F.lit('"'), F.col("importance").cast("string"), F.lit('"'))).when(k == 1, F.lit("null")).otherwise(F.col("importance").cast("string"))
    line = F.concat(F.lit('{"id":"'), "id", F.lit('","text":'), F.to_json(F.array("scope")).substr(F.lit(2), F.length(F.to_json(F.array("scope"))) - 2), F.lit(',"importance":'), imp, F.lit(',"tags":["a",1,"b"],"validFrom":'), F.col("valid_from").cast("string"), F.lit("}"))
    line = F.when(k == 2, F.concat(F.lit("{"), line)).when(k == 3, F.lit('{"text":"no id"}')).when(k == 4, F.lit("[1]")).otherwise(line)
    return m.select(F.concat(F.lit("f"), (F.col("seq") % 10).cast("string")).alias("file"), line.alias("line"), "seq")


@query("S06", """SELECT id, scope AS text, CASE WHEN seq % 8 < 2 THEN 0.5 ELSE importance END AS importance, 'a,b' AS tags, valid_from, 'default' AS scope, CAST(NULL AS STRING) AS flaw FROM fx_memories WHERE seq % 8 NOT IN (2, 3, 4)
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, CASE seq % 8 WHEN 2 THEN 'not JSON' WHEN 3 THEN 'id missing' ELSE 'not an object' END FROM fx_memories WHERE seq % 8 IN (2, 3, 4)""", ("memories",))  # fmt: skip
def s06(spark, d):
    good, bad = archive.read_memories(odd_lines(spark, d).select("file", "line"))
    return good.select("id", "text", "importance", tag_text(), "valid_from", "scope").unionByName(bad.select("flaw"), allowMissingColumns=True)


@query("S07", "SELECT episode_id AS id, text AS content, scope, source_client, created_at FROM fx_memories WHERE episode_id IS NOT NULL AND deleted_at IS NULL", ("memories",))
def s07(spark, d):
    good, _ = archive.read_episodes(archive.lines(spark, exported(spark, d), "episodes"))
    return good.select("id", "content", "scope", "source_client", "created_at")


@query("S08", "SELECT concat('f', CAST(seq % 10 AS STRING)) AS file, 'too many lines' AS reason FROM fx_memories GROUP BY seq % 10 HAVING count(*) > 20", ("memories",))
def s08(spark, d):
    text = odd_lines(spark, d)
    found = text.groupBy("file").agg(F.sum(F.octet_length("line")).alias("bytes"))
    return archive.over_caps(found, text, most_lines=20)


@query("S09", r"""WITH lines AS (SELECT conv_id * 1000 + turn AS id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) AS line_no FROM conversations),
entries AS (SELECT id, line_no, substr(trim(regexp_replace(trim(regexp_replace(line, '[\t\x{a0}\x{feff}]', ' ', 'g')), '^(?:[-*\x{2022}]|[0-9]+[.)])\s+', '')), 1, 2000) AS entry FROM lines)
SELECT * FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY line_no) AS pos, entry FROM entries WHERE regexp_matches(entry, '[\p{L}\p{N}]')) WHERE pos <= 500""")
def s09(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return imports.parse_pasted(c).select("id", F.col("pos").cast("long").alias("pos"), "entry")


@query("S10", "SELECT doc_id AS file, 'user' AS about, substr(text, 1, 2000) AS entry FROM documents WHERE doc_id % 3 > 0 AND trim(text) <> '' UNION ALL SELECT doc_id, 'model', source FROM documents WHERE doc_id % 3 = 2")
def s10(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    data = F.when(F.col("doc_id") % 3 == 2, F.create_map(F.lit("about_user_message"), "text", F.lit("about_model_message"), "source")).otherwise(F.create_map(F.lit("about_user_message"), "text"))
    node = lambda marked: F.struct(F.struct(F.struct(marked.alias("is_user_system_message"), data.alias("user_context_message_data")).alias("metadata")).alias("message"))
    mapping = F.create_map(F.lit("root"), node(F.lit(False)), F.lit("sys"), node(F.col("doc_id") % 3 > 0), F.lit("later"), node(F.lit(False)))
    return imports.custom_instructions(docs.select(F.col("doc_id").alias("file"), F.to_json(F.array(F.struct(mapping.alias("mapping")))).alias("content")))


@query("S11", "SELECT CAST(event_time AS DATE) AS day, count(*) AS n, count(*) FILTER (refused) AS refused FROM fx_audit GROUP BY 1", ("audit",))
def s11(spark, d):
    path = scratch(spark)
    tables.append(fixtures.audit(spark, d), path, "audit")
    return spark.read.parquet(f"{path}/audit").groupBy("day").agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"))


@query("F01", f"SELECT id, created_at FROM fx_memories WHERE {LIVE} AND scope = 'src1' AND created_at >= {MID - 3 * DAY} AND created_at < {MID + DAY}", ("memories",))
def f01(spark, d):
    return filters.list_memories(fixtures.memories(spark, d), scope="src1", since=MID - 3 * DAY, until=MID + DAY).select("id", "created_at")


@query("F02", f"SELECT id FROM fx_memories WHERE {LIVE} AND tag1 = 'en' AND tag2 = 'b3'", ("memories",))
def f02(spark, d):
    return filters.list_memories(fixtures.memories(spark, d), tags=["en", "b3"]).select("id")


@query("F03", "SELECT id FROM fx_memories WHERE origin = 'user' OR approved", ("memories",))
def f03(spark, d):
    return fixtures.memories(spark, d).where(filters.eligible()).select("id")


@query("F04", f"SELECT id, valid_until FROM fx_memories WHERE deleted_at IS NULL AND valid_from <= {MID} AND (valid_until IS NULL OR valid_until > {MID})", ("memories",))
def f04(spark, d):
    return filters.as_of(fixtures.memories(spark, d), MID).select("id", "valid_until")


INSTANTS = [MID, MID - 3600000, MID - DAY, MID - 7 * DAY, MID - 30 * DAY, NOW]


@query("F05", f"SELECT instant, id FROM fx_memories JOIN (SELECT unnest([{', '.join(map(str, INSTANTS))}]) AS instant) ON deleted_at IS NULL AND valid_from <= instant AND (valid_until IS NULL OR valid_until > instant)", ("memories",))
def f05(spark, d):
    return filters.timeline(fixtures.memories(spark, d), INSTANTS).select(F.col("at").alias("instant"), "id")


EVENT_MS = "SELECT DISTINCT epoch_us(ts) // 1000 AS at FROM events"


def event_instants(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))


@query("F05b", f"SELECT a.at AS at, m.scope, count(*) AS n FROM ({EVENT_MS}) a JOIN fx_memories m ON deleted_at IS NULL AND valid_from <= a.at AND (valid_until IS NULL OR valid_until > a.at) GROUP BY 1, 2", ("memories",))
def f05b(spark, d):
    """How many memories of each scope held at the instant of every event."""
    return filters.timeline_sizes(fixtures.memories(spark, d), event_instants(spark, d))


@query("F05c", f"SELECT a.at AS at, m.id FROM ({EVENT_MS}) a JOIN fx_memories m ON deleted_at IS NULL AND valid_from <= a.at AND valid_until > a.at", ("memories",))
def f05c(spark, d):
    """Which of the memories that were superseded later held at the instant of every event."""
    m = fixtures.memories(spark, d).where("valid_until is not null")
    return filters.timeline_at(m, event_instants(spark, d), ["id"])


@query("F06", f"SELECT id, scope FROM fx_memories WHERE {LIVE} AND seq IN (SELECT item_id FROM benchmark)", ("memories",))
def f06(spark, d):
    ids = spark.read.parquet(f"{d}/benchmark.parquet").select(F.concat(F.lit("m"), F.lpad(F.col("item_id").cast("string"), 8, "0")).alias("id"))
    return filters.by_ids(fixtures.memories(spark, d), ids).select("id", "scope")


@query("F07", f"""WITH p AS (SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS k FROM fx_memories WHERE created_at < {MID}),
c AS (SELECT translate(rtrim(to_base64(encode(concat(CAST(created_at AS STRING), ':', id))), '='), '+/', '-_') AS next_cursor FROM p WHERE k = 50)
SELECT id, created_at, CASE WHEN (SELECT count(*) FROM p) > 50 THEN (SELECT next_cursor FROM c) END AS next_cursor FROM p WHERE k <= 50""", ("memories",))  # fmt: skip
def f07(spark, d):
    import base64

    cursor = base64.urlsafe_b64encode(f"{MID}:".encode()).decode().rstrip("=")
    return filters.page(fixtures.memories(spark, d), 50, cursor).select("id", "created_at", "next_cursor")


@query("F09", "SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'text missing' WHEN length(text) > 65536 THEN 'text too long' WHEN doc_id % 9 = 0 THEN 'too many tags' WHEN doc_id % 10 = 0 THEN 'importance outside [0, 1]' END AS flaw FROM documents")
def f09(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 9 == 0, F.transform(F.sequence(F.lit(1), F.lit(33)), lambda x: x.cast("string"))).alias("tags"), F.when(F.col("doc_id") % 10 == 0, 1.5).otherwise(0.5).alias("importance"))
    good, bad = filters.validate(rows)
    return good.select("doc_id").withColumn("flaw", F.lit(None).cast("string")).unionByName(bad.select("doc_id", "flaw"))


@query("F10", "SELECT episode_id AS id, source_client FROM fx_memories WHERE episode_id IS NOT NULL AND deleted_at IS NULL", ("memories",))
def f10(spark, d):
    return filters.visible_episodes(episodes(spark, d)).select("id", "source_client")


@query("F11", "SELECT id, action, memory_id FROM fx_audit WHERE action = 'recall' AND NOT refused AND (epoch_us(event_time) // 1000) BETWEEN 1704067200000 AND 1706745600000", ("audit",))
def f11(spark, d):
    return filters.list_audit(fixtures.audit(spark, d), action="recall", since=1704067200000, until=NOW, refused=False).select("id", "action", "memory_id")


@query("F13", "SELECT 'client' AS what, id AS name, (epoch_us(last_seen) // 1000) AS n FROM fx_clients UNION ALL SELECT DISTINCT 'space', model_id, dim FROM fx_vectors", ("clients", "vectors"))
def f13(spark, d):
    c = filters.list_clients(fixtures.clients(spark, d)).select(F.lit("client").alias("what"), F.col("id").alias("name"), F.col("last_seen").alias("n"))
    return c.unionByName(filters.vector_spaces(fixtures.view(spark, d, "vectors")).select(F.lit("space").alias("what"), F.col("model_id").alias("name"), F.col("dim").cast("long").alias("n")))


@query("J03", f"SELECT id, {TAGS} FROM fx_memories WHERE {LIVE}", ("memories",))
def j03(spark, d):
    live = filters.live(fixtures.memories(spark, d))
    tags = live.select("id", F.explode("tags").alias("tag"))
    return live.select("id").join(tags, "id", "left").groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("tags")).select("id", tag_text())


@query("J05", f"SELECT seq FROM fx_memories WHERE {LIVE} AND seq NOT IN (SELECT seq FROM fx_vectors)", ("memories", "vectors"))
def j05(spark, d):
    return embedding.backlog(fixtures.memories(spark, d), fixtures.view(spark, d, "vectors")).select("seq")


@query("J06", f"SELECT count(*) FILTER (NOT alive AND was) AS demoted, count(*) FILTER (alive AND NOT was) AS promoted FROM (SELECT v.seq % 3 > 0 AS was, coalesce({LIVE}, false) AND m.seq IS NOT NULL AS alive FROM fx_vectors v LEFT JOIN fx_memories m ON m.seq = v.seq)", ("memories", "vectors"))
def j06(spark, d):
    v = fixtures.view(spark, d, "vectors").withColumn("live", F.col("seq") % 3 > 0)
    return embedding.sync_liveness(v, fixtures.memories(spark, d))[1]


ACTIVE = "NOT refused AND action IN ('recall', 'get_context', 'list_memories', 'export', 'remember', 'update_memory', 'forget', 'restore', 'import')"
READ = "action IN ('recall', 'get_context', 'list_memories', 'export')"


@query("J07", f"SELECT coalesce(c.id, a.source_client) AS id, c.id IS NOT NULL AS known, coalesce(enabled, true) AS enabled, coalesce(reads, 0) AS reads, coalesce(writes, 0) AS writes FROM fx_clients c FULL JOIN (SELECT source_client, count(*) FILTER ({READ}) AS reads, count(*) FILTER (NOT {READ}) AS writes FROM fx_audit WHERE {ACTIVE} GROUP BY 1) a ON c.id = a.source_client", ("clients", "audit"))
def j07(spark, d):
    return stats.clients_with_activity(fixtures.clients(spark, d), stats.client_activity(fixtures.audit(spark, d)))


@query("J08", "SELECT id, CASE WHEN seq % 2 = 0 THEN episode_id END AS episode_id, CASE WHEN superseded_by IN (SELECT id FROM fx_memories) THEN superseded_by END AS superseded_by FROM fx_memories", ("memories",))
def j08(spark, d):
    m = fixtures.memories(spark, d)
    half = episodes(spark, d).where(F.substring("id", 2, 8).cast("long") % 2 == 0)
    return mutations.linked(m, half, m.limit(0)).select("id", "episode_id", "superseded_by")


NEAREST = """SELECT query_id, seq, distance, rank FROM (SELECT q.query_id, v.seq, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS distance,
row_number() OVER (PARTITION BY query_id ORDER BY round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9), v.seq) AS rank
FROM fx_queries q, fx_vectors v {where}) WHERE rank <= {k}"""


def shown(near):
    return near.select("query_id", "seq", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("J09", NEAREST.format(where="WHERE q.embedding IS NOT NULL", k=10), ("queries", "vectors"))
def j09(spark, d):
    return shown(knn(fixtures.view(spark, d, "queries"), fixtures.view(spark, d, "vectors"), 10))


@query("J02", NEAREST.format(where=f"JOIN fx_memories m ON m.seq = v.seq WHERE q.embedding IS NOT NULL AND {LIVE}", k=10), ("queries", "vectors", "memories"))
def j02(spark, d):
    live = filters.live(fixtures.memories(spark, d)).select("seq")
    return shown(knn(fixtures.view(spark, d, "queries"), fixtures.view(spark, d, "vectors").join(live, "seq", "left_semi"), 10))


@query("J10", "SELECT a.id, source_client, NOT coalesce(enabled, true) AS refused FROM fx_audit a LEFT JOIN fx_clients c ON c.id = source_client", ("audit", "clients"))
def j10(spark, d):
    return mutations.gate(fixtures.audit(spark, d), fixtures.clients(spark, d)).select("id", "source_client", "refused")


@query("A01", f"""SELECT count(*) FILTER ({LIVE}) AS live, count(*) FILTER (deleted_at IS NOT NULL) AS deleted, count(*) FILTER (deleted_at IS NULL AND valid_until IS NOT NULL) AS superseded, count(*) FILTER ({LIVE} AND redacted) AS redacted,
min(created_at) FILTER ({LIVE}) AS oldest, max(created_at) FILTER ({LIVE}) AS newest, count(*) FILTER ({LIVE} AND created_at >= {NOW - 30 * DAY}) AS recent FROM fx_memories""", ("memories",))  # fmt: skip
def a01(spark, d):
    return stats.store_stats(fixtures.memories(spark, d), NOW)


@query("A02", f"SELECT scope, count(*) AS n FROM fx_memories WHERE {LIVE} GROUP BY scope ORDER BY n DESC, scope LIMIT 10", ("memories",))
def a02(spark, d):
    return stats.top_scopes(fixtures.memories(spark, d))


@query("A03", f"SELECT tag, count(*) AS n FROM (SELECT unnest([tag1, tag2]) AS tag FROM fx_memories WHERE {LIVE}) GROUP BY tag ORDER BY n DESC, tag LIMIT 10", ("memories",))
def a03(spark, d):
    return stats.top_tags(fixtures.memories(spark, d))


@query("A04", f"SELECT source_client, count(*) FILTER ({READ}) AS reads, count(*) FILTER (NOT {READ}) AS writes, count(*) AS total FROM fx_audit WHERE {ACTIVE} AND (epoch_us(event_time) // 1000) >= {MID} GROUP BY 1", ("audit",))
def a04(spark, d):
    return stats.client_activity(fixtures.audit(spark, d), MID)


@query("A07", f"SELECT count(*) AS n FROM fx_memories WHERE {LIVE}", ("memories",))
def a07(spark, d):
    return stats.live_count(fixtures.memories(spark, d))


@query("A08", "SELECT m.id, access_count + coalesce(n, 0) AS access_count, greatest(last_accessed, last) AS last_accessed FROM fx_memories m LEFT JOIN (SELECT memory_id, count(*) AS n, max((epoch_us(event_time) // 1000)) AS last FROM fx_audit WHERE action = 'recall' GROUP BY 1) a ON a.memory_id = m.id", ("memories", "audit"))
def a08(spark, d):
    return stats.touch(fixtures.memories(spark, d), fixtures.audit(spark, d).where("action = 'recall'")).select("id", "access_count", "last_accessed")


@query("W01", "SELECT query_id, branch, id, CAST(rank AS BIGINT) AS rank FROM (SELECT source_client AS query_id, action AS branch, memory_id AS id, row_number() OVER (PARTITION BY source_client, action ORDER BY min(id)) AS rank FROM fx_audit GROUP BY 1, 2, 3)", ("audit",))
def w01(spark, d):
    """Each client's memories by action, in the order of their first call."""
    calls = fixtures.audit(spark, d).groupBy(F.col("source_client").alias("query_id"), F.col("action").alias("branch"), F.col("memory_id").alias("id")).agg(F.min("id").alias("first"))
    return calls.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "branch").orderBy("first"))).select("query_id", "branch", "id", F.col("rank").cast("long").alias("rank"))


@query("W05", f"SELECT scope, id, CAST(rank AS BIGINT) AS rank FROM (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id DESC) AS rank FROM fx_memories WHERE {LIVE}) WHERE rank <= 5", ("memories",))
def w05(spark, d):
    return search.top(filters.live(fixtures.memories(spark, d)), 5, F.desc("created_at"), F.desc("id"), by="scope").select("scope", "id", F.col("rank").cast("long").alias("rank"))


@query("W06", f"SELECT scope, id FROM (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY importance DESC, created_at DESC, id DESC) AS k FROM fx_memories WHERE {LIVE}) WHERE k <= 200", ("memories",))
def w06(spark, d):
    return context.importance_pool(filters.live(fixtures.memories(spark, d))).select("scope", "id")


@query("W07", "SELECT doc_id, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) = 1 AS first FROM documents")
def w07(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias("scope"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return mutations.first_in_batch(docs, pos="doc_id").select("doc_id", "first")


@query("U01", f"""SELECT DISTINCT scope, id FROM (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY importance DESC, created_at DESC, id DESC) AS a, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id DESC) AS b
FROM fx_memories WHERE {LIVE}) WHERE a <= 5 OR b <= 5""", ("memories",))  # fmt: skip
def u01(spark, d):
    live = filters.live(fixtures.memories(spark, d))
    return context.recency_pool(live, 5).unionByName(context.importance_pool(live, 5)).select("scope", "id").dropDuplicates(["scope", "id"])


@query("U03", "SELECT lang, source, string_agg(DISTINCT concat('b', CAST(doc_id % 6 AS STRING)), ',' ORDER BY concat('b', CAST(doc_id % 6 AS STRING))) AS tags FROM documents GROUP BY lang, source")
def u03(spark, d):
    m = fixtures.memories(spark, d).select(F.col("scope").alias("source"), F.array_except("tags", F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es"))).alias("tags"), F.array_except("tags", F.array(*[F.lit(f"b{k}") for k in range(6)])).alias("lang"))
    sets = m.groupBy(F.get("lang", F.lit(0)).alias("lang"), "source").agg(F.flatten(F.collect_set("tags")).alias("tags"))
    return sets.select("lang", "source", tag_text(F.array_sort(F.array_union("tags", "tags"))))

"""Queries of the numbered operators, and the SQL that states what they return."""

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import bpe, compaction, embdup, exact, interaction, licenses, merkle, packing, quality, secrets, simhash, topk, toxicity
from tidepool.llm.common import shared_dir, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(found.fp).alias("fingerprint"), "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir), stored=True).drop("h")


def op5_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive by language, are merged, and come back from the newest version."""
    store = compaction.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.append(table(spark, sf_dir, "documents"), arrival="lang")
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("text_length"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple:
    """Learned from docs and those of their labels that are not held out."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, *toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, pattern)
    return bpe.decode(encoded, path, pattern).drop("decoded")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come into a new index in two loads."""
    index = exact.DigestIndex(spark, f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}")
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"), index)
    index.close()  # what is returned reads stored tables
    return found.select("doc_id", "keep_id", "group_size", "kept", merkle.hexed(F.col("digest")).alias("text_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_simhash, op3_license_scan, op4_quality, op5_compaction, op6_top_k, op7_toxicity, op8_byte_bpe, op9_embedding_dedup, op10_packing, op11_filter_interaction, op12_exact_dedup, op13_merkle_manifest)}


ROUND_TRIP = "SELECT doc_id, lang, source, n_chars, length(text) AS text_length, sha256(text) AS text_sha256 FROM documents"
BEST = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

#: Orders by recursion, every document judged anew in each.
INTERACTION = r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS f FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
prefixes AS (SELECT '' AS p, 0 AS step, '' AS x UNION ALL SELECT concat(p, letters.x), step + 1, letters.x FROM prefixes JOIN letters ON NOT contains(p, letters.x)),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
judged AS (SELECT part, p, step, x, n, good, toxic, contains(f, x) AS failing, f = x AS alone, length(translate(f, left(p, step - 1), '')) < length(f) AS gone FROM prefixes JOIN cells ON step > 0),
metrics AS (SELECT part, p, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed, coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost FROM judged GROUP BY ALL),
orders AS (SELECT m.*, o.p AS filter_order FROM metrics m JOIN prefixes o ON o.step = 5 AND left(o.p, m.step) = m.p)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM orders"""
EQUAL = """WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""
#: crc32 bit by bit; nodes level by level; every document climbs from its leaf, its proof a string of siblings.
CRC = "xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS STRING), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295))"
FIELD = "coalesce(concat(strlen(CAST({0} AS STRING)), ':', CAST({0} AS STRING)), '-')"
MERKLE = f"""WITH RECURSIVE leaves AS (SELECT doc_id, coalesce(concat('=', lang), '') AS tree, sha256(concat({', '.join(FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))})) AS leaf,
sha256(concat({', '.join(FIELD.format(c) for c in ('doc_id', 'source', 'lang', '(n_chars + 1)', 'text'))})) AS altered, n_chars IS NOT NULL AND {CRC} % 7 = 0 AS touched FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (SELECT tree, 0 AS height, idx, n, leaf AS h FROM placed UNION ALL SELECT tree, height + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, height, idx // 2, n),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
uppers AS (SELECT 0 AS height, idx, n, subroot AS h FROM subroots UNION ALL SELECT height + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM uppers WHERE n > 1 GROUP BY height, idx // 2, n),
every AS (SELECT tree, height, idx, n, h FROM nodes UNION ALL SELECT NULL, height, idx, n, h FROM uppers),
climbs AS (SELECT doc_id, tree, 0 AS height, idx, n, CASE WHEN touched THEN altered ELSE leaf END AS h, '' AS proof FROM placed
UNION ALL SELECT c.doc_id, CASE WHEN c.n > 1 THEN c.tree END, CASE WHEN c.n > 1 THEN c.height + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.idx // 2 ELSE r.idx END, CASE WHEN c.n > 1 THEN (c.n + 1) // 2 ELSE r.n END,
CASE WHEN c.n = 1 THEN c.h WHEN c.idx % 2 = 0 THEN sha256(concat(c.h, s.h)) ELSE sha256(concat(s.h, c.h)) END, concat(c.proof, s.h)
FROM climbs c LEFT JOIN every s ON c.n > 1 AND s.tree IS NOT DISTINCT FROM c.tree AND s.height = c.height AND s.idx = xor(c.idx, 1) LEFT JOIN subroots r ON c.n = 1 AND r.tree = c.tree WHERE c.n > 1 OR c.tree IS NOT NULL)
SELECT p.doc_id, p.leaf, s.subroot, u.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = u.h AS verified FROM placed p JOIN subroots s ON s.tree = p.tree JOIN climbs c ON c.doc_id = p.doc_id AND c.tree IS NULL AND c.n = 1 JOIN uppers u ON u.n = 1"""


def oracle_sql() -> dict[str, str]:
    """The other operators are beyond SQL; tests hold them against brute force, round trips and held-out rows."""
    return {"op5_compaction": ROUND_TRIP, "op6_top_k": BEST, "op11_filter_interaction": INTERACTION, "op12_exact_dedup": EQUAL, "op13_merkle_manifest": MERKLE}

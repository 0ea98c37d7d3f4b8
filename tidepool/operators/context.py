"""Context blocks: the pool for blank queries, budget packing, and the block of every query."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import score, text
from tidepool.operators import search
from tidepool.operators.filters import eligible, has_all_tags, live
from tidepool.operators.textindex import TextIndex

BUDGET = 800


def importance_pool(memories: DataFrame, size: int = 200, by: str = "scope") -> DataFrame:
    """The most important rows of each scope, newer ones first among equals."""
    return search.top(memories, size, F.desc("importance"), F.desc("created_at"), F.desc("id"), by=by, rank="place")


def recency_pool(memories: DataFrame, size: int = 200, by: str = "scope") -> DataFrame:
    return search.top(memories, size, F.desc("created_at"), F.desc("id"), by=by, rank="place")


def blank_pool(queries: DataFrame, memories: DataFrame, now: int, tags: list[str] | None = None, exclude_unapproved: bool = True, size: int = 200, limit: int = 50) -> DataFrame:
    """For queries (query_id, scope) without words: newest and most important rows of the scope, or of all scopes for a query
    without one, re-ranked without relevance."""
    rows = live(memories) if not tags else live(memories).where(has_all_tags(tags))
    rows = rows.where(eligible()) if exclude_unapproved else rows

    def pool(of: DataFrame, by: str) -> DataFrame:
        both = recency_pool(of, size, by).unionByName(importance_pool(of, size, by)).drop("place").dropDuplicates(["id"])
        return both.withColumn("parts", score.parts(F.lit(0.0), now)).withColumn("score", F.round(score.blend(F.col("parts")), 9))

    scoped = queries.where("scope is not null").select("query_id", "scope").join(pool(rows, "scope"), "scope")
    everywhere = pool(rows.withColumn("_all", F.lit(0)), "_all").drop("_all")  # twice `size` rows at most
    open_ones = queries.where("scope is null").select("query_id").join(F.broadcast(everywhere))
    return search.top(scoped.unionByName(open_ones), limit, F.desc("score"), F.col("id"))


def budget(c: Column | None) -> Column:
    """Whole tokens; 800 where missing, not finite, or below 1."""
    c = F.lit(None).cast("double") if c is None else c.cast("double")
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (c >= 1)
    return F.when(ok, F.floor(c)).otherwise(F.lit(BUDGET)).cast("long")


def pack(entries: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """(query_id, text, ids, n_kept, tokens, truncated) from entries (query_id, rank, id, line): lines are taken in order of rank
    if the block with them stays within the budget, and skipped otherwise; later, shorter ones may still fit.

    budgets (query_id, token_budget). A query's entries (at most 50 from a search) are folded inside one row, without Python.
    """
    lines = entries.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "line"))).alias("lines"))
    lines = lines.withColumn("token_budget", F.lit(None).cast("double")) if budgets is None else lines.join(budgets.select("query_id", "token_budget"), "query_id", "left")
    lines = lines.withColumn("_most", budget(F.col("token_budget")))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("ids"), F.lit(False).alias("truncated"))

    def step(acc: Column, x: Column) -> Column:
        longer = F.when(acc["text"] == "", x["line"]).otherwise(F.concat(acc["text"], F.lit("\n"), x["line"]))
        fits = text.token_estimate(longer) <= F.col("_most")
        return F.struct(F.when(fits, longer).otherwise(acc["text"]).alias("text"), F.when(fits, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"), (acc["truncated"] | ~fits).alias("truncated"))

    out = lines.withColumn("b", F.aggregate("lines", start, step))
    return out.select("query_id", "b.text", "b.ids", F.size("b.ids").alias("n_kept"), text.token_estimate(F.col("b.text")).alias("tokens"), "b.truncated")


def entry_lines(rows: DataFrame) -> DataFrame:
    unreviewed = (F.col("origin") == "import") & ~F.coalesce(F.col("approved"), F.lit(False))
    return rows.withColumn("line", text.entry_line(F.col("id"), F.col("scope"), F.col("created_at"), unreviewed, F.col("text")))


def get_context(queries: DataFrame, memories: DataFrame, index: DataFrame | TextIndex, stats: DataFrame | None, vectors: DataFrame | None, now: int, exclude_unapproved: bool = True, **options) -> DataFrame:
    """The block of every query (query_id, query, embedding, scope, token_budget), an empty one where nothing was found, with
    `degraded` and its reason. Blank queries get their scope's pool, or that of all scopes, and are never degraded."""
    words = F.size(F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit(text.TOKEN), F.lit(0))) > 0
    strict = {"candidate_limit": 200, "limit": 50, "min_relevance": 0.15, "min_coverage": 0.4, "max_distance": 0.15} | options
    hits = search.hybrid_search(queries.where(words), memories, index, stats, vectors, now, exclude_unapproved=exclude_unapproved, **strict)
    cols = ["query_id", "rank", "id", "scope", "created_at", "origin", "approved", "text"]
    blank = blank_pool(queries.where(~words), memories, now, exclude_unapproved=exclude_unapproved).select(cols)
    entries = entry_lines(hits.withColumn("rank", F.col("pick")).select(cols).unionByName(blank))
    packed = pack(entries.select("query_id", "rank", "id", "line"), queries.select("query_id", "token_budget") if "token_budget" in queries.columns else None)
    every = queries.select("query_id").join(packed, "query_id", "left").join(search.degraded(queries.where(words), vectors), "query_id", "left")
    none = {"text": F.lit(""), "ids": F.array().cast("array<string>"), "n_kept": F.lit(0), "tokens": F.lit(0), "truncated": F.lit(False), "degraded": F.lit(False)}
    return every.withColumns({c: F.coalesce(c, x) for c, x in none.items()})

"""Entries from pasted text and from a vendor's conversation export."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST, MOST = 2000, 500


def parse_pasted(rows: DataFrame, id: str = "doc_id", column: str = "text", most: int | None = MOST) -> DataFrame:
    """(id, pos, entry): a line is an entry without its bullet or number; lines without a letter or digit are none."""
    line = F.posexplode(F.split(F.col(column), "\r\n|\r|\n"))
    lines = rows.select(F.col(id).alias("id"), line.alias("line_no", "line"))
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace("line", r"[\t\u00a0\ufeff]", " ")), r"^(?:[-*\u2022]|[0-9]+[.)])\s+", ""))
    entries = lines.select("id", "line_no", F.substring(bare, 1, LONGEST).alias("entry")).where(F.col("entry").rlike(r"[\p{L}\p{N}]"))
    pos = F.row_number().over(Window.partitionBy("id").orderBy("line_no"))
    numbered = entries.withColumn("pos", pos)
    return (numbered if most is None else numbered.where(F.col("pos") <= most)).select("id", "pos", "entry")


EXPORT = "array<struct<mapping:map<string,struct<message:struct<metadata:struct<is_user_system_message:boolean,user_context_message_data:map<string,string>>>>>>>"


def custom_instructions(files: DataFrame, column: str = "content") -> DataFrame:
    """(file, about, entry) of a vendor's exports (file, content): the first message marked as the user's system message, its
    named fields or else its first two strings; each cut to 2000 characters."""
    nodes = files.select("file", F.posexplode(F.from_json(F.col(column), EXPORT)).alias("conv", "c")).select("file", "conv", F.posexplode(F.map_values("c.mapping")).alias("node", "n"))
    data = nodes.select("file", "conv", "node", F.col("n.message.metadata.is_user_system_message").alias("marked"), F.col("n.message.metadata.user_context_message_data").alias("data")).where("marked and data is not null")
    first = data.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("conv", "node"))).where("k = 1")
    named = lambda key: F.nullif(F.trim(F.col("data")[key]), F.lit(""))
    rest = F.filter(F.map_values(F.map_filter("data", lambda k, v: ~k.isin("about_user_message", "about_model_message"))), lambda v: F.length(F.trim(v)) > 0)
    user, model = F.coalesce(named("about_user_message"), F.get(rest, F.lit(0))), F.coalesce(named("about_model_message"), F.get(rest, F.when(named("about_user_message").isNull(), 1).otherwise(0)))
    pairs: Column = F.array(F.struct(F.lit("user").alias("about"), user.alias("entry")), F.struct(F.lit("model").alias("about"), model.alias("entry")))
    return first.select("file", F.explode(pairs).alias("p")).select("file", "p.about", F.substring("p.entry", 1, LONGEST).alias("entry")).where("entry is not null")


def as_incoming(entries: DataFrame, client: str, scope: Column, tags: list[str], seq_from: int) -> DataFrame:
    """Entries (id, pos, entry) as writes for bulk_ingest, in the order of id and pos, however many an id has."""
    step = entries.agg(F.greatest(F.max("pos"), F.lit(MOST)).alias("_step"))  # one row: an id's numbers end before the next one's begin
    entries = entries.join(F.broadcast(step))
    key = F.concat_ws("/", F.lit(client), F.col("id").cast("string"), F.col("pos").cast("string"))
    return entries.select(
        F.concat(F.lit("i-"), F.substring(F.sha2(key, 256), 1, 32)).alias("id"),
        (F.lit(seq_from) + F.col("id") * F.col("_step") + F.col("pos")).cast("long").alias("seq"),
        (F.col("id") * F.col("_step") + F.col("pos")).cast("long").alias("pos"),
        F.col("entry").alias("text"),
        scope.alias("scope"),
        F.lit(client).alias("source_client"),
        F.lit(None).cast("double").alias("importance"),
        F.array(*map(F.lit, tags)).alias("tags"),
    )

"""A text index that is kept: immutable segments of posting blocks, added to batch by batch, and a search that skips blocks.

An index is a folder of Parquet tables, each parted by `segment`, and those that are looked up by term also by `bucket`, a
hash of the term, so that a search reads the buckets of its terms alone:

- `blocks` (term, part, block, n, max_tf, min_dl, posts): the postings of a term by falling impact, some at a time. A block's
  largest tf and smallest length bound what any text in it can score, whatever the mean length comes to be. A term of very
  many texts is cut into parts by a hash of seq, so no group grows with the table.
- `docs` (seq, dl, has_text, toks, terms): the folded tokens of every text in order and its terms, so that no search tokenises a text.
- `terms` (term, df) and `totals`: counts to add up over the segments; replaced texts are subtracted.
- `gone` (seq): texts that a segment replaces or removes; what earlier segments hold of them counts no more.

`add` tokenises its batch alone. `merge` joins neighbouring segments of similar size into one. A segment counts once its name
is published, by one atomic creation of an empty file, so a job that dies leaves an index that is whole; one writer at a time.
A name holds the range of additions that a segment covers, and a merged one hides those inside its range; `vacuum` deletes them.
"""

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.functions import text
from tidepool.sources.stored import stored

K1, B = 1.2, 0.75
SLACK = 1e-6  # scores are rounded to 9 decimals: a block this near to the bound stays
TABLES = {
    "blocks": "term STRING, part INT, block INT, n INT, max_tf BIGINT, min_dl INT, posts ARRAY<STRUCT<seq: BIGINT, tf: BIGINT, dl: INT>>, segment STRING, bucket INT",
    "docs": "seq BIGINT, dl INT, has_text BOOLEAN, toks ARRAY<STRING>, terms ARRAY<STRING>, segment STRING",
    "terms": "term STRING, df BIGINT, segment STRING, bucket INT",
    "totals": "n_docs BIGINT, n_texts BIGINT, n_tokens BIGINT, segment STRING",
    "gone": "seq BIGINT, segment STRING",
}


class Segment(NamedTuple):
    first: int
    last: int
    has_gone: bool
    name: str


def impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term of weight one adds to a text's score; grows with tf, falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _run_of(sizes: list[int], run: int, ratio: int) -> tuple[int, int] | None:
    """The first stretch of at least `run` neighbours of similar size."""
    for k in range(len(sizes)):
        end = k
        while end < len(sizes) and max(sizes[k : end + 1]) <= ratio * max(1, min(sizes[k : end + 1])):
            end += 1
        if end - k >= run:
            return k, end
    return None


def idf(df: Column, n_docs: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, block: int = 128, part: int = 1 << 16):
        """Opens the index at path, or begins one; buckets holds for a new one, an existing one keeps its own. A block holds
        `block` postings, a part of a term about `part`."""
        self.spark, self.path, self.block, self.part = spark, path, block, part
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = [n for n in self._names("") if n.startswith("published-")]
        self.buckets = int(known[0].split("-")[1]) if known else buckets
        self._published = f"published-{self.buckets}"
        self._fs.mkdirs(self._path(f"{path}/{self._published}"))

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}" if folder else self.path)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def segments(self) -> list[Segment]:
        """Those that count, oldest first."""
        split = [(n.split("-"), n) for n in self._names(self._published)]
        found, live = sorted((Segment(int(p[0]), int(p[1]), p[2] == "g", n) for p, n in split), key=lambda s: (s.first, -s.last)), []
        for s in found:
            if not live or s.last > live[-1].last:
                live.append(s)
        return live

    def _read(self, table: str, segments: list[Segment] | None = None) -> DataFrame:
        """A table's rows of segments (all that count, if None), with `age`, the last addition of their segment."""
        names = [s.name for s in (self.segments() if segments is None else segments)]
        folder = f"{self.path}/{table}"
        if not names or not self._fs.exists(self._path(folder)):
            rows = self.spark.createDataFrame([], TABLES[table])
        else:
            rows = self.spark.read.schema(TABLES[table]).parquet(folder).where(F.col("segment").isin(names))
        return rows.withColumn("age", F.split("segment", "-")[1].cast("int"))

    def _kept(self, rows: DataFrame) -> DataFrame:
        """rows (seq, age, ...) without those that a later segment replaced or removed."""
        if not any(s.has_gone for s in self.segments()):
            return rows
        gone = self._read("gone").groupBy(F.col("seq").alias("gone")).agg(F.max("age").alias("until"))
        return rows.join(gone, (F.col("seq") == F.col("gone")) & (F.col("age") < F.col("until")), "left_anti")

    def docs(self) -> DataFrame:
        """(seq, dl, has_text, toks, terms) of every text, dead rows' too."""
        return self._kept(self._read("docs")).drop("segment", "age")

    def postings(self) -> DataFrame:
        """(term, seq, tf, dl)."""
        each = self._read("blocks").select("term", "age", F.explode("posts").alias("p")).select("term", "age", "p.*")
        return self._kept(each).select("term", "seq", "tf", "dl")

    def stats(self) -> DataFrame:
        """One row: the number of texts and their mean length in tokens."""
        t = self._read("totals").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_texts", "n_tokens")])
        return t.select("n_docs", F.try_divide("n_tokens", "n_texts").alias("avgdl"))

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    # -- writing

    def add(self, rows: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Takes rows (seq, text) in, seqs different; those that the index knows are replaced. removed (seq): texts to take out."""
        rows = self.spark.createDataFrame([], "seq long, text string") if rows is None else rows
        before = self.segments()
        split = rows.select("seq", F.col("text").isNotNull().alias("has_text"), *[F.coalesce(f(F.col("text")), F.array().cast("array<string>")).alias(n) for f, n in ((text.tokens, "toks"), (text.text_terms, "terms"))])
        new = stored(split.select("seq", F.size("toks").alias("dl"), "has_text", "toks", "terms"), "tokens")
        old = None
        if before:
            named = new.select("seq") if removed is None else new.select("seq").unionByName(removed.select("seq")).distinct()
            old = stored(self.docs().join(named, "seq", "left_semi").select("seq", "has_text", "toks"), "replaced")
        counted = lambda df, sign: df.select(F.explode(F.array_distinct("toks")).alias("term"), F.lit(sign).alias("df"))
        summed = lambda df, sign: df.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((F.lit(sign), "n_docs"), (F.when(F.col("has_text"), sign), "n_texts"), (sign * F.size("toks"), "n_tokens"))])
        terms, totals = counted(new, 1), summed(new, 1)
        if old is not None:
            terms, totals = terms.unionByName(counted(old, -1)), totals.unionByName(summed(old, -1)).groupBy().sum().toDF("n_docs", "n_texts", "n_tokens")
        at = before[-1].last + 1 if before else 0
        self._publish(at, at, new, terms.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), totals, None if old is None else old.select("seq"))

    def _publish(self, first: int, last: int, docs: DataFrame, terms: DataFrame, totals: DataFrame, gone: DataFrame | None) -> None:
        if gone is not None and gone.isEmpty():
            gone = None
        name = f"{first:06d}-{last:06d}-{'n' if gone is None else 'g'}-{uuid.uuid4().hex[:12]}"

        def write(rows: DataFrame, table: str, *by: str) -> None:
            rows.withColumn("segment", F.lit(name)).write.mode("append").option("compression", "zstd").partitionBy("segment", *by).parquet(f"{self.path}/{table}")

        write(docs.select("seq", "dl", "has_text", "toks", "terms").repartitionByRange("seq").sortWithinPartitions("seq"), "docs")
        write(terms.select("term", "df", self.bucket(F.col("term")).alias("bucket")).repartition("bucket"), "terms", "bucket")
        write(totals, "totals")
        write(self._blocks(docs), "blocks", "bucket")
        if gone is not None:
            write(gone.select("seq").distinct(), "gone")
        if not self._fs.createNewFile(self._path(f"{self.path}/{self._published}/{name}")):
            raise ValueError(f"another writer published {name}")

    def _blocks(self, docs: DataFrame) -> DataFrame:
        each = docs.select("seq", "dl", F.explode(text.term_counts(F.col("toks"))).alias("p"))
        posts = stored(each.select("p.term", "seq", "p.tf", "dl"), "postings")
        large = stored(posts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") > self.part), "large-terms")
        mean = docs.agg(F.coalesce(F.avg("dl"), F.lit(1.0)).alias("mean"))  # for the order only
        parts = posts.join(large, "term", "left").join(F.broadcast(mean)).withColumn("part", F.pmod(F.xxhash64("seq"), F.ceil(F.coalesce("df", F.lit(1)) / self.part)).cast("int"))
        order = Window.partitionBy("term", "part").orderBy(F.desc(impact(F.col("tf"), F.col("dl"), F.col("mean"))), "seq")
        cut = parts.withColumn("block", F.floor((F.row_number().over(order) - 1) / self.block).cast("int"))
        blocks = cut.groupBy("term", "part", "block").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.sort_array(F.collect_list(F.struct("seq", "tf", "dl"))).alias("posts"))
        return blocks.withColumn("bucket", self.bucket(F.col("term"))).repartition("bucket", "part").sortWithinPartitions("bucket", "term", "part", "block")

    def merge(self, run: int = 4, ratio: int = 4) -> int:
        """Merges runs of at least `run` neighbouring segments, each at most `ratio` times as large as the smallest, until
        there is none; how many segments were merged away."""
        merged = 0
        while True:
            live = self.segments()
            sizes = {r["segment"]: r["n"] for r in self._read("docs").groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row for each segment
            due = _run_of([sizes.get(s.name, 0) for s in live], run, ratio)
            if due is None:
                return merged
            some = live[due[0] : due[1]]
            docs = stored(self._kept(self._read("docs", some)).drop("segment", "age"), "merged-docs")
            terms = self._read("terms", some).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            totals = self._read("totals", some).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_texts", "n_tokens")])
            gone = self._read("gone", some).select("seq") if due[0] and any(s.has_gone for s in some) else None  # nothing older is left to strike out
            self._publish(some[0].first, some[-1].last, docs, terms, totals, gone)
            merged += len(some) - 1

    def vacuum(self) -> int:
        """Deletes segments that merged ones hide; how many. Searches begun before a merge may still read them."""
        live = {s.name for s in self.segments()}
        hidden = [n for n in self._names(self._published) if n not in live]
        for name in hidden:
            self._fs.delete(self._path(f"{self.path}/{self._published}/{name}"), False)
            for table in TABLES:
                self._fs.delete(self._path(f"{self.path}/{table}/segment={name}"), True)
        return len(hidden)

    # -- searching

    def weights(self, terms: DataFrame) -> DataFrame:
        """(term, idf, avgdl) of the distinct terms given that the index holds."""
        asked = terms.withColumn("bucket", self.bucket(F.col("term")))
        df = self._read("terms").join(asked, ["bucket", "term"], "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return df.join(F.broadcast(self.stats())).select("term", idf(F.col("df"), F.col("n_docs")).alias("idf"), "avgdl")  # stats is one row

    def top_k(self, terms: DataFrame, allowed: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """((query_id, seq, bm25) of every text that may be among a query's k best, scored in full; the blocks told
        apart: (query_id, term, segment, part, block, n, kept)).

        terms (query_id, term, times): single tokens. allowed (query_id, seq) or (seq, scope) with terms (query_id, ..., only):
        the texts that a query may find; a query with `only` sees that scope. Works in three steps. The blocks of largest
        impact of each term are read until they hold k texts; the sums over them are lower bounds of scores, the kth of them
        (of allowed texts) is a bound that the k best reach. A block is kept if its own bound with the other terms' largest
        reaches it, and if its term is not one of those that together fall short of it. Texts of kept blocks, and no others,
        are scored, by their postings of the asked terms, and those that reach the bound are returned.
        """
        asked = terms.groupBy("query_id", "term", *(["only"] if "only" in terms.columns else [])).agg(F.sum("times").alias("times"))
        weighted = stored(asked.join(self.weights(asked.select("term").distinct()), "term").withColumn("w", F.col("idf") * F.col("times")), "weights")
        wanted = weighted.select("term").distinct().withColumn("bucket", self.bucket(F.col("term")))
        own = stored(self._read("blocks").join(wanted, ["bucket", "term"], "left_semi").drop("bucket"), "asked-blocks")  # each once, for all queries
        ident = ["term", "segment", "part", "block"]
        heads = own.select(*ident, "n", "max_tf", "min_dl").join(weighted, "term").withColumn("bound", F.col("w") * impact(F.col("max_tf"), F.col("min_dl"), F.col("avgdl")))
        heads = stored(heads.drop("max_tf", "min_dl", "idf", "times"), "heads")

        by_term = heads.groupBy("query_id", "term").agg(F.max("bound").alias("most"))
        query = Window.partitionBy("query_id").orderBy("most", "term")  # terms of one query
        by_term = by_term.withColumn("upto", F.sum("most").over(query)).withColumn("all", F.sum("most").over(Window.partitionBy("query_id")))

        first = F.sum("n").over(Window.partitionBy("query_id", "term").orderBy(F.desc("bound"), *ident[1:]).rowsBetween(Window.unboundedPreceding, -1))
        lead = heads.withColumn("before", F.coalesce(first, F.lit(0))).where(F.col("before") < k).drop("before")
        partial = self._found(lead, own, ident, allowed).groupBy("query_id", "seq").agg(F.sum("part_score").alias("s"))
        kth = stored(partial.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "seq"))).where(F.col("r") == k).select("query_id", F.col("s").alias("least")), "kth")

        told = heads.join(by_term, ["query_id", "term"]).join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
        kept = (F.col("bound") + F.col("all") - F.col("most") >= F.col("least")) & (F.col("upto") >= F.col("least"))
        told = stored(told.withColumn("kept", kept), "told")
        some = own.join(told.where("kept").select(*ident).distinct(), ident, "left_semi")  # a block that several queries keep is opened once

        # each posting of the texts in those blocks once; the terms that queries ask meet them where the text lies, and a pair is one sum
        opened = lambda blocks: self._kept(blocks.select("term", F.split("segment", "-")[1].cast("int").alias("age"), F.explode("posts").alias("p")).select("term", "age", "p.*"))
        posts = opened(own).join(opened(some).select("seq").distinct(), "seq", "left_semi").join(allowed, "seq").repartition("seq")
        scored = posts.join(F.broadcast(weighted.drop("idf", "times")), "term")  # terms of the queries: few
        scored = scored.where("only is null or only = scope") if "only" in weighted.columns else scored
        total = scored.groupBy("query_id", "seq").agg(F.round(F.sum(F.col("w") * impact(F.col("tf"), F.col("dl"), F.col("avgdl"))), 9).alias("bm25"))
        best = total.join(F.broadcast(kth), "query_id", "left").where(F.col("bm25") >= F.coalesce("least", F.lit(0.0)) - SLACK)  # a row for each query
        return best.select("query_id", "seq", "bm25"), told.select("query_id", *ident, "n", "kept")

    def _found(self, chosen: DataFrame, own: DataFrame, ident: list[str], allowed: DataFrame) -> DataFrame:
        """(query_id, seq, part_score): the postings of the blocks chosen that their queries may find."""
        posts = chosen.join(own.select(*ident, "posts"), ident).withColumn("age", F.split("segment", "-")[1].cast("int"))
        each = posts.select("query_id", "age", "w", "avgdl", *(["only"] if "only" in chosen.columns else []), F.explode("posts").alias("p"))
        each = each.select("query_id", "age", *(["only"] if "only" in chosen.columns else []), "p.seq", (F.col("w") * impact(F.col("p.tf"), F.col("p.dl"), F.col("avgdl"))).alias("part_score"))
        each = self._kept(each).join(allowed, "seq")
        return (each.where("only is null or only = scope") if "only" in chosen.columns else each).select("query_id", "seq", "part_score")

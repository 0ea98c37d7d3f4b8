"""Filter interaction audit: what each filter removes in every order of the filters, alone, and on average over the orders.

A document's outcome under any order depends only on its mask, the set of filters that it fails, so the documents are read
once and reduced to cells: counts by part and mask. The orders are a recursive CTE: a prefix of filters is extended by every
letter it has not used, joined with the masks that occur, and carries the bits it has applied; each level of the recursion
holds one step's outcome for each mask (kept, removed by this filter, failing it but removed before). The outcomes are then
weighted with the cells of every part. Masks number 2 to the number of filters at most, so the recursion is small whatever
the table; parts meet it afterwards, distributed, for there may be many.

Filters: A few words; B few different words among them; C many capital letters; D odd symbols; E the text of a smaller
doc_id again, table-wide. Words are maximal runs of other characters than space and 0x09 to 0x0D.

Null text counts as empty: it fails A alone, and E if an empty text has a smaller doc_id. A null doc_id has no label, repeats
nothing and is repeated by nothing. Repeated rows with the same doc_id do not fail E by one another. A null part is the empty
string. Several labels of a doc_id count as the best (or most toxic) of them. An empty table gives no rows. Texts of any
length are read whole, in pieces. Further columns are ignored.
"""

import hashlib
import re
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import save

LETTERS = "ABCDE"
#: The bounds of the filters.
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
CAPITALS, ODD, SPACE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", re.compile(rb"[ \t-\r]")


def words(raw: bytes, piece: int = 1 << 20):
    """Lists of the words of raw, in pieces of about that many bytes."""
    at = 0
    while at < len(raw):
        end = SPACE.search(raw, at + piece)
        end = end.start() if end else len(raw)
        yield raw[at:end].split()
        at = end


def own_mask(text: str) -> int:
    """Bits of the filters A to D that the text fails."""
    raw, n, seen = text.encode("utf-8", "surrogatepass"), 0, set()
    for some in words(raw):
        n += len(some)
        seen.update(some)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    odd = len(raw.translate(None, ODD)) < len(raw)
    return (n < FEW_WORDS) | (100 * len(seen) < DISTINCT_PERCENT * n) << 1 | (100 * capitals > CAPITAL_PERCENT * len(text)) << 2 | odd << 3


def facts(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, own, digest) of every row."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            masks = pa.array([own_mask(t) for t in texts], pa.int32())
            marks = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), masks, marks], names=["doc_id", "part", "own", "digest"])

    return docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), "text").mapInArrow(run, "doc_id long, part string, own int, digest binary")


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters that they fail."""
    rows = save(facts(docs, part), "facts")
    shared = save(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "shared")
    told = save(labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "labels")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    mask = F.col("own").bitwiseOR(F.shiftleft(again, 4)).alias("mask")
    joined = rows.join(shared, "digest", "left").select("doc_id", "part", mask).join(told, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


#: Each level holds, for every prefix of that many filters and every mask, what the prefix's last filter does to the mask.
ORDERS = """WITH RECURSIVE steps (prefix, step, letter, applied, mask, kept, removed, redundant, alone) AS (
  SELECT '', 0, '', 0, mask, 1, 0, 0, 0 FROM {masks}
  UNION ALL
  SELECT concat(s.prefix, l.letter), s.step + 1, l.letter, s.applied | l.bit, m.mask,
    IF(m.mask & (s.applied | l.bit) = 0, 1, 0), IF(m.mask & s.applied = 0 AND m.mask & l.bit <> 0, 1, 0), IF(m.mask & s.applied <> 0 AND m.mask & l.bit <> 0, 1, 0), IF(m.mask = l.bit, 1, 0)
  FROM steps s JOIN {letters} l ON s.applied & l.bit = 0 JOIN {masks} m ON m.mask = s.mask
) SELECT * FROM steps WHERE step > 0"""


def effects(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(prefix, step, letter, mask, kept, removed, redundant, alone) for every order's every prefix and every mask given."""
    spark = masks.sparkSession
    bits = spark.createDataFrame([(x, 1 << k) for k, x in enumerate(letters)], "letter string, bit int")
    return spark.sql(ORDERS, masks=masks.select("mask").distinct(), letters=bits)


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, every
    order of the filters and every step of it."""
    counted = save(cells(docs, labels, part), "cells")
    outcome = save(effects(counted), "effects")
    total = lambda what, of, name: F.sum(F.col(of) * what).cast("long").alias(name)
    by_prefix = (
        counted.join(outcome, "mask")
        .groupBy("part", "prefix", "step", "letter")
        .agg(total(F.col("kept"), "n", "kept"), total(F.col("removed"), "n", "removed"), total(F.col("redundant"), "n", "redundant"), total(F.col("alone"), "n", "unique_fails"), total(F.col("removed"), "good", "good_lost"), total(F.col("removed"), "toxic", "toxic_lost"))
    )
    orders = docs.sparkSession.createDataFrame([("".join(p), k, "".join(p[:k])) for p in permutations(LETTERS) for k in range(1, len(p) + 1)], "filter_order string, step int, prefix string")
    rows = save(by_prefix.drop("step").join(F.broadcast(orders), "prefix"), "by-order")  # 600 rows, whatever the tables
    shapley = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "letter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

"""Texts that NFKC leaves as they are stay in the JVM, terms are counted in their row, and pairs of blocks are spread."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidepool.functions import text
from tidepool.operators import lists, search


def test_only_texts_that_nfkc_changes_leave_the_jvm(spark):
    rnd = random.Random(4)
    some = [chr(cp) for cp in range(0x80, 0x30000) if not 0xD800 <= cp < 0xE000 and unicodedata.category(chr(cp)) not in ("Cn", "Co")]
    marks = [c for c in some if unicodedata.combining(c)][:300] + [chr(0x1161), chr(0x11A8), chr(0x09BE), chr(0x0CC2)]
    texts = ["".join(rnd.choice([rnd.choice(some), rnd.choice(marks), chr(0x1100), "e", "a", chr(0xAC00), chr(0x09C7)]) for _ in range(rnd.randint(1, 4))) for _ in range(4000)]
    texts += ["caf\u00e9 \u00fcber \u65e5\u672c\u8a9e \u043f\u0440\u0438\u0432\u0435\u0442", "cafe\u0301", "\ufb01", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(text.unstable()).alias("odd")).collect()
    odd = {r.t: r.odd for r in rows}
    assert all(odd[t] or unicodedata.normalize("NFKC", t) == t for t in texts)
    assert [odd[t] for t in texts[-4:]] == [False, True, True, False] and 100 < sum(odd.values()) < len(odd)
    got = spark.createDataFrame([("Cafe\u0301  \ufb01x",), (None,)], "t string").select(text.normalized(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == ["caf\u00e9 fix", None]


def test_postings_and_statistics_without_a_shuffle_of_postings(spark):
    rows = [(1, "b a b c'b a1 b"), (2, ""), (3, None), (4, "\u00c9t\u00e9 ete z"), (5, "b")]
    m = spark.createDataFrame(rows, "seq long, text string")
    wanted = spark.createDataFrame([("b",), ("ete",), ("none",)], "term string")
    p, stats = search.postings_and_stats(m, wanted)
    assert sorted(map(tuple, p.select("term", "seq", "tf", "dl").collect())) == [("b", 1, 4, 7), ("b", 5, 1, 1), ("ete", 4, 2, 3)]
    assert stats.first() == search.index_stats(m).first() and p.dtypes == search.postings(m, wanted).dtypes
    assert "Exchange hashpartitioning(term" not in search.postings(m)._jdf.queryExecution().executedPlan().toString()
    none, empty = search.postings_and_stats(m.limit(0), wanted)
    assert none.count() == 0 and tuple(empty.first()) == (0, None)


def test_pairs_of_blocks_are_spread_over_as_many_partitions(spark):
    rnd = random.Random(2)
    v = spark.createDataFrame([(k, [rnd.gauss(0, 1) for _ in range(4)]) for k in range(300)], "seq long, embedding array<float>")
    pairs = lists.similar_pairs(v, 0.4, 1, 100, 30)
    assert pairs.rdd.getNumPartitions() >= 10 * 11 // 2
    assert pairs.count() == lists.similar_pairs(v, 0.4, 8, 100, 1000).count() > 100

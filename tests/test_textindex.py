"""The kept index against postings built anew, and its pruned search against full scoring."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_library import NOW, memories, memory
from tidepool.operators import search
from tidepool.operators.textindex import TextIndex, _run_of

WORDS = [f"w{k}" for k in range(60)]


def corpus(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        some = rnd.choices(WORDS, weights=[1 / (1 + i) for i in range(60)], k=rnd.randint(1, 60))
        rows.append(memory(k, text=None if k == 7 else "" if k == 8 else " ".join(some) + " tail" * (k % 9 == 0), scope="ab"[k % 2], deleted_at=5 if k % 11 == 0 else None, tags=["x"] if k % 3 else []))
    return memories(spark, *rows, hash=False)


def asked(spark, n=25, scoped=True):
    rnd = random.Random(5)
    rows = [(f"q{k}", " ".join(rnd.choices(WORDS, k=rnd.randint(1, 8))), [None, "a", "b"][k % 3]) for k in range(n)]
    rows += [("none", "zzz", None), ("stop", "what is the", None), ("rare", "w59 w0 w0 w1", None), ("phrase", "w0-w1 w5", None), ("phrase2", "w0'w0", "a"), ("null", None, None)]
    df = spark.createDataFrame(rows, "query_id string, query string, scope string")
    return df if scoped else df.drop("scope")


def rows_of(df):
    return sorted((r.query_id, r.id, round(r.bm25, 6), r["rank"], round(r.coverage, 6)) for r in df.collect())


def posts(df):
    return sorted((r.term, r.seq, r.tf, r.dl) for r in df.collect())


@pytest.mark.parametrize("limit, tags, scoped", [(5, None, True), (5, ["x"], True), (50, None, False), (1000, None, True)])
def test_pruned_search_equals_full_scoring(spark, tmp_path, limit, tags, scoped):
    m, q = corpus(spark), asked(spark, scoped=scoped)
    index = TextIndex(spark, f"{tmp_path}/index", buckets=4, block=8, part=50)
    index.add(m.where("seq < 250").select("seq", "text"))
    index.add(m.where("seq >= 250").select("seq", "text"))
    want = rows_of(search.fts_search(q, m, search.postings(m), search.index_stats(m), tags, limit))
    assert rows_of(search.fts_search(q, m, index, None, tags, limit)) == want and len(want) > 25
    if scoped and limit == 5:
        told = search.kept_hits(q, search.allowed(q, m, tags), index, limit)[1]
        n, skipped, posts_all, posts_kept = told.agg(F.count("*"), F.count_if(~F.col("kept")), F.sum("n"), F.sum(F.when(F.col("kept"), F.col("n")))).first()
        assert skipped > 0.3 * n and posts_kept < 0.7 * posts_all  # blocks that no best can lie in


def test_ties_at_the_edge_are_kept(spark, tmp_path):
    rows = [memory(k, id=f"m{99 - k:02d}", text="same words here") for k in range(40)] + [memory(50, text="same")]
    m = memories(spark, *rows, hash=False)
    index = TextIndex(spark, f"{tmp_path}/index", buckets=2, block=4)
    index.add(m.select("seq", "text"))
    q = spark.createDataFrame([("q", "words")], "query_id string, query string")
    assert [r.id for r in search.fts_search(q, m, index, limit=3).orderBy("rank").collect()] == ["m60", "m61", "m62"]


def test_batches_replacements_and_merges_equal_an_index_built_anew(spark, tmp_path):
    rnd = random.Random(3)
    index = TextIndex(spark, f"{tmp_path}/index", buckets=4, block=8, part=50)
    now = {}
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "seq long, text string")

    def same():
        m = memories(spark, *[memory(k, text=t) for k, t in now.items()], hash=False)
        assert posts(index.postings()) == posts(search.postings(m))
        assert index.stats().first() == search.index_stats(m).first()
        df = {r.term: r.df for r in search.postings(m).groupBy("term").agg(F.count("*").alias("df")).collect()}
        got = index._read("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").collect()
        assert {r.term: r.df for r in got} == df
        q = asked(spark)
        assert rows_of(search.fts_search(q, m, index, None, limit=7)) == rows_of(search.fts_search(q, m, search.postings(m), search.index_stats(m), limit=7))

    for step in range(5):
        batch = {k: " ".join(rnd.choices(WORDS, k=rnd.randint(1, 20))) for k in rnd.sample(range(200), 40)}
        removed = rnd.sample(sorted(set(now) - set(batch)), 5) if step in (2, 4) else []
        index.add(frame(batch), spark.createDataFrame([(k,) for k in removed], "seq long") if removed else None)
        now = {k: t for k, t in (now | batch).items() if k not in removed}
        if step in (1, 4):
            same()
    assert len(index.segments()) == 5
    merged = index.merge(run=3, ratio=8)
    assert merged == 4 and len(index.segments()) == 1
    same()
    again = TextIndex(spark, f"{tmp_path}/index", buckets=99, block=8)  # opened anew, with its own buckets
    assert again.buckets == 4 and posts(again.postings()) == posts(index.postings())
    again.add(frame({3: "w1 w2", 777: "fresh text"}))
    now |= {3: "w1 w2", 777: "fresh text"}
    assert again.vacuum() == 5 and len(index.segments()) == 2
    same()


def test_adding_reads_the_batch_alone(spark, tmp_path, monkeypatch):
    """No text but the batch's is tokenised, and what the index holds of other texts is not rewritten."""
    index = TextIndex(spark, f"{tmp_path}/index", buckets=2)
    index.add(spark.createDataFrame([(k, f"alpha beta{k}") for k in range(20)], "seq long, text string"))
    files = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    split = []
    monkeypatch.setattr("tidepool.operators.textindex.text.tokens", lambda c, f=search.text.tokens: split.append(1) or f(c))
    index.add(spark.createDataFrame([(3, "gamma"), (30, "delta")], "seq long, text string"))
    assert len(split) == 1 and all(p.stat().st_mtime_ns == files[str(p)] for p in (tmp_path / "index").rglob("*.parquet") if str(p) in files) and files.keys() <= {str(p) for p in (tmp_path / "index").rglob("*.parquet")}
    assert {r.seq for r in index.postings().where("term = 'alpha'").collect()} == set(range(20)) - {3}


def test_what_is_not_published_does_not_count(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/index", buckets=2)
    rows = spark.createDataFrame([(1, "one text")], "seq long, text string")
    index.add(rows)
    published = tmp_path / "index" / "published-2"
    name = next(p for p in published.iterdir() if p.name.startswith("0"))
    name.unlink()  # as if the job had died before
    assert index.postings().count() == 0 == index.docs().count() and index.stats().first().n_docs == 0
    index.add(rows)
    assert posts(index.postings()) == [("one", 1, 1, 2), ("text", 1, 1, 2)]


def test_an_empty_index_finds_nothing(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/index", buckets=2)
    m = corpus(spark, 3)
    assert search.fts_search(asked(spark), m, index).count() == 0
    index.add()
    assert search.fts_search(asked(spark), m, index).count() == 0 and index.merge() == 0


def test_hybrid_search_takes_either_index(spark, tmp_path):
    m = corpus(spark, 120)
    q = asked(spark, 10).withColumn("embedding", F.lit(None).cast("array<float>"))
    index = TextIndex(spark, f"{tmp_path}/index", buckets=4)
    index.add(m.select("seq", "text"))
    hits = lambda i, st: sorted((r.query_id, r.pick, r.id, r.score) for r in search.hybrid_search(q, m, i, st, None, NOW, limit=5).collect())
    assert hits(index, None) == hits(search.postings(m), search.index_stats(m)) != []


def test_runs_of_similar_sizes():
    assert _run_of([100, 10, 12, 9, 11, 500], 4, 4) == (1, 5) and _run_of([1, 1, 1], 4, 4) is None and _run_of([0, 0, 1, 2], 4, 4) == (0, 4)
    assert _run_of([], 4, 4) is None and _run_of([8, 64, 512, 4096], 2, 4) is None


def test_a_search_needs_the_postings_of_its_own_terms_alone(spark):
    m, q = corpus(spark, 120), asked(spark, 10)
    wanted = {r.term for r in search.asked_tokens(q).collect()}
    some = search.postings(m, search.asked_tokens(q))
    assert posts(some) == [p for p in posts(search.postings(m)) if p[0] in wanted] != posts(search.postings(m))
    assert search.index_stats(m).first() == search.index_stats(m, search.postings(m)).first()
    assert rows_of(search.fts_search(q, m, some, search.index_stats(m))) == rows_of(search.fts_search(q, m, search.postings(m), search.index_stats(m))) != []


def test_scores_come_from_postings_not_from_the_tokens_of_texts(spark, tmp_path):
    """A pair of a query and a text costs the postings they share, however long the text is."""
    m, q = corpus(spark, 60), asked(spark, 6).where("query_id not like 'phrase%'")
    index = TextIndex(spark, f"{tmp_path}/index", buckets=2, block=8)
    index.add(m.select("seq", "text"))
    hits = search.kept_hits(q, search.allowed(q, m), index, 5)[0]
    assert "toks" not in hits._jdf.queryExecution().optimizedPlan().toString() and hits.count() > 5
    full = {(r.query_id, r.seq): r.bm25 for r in search.bm25(q, m, search.postings(m), search.index_stats(m), search.allowed(q, m).select("seq")).collect()}
    assert all(full[r.query_id, r.seq] == pytest.approx(r.bm25, abs=1e-8) for r in hits.collect())


def test_pairs_of_queries_and_texts_do_not_move(spark):
    """Scores are summed where the postings of a text are; texts stay in place when the best hits' terms are read."""
    m, q = corpus(spark), asked(spark)
    out = search.bm25(q, m, search.postings(m), search.index_stats(m), search.allowed(q, m).select("seq"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(seq" in plan and "hashpartitioning(query_id" not in plan and "hashpartitioning(phrase" not in plan
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as if every side were large
    try:
        hits = search.fts_search(q, m, search.postings(m), search.index_stats(m))
        assert "hashpartitioning(seq" not in hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)

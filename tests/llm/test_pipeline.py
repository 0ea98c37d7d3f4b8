"""The corpus pipeline as a whole against plain Python, stage after stage, and its behaviour on odd tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_set_ops import groups
from tests.llm.test_text_ops import unseen_scores
from tidepool.llm import secrets, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the a of red tree river stone walk sing bright morning house garden window letter winter summer road bridge market".split()


def corpus():
    rnd = random.Random(21)
    docs, labels = [], []
    for k in range(150):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(60, 90))]
        toxic, junk = k % 5 == 1, k % 10 == 3
        if toxic:
            words[5::9] = ["moron"] * len(words[5::9])
        text = " ".join(words)
        if junk:
            text = " ".join(f"#{rnd.randrange(10**6)}%|" for _ in range(60))
        if k % 10 == 7:
            text += ' token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" end'
        if k % 10 == 9:
            text = docs[k - 1][1] + " tail" * (k % 20 == 9)
        docs.append((k, text, "en", "s", len(text)))
        if k % 2 or k % 3:
            labels.append((k, int(not junk), int(toxic)))
    docs += [(200, None, "en", "s", None), (201, "", None, None, 0), (None, docs[0][1], "en", "s", 5)]
    return docs, labels


def quantile(xs, q):
    return sorted(xs)[max(int(np.ceil(len(xs) * q)) - 1, 0)]


def survivors(docs, labels, model):
    """The stages before packing in plain Python; the toxicity model is the only thing taken over."""
    trusted = {i for i, quality, _ in labels if quality == 1}
    raw = unseen_scores({i: t for i, t, *_ in docs if t}, trusted)
    middle = quantile([raw[i] for i in trusted], 0.5)
    score = {i: (raw[i] * len(t) + middle * 200) / (len(t) + 200) for i, t, *_ in docs if t}
    limit = quantile([score[i] for i in trusted], 0.999)
    docs = [d for d in docs if not d[1] or score[d[0]] <= limit + 1e-9]
    one = toxicity.scorer(*model(docs))
    docs = [d for d in docs if one(d[1]) < 0.5]
    sets = [{" ".join(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in ((d[1] or "").lower().split() for d in docs)]
    alike = groups(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])
    first = {}
    for d, g in zip(docs, alike):
        first[g] = min(first.get(g, d), d, key=lambda x: (x[0] is None, x[0] or 0))
    return {d[0]: secrets.masked(d[1] or "", 6.0) for d in first.values()}


def tables(spark, path, docs, labels):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_equals_plain_python(spark, tmp_path):
    docs, labels = corpus()
    sf = tables(spark, tmp_path / "in", docs, labels)
    rows = corpus_pipeline.run(spark, sf).collect()

    def model(left):
        known = spark.createDataFrame(labels, "doc_id long, quality long, toxic long").where(~toxicity.held_out(F.col("doc_id")))
        return toxicity.fit(spark.createDataFrame(left, SCHEMA), known)

    want = survivors(docs, labels, model)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in rows} == set(want)
    assert 60 < len(want) < 120 and any("[secret:" in x for x in want.values())
    for i, text in want.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == ids.tobytes() and all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in pieces)


def test_stages_keep_columns_and_take_odd_tables(spark, tmp_path):
    docs, labels = corpus()
    sf = tables(spark, tmp_path / "in", docs, labels)
    odd = spark.createDataFrame(docs[:40] + docs[:3] + docs[-3:], SCHEMA).withColumns({c: F.lit("x") for c in ("row_key", "_row_key", "score", "spans", "h", "keep", "part")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (odd, odd.limit(0)):
            out = stage(spark, table, sf)
            assert out.columns == table.columns and out.count() <= table.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), sf).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "simhash", "secrets", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in corpus_pipeline.queries()

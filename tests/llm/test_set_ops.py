"""Operators on whole tables against brute force: SimHash, top-k, embedding near-duplicates, packing, compaction, components."""

import itertools
import json
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tests.llm.test_text_ops import EDGES, docs_of
from tidepool.llm import common, compaction, embdup, packing, simhash, topk


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(300, 360)] + [(400, k) for k in range(401, 460)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups(460, links)
    assert all(got.get(k, k) == want[k] for k in range(460))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text, words=3):
    tokens, at = [], ""
    for c in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " "):
        at = at + c if c != " " else (tokens.append(at) or "" if at else "")
    tokens += [at] if at else []
    tokens = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in tokens]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    texts = [t for t in EDGES if t is None or len(t) < 1000] + ["A b\tC\x0bd\re  f", "É é\xa0ü x y", "one two", "Aa bb cc dd " * 300]
    rows = simhash.fingerprints(docs_of(spark, texts)).collect()
    assert all(r.fp % (1 << 64) == brute_fingerprint(texts[r.doc_id]) for r in rows)


@pytest.mark.parametrize("shard", [5, 1000])
def test_links_lose_no_component(spark, shard):
    rnd = random.Random(4)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for k in range(240):
        x = fps[k % len(fps) if k % 2 else 0]
        for b in rnd.sample(range(64), rnd.randint(0, 4)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    want = groups(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.link(spark.createDataFrame([(x,) for x in signed], "fp long"), shard=shard).collect()
    assert all(0 < ((x.a ^ x.b) % (1 << 64)).bit_count() <= 3 for x in edges) and len(edges) < 10 * len(fps) * (-(-len(fps) // shard))
    at = {x: k for k, x in enumerate(signed)}
    assert groups(len(fps), [(at[x.a], at[x.b]) for x in edges]) == want


def test_bk_tree():
    rnd = random.Random(1)
    items = [rnd.getrandbits(10) for _ in range(200)]
    tree = simhash.BKTree(items)
    for q in range(0, 1024, 37):
        assert sorted(tree.within(q, 2)) == [k for k, x in enumerate(items) if (x ^ q).bit_count() <= 2]


def test_near_duplicates_and_pipeline_form(spark):
    base = " ".join(f"w{k}" for k in range(400))
    texts = [base, base + " x", "other text entirely here", base.upper(), None, "", "other text entirely here"]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = groups(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert [got[k] for k in range(len(texts))] == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.deduplicate(docs.limit(0)).count()


def test_deduplicate_keeps_one_of_each_group(spark):
    """Against the exact similarity of all pairs of word 5-shingle sets."""
    rnd = random.Random(11)
    vocab = [f"w{k}" for k in range(3000)]
    texts = []
    for k in range(60):
        base = [rnd.choice(vocab) for _ in range(400)]
        texts.append(" ".join(base))
        for change in [[], [1], [2], [40], [60]][k % 5 : k % 5 + 1][0] if k % 3 else []:
            copy = list(base)
            for at in rnd.sample(range(0, 400), change):
                copy[at] = "x" + copy[at]
            texts.append(" ".join(copy).upper() if k % 2 else " ".join(copy))
    texts += [texts[0], None, "", "few words", "few words", "few  WORDS", "lone text of a few more words"]
    sets = [{" ".join(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in ((x or "").lower().split() for x in texts)]
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a) if sets[a] & sets[b]}
    want = groups(len(texts), [x for x, j in jaccard.items() if j >= 0.8])
    docs = docs_of(spark, texts).withColumnRenamed("spans", "row_key").withColumnRenamed("score", "kept_id")
    for shard in (1000, 4):
        out = simhash.deduplicate(docs, shard=shard)
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(set(want))
    twice = docs.unionByName(docs).unionByName(docs.where("doc_id = 0").selectExpr("cast(null as long) as doc_id", "'lone text of no name' as text", *docs.columns[2:]))
    assert sorted((r.doc_id is None, r.doc_id) for r in simhash.deduplicate(twice).collect()) == [(False, k) for k in sorted(set(want))] + [(True, None)]


def family(rnd, size, shared, own):
    """Texts of one form letter: `shared` words alike, `own` words in the middle each text's own."""
    form = [rnd.choice(["dear", "sir", "we", "write", "about", "your", "order", "of", "last", "week"]) + str(k % 37) for k in range(shared)]
    return [" ".join(form[: shared // 2] + [f"x{rnd.randrange(10**6)}" for _ in range(own)] + form[shared // 2 :]) for _ in range(size)]


def exact_pairs(texts, words=5):
    """Every pair's Jaccard similarity of shingle sets."""
    sets = [{" ".join(t[k : k + words]) for k in range(max(1, len(t) - words + 1))} for t in (x.lower().split() for x in texts)]
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a)}


@pytest.mark.parametrize("shard", [1000, 25])
def test_form_letters_link_by_their_exact_similarity(spark, shard):
    """Families on both sides of the threshold, and one with copies inside: no link of a pair below it, none above it lost."""
    rnd = random.Random(shard)
    texts = family(rnd, 60, 300, 36) + family(rnd, 60, 300, 26)  # similarities of about 0.78 and 0.83
    below = family(rnd, 80, 300, 40)
    for t in below[:30]:  # near copies: one word more at the end
        below.append(t + " tail")
    texts += below + family(rnd, 20, 300, 30)
    pairs = exact_pairs(texts)
    near = [x for x, j in pairs.items() if j >= 0.8]
    assert 1000 < len(near) and sum(0.7 < j < 0.8 for j in pairs.values()) > 3000
    docs = docs_of(spark, texts)
    prints, roots = simhash.similar(docs, 5, 16, 0.8, shard)
    root = {r.node: r.root for r in roots.collect()}
    got = {r.doc_id: root.get(r.node, r.node) for r in prints.collect()}
    want = groups(len(texts), near)
    alike = {(a, b) for a in range(len(texts)) for b in range(a) if got[a] == got[b]}
    assert all(want[a] == want[b] for a, b in alike)  # nothing is joined that exact links do not join
    assert sum((a, b) in alike for a, b in near) >= 0.99 * len(near)


def test_exact_links_span_what_all_pairs_connect():
    rnd = random.Random(8)
    for star in (False, True):
        for blocks in (1, 2):
            texts = family(rnd, 25, 60, 6) + family(rnd, 25, 60, 5) + ["", "few words", "few words more"]
            rnd.shuffle(texts)
            own = [k % blocks for k in range(len(texts))]
            pairs = [(a, b) for (a, b), j in exact_pairs(texts).items() if j >= 0.8 and texts[a] and texts[b] and (b == 0 if star else blocks == 1 or own[a] != own[b])]
            i, j = simhash.exact_links(texts, own, 5, 0.8, star)
            assert groups(len(texts), list(zip(i.tolist(), j.tolist()))) == groups(len(texts), pairs) and len(i) < len(texts)


def test_minima_estimate_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.8, 0.95):
        got = []
        for _ in range(40):
            n = int(1000 * share)
            common, a, b = rng.integers(0, 1 << 63, n).astype("<u8") * 2, *(rng.integers(0, 1 << 63, (1000 - n) // 2).astype("<u8") * 2 for _ in "ab")
            got.append((simhash.minima(np.concatenate([common, a])) == simhash.minima(np.concatenate([common, b]))).mean())
        assert abs(np.mean(got) - share) < 0.03


VECTORS = "vec_id long, embedding array<float>, label int, score double, n_links string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1.0, "x") for i, v in rows], VECTORS)


def odd_vectors(n, dim, seed):
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((n, dim))
    x[n // 2 :] = x[rnd.integers(0, 6, n - n // 2)] + 0.16 * rnd.standard_normal((n - n // 2, dim))
    rows = [(k, v) for k, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [math.nan] + [0.1] * (dim - 1)), (n + 4, [math.inf] + [0.1] * (dim - 1)), (n + 5, [None] + [0.1] * (dim - 1)), (n + 6, rows[3][1]), (n + 7, rows[3][1] * 5), (n + 8, [1.0, 2.0])]
    return rows


def usable(v, zero=True):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and (not zero or any(x != 0 for x in v))


@pytest.mark.parametrize("blocks", [(4096, 1024), (37, 5)])
def test_top_k(spark, blocks):
    rows = odd_vectors(300, 8, 1)
    vectors = vectors_of(spark, rows)
    got = {}
    for r in topk.top_k(vectors, vectors.where("vec_id % 10 = 0"), 5, *blocks).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ints = {i: np.floor(256 * np.asarray(v, np.float64)).astype(int) for i, v in rows if usable(v, zero=False)}
    for q in ints:
        if q % 10 == 0:
            best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
            assert got.get(q, {}) == {k + 1: (i, -s) for k, (s, i) in enumerate(best)}, q
    assert set(got) <= {q for q in ints if q % 10 == 0}


def test_top_k_few_ties_and_empty(spark):
    vectors = vectors_of(spark, [(k, [1.0, 0.0]) for k in range(40)] + [(50, [0.0, 1.0])])
    got = sorted((r["rank"], r.vec_id) for r in topk.top_k(vectors, vectors.where("vec_id = 7"), 5, 8, 4).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    three = vectors.where("vec_id in (0, 1, 50)")
    assert sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(three, three.where("vec_id = 0")).collect()) == [(1, 1, 65536), (2, 50, 0)]
    assert topk.top_k(vectors.limit(0), vectors).count() == 0


def test_top_k_counts_every_row(spark):
    """Rows that share a vec_id are candidates, and queries, of their own."""
    rng = np.random.default_rng(4)
    rows = [(int(k) % 30, v) for k, v in enumerate(rng.standard_normal((90, 6)))] + [(100, [300.0] * 6), (101, [-200.0, 1e5, 0, 0, 0, 0]), (10, rng.standard_normal(6))] * 2
    vectors = vectors_of(spark, rows)
    ints = [np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(int) for _, v in rows]
    want = []
    for q, (i, _) in enumerate(rows):
        if i % 10 == 0:
            best = sorted((-int(ints[q] @ ints[c]), j, c) for c, (j, _) in enumerate(rows) if c != q)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j, _) in enumerate(best)]
    for blocks in ((4096, 1024), (7, 3)):
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("vec_id % 10 = 0"), 5, *blocks).collect()]
        assert sorted(got) == sorted(want)


def test_top_k_moves_a_block_once_for_a_group_of_blocks(spark):
    """No block is copied for every block it meets, and none of the copies is sent to every task through the driver."""
    rng = np.random.default_rng(6)
    vectors = vectors_of(spark, [(k, v) for k, v in enumerate(rng.standard_normal((2000, 8)))])
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30k")  # below the candidates, above the queries
    try:
        found = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, 100, 20)
        assert len(found.collect()) == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    lines = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    sent = [list(itertools.takewhile(lambda x, top=line: depth(x) > depth(top), lines[at + 1 :])) for at, line in enumerate(lines) if "BroadcastExchange" in line]
    made = [line for line in lines if "Generate explode" in line]
    assert made and not any(line in part for line in made for part in sent)


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for d in (3, 1024, 5000):
        a, b = rng.integers(-127, 128, (20, d)), np.full((20, d), 127)
        assert (embdup.products(a.astype(np.float32), b.astype(np.float32)) == a @ b.T).all()


@pytest.mark.parametrize("tile", [4096, 16])
def test_embedding_near_duplicates(spark, tile, monkeypatch):
    monkeypatch.setattr(embdup, "DOUBTS", 10)
    rows = odd_vectors(260, 16, 3)
    got = {r.vec_id: r for r in embdup.near_duplicates(vectors_of(spark, rows), 0.9, tile).collect()}
    x = {i: np.asarray(v, np.float64) for i, v in rows if usable(v)}
    near = {(i, j) for i in x for j in x if i != j and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.9}
    want = groups(len(rows), near)
    for k, _ in rows:
        assert got[k].n_links == sum(a == k for a, _ in near), k
        assert got[k].component_id == want[k] and got[k].kept == (want[k] == k)
    assert len(near) > 500


def test_embedding_near_duplicates_of_nothing(spark):
    assert embdup.near_duplicates(vectors_of(spark, []), 0.9).count() == 0
    assert [r.n_links for r in embdup.near_duplicates(vectors_of(spark, [(1, None), (2, [0.0])]), 0.9).collect()] == [0, 0]


def test_quantisation_bound_holds():
    rnd = np.random.default_rng(5)
    x = rnd.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.abs(x).max(axis=1) / 127
    q = np.rint(x / s[:, None]) * s[:, None]
    e = np.linalg.norm(x - q, axis=1)
    assert (np.abs(x @ x.T - q @ q.T) <= (1 + e[:, None]) * e[None, :] + e[:, None]).all()


PATH = public_tokenizers.path("word_bpe_49k.json")


def test_packing(spark):
    rnd = random.Random(6)
    texts = EDGES + ["İstanbul Ünïcode é é 中文 don't \x1c\x1d a\xa0b It's ΣΑΣ.", "a <|endoftext|> b", "x<|endoftext|>y<|startoftext|>.", "<|EndOfText|> e\u0301 \u0301x", *[" ".join(rnd.choice(["the", "river", "stone's", "Walk", "1234", "é"]) for _ in range(rnd.randint(0, 900))) for _ in range(60)]]
    t = Tokenizer.from_file(PATH)
    want = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]
    rows = packing.pack(docs_of(spark, texts), PATH).collect()
    fill = {}
    for r in rows:
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length > 0 and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id]) and bytes(r.ids) == piece.tobytes()
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, x in enumerate(want):
        assert sum(r.length for r in rows if r.doc_id == k) == len(x) and len({r.start for r in rows if r.doc_id == k}) == sum(r.doc_id == k for r in rows)
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(docs_of(spark, texts).limit(0), PATH).count() == 0


@pytest.mark.parametrize("split", [True, False])
def test_ids_follow_the_tokenizer_file(spark, split, tmp_path):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("aB9 .,'\té\u0301ßİΣ\u2003\u212b中-_x") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["<|endoftext|>", ""]
    path = PATH
    if not split:  # another splitter: texts are encoded whole
        spec = json.load(open(PATH))
        spec["normalizer"] = {"type": "Lowercase"}
        path = f"{tmp_path}/other.json"
        json.dump(spec, open(path, "w"))
    assert packing.splits_at_space(path) == split
    t = Tokenizer.from_file(path)
    for most in (1 << 19, 5):
        ids, sums = packing.encoded(pa.array(texts), known := packing.Strings(path, "<u4", most), split)
        for x, got, v in zip(texts, ids, sums):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
            assert np.allclose(v, known.projection[np.frombuffer(got, "<u4")].sum(axis=0), atol=1e-3)


def test_hilbert_neighbours():
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    order = cells[np.argsort(packing.hilbert(cells, 3))]
    assert sorted(packing.hilbert(cells, 3).tolist()) == list(range(64))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_compaction(spark, tmp_path):
    store = compaction.Store(spark, f"{tmp_path}/store")
    assert store.read().count() == 0
    rows = docs_of(spark, ["x" * 50 * k for k in range(40)] + [None, "", "dup", "dup"])
    for k in range(8):
        store.append(rows.where(f"doc_id % 8 = {k}").coalesce(1))
    store.append(rows.limit(0))
    before = store.versions()
    assert len(before) == 9
    done = store.compact(target=1 << 20, run=4)
    assert done and len(store.shards()) < 8
    for v in (before[7], done[-1]):
        assert sorted(map(str, store.read(v).select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert store.compact(target=1 << 20, run=4) == []
    with pytest.raises(ValueError):
        store.commit([], {"data/none"})
    store.vacuum()
    assert store.versions() == done[-1:] and store.read().count() == rows.count()


def test_an_empty_store_is_read_as_no_rows(spark, tmp_path):
    docs = docs_of(spark, [])
    store = compaction.Store(spark, f"{tmp_path}/store")
    assert store.read().count() == 0 and store.read().columns == []
    store.append(docs, arrival="lang")
    assert store.compact() == [] and store.read().schema == docs.schema and store.read().count() == 0
    store.append(docs_of(spark, ["a", None]))
    assert store.read().count() == 2


def test_sweep_takes_what_no_version_names(spark, tmp_path):
    store = compaction.Store(spark, f"{tmp_path}/data/store")
    store.append(spark.range(5).coalesce(1))
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/data/store/data/a-dead")
    assert store.sweep() == 0 and store.sweep(older_than_s=-60) >= 1
    assert store.read().count() == 5 and not list((tmp_path / "data/store/data/a-dead").glob("*.parquet"))


def test_compaction_by_arrival_keeps_columns(spark, tmp_path):
    store = compaction.Store(spark, f"{tmp_path}/store")
    rows = docs_of(spark, ["a", None, "c"]).withColumnRenamed("spans", "_arrival")
    store.append(rows, arrival="text")
    assert sorted(r.doc_id for r in store.read().collect()) == [0, 1, 2] and set(store.read().columns) == set(rows.columns)


def test_compaction_keeps_the_columns_of_every_arrival(spark, tmp_path):
    store = compaction.Store(spark, f"{tmp_path}/store")
    for k in range(6):
        row = f"{k} as doc_id" + (f", 'v{k}' as more, named_struct('a', 1, 'b', {k}) as s" if k in (2, 5) else ", named_struct('a', 1) as s")
        store.append(spark.sql(f"select {row}").coalesce(1))
    assert store.compact(target=1 << 20, run=4)
    store.vacuum()
    want = [(k, f"v{k}" if k in (2, 5) else None, k if k in (2, 5) else None) for k in range(6)]
    assert sorted(store.read().selectExpr("doc_id", "more", "s.b").collect()) == want
    with pytest.raises(ValueError):
        store.append(spark.sql("select 'x' as doc_id"))
    assert store.read().count() == 6


def test_a_version_is_claimed_by_one_writer(spark, tmp_path):
    store, other = (compaction.Store(spark, f"{tmp_path}/store") for _ in range(2))

    class Late:
        """The other writer commits after this one has looked."""

        def __init__(self, fs):
            self.fs, self.first = fs, True

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def exists(self, path):
            return False

        def create(self, path, overwrite):
            if self.first:
                self.first = False
                other.append(spark.range(1).coalesce(1))
            return self.fs.create(path, overwrite)

    store._fs = Late(store._fs)
    store.append(spark.range(1, 2).coalesce(1))
    assert sorted(r.id for r in other.read().collect()) == [0, 1]

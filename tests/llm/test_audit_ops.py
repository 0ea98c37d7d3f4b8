"""Filter interaction, exact duplicates and the Merkle manifest against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_ops import EDGES, docs_of
from tidepool.llm import exact, interaction, merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, part string, tree string, idx long, leaf string"


def table_of(spark, rows):
    """Documents (doc_id, text, lang, source, n_chars) with further columns named like the operators' own."""
    return spark.createDataFrame([(*r, "x", "y", "z", 7, "l") for r in rows], COLUMNS)


# -- exact duplicates


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_exact(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(lowered(t), []).append(k)
    out = []
    for k, t in rows:
        ids = [x for x in groups[lowered(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((k, keep, len(groups[lowered(t)]), k == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = [*EDGES, "Ab É", "aB É", "ab é", "İI", "ıi", "iI", "ß", "SS", "\U0001f600X", "\U0001f600x", "x" * 300_000, "X" * 300_000, "tail ", "tail"]


@pytest.mark.parametrize("loads", [1, 3])
def test_exact_duplicates(spark, tmp_path, loads):
    rnd = random.Random(loads)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(k, rnd.choice(["Hot", "hot", "HOT", None, ""])) for k in range(100, 160)]
    rows += [(None, "hot"), (None, "alone without an id"), (7, "dup"), (7, "DUP")]  # null ids, a row twice
    rnd.shuffle(rows)
    docs = table_of(spark, [(k, t, "en", "s", 1) for k, t in rows])
    index = exact.DigestIndex(spark, f"{tmp_path}/index", buckets=4)
    got = exact.exact_duplicates(docs, index, loads).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got], key=str) == brute_exact(rows)
    index.close()


def test_the_index_lasts_and_grows_by_what_is_new(spark, tmp_path):
    make = lambda rows: table_of(spark, [(k, t, "en", "s", 1) for k, t in rows])
    index = exact.DigestIndex(spark, f"{tmp_path}/index", buckets=4)
    first = exact.deduplicate(make([(1, "a"), (2, "A"), (3, "b")]), index)
    assert sorted(r.doc_id for r in first.collect()) == [2, 3] and first.columns == make([(1, "a")]).columns
    index.close()
    again = exact.DigestIndex(spark, f"{tmp_path}/index", buckets=99)  # found with its own number of buckets
    assert again.buckets == 4
    later = exact.deduplicate(make([(1, "B"), (4, "a"), (5, "c"), (5, "c")]), again)
    assert sorted((r.doc_id, r.text) for r in later.collect()) == [(4, "a"), (5, "c")]
    rows = lambda: sorted((bytes(r.digest), r.doc_id) for r in spark.table(again.name).collect())
    assert len(rows()) == 4  # a by 2 and by 4, b, c: the known b was not appended again
    again.add(exact.digests(make([(4, "a"), (3, "b")])))
    assert len(rows()) == 4
    now = {bytes(r.digest): r.doc_id for r in again.read().collect()}
    again.compact()
    assert dict(rows()) == now and len(now) == 3 and again.generation == 1
    again.close()
    third = exact.DigestIndex(spark, f"{tmp_path}/index")
    assert {bytes(r.digest): r.doc_id for r in third.read().collect()} == now
    third.close()


def test_new_rows_meet_the_buckets_by_sort_merge(spark, tmp_path):
    """The index is neither shuffled nor broadcast, and no Python runs."""
    index = exact.DigestIndex(spark, f"{tmp_path}/index", buckets=4)
    docs = docs_of(spark, [f"text {k}" for k in range(50)])
    index.add(exact.digests(docs))
    files = [f for f in index._folder(0) and __import__("os").listdir(index._folder(0)) if f.endswith(".parquet")]
    assert len(files) == 4
    known = spark.table(index.name).select(F.col("digest").alias("known"), F.col("doc_id").alias("known_id"))
    new = exact.digests(docs).groupBy("digest").agg(F.max("doc_id").alias("doc_id"))
    plan = new.join(known.hint("merge"), F.col("digest") == F.col("known"), "left_anti")._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("known#") if "known#" in plan else 0 :]
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "Python" not in plan and "Broadcast" not in plan and "Exchange" not in side.split("FileScan")[-1]
    index.close()


def test_exact_duplicates_of_nothing(spark, tmp_path):
    index = exact.DigestIndex(spark, f"{tmp_path}/index", buckets=2)
    none = table_of(spark, [])
    assert exact.exact_duplicates(none, index).collect() == [] and exact.deduplicate(none, index).collect() == []
    index.compact()
    assert index.read().count() == 0
    index.close()


# -- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_tree(nodes, arity):
    """(root, for each node a list of (slot, others)) of a list of digests."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            run = nodes[a - a % arity : a - a % arity + arity]
            steps[k].append((a % arity, run[: a % arity] + run[a % arity + 1 :]))
        at = [a // arity for a in at]
        nodes = [sha(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
    return (nodes[0] if nodes else None), steps


def brute_audit(rows, arity):
    """rows (doc_id, text, lang, source, n_chars), doc_ids different."""
    order = lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0)
    rows = sorted(rows, key=order)
    langs = list(dict.fromkeys(r[2] for r in rows))
    trees = {g: brute_tree([brute_leaf((r[0], r[3], r[2], r[4], r[1])) for r in rows if r[2] == g], arity) for g in langs}
    root, upper = brute_tree([trees[g][0] for g in langs], arity)
    out = []
    for g, above in zip(langs, upper):
        for r, own in zip([r for r in rows if r[2] == g], trees[g][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            at = brute_leaf((r[0], r[3], r[2], r[4] + hit if r[4] is not None else None, r[1]))
            for slot, others in own + above:
                at = sha(*others[:slot], at, *others[slot:])
            out.append((r[0], brute_leaf((r[0], r[3], r[2], r[4], r[1])), trees[g][0], root, sha(*[x for _, o in own + above for x in o]), at, at == root))
    return sorted(out, key=str)


def audited(docs, arity):
    got = merkle.audit(docs, arity)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in got.collect()], key=str)


@pytest.mark.parametrize("arity, sizes", [(2, (1, 2, 3, 9)), (3, (1, 4, 9, 10)), (2, (33,))])
def test_merkle_equals_brute_force(spark, arity, sizes):
    rnd = random.Random(arity)
    langs, rows, k = [None, "", "é", "z", "\U0001f600"], [], 0
    for lang, size in zip(langs[-len(sizes) :] if len(sizes) > 1 else ["en"], sizes):
        for _ in range(size):
            rows.append((k * 3 - 5, rnd.choice(TEXTS), lang, rnd.choice([None, "", "sé", "s"]), rnd.choice([None, 0, 5, (1 << 63) - 1])))
            k += 1
    hit = next(k for k in range(2000, 3000) if zlib.crc32(str(k).encode()) % 7 == 0)
    rows += [(hit, "tampered with", langs[-1], "s", 5), (hit + 1000, "not counted", langs[-1], "s", None)]
    if len(sizes) > 1:
        rows += [(None, "no id", None, "s", 3), (1000, "x", None, None, None)]
    rnd.shuffle(rows)
    want = brute_audit(rows, arity)
    assert audited(table_of(spark, rows), arity) == want
    assert {r[-1] for r in want} == {True, False}


def test_merkle_of_little(spark):
    assert audited(table_of(spark, []), 2) == []
    one = [(7, "a lone leaf", "en", "s", 3)]
    assert audited(table_of(spark, one), 2) == brute_audit(one, 2)
    twins = audited(table_of(spark, one * 5), 2)  # equal rows are interchangeable
    assert len(twins) == 5 and len({r[:4] for r in twins}) == 1


def test_ranks_follow_the_order_over_many_ranges(spark):
    rows = [("hot" if k % 4 else f"t{k % 13}", k // 3, bytes([k % 251])) for k in range(3000)]
    got = merkle.ranked(spark.createDataFrame(rows, "tree string, doc_id long, digest binary").repartition(7), ["doc_id", "digest"]).collect()
    for t in {r[0] for r in rows}:
        own = sorted((r for r in got if r.tree == t), key=lambda r: r.idx)
        assert [r.idx for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        assert [(r.doc_id, bytes(r.digest)) for r in own] == sorted((r[1], r[2]) for r in rows if r[0] == t)


# -- filter interaction


def brute_fails(rows):
    """The letters each row fails; rows (doc_id, text)."""
    out = []
    for k, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = k is not None and any(j is not None and j < k and (s or "") == t for j, s in rows)
        out.append({x for x, failed in fails.items() if failed})
    return out


def brute_interactions(rows, labels):
    """rows (doc_id, text, lang)."""
    good, toxic = ({k for k, q, x in labels if (q, x)[i] == 1 and k is not None} for i in (0, 1))
    fails, out = brute_fails([r[:2] for r in rows]), []
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        removed_of, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, x in enumerate(order, 1):
                removed = [(k, f) for k, f in left if x in f]
                redundant = sum(x in f for _, f in gone)
                left = [(k, f) for k, f in left if x not in f]
                gone = gone + removed
                removed_of[x] += len(removed)
                lines.append((x, ("".join(order), step, len(left), len(removed), redundant, sum(f == {x} for _, f in own), sum(k in good for k, _ in removed), sum(k in toxic for k, _ in removed))))
        out += [(part, *line, removed_of[x]) for x, line in lines]
    return sorted(out)


def test_interactions_equal_brute_force(spark):
    rnd = random.Random(9)
    pool = [*TEXTS, "A # b", "Same text", " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(250)) + " $", "W " * 250, "one two " * 120 + "Ü" * 9, "ABC " * 10, "x\x0by\x1cz\x85w"]
    rows = [(k, rnd.choice(pool), rnd.choice([None, "", "en", "fr"])) for k in range(150)] + [(None, "Same text", "en"), (None, None, None), (3, "again", "en"), (3, "again", "en")]
    labels = [(k, rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1])) for k in range(0, 200, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    docs = table_of(spark, [(k, t, g, "s", 1) for k, t, g in rows])
    told = spark.createDataFrame([(*x, "p", 1) for x in labels], "doc_id long, quality int, toxic int, part string, mask int")
    got = interaction.interactions(docs, told)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == brute_interactions(rows, labels)


def test_masks_of_pieces_are_those_of_the_whole():
    rnd = random.Random(3)
    for _ in range(50):
        raw = "".join(rnd.choice("ab \t\x0b\n\x1cé") for _ in range(rnd.randint(0, 300))).encode()
        for piece in (1, 7, 1000):
            assert [w for some in interaction.words(raw, piece) for w in some] == raw.split()


def test_interactions_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.interactions(table_of(spark, []), none).count() == 0
    rows = [(1, "a", "en", "s", 1)]
    assert interaction.interactions(table_of(spark, rows), none).count() == 600


def test_effects_enumerate_every_prefix_once(spark):
    got = interaction.effects(spark.createDataFrame([(0,), (5,), (5,)], "mask int")).collect()
    assert sorted((r.prefix, r["mask"]) for r in got) == sorted(("".join(p), m) for k in range(1, 6) for p in permutations("ABCDE", k) for m in (0, 5))

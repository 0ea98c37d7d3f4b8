"""SimHash near-duplicates: fingerprints of word shingles, links within a Hamming radius found by sharded BK-trees.

A shard is a BK-tree (children keyed by their Hamming distance to the parent); a query follows only edges within the radius
of its own distance. Shards above `shard` rows are cut into trees of about that size, and their rows meet every tree of the
shard, block against block, so no task holds a large group. Each task returns a spanning forest of the links it found, never
the pairs, so what thousands of near copies return stays linear. There are two ways to shard:

- `link` (small radius, exact): split 64 bits into radius + 2 blocks; a pair within the radius agrees on two of them at least,
  so each fingerprint goes to the shard of every pair of blocks, and every pair within the radius meets.
- `deduplicate` (similar texts, whose fingerprints may differ in many bits): a text's shingles give 128 minima (the smallest
  hash from each of 128 even steps on); texts go to the shard of every 4 minima in turn. Texts that share 80 % of their shingles
  meet in one of 32 shards but for a chance of 10^-7. A pair found there is a candidate if the share of equal minima, which
  estimates the similarity with a standard error of 0.035, is within `slack` (four of those) of the similarity asked for.
  Candidates only say which texts to compare: inside each of their components the sets of shingles themselves are compared,
  and only pairs whose similarity is reached link. A component above `shard` texts (or of long texts) first meets its text of
  the smallest node; those that link with it need no comparison with one another, the others meet all, block against block.

Null text counts as empty. A text without words has fingerprint zero and links like any other. Of fewer words than a
shingle, the whole sequence is the shingle. Repeated rows have distance zero. An empty table gives no rows. A null doc_id
takes part; component_id is the smallest doc_id that is not null, or null. Further columns are ignored.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import components, fresh, local_roots, save, sorted_groups

MINIMA, BAND = 128, 4


def shingles(text: str, words: int) -> np.ndarray:
    """Hash of each shingle, repeats included."""
    tokens = text.encode().lower().split()  # bytes: A-Z only, and white space is space and 0x09 to 0x0D
    joined = memoryview(b" ".join(tokens))
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts, k = ends - size, max(len(tokens) - words, 0)
    hash64 = xxhash.xxh64_intdigest
    return np.array([hash64(joined[a:b], 42) for a, b in zip(starts[: k + 1].tolist(), ends[-k - 1 :].tolist())], "<u8")


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str, words: int) -> int:
    return majority(shingles(text, words))


def minima(h: np.ndarray) -> np.ndarray:
    """The smallest hash from each of 128 even steps on; past the last hash, from the first."""
    u = np.unique(h)
    steps = np.arange(MINIMA, dtype=np.uint64) << np.uint64(57)
    return u[np.searchsorted(u, steps) % len(u)] if len(u) else np.zeros(MINIMA, "<u8")


def row_key() -> F.Column:
    """Tells documents with other ids or texts apart, together with doc_id."""
    return F.xxhash64("doc_id", "text")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, h, fp long) of every row; h is its row_key."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t or "", words) for t in b.column(2).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "h", "fp"])

    return docs.select("doc_id", row_key().alias("h"), "text").mapInArrow(run, "doc_id long, h long, fp long")


class BKTree:
    """Children keyed by their integer Hamming distance to the parent."""

    def __init__(self, items: list[int]):
        self.items = items
        self.children: list[dict[int, int]] = [{} for _ in items]
        for k in range(1, len(items)):
            at = 0
            while True:
                d = (items[k] ^ items[at]).bit_count()
                if (to := self.children[at].get(d)) is None:
                    self.children[at][d] = k
                    break
                at = to

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.items else []
        while todo:
            at = todo.pop()
            d = (x ^ self.items[at]).bit_count()
            if d <= radius:
                found.append(at)
            todo += [to for edge, to in self.children[at].items() if d - radius <= edge <= d + radius]
        return found


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links (i[x], j[x]) among n positions make a spanning forest."""
    root, chosen = np.arange(n), np.zeros(0, np.int64)
    while len(cross := np.flatnonzero(root[i] != root[j])):
        first = np.full(n, len(i))
        np.minimum.at(first, root[i[cross]], cross)
        np.minimum.at(first, root[j[cross]], cross)
        chosen = np.union1d(chosen, first[first < len(i)])
        root = local_roots(n, i[chosen], j[chosen])
    return chosen


def block_edges(fps: np.ndarray, own: np.ndarray, radius: int, alike=None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the spanning links within the radius among the rows of one block: all, or those of one tree against
    those of another. alike(i, j), if given, says which of those links count."""
    if len(fps) == 2:
        near = int(np.bitwise_count(fps[:1].view(np.uint64) ^ fps[1:].view(np.uint64))[0]) <= radius
        i, j = np.arange(0, int(near)), np.arange(1, 1 + int(near))
    else:
        one = own == own[0]
        tree_at = np.flatnonzero(one)
        query_at = tree_at if one.all() else np.flatnonzero(~one)
        values = [int(x) & (1 << 64) - 1 for x in fps]
        tree = BKTree([values[k] for k in tree_at])
        i, j = [], []
        for q in query_at.tolist():
            near = tree.within(values[q], radius)
            i += [q] * len(near)
            j += near
        i, j = np.array(i, np.int64), tree_at[np.array(j, np.int64)]
        i, j = i[i != j], j[i != j]
    if alike is not None and len(i):
        good = np.concatenate([alike(i[at : at + (1 << 14)], j[at : at + (1 << 14)]) for at in range(0, len(i), 1 << 14)])
        i, j = i[good], j[good]
    kept = forest(len(fps), i, j)
    return i[kept], j[kept]


def link(distinct: DataFrame, radius: int = 3, shard: int = 1000) -> DataFrame:
    """(a, b): links within the radius among the distinct values of column fp, as a spanning set."""
    blocks = radius + 2
    at = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << at[k + 1]) - (1 << at[k])) for k in range(blocks)]
    keys = [masks[x] | masks[y] for x in range(blocks) for y in range(x + 1, blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    shards = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("k")) for k, m in enumerate(keys)])).alias("x"))
    return link_in_shards(shards.select("x.c", "x.k", F.col("fp").alias("node"), "fp"), radius, shard)


def in_blocks(rows: DataFrame, keys: list[str], trees: F.Column) -> DataFrame:
    """rows with `own`, a block of theirs in the group of keys, and a row for each block (i, j) of blocks that they meet in."""
    return (
        rows.withColumn("_g", trees)
        .withColumn("own", F.pmod(F.xxhash64("node"), "_g").cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
        .select(*keys, F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), *[c for c in rows.columns if c not in keys], "own")
    )


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with equal keys in one partition, one after the other."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def edges_of(out: list[tuple[np.ndarray, np.ndarray]]):
    """A batch of links, if there are any."""
    if out := [x for x in out if len(x[0])]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in (0, 1)], names=["a", "b"])


def link_in_shards(shards: DataFrame, radius: int, shard: int, least: float | None = None) -> DataFrame:
    """(a, b): spanning links between nodes of one shard (c, k) whose fp are within the radius, and, with `least`, whose
    minima are equal in that share."""
    large = save(shards.groupBy("c", "k").agg(F.count("*").alias("n")).where(F.col("n") > shard), "large-shards")
    rows = shards.join(large, ["c", "k"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    blocks = in_blocks(rows.select("c", "k", "node", "fp", "n", *([] if least is None else ["minima"])), ["c", "k"], F.ceil(F.col("n") / shard).cast("int")).drop("n")

    def run(batches):
        for rows, starts in sorted_groups(batches, ["c", "k", "i", "j"]):
            fps, own, node = (rows[x].to_numpy() for x in ("fp", "own", "node"))
            ends = np.append(starts[1:], len(fps))
            out = []
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                alike = None
                if least is not None:
                    m = np.frombuffer(b"".join(rows["minima"].slice(s, e - s).to_pylist()), "<u2").reshape(-1, MINIMA)
                    alike = lambda i, j, m=m: (m[i] == m[j]).mean(axis=1) >= least
                i, j = block_edges(fps[s:e], own[s:e], radius, alike)
                out.append((node[s:e][i], node[s:e][j]))
            yield from edges_of(out)

    return gathered(blocks, ["c", "k", "i", "j"]).mapInArrow(run, "a long, b long")


def first_row() -> F.Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("first")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, shard: int = 1000) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable by links."""
    prints = save(fingerprints(docs, words), "fingerprints")
    distinct = save(prints.groupBy("fp").agg(first_row()), "distinct")
    roots = components(link(distinct, radius, shard))
    rooted = save(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    smallest = save(rooted.groupBy("root").agg(F.min("first").alias("first")), "smallest")
    named = save(rooted.select("fp", "root").join(smallest, "root").select("fp", F.col("first.doc_id").alias("component_id")), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, node, fp, minima binary, bands) of every row; node names the set of shingles."""

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(2).to_pylist():
                h = shingles(text or "", words)
                m = minima(h)
                node = xxhash.xxh64_intdigest(np.unique(h).tobytes(), 7) - (1 << 63)
                bands = [xxhash.xxh64_intdigest(m[at : at + BAND].tobytes()) - (1 << 63) for at in range(0, MINIMA, BAND)]
                out.append((node, majority(h), (m >> np.uint64(20)).astype("<u2").tobytes(), bands))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))))], names=["doc_id", "h", "node", "fp", "minima", "bands"])

    return docs.select("doc_id", row_key().alias("h"), "text").mapInArrow(run, "doc_id long, h long, node long, fp long, minima binary, bands array<long>")


def exact_links(texts: list[str], own: list[int], words: int, similarity: float, star: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links that span what pairs of texts with that Jaccard similarity of shingle sets connect: pairs inside
    one block, or between two (own tells the blocks); with star, pairs of the first text only."""
    sets = [np.unique(shingles(t, words)) for t in texts]
    size = np.array([len(x) for x in sets])
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum([0, *size[:-1]])
    block, root, marks = np.array(own), np.arange(len(texts)), np.zeros(len(names), np.int64)
    apart = bool((block != block[0]).any()) and not star
    i, j = [], []
    for k in range(1 if star else len(texts)):
        other = (np.arange(len(texts)) > k) & (root != root[k]) & (size > 0)
        other &= np.minimum(size, size[k]) >= similarity * np.maximum(size, size[k]) - 1e-9
        if apart:
            other &= block != block[k]
        if not size[k] or not other.any():
            continue
        mine = at[starts[k] : starts[k] + size[k]]
        marks[mine] = 1
        to = np.flatnonzero(other)
        if len(to) < 32:
            both = np.array([marks[at[starts[x] : starts[x] + size[x]]].sum() for x in to])
        else:
            sums = np.cumsum(np.concatenate([[0], marks[at]]))
            both = sums[starts[to] + size[to]] - sums[starts[to]]
        marks[mine] = 0
        for x in to[both >= similarity * (size[to] + size[k] - both) - 1e-9].tolist():
            if root[x] != root[k]:
                i.append(k)
                j.append(x)
                root[root == root[x]] = root[k]
    return np.array(i, np.int64), np.array(j, np.int64)


def compared(rows: DataFrame, keys: list[str], words: int, similarity: float, star: bool = False) -> DataFrame:
    """(a, b): the links that exact_links finds in each group of keys of rows (node, own, text)."""

    def run(batches):
        for rows, starts in sorted_groups(batches, keys):
            for s, e in zip(starts, [*starts[1:], rows.num_rows]):
                if e - s > 1:
                    g = rows.slice(s, e - s)
                    node = g["node"].to_numpy()
                    first = np.argsort(node, kind="stable") if star else np.arange(e - s)  # the leader has the smallest node
                    text = g["text"].to_pylist()
                    i, j = exact_links([text[k] or "" for k in first], g["own"].to_numpy()[first].tolist(), words, similarity, star)
                    yield from edges_of([(node[first][i], node[first][j])])

    return gathered(rows, keys).mapInArrow(run, "a long, b long")


def verified(members: DataFrame, words: int, similarity: float, block: int, most: int = 1 << 23) -> DataFrame:
    """(a, b): links that span the pairs of that similarity inside each component; members (comp, node, text) is stored. A
    block holds about `block` texts and `most` characters; what is planned for a text is planned on its node alone."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("node").alias("leader"))
    g = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("chars") / most)).cast("int")
    sizes = save(sizes.where("n > 1").select("comp", "n", "leader", g.alias("g")), "sizes")
    nodes = save(members.select("comp", "node").join(sizes, "comp"), "nodes")
    texts, at = members.select("node", "text"), F.xxhash64("node")

    # large components: the leader goes to every part of its component, each other text to one
    parts = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(F.pmod(at, "g").cast("int")))
    star = nodes.where("g > 1").select("comp", "node", parts.alias("parts")).join(texts, "node").select("comp", F.explode("parts").alias("part"), F.lit(0).alias("own"), "node", "text")
    stars = save(compared(star, ["comp", "part"], words, similarity, star=True), "stars")
    settled = stars.select(F.greatest("a", "b").alias("node"), F.lit(True).alias("settled"))  # the leader has the smaller node
    told = nodes.where("node <> leader or g = 1").join(settled, "node", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    told = save(told, "told")
    unsettled = save(told.where("not settled").groupBy("comp").agg(F.count("*").alias("u")), "unsettled")  # no row where the leader links with all

    # blocks 0 to gu - 1 hold the unsettled texts and meet every block; the settled ones are in g more
    gu = F.ceil(F.col("g") * F.col("u") / F.col("n")).cast("int")
    last = F.when(F.col("settled"), F.col("gu") - 1).otherwise(F.col("gu") + F.when(F.col("g") > 1, F.col("g")).otherwise(F.lit(0)) - 1)
    own = F.when(F.col("settled"), F.col("gu") + F.pmod(at, "g")).otherwise(F.pmod(at, "gu")).cast("int")
    planned = told.join(unsettled, "comp").withColumn("gu", gu).select("comp", "node", own.alias("own"), last.alias("last")).join(texts, "node")
    blocks = planned.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "text")
    return stars.unionByName(compared(blocks, ["comp", "i", "j"], words, similarity))


def similar(docs: DataFrame, words: int, radius: int, similarity: float, shard: int, slack: float = 0.14) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, node) of every row, and (node, root) of linked nodes."""
    prints = save(sketches(docs, words), "sketches")
    distinct = save(prints.groupBy("node").agg(F.min(F.struct("fp", "minima", "bands")).alias("x"), first_row()).select("node", "x.*", "first"), "distinct")
    shards = distinct.select("node", "fp", F.posexplode("bands").alias("c", "k"))
    shared = save(shards.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1").select("c", "k"), "shared-shards")
    meeting = save(shards.join(shared, ["c", "k"]).select("c", "k", "node"), "meeting")
    found = link_in_shards(meeting.join(distinct.select("node", "fp", "minima"), "node"), radius, shard, similarity - slack)
    comps = components(save(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates"))
    comps = comps.unionByName(comps.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "comp")
    named = save(comps.join(distinct.select("node", "first"), "node").select("comp", "node", F.col("first.doc_id").alias("id"), F.col("first.h").alias("key")), "members")
    texts = docs.select("doc_id", row_key().alias("h"), "text").join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key")))
    members = save(texts.dropDuplicates(["node"]).select("comp", "node", "text"), "texts")
    return prints.select("doc_id", "h", "node"), components(save(verified(members, words, similarity, shard), "links"))


def deduplicate(docs: DataFrame, words: int = 5, radius: int = 16, similarity: float = 0.8, shard: int = 1000) -> DataFrame:
    """One row of docs for each group of similar texts, that of the smallest doc_id; all columns."""
    prints, roots = similar(docs, words, radius, similarity, shard)
    rooted = prints.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "doc_id", "h")
    kept_id, kept_h, key = fresh(docs, "kept_id"), fresh(docs, "kept_h"), fresh(docs, "row_key")
    kept = save(rooted.groupBy("root").agg(first_row()).select("first.*").select(F.col("doc_id").alias(kept_id), F.col("h").alias(kept_h)), "kept")
    one = docs.withColumn(key, row_key()).join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_h)), "left_semi")
    return one.dropDuplicates(["doc_id", key]).select(*docs.columns)


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

"""Merkle manifest of a table: leaves by row, a tree for each group, a tree over the groups' roots, and a proof for every row.

H is the lowercase hex SHA-256 of its inputs one after the other, digests as hex text. A leaf is H of its row's values, each
`-` if null, else its UTF-8 byte count, `:` and the value. The leaves of a group ascend by id; while it has several nodes,
every `arity` consecutive ones (the last run may have fewer, even one) become their H. A lone leaf is its group's root. The
groups' roots, ordered by group (null first, by UTF-8 bytes), likewise give the root.

Levels are built by sibling-shift self-joins: the nodes of a level are joined with themselves on the computed index of each
sibling (index XOR 1 for two; for more, a shift of the slot inside the run), so every node learns its whole run, and the rows
at slot zero emit the parents. Each level is a stored table of half (1 / arity) the rows of the one below; a tree drops out
when one node of it is left. Proofs go down again: the nodes of a level join their parents' proofs. So both ways move a few
rows for each leaf, whatever the number of levels, which grows with the logarithm of the rows.

Indices are ranks, without a task that holds a group: rows are range-partitioned by group and id, each partition numbers its
own, and the counts of earlier partitions are added.

A null id comes first, and repeated ids are ordered by their leaves; equal rows are interchangeable. A null group is a group
of its own, apart from the empty one. An empty table gives no rows. Texts of any length are hashed whole. Columns that are
not named are ignored, so their names cannot clash.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import save


def h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-`, or byte count, colon, value; integers are decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return h(*[encoded(v) for v in values])


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, hexed), "")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) with idx, from 0, by `order` inside each tree, and n, the rows of the tree."""
    tie = F.monotonically_increasing_id()  # lets equal rows lie in several ranges
    spread = rows.withColumn("tie", tie).repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie")
    place = F.monotonically_increasing_id()  # number of the partition, and place in it
    placed = save(spread.withColumn("place", place).select(*rows.columns, F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("place")), "placed")
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("here"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = save(counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("here").over(Window.partitionBy("tree")).alias("n")), "starts")  # a row for each range and tree in it
    return placed.join(starts, ["tree", "part"]).select(*rows.columns, (F.col("place") + F.col("shift")).alias("idx"), "n")


def level(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (tree, idx, n, digest, ...) with run: the digests of the node's whole run, in order."""
    slot = F.col("idx") % arity
    out = nodes
    for off in range(1, arity):
        at = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("idx") - slot + F.pmod(slot - off, F.lit(arity))
        out = out.join(nodes.select("tree", at.alias("idx"), F.col("digest").alias(f"s{off}")), ["tree", "idx"], "left")
    shifted = F.array(*[F.col(f"s{off}") for off in range(1, arity)])
    run = F.array(*[F.when(slot == t, F.col("digest")).otherwise(F.get(shifted, (F.pmod(F.lit(t) - slot, F.lit(arity)) - 1).cast("int"))) for t in range(arity)])
    return out.select(*nodes.columns, F.filter(run, lambda x: x.isNotNull()).alias("run"))


def parents(below: DataFrame, arity: int) -> DataFrame:
    """The next level's nodes, emitted by the rows at slot zero."""
    return below.where(F.col("idx") % arity == 0).select("tree", F.floor(F.col("idx") / arity).cast("long").alias("idx"), F.ceil(F.col("n") / arity).cast("long").alias("n"), F.unhex(F.sha2(joined(F.col("run")).cast("binary"), 256)).alias("digest"))


#: Rows that a task takes at least: the upper levels have few, and are joined in few tasks.
PER_TASK = 10_000
Levels = list[tuple[DataFrame, int]]


def sized(rows: DataFrame, n: int) -> DataFrame:
    return rows.coalesce(max(1, -(-n // PER_TASK)))


def grow(nodes: DataFrame, arity: int) -> tuple[Levels, DataFrame]:
    """The levels of all trees over stored nodes (tree, idx, n, digest, ...), lowest first, without trees of one node, each
    with about its number of rows; and (tree, height, digest) of every tree's root."""
    most, leaves, trees = nodes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count_if(F.col("n") > 1), F.count_if(F.expr("n > 1 and idx = 0"))).first()
    levels, roots, height = [], [], 0
    now = nodes
    while True:
        roots.append(now.where("n = 1").select("tree", F.lit(height).alias("height"), "digest"))
        if most <= 1:
            break
        rows = leaves // arity**height + trees
        levels.append((save(sized(level(now.where("n > 1"), arity), rows), f"level-{height}"), rows))
        now = parents(levels[-1][0], arity)
        most, height = -(-most // arity), height + 1
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, save(out, "roots")


STEPS = "array<struct<slot:int,others:array<binary>>>"


def climb(levels: Levels, tops: DataFrame, arity: int, stride: int = 6) -> DataFrame:
    """Rows of the lowest level, with their columns, and with the columns of tops (tree, height, steps, ...) of their tree:
    `steps` prolonged downwards, the slot and the siblings of every level. A tree of height zero has no row here."""
    carried = [c for c in tops.columns if c not in ("tree", "height")]
    above = lambda k: tops.where(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("idx"), *carried)
    now = above(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        nodes, n = levels[k]
        up = now.withColumnsRenamed({"idx": "_up", **{c: f"_{c}" for c in carried}})
        rows = nodes.withColumn("_up", F.floor(F.col("idx") / arity).cast("long")).join(up, ["tree", "_up"])
        slot = (F.col("idx") % arity).cast("int")
        step = F.struct(slot.alias("slot"), F.filter("run", lambda _, i: i != slot).alias("others"))
        own = nodes.drop("run", "n", "digest").columns if k == 0 else ["tree", "idx"]
        now = rows.select(*own, F.concat(F.array(step), "_steps").alias("steps"), *[F.col(f"_{c}").alias(c) for c in carried if c != "steps"])
        now = sized(now, n)
        if k:
            now = now.unionByName(above(k))
            now = save(now, f"proofs-{k}") if k % stride == 0 else now
    return now


def folded(first: Column, steps: Column) -> Column:
    """What a leaf (hex) becomes with its proof's siblings, level by level."""
    return F.aggregate(steps, first, lambda acc, s: h(joined(F.slice(s["others"], 1, s["slot"])), acc, joined(F.slice(s["others"], s["slot"] + 1, F.greatest(F.size(s["others"]) - s["slot"], F.lit(0))))))


def prove(rows: DataFrame, arity: int = 2) -> DataFrame:
    """rows (doc_id, grp, leaf binary, seen binary) with leaf and seen in hex, subroot, root, proof_sha256, folded_root (from
    seen and the proof's siblings) and verified (folded_root is the root)."""
    group = F.coalesce(F.concat(F.lit("="), "grp"), F.lit(""))  # null first, never null
    named = rows.select(group.alias("tree"), "doc_id", F.col("leaf").alias("digest"), "seen")
    nodes = save(ranked(named, ["doc_id", "digest"]), "leaves")
    levels, subroots = grow(nodes, arity)
    upper = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "height", "digest"), ["member"])
    upper_levels, roots = grow(save(upper, "subroots"), arity)
    if upper_levels:
        top = roots.select("tree", "height", F.array().cast(STEPS).alias("steps"), F.col("digest").alias("root"))
        group_tops = climb(upper_levels, top, arity).select(F.col("member").alias("tree"), "steps", "root")
    else:  # one group at most, whose root is the root
        group_tops = subroots.select("tree", F.array().cast(STEPS).alias("steps"), F.col("digest").alias("root"))
    tops = save(subroots.withColumnRenamed("digest", "subroot").join(group_tops, "tree"), "tops")
    lone = nodes.where("n = 1").join(tops.drop("height"), "tree")
    keep = ["doc_id", "leaf", "seen", "subroot", "root", "steps"]
    out = lone.withColumn("leaf", F.col("digest")).select(*keep)
    if levels:
        lowest = levels[0][0].withColumn("leaf", F.col("digest"))
        out = climb([(lowest, levels[0][1]), *levels[1:]], tops, arity).select(*keep).unionByName(out)
    back = folded(hexed(F.col("seen")), F.col("steps"))
    proof = h(joined(F.flatten(F.transform("steps", lambda s: s["others"]))))
    told = out.select("doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), proof.alias("proof_sha256"), back.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tampered(doc_id: Column) -> Column:
    """The rows whose copies the audit alters: 7 divides the crc32 of their id; none with a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def audit(docs: DataFrame, arity: int = 2) -> DataFrame:
    """prove() over documents, grouped by lang; tampered rows are seen with n_chars one larger."""
    real = leaf([F.col(c) for c in FIELDS])
    altered = leaf([(F.col(c).cast("decimal(20,0)") + 1) if c == "n_chars" else F.col(c) for c in FIELDS])
    seen = F.when(tampered(F.col("doc_id")) & F.col("n_chars").isNotNull(), altered).otherwise(real)
    leaves = save(docs.select("doc_id", F.col("lang").alias("grp"), F.unhex(real).alias("leaf"), F.unhex(seen).alias("seen")), "hashed")
    return prove(leaves, arity)

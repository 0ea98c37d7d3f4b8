"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text, by language quantiles.

The model is of order four over code points: every assigned code point up to U+FFFF is a symbol of its own, those beyond
share the places that surrogates and private use leave free. So it needs no vocabulary, works in any script, and grows with
the trusted text. Counts come from all trusted documents. Lower orders use continuation counts, each order has the three
discounts of Chen & Goodman (1999), and orders interpolate down to the uniform distribution.

Scoring joins n-grams with the sharded counts: documents are packed, in the order they are read, into chunks of up to
`chunk` characters; a chunk asks once for each of its distinct n-grams, the distinct n-grams of all chunks are joined with
the counts of every order, and the answers return to the chunks, where the documents are scored. What moves is the distinct
n-grams of each chunk, and the chunks' compressed texts. The documents are read twice, so a table that may give its rows in
another order the second time is stored first, unless `stored` says that it is a plain scan of files.

A document's score is its mean negative log probability, drawn towards its language's trusted median as if `prior` more
characters had that value (short texts vary by chance). It is rejected if the score lies above the `high` quantile of its
language's trusted documents. Languages without trusted text use the largest of these thresholds.

No document is scored by a model that was taught with it: texts are dealt into `folds` by a hash (equal texts together), and
a document's model has the counts of the other folds' trusted texts. So trusted documents are scored unseen, like all others,
and a quantile of their scores is what good text that nobody has labelled reaches too; scores of what a model was taught are
lower, and a quantile of those would reject good text. The models are counted, asked and joined in one pass, told apart by a
column `m`.

Null and empty text have no score and are kept. Without trusted text all is kept. A document whose
other folds have no trusted text (there is a single one, say) counts as uniform noise, in thresholds as well. Repeated rows get the same score. An
empty table gives no rows. Long texts are scored whole. Null lang is a language of its own. Further columns are ignored.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import fresh, save, sorted_groups

N, SHIFT = 4, 16
SIZE = 1 << SHIFT
#: The first place and the number of places that no character below U+10000 takes (surrogates, private use).
FREE, PLACES = 0xD800, 0xF900 - 0xD800


def symbols(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(cp < SIZE, cp, FREE + cp % PLACES).astype(np.uint16)


def mask(order: int) -> int:
    """The last `order` symbols of a key, as a signed 64-bit integer."""
    return (1 << SHIFT * order) - 1 if order < N else -1


def keys(parts: list[np.ndarray]) -> np.ndarray:
    """The n-gram that ends at each symbol of each part, newest symbol in the lowest bits; a part begins after spaces."""
    pad = np.full(N - 1, ord(" "), np.uint16)
    flat = np.concatenate([x for p in parts for x in (pad, p)]).astype(np.int64) if parts else np.zeros(0, np.int64)
    at = np.ones(len(flat), bool)
    starts = np.cumsum([0, *[len(p) + N - 1 for p in parts]])[:-1]
    for k in range(N - 1):
        at[starts + k] = False
    at = np.flatnonzero(at)
    key = flat[at]
    for k in range(1, N):
        key |= flat[at - k] << SHIFT * k
    return key


def slices(texts: list[str], most: int = 1 << 20):
    """Lists of texts of about `most` characters."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def _grams(batches, most: int = 1 << 20):
    """Counts of n-grams by fold in a task's texts, given out whenever there are `most`."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def out():
        for fold, (key, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), fold, np.int32)), pa.array(key), pa.array(n)], names=["fold", "key", "n"])

    for b in batches:
        texts: dict[int, list[str]] = {}
        for fold, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t:
                texts.setdefault(fold, []).append(t)
        for fold, own in texts.items():
            for some in slices(own):
                more, c = np.unique(keys([symbols(t) for t in some]), return_counts=True)
                key, n = held.get(fold, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                key, at = np.unique(np.concatenate([key, more]), return_inverse=True)
                held[fold] = key, np.bincount(at, np.concatenate([n, c]), len(key)).astype(np.int64)
                if sum(len(key) for key, _ in held.values()) >= most:
                    yield from out()
                    held = {}
    yield from out()


#: The model of all trusted text, where there are no folds; else model k lacks fold k.
WHOLE = -1
Model = dict[int, tuple[DataFrame, DataFrame, DataFrame]]


def train(trusted: DataFrame, folds: int = 0) -> Model:
    """By order: counts (m, key, n), contexts (m, context, total, n1, n2, n3), discounts (m, d1, d2, d3), each for every model
    m; trusted (text[, fold])."""
    rows = trusted.select(F.col("fold") if folds else F.lit(0).alias("fold"), "text")
    by_fold = rows.mapInArrow(_grams, "fold int, key long, n long").groupBy("fold", "key").agg(F.sum("n").alias("n"))
    models = F.array(*[F.lit(m) for m in (range(folds) if folds else [WHOLE])])
    each = by_fold.select(F.explode(F.filter(models, lambda m: m != F.col("fold")) if folds else models).alias("m"), "key", "n")
    counts = save(each.groupBy("m", "key").agg(F.sum("n").alias("n")), "grams")
    model = {}
    for order in range(N, 0, -1):
        if order < N:  # how many different symbols stand before it
            counts = save(counts.groupBy("m", F.col("key").bitwiseAND(mask(order)).alias("key")).agg(F.count("*").alias("n")), "grams")
        of = counts.groupBy("m").agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).collect()  # a row for each model
        off = counts.sparkSession.createDataFrame([(r[0], *discounts(*r[1:])) for r in of], "m int, d1 double, d2 double, d3 double")
        contexts = counts.groupBy("m", F.shiftrightunsigned("key", SHIFT).alias("context")).agg(F.sum("n").alias("total"), *[F.count_if(F.col("n") == k if k < 3 else F.col("n") >= 3).alias(f"n{k}") for k in (1, 2, 3)])
        model[order] = counts, contexts, off
    return model


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Chen & Goodman's, held to [0.1, k] so that unseen n-grams have a share; where a count is missing, k / 2."""
    y = n1 / (n1 + 2 * n2) if n1 else 0
    return [min(max(k - (k + 1) * y * b / a, 0.1), float(k)) if a and b else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def probabilities(asked: DataFrame, model: Model) -> DataFrame:
    """(m, key, p) of every distinct (m, key) asked; without m, of the model of all text."""
    below = None
    asked = asked if "m" in asked.columns else asked.withColumn("m", F.lit(WHOLE))
    for order in range(1, N + 1):
        counts, contexts, discount = model[order]
        q = asked if order == N else asked.select("m", F.col("key").bitwiseAND(mask(order)).alias("key")).distinct()
        n = F.coalesce("n", F.lit(0))
        off = F.when(n == 0, 0.0).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = q.join(counts, ["m", "key"], "left").withColumn("context", F.shiftrightunsigned("key", SHIFT)).join(contexts, ["m", "context"], "left").join(F.broadcast(discount), "m", "left")
        if below is None:
            rows = rows.withColumn("low", F.lit(1 / SIZE))
        else:
            rows = rows.withColumn("tail", F.col("key").bitwiseAND(mask(order - 1))).join(below.select("m", F.col("key").alias("tail"), F.col("p").alias("low")), ["m", "tail"])
        left = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("low")).otherwise(F.greatest(n - off, F.lit(0.0)) / F.col("total") + left * F.col("low"))
        below = save(rows.select("m", "key", p.alias("p")), "probabilities")
    return below


def _chunks(batches, chunk: int, grams_only: bool):
    """A row for each chunk and n-gram (chunk, m, key) with grams_only, else a row for each chunk (chunk, m, documents, texts).
    A chunk is for one model; a task fills one for each at a time."""

    def row(m, hs, ids, langs, texts):
        size = np.array([len(t) for t in texts], "<i8")
        name = xxhash.xxh64_intdigest(np.array([m, *hs], "<i8").tobytes() + size.tobytes()) - (1 << 63)
        if grams_only:
            key = np.zeros(0, np.int64)
            for some in slices(texts, 1 << 22):
                key = np.union1d(key, keys([symbols(t) for t in some]))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), name)), pa.array(np.full(len(key), m, np.int32)), pa.array(key)], names=["chunk", "m", "key"])
        packed = zstandard.ZstdCompressor(level=5).compress("".join(texts).encode("utf-8", "surrogatepass"))
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m], pa.int32()), pa.array([hs], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())), pa.array([langs], pa.list_(pa.string())), pa.array([size.tobytes()], pa.binary()), pa.array([packed], pa.binary())], names=["chunk", "m", "hs", "ids", "langs", "sizes", "packed"])

    held: dict[int, tuple[list, list, list, list]] = {}
    filled: dict[int, int] = {}
    for b in batches:
        for m, h, i, lang, text in zip(*(b.column(k).to_pylist() for k in range(5))):
            text = text or ""
            if m in held and filled[m] + len(text) > chunk:
                yield row(m, *held.pop(m))
            if m not in held:
                held[m], filled[m] = ([], [], [], []), 0
            for column, value in zip(held[m], (h, i, lang, text)):
                column.append(value)
            filled[m] += len(text)
    for m, own in held.items():
        yield row(m, *own)


def _answers(batches):
    for t, starts in sorted_groups(batches, ["chunk"]):
        for s, e in zip(starts, [*starts[1:], t.num_rows]):
            g = t.slice(s, e - s)
            small = zstandard.ZstdCompressor(level=3).compress(np.diff(g["key"].to_numpy(), prepend=0).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([g["chunk"].slice(0, 1).combine_chunks(), pa.array([small]), pa.array([np.log(g["p"].to_numpy()).astype("<f4").tobytes()])], names=["chunk", "keys", "logs"])


class Logs:
    """Log probabilities by key: a slot for each hash, and a search for keys that lost theirs."""

    def __init__(self, answers: list[dict]):
        key = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(np.frombuffer(zstandard.decompress(x["keys"]), "<i8")) for x in answers]])
        log = np.concatenate([np.zeros(0, "<f4"), *[np.frombuffer(x["logs"], "<f4") for x in answers]])
        self.key, first = np.unique(key, return_index=True)
        self.log = log[first]
        bits = len(self.key).bit_length() + 3
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self.slot(self.key)] = np.arange(len(self.key))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __getitem__(self, key: np.ndarray) -> np.ndarray:
        at = self.slots[self.slot(key)]
        lost = np.flatnonzero(self.key[at] != key)
        at[lost] = np.searchsorted(self.key, key[lost])
        return self.log[at]


def _score(batches):
    for b in batches:
        for k in range(b.num_rows):
            x = b.slice(k, 1).to_pylist()[0]
            sizes = np.frombuffer(x["sizes"], "<i8")
            text, ends = zstandard.decompress(x["packed"]).decode("utf-8", "surrogatepass"), np.cumsum(sizes).tolist()
            if text and not x["answers"]:
                raise ValueError("a chunk of documents was read in another order the second time: do not pass stored=True")
            logs, total = Logs(x["answers"] or []), []
            for some in slices([text[e - n : e] for e, n in zip(ends, sizes.tolist())]):
                parts = [symbols(t) for t in some]
                size = [len(p) for p in parts]
                v = np.concatenate([[0.0], np.cumsum(logs[key], dtype=np.float64)]) if len(key := keys(parts)) else np.zeros(1)
                to = np.cumsum(size)
                total += (v[to] - v[to - size]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x["hs"], pa.int64()), pa.array(x["ids"], pa.int64()), pa.array(x["langs"], pa.string()), pa.array(sizes), pa.array(total, pa.float64())], names=["h", "doc_id", "lang", "n", "log_p"])


def fold_of(text: F.Column, folds: int) -> F.Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(folds)).cast("int")


def log_probabilities(docs: DataFrame, trusted: DataFrame, chunk: int = 1 << 24, folds: int = 0) -> DataFrame:
    """(h, doc_id, lang, n, log_p) of every document, under the model of all trusted text, or with folds under that of the other
    folds'; h tells rows with other ids or texts apart."""
    own = fold_of(F.col("text"), folds) if folds else F.lit(WHOLE)
    rows = docs.select(own.alias("m"), F.xxhash64("doc_id", "text").alias("h"), "doc_id", "lang", "text")
    model = train(trusted.select(own.alias("fold"), "text") if folds else trusted, folds)
    asked = save(rows.mapInArrow(lambda it: _chunks(it, chunk, True), "chunk long, m int, key long"), "asked")
    known = probabilities(asked.select("m", "key").distinct(), model)
    answers = asked.join(known, ["m", "key"]).select("chunk", "key", "p").sortWithinPartitions("chunk", "key").mapInArrow(_answers, "chunk long, keys binary, logs binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("keys", "logs")).alias("answers"))  # a chunk's n-grams
    packed = rows.mapInArrow(lambda it: _chunks(it, chunk, False), "chunk long, m int, hs array<long>, ids array<long>, langs array<string>, sizes binary, packed binary").drop("m")
    return save(packed.join(answers, "chunk", "left").select("hs", "ids", "langs", "sizes", "packed", "answers").mapInArrow(_score, "h long, doc_id long, lang string, n long, log_p double"), "scores")


def classify(docs: DataFrame, trusted_ids: DataFrame, high: float = 0.999, prior: int = 200, chunk: int = 1 << 24, stored: bool = False, folds: int = 2) -> DataFrame:
    """(doc_id, h, lang, n_chars, log_perplexity, score, threshold, keep) of every document.

    trusted_ids (doc_id): the documents that teach the models and set the quantiles.
    """
    docs = docs.select("doc_id", "lang", "text")
    if not stored:
        docs = save(docs, "docs")
    spark = docs.sparkSession
    ids = trusted_ids.select("doc_id")
    # a Bloom filter of the trusted ids, of bounded size, drops most other texts before they are shuffled for the exact join;
    # the join is a sort-merge join at every size
    bloom = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k) for k in bloom}
    for k, v in bloom.items():
        spark.conf.set(k, v)
    try:
        scores = log_probabilities(docs, docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi"), chunk, folds)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    scores = scores.withColumn("raw", F.when(F.col("n") > 0, -F.col("log_p") / F.col("n")))
    unseen = scores.where("raw is not null").join(ids, "doc_id", "left_semi")
    medians = unseen.groupBy("lang").agg(F.expr("percentile_approx(raw, 0.5, 10000)").alias("median"))
    everywhere = unseen.agg(F.expr("percentile_approx(raw, 0.5, 10000)").alias("all_median"))
    drawn = (F.col("raw") * F.col("n") + F.col("median") * prior) / (F.col("n") + prior)
    shrunk = lambda df: df.join(F.broadcast(everywhere)).join(medians.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("median", F.coalesce("median", "all_median")).withColumn("score", drawn)
    marks = shrunk(unseen).groupBy("lang").agg(F.expr(f"percentile_approx(score, {high}, 10000)").alias("threshold"))
    marks = save(marks.select(F.col("lang").alias("l2"), "threshold"), "thresholds")
    any_mark = marks.agg(F.max("threshold").alias("most"))
    out = shrunk(scores).join(marks, F.col("lang").eqNullSafe(F.col("l2")), "left").join(F.broadcast(any_mark)).withColumn("threshold", F.coalesce("threshold", "most"))
    return out.select("doc_id", "h", "lang", F.col("n").alias("n_chars"), F.col("raw").alias("log_perplexity"), "score", "threshold", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)).alias("keep"))


def keep(docs: DataFrame, trusted_ids: DataFrame, **options) -> DataFrame:
    """The rows of docs that classify keeps; all columns."""
    key, out_h, out_id = fresh(docs, "row_key"), fresh(docs, "out_h"), fresh(docs, "out_id")
    out = classify(docs, trusted_ids, **options).where(~F.col("keep")).select(F.col("h").alias(out_h), F.col("doc_id").alias(out_id)).distinct()
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    return rows.join(out, (F.col(key) == F.col(out_h)) & F.col("doc_id").eqNullSafe(F.col(out_id)), "left_anti").select(*docs.columns)

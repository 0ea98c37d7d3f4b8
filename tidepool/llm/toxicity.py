"""Toxicity: a logistic classifier whose score is held still when identity terms are swapped.

Features are the distinct words of a text in lower case and the beginnings (3 to 8 letters) of its words, hashed to
2^22 slots. From a sample of labelled rows, the slots whose log-odds differ surely between the classes (by `least_z` standard
errors) are chosen, then a logistic model of their presence is fitted. Each labelled text that names a group gets a
counterfactual twin, with every identity term replaced by the next term of its list; the fit adds
`fairness` / 2 * (change of the log-odds)^2 for each twin, so that naming a group by itself moves no score, while
insults beside it still do.

The sample of labelled rows is bounded by `sample` (those with the smallest hash of doc_id); it is the only bounded thing:
all rows are scored, whole. The fit mixes parameters: each round, every shard of the sample improves the shared weights, and
the weights of the shards are averaged. A row's shard is a hash of its id, and rows are sorted in it, so the model is the same
on any number of cores.

Null and empty texts have no features and score the bias alone. Without labels of both classes every score is 0. Repeated
rows repeat; an empty table gives no rows; further columns are ignored. Of conflicting labels the toxic one counts.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import Memo, save, sorted_groups

SLOTS = 1 << 22
WORD = re.compile(r"[^\W\d_]+")
#: Identity terms by language and kind; a term is swapped for the next of its list.
IDENTITIES = """
christian muslim jewish hindu buddhist atheist
christians muslims jews hindus buddhists atheists
black white asian latino african european
gay straight lesbian bisexual transgender queer
woman man
women men
girl boy
girls boys
immigrant refugee foreigner citizen
immigrants refugees foreigners citizens
disabled deaf blind old young
mexican american chinese french german russian turkish
christ muslim jude hindu buddhist atheist
christen muslime juden hindus buddhisten atheisten
schwarze weiße asiatische afrikanische europäische
schwuler hetero lesbe bisexueller
frau mann
frauen männer
mädchen junge
einwanderer flüchtling ausländer bürger
behinderte gehörlose blinde alte junge
türken russen polen franzosen deutsche
chrétien musulman juif hindou bouddhiste athée
chrétiens musulmans juifs hindous bouddhistes athées
noir blanc asiatique africain européen
homosexuel hétérosexuel lesbienne bisexuel transgenre
femme homme
femmes hommes
fille garçon
immigré réfugié étranger citoyen
immigrés réfugiés étrangers citoyens
handicapés sourds aveugles vieux jeunes
arabes algériens marocains français allemands
cristiano musulmán judío hindú budista ateo
cristianos musulmanes judíos hindúes budistas ateos
negro blanco asiático africano europeo
homosexual heterosexual lesbiana bisexual transgénero
mujer hombre
mujeres hombres
niña niño
inmigrante refugiado extranjero ciudadano
inmigrantes refugiados extranjeros ciudadanos
discapacitados sordos ciegos viejos jóvenes
mexicanos chinos gitanos españoles alemanes
"""
SWAP: dict[str, str] = {}
for _terms in map(str.split, IDENTITIES.strip().splitlines()):
    for _k, _t in enumerate(_terms):
        SWAP.setdefault(_t, _terms[(_k + 1) % len(_terms)])


def slots_of(word: str) -> list[int]:
    """The slots of a word and of its beginnings of 3 to 8 letters."""
    raw = word.encode("utf-8", "surrogatepass")
    out, crc = [zlib.crc32(b"w " + raw) % SLOTS], zlib.crc32(b"p ")
    for k, c in enumerate(word[:8], 1):
        crc = zlib.crc32(c.encode("utf-8", "surrogatepass"), crc)
        if k >= 3:
            out.append(crc % SLOTS)
    return out


def slots_of_all(words: set[str], known: Memo) -> np.ndarray:
    return np.array(sorted({s for w in words for s in known[w]}), np.int64)


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def _counts(batches):
    slots, n = Memo(slots_of, 1 << 17), np.zeros((2, SLOTS), np.int32)
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n[int(toxic), slots_of_all(words_of(text), slots)] += 1
    found = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[0, found].astype(np.int64)), pa.array(n[1, found].astype(np.int64))], names=["slot", "clean", "toxic"])


FEATURES = "part int, h long, y long, own binary, twin binary, named boolean"


def _rows(batches, chosen: np.ndarray):
    slots = Memo(slots_of, 1 << 17)
    chosen_in = lambda words: np.searchsorted(chosen, np.intersect1d(slots_of_all(words, slots), chosen, assume_unique=True)).astype("<i4").tobytes()
    for b in batches:
        own, twin, named = [], [], []
        for text in b.column(0).to_pylist():
            words = words_of(text)
            named.append(bool(words & SWAP.keys()))
            own.append(chosen_in(words))
            twin.append(chosen_in({SWAP.get(w, w) for w in words}) if named[-1] else own[-1])
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(1).cast(pa.int64()), pa.array(own, pa.binary()), pa.array(twin, pa.binary()), pa.array(named, pa.bool_())], names=["part", "h", "y", "own", "twin", "named"])


def improve(weights: np.ndarray, rows: list[dict], fairness: float, ridge: float, steps: int, weight: float) -> np.ndarray:
    """Steps of Adagrad on the mean loss of rows; the last weight is the bias."""
    flat = lambda k: (np.concatenate([np.frombuffer(r[k], "<i4") for r in rows]), np.repeat(np.arange(len(rows)), [len(r[k]) // 4 for r in rows]))
    (f, at), (tf, tat) = flat("own"), flat("twin")
    y, named = np.array([r["y"] for r in rows], float), np.array([r["named"] for r in rows])
    n, w, seen = len(rows), weights.copy(), np.full(len(weights), 1e-8)
    for _ in range(steps):
        z = np.bincount(at, w[f], n) + w[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y > 0, weight, 1.0)
        moved = np.where(named, z - np.bincount(tat, w[tf], n) - w[-1], 0.0) * fairness
        g = np.bincount(f, (miss + moved)[at], len(w)) - np.bincount(tf, moved[tat], len(w))
        g[-1] = miss.sum()
        g = g / n + ridge * np.append(w[:-1], 0)
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20000, least_z: float = 4.0, fairness: float = 1.0, ridge: float = 1e-4, weight: float = 2.0, rounds: int = 3, shards: int = 4, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """(slots in order, weights with the bias last), from docs (doc_id, text) and labels (doc_id, toxic 0/1).

    A toxic row counts `weight` times in the loss.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = save(docs.select("doc_id", "text").join(F.broadcast(save(known, "labels")), "doc_id").select("text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("part"), F.xxhash64("doc_id", "text").alias("h")), "labelled")  # at most `sample` ids
    counts = rows.mapInArrow(_counts, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = rows.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not all(total):
        return np.zeros(0, np.int64), np.array([-np.inf])
    odds = lambda c, n: F.log((F.col(c) + 0.5) / (n - F.col(c) + 0.5))
    z = (odds("toxic", total[1]) - odds("clean", total[0])) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counts.where(F.abs(z) >= least_z).select("slot")
    chosen = np.array(sorted(r["slot"] for r in best.collect()), np.int64)  # bounded by the sample: each is in several of its texts
    train = save(rows.mapInArrow(lambda it: _rows(it, chosen), FEATURES), "features")
    weights = np.zeros(len(chosen) + 1)
    for _ in range(rounds):
        start = weights

        def shard(batches):
            for t, starts in sorted_groups(batches, ["part"]):
                for s, e in zip(starts, [*starts[1:], t.num_rows]):
                    own = t.slice(s, e - s).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([own[0]["part"]], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([improve(start, own, fairness, ridge, steps, weight).tobytes()])], names=["part", "n", "w"])  # noqa: B023

        got = train.repartition(shards, "part").sortWithinPartitions("part", "h", "y", "own").mapInArrow(shard, "part int, n long, w binary").collect()  # `shards` rows
        got.sort(key=lambda r: r["part"])
        weights = np.average([np.frombuffer(r["w"]) for r in got], axis=0, weights=[r["n"] for r in got])
    return chosen, weights


_hits: dict[bytes, Memo] = {}


def scorer(chosen: np.ndarray, weights: np.ndarray):
    """A function from texts to scores. A worker remembers the words it met, for one model at a time."""
    name = chosen.tobytes()
    if name not in _hits:
        at = {int(s): k for k, s in enumerate(chosen)}
        _hits.clear()
        _hits[name] = Memo(lambda word: tuple(at[s] for s in slots_of(word) if s in at))
    hits = _hits[name]

    def score(text: str | None) -> float:
        found = {k for w in words_of(text) for k in hits[w]}
        z = float(weights[sorted(found)].sum() + weights[-1])
        return float(np.exp(-np.logaddexp(0.0, -z)))

    return score


def score(docs: DataFrame, chosen: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row. The model is bounded by the sample."""

    def run(batches):
        one = scorer(chosen, weights)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, chosen: np.ndarray, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below threshold, all columns."""
    at = docs.columns.index("text")

    def run(batches):
        one = scorer(chosen, weights)
        for b in batches:
            yield b.filter(pa.array([one(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))

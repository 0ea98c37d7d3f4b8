"""Packing along a space-filling curve: documents with similar vectors share sequences, and almost nothing is padding.

Each document becomes token ids, and its hashed vector (256 signed features of its tokens) projected to four dimensions;
the cells of the four coordinates give a Hilbert key. Documents are range-sorted by (key, doc_id, row), so copies with one
key still spread over many ranges. Along the curve, ids follow one another without gaps and are cut at every multiple of
the sequence length; the last, incomplete stretch is cut into sequences whose lengths are powers of two, which take no
padding. Only keys and lengths are sorted; ids move once, to be joined with their place.

Ids are those of the tokenizers library for the whole text without added special tokens; special tokens in a text are what
the library makes of them. Null text counts as empty and has the end id alone. Repeated rows are packed once each. An empty table gives no rows.
Documents of any length are cut freely. A null doc_id takes part. Further columns are ignored.
"""

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import Memo, save

DIMS, BITS, FEATURES = 4, 8, 256
#: The normaliser and the splitter of tokenizer files that drop white space and never join strings across it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
PIECES = regex.compile(SPLITTER["pretokenizers"][0]["pattern"]["Regex"]).findall


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys of integer points (n, d) on the Hilbert curve, after Skilling (2004)."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if visible, else the next from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@functools.cache
def splits_at_space(path: str) -> bool:
    """Whether the ids of a text are those of its strings between white space in turn: so it is for files whose normaliser,
    splitter and special tokens are the fixed ones above; other files get their texts whole."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in spec["added_tokens"])
    return plain and (spec["normalizer"], spec["pre_tokenizer"]) == (NORMALIZER, SPLITTER)


class Strings:
    """ids of strings by a tokenizer file. Where texts may be split, strings and the pieces in them are remembered: the last
    `most` to 2 * `most` that were asked for; pieces go through the model alone, strings with a special token through all."""

    def __init__(self, path: str, kind: str, most: int = 1 << 19):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.most = Tokenizer.from_file(path), kind, most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        letters, model = byte_letters(), self.tokenizer.model
        self.bytes_of = [np.array([k], kind).tobytes() for k in range(self.tokenizer.get_vocab_size())]
        self.pieces = Memo(lambda p: b"".join([self.bytes_of[x.id] for x in model.tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters))]), most)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)").search
        rnd, n = np.random.default_rng(11), self.tokenizer.get_vocab_size()
        sign, slot = rnd.choice([-1.0, 1.0], n), rnd.integers(0, FEATURES, n)
        self.projection = (sign[:, None] * rnd.standard_normal((FEATURES, DIMS))[slot]).astype(np.float32)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def one(self, string: str) -> bytes:
        if self.special(string):
            return self.whole([string])[0]
        # the normaliser does no more than lower the letters before U+0250
        text = string.lower() if string.isascii() or max(string) < "\u0250" else self.tokenizer.normalizer.normalize_str(string)
        if text.isalpha():
            return self.pieces[text]
        if text[:-1].isalpha() and text[-1] in ".,;:!?":
            return self.pieces[text[:-1]] + self.pieces[text[-1]]
        return b"".join(map(self.pieces.__getitem__, PIECES(text)))

    def ids(self, strings: list[str]) -> list[bytes]:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        new, old, one = self.new, self.old, self.one
        out = list(map(new.get, strings))
        for k, x in enumerate(out):
            if x is None:
                s = strings[k]
                if (x := old.get(s)) is None:
                    x = one(s)
                out[k] = new[s] = x
        return out


_made: dict[tuple[str, str], Strings] = {}


def bounded(texts: pa.Array, most: int = 1 << 24):
    """Slices of texts of about `most` bytes, of one text at least."""
    before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(before, before[at] + most, "right")) - 1)
        yield at, to
        at = to


def encoded(texts: pa.Array, known: Strings, split: bool) -> tuple[list[bytes], np.ndarray]:
    """ids of each text, and the sums of their ids' projections. Every different string is looked up once."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if split:
        # the quick split also takes the separators 0x1C to 0x1F for white space
        odd = pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py()
        parts = pc.split_pattern_regex(texts, "[\t-\r ]+") if odd else pc.ascii_split_whitespace(texts)
        ends, strings = parts.offsets.to_numpy() - parts.offsets[0].as_py(), parts.flatten().dictionary_encode()
        of, ids = strings.indices.to_numpy(), known.ids(strings.dictionary.to_numpy(zero_copy_only=False).tolist())
    else:
        ends, of, ids = np.arange(len(texts) + 1), np.arange(len(texts)), known.whole(texts.to_pylist())
    flat = np.frombuffer(b"".join(ids), known.kind)
    last = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize)
    sums = segment_sums(segment_sums(known.projection[flat], np.append(0, last)).astype(np.float32)[of], ends)
    cuts = ends.tolist()
    return [b"".join([ids[k] for k in of[a:b].tolist()]) for a, b in zip(cuts, cuts[1:])], sums


def segment_sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows ends[k] to ends[k + 1]."""
    out = np.add.reduceat(np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)]), ends[:-1], axis=0, dtype=np.float64)
    out[ends[1:] == ends[:-1]] = 0
    return out


def id_kind(path: str, end_id: int) -> str:
    """16 bits where every id has room in them, else 32."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return "<u2" if max(end_id, *t.get_vocab().values()) < 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """(doc_id, n, key, ids): ids as little-endian integers of that kind."""

    def run(batches):
        if (path, kind) not in _made:
            _made[path, kind] = Strings(path, kind)
        known, split, end = _made[path, kind], splits_at_space(path), np.array([end_id], kind).tobytes()
        for b in batches:
            for at, to in bounded(b.column(1)):
                ids, v = encoded(b.column(1).slice(at, to - at), known, split)
                v = (v + known.projection[end_id] if end_id < len(known.projection) else v).round(6)
                v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)
                cells = np.clip((v + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                size = len(end)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array([len(x) // size + 1 for x in ids], pa.int64()), pa.array(hilbert(cells, BITS)), pa.array([x + end for x in ids], pa.binary())], names=["doc_id", "n", "key", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key long, ids binary")


def places(batches):
    """Adds to sorted rows the partition's number and the count of ids before the row in it."""
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column(1).to_numpy()
        ends = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)], names=["row", "n", "part", "before"])
        before = int(ends[-1]) if len(n) else before


def cut_points(start: int, end: int, total: int, size: int) -> list[tuple[int, int, int, int]]:
    """(from, to, sequence, offset) of the pieces of a document at [start, end) of a curve of total ids."""
    whole = total // size
    edges = [(whole * size + (total % size >> k + 1 << k + 1), 1 << k) for k in range(size.bit_length()) if total % size >> k & 1][::-1]
    out = []
    while start < end and start < whole * size:
        seq = start // size
        to = min(end, (seq + 1) * size)
        out.append((start, to, seq, start - seq * size))
        start = to
    for k, (first, length) in enumerate(edges):
        if start < end and first <= start < first + length:
            to = min(end, first + length)
            out.append((start, to, whole + k, start - first))
            start = to
    return out


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids binary) of every piece."""
    kind = id_kind(path, end_id)
    tokens = save(tokenised(docs, path, end_id, kind).withColumn("row", F.monotonically_increasing_id()), "tokens")
    order = tokens.select("row", "doc_id", "n", "key").repartitionByRange("key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    placed = save(order.select("row", "n").mapInArrow(places, "row long, n long, part int, before long"), "places")
    parts = save(placed.groupBy("part").agg(F.sum("n").alias("n")), "parts")  # a row for each range
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rows = tokens.select("row", "doc_id", "n", "ids").join(placed.join(ahead, "part").select("row", (F.col("ahead") + F.col("before")).alias("at"), "total"), "row")

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc, n, ids, at, total in zip(*(b.column(k).to_pylist() for k in range(5))):
                wide = np.frombuffer(ids, kind).astype("<u4")
                for start, end, seq, offset in cut_points(at, at + n, total, size):
                    piece = wide[start - at : end - at].tobytes()
                    for k, x in zip(out, (doc, start - at, end - start, zlib.crc32(piece), n, seq, offset, piece)):
                        out[k].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == "ids" else pa.int64()) for k, x in out.items()], names=list(out))

    return rows.select("doc_id", "n", "ids", "at", "total").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")

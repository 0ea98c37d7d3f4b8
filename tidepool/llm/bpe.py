"""Byte-level BPE encoding in linear time, and decoding.

A vocabulary of ranked byte strings becomes an Aho-Corasick automaton over bytes read as Latin-1. From each position of a
piece the automaton gives the longest token. The encoder takes it if it may stand beside the token before it, else the next
shorter token that is its prefix; where none is left it steps back and marks the position as dead. Whether two tokens may
stand side by side is what the merges would leave uncombined; it follows from the split of each token into the two that
merge last, and is kept once found. Each position is entered at most once, so the work grows with the piece, not its square.

A piece that is itself a token is that token, as in public rank files. Null text counts as empty; empty text has no
tokens; repeated rows repeat; an empty table gives no rows. Long pieces are encoded whole. Further columns are ignored.
"""

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the white space that the pattern's \s means, spelled out.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
KEPT = 1 << 18  # pieces whose ids, and pairs of tokens whose fit, a worker remembers; it starts anew beyond


def spelled_out(pattern: str) -> str:
    return pattern.replace("[^\\s", f"[^{SPACE}").replace("(?!\\S)", f"(?![^{SPACE}])").replace("\\s", f"[{SPACE}]")


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}  # the longest token that is a proper prefix
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for b, i in ranks.items():
            self.shorter[i] = next((ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in ranks), None)
        for i in sorted(self.bytes_of):
            b, left = self.bytes_of[i], self.shorter[i]
            self.split[i] = (i, i)
            while left is not None:
                right = ranks.get(b[self.length[left] :])
                if right is not None and left < i and right < i and self._fit(left, right):
                    self.split[i], self.merged[left, right] = (left, right), i
                    break
                left = self.shorter[left]

    def fit(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b as they stand side by side."""
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) >= KEPT:
                self.fits.clear()
            known = self.fits[a, b] = self._fit(a, b)
        return known

    def _fit(self, a: int, b: int) -> bool:
        # undo the later merge of the two again and again; a pair across the border that would have merged before it, at
        # the time both stood there, forbids the neighbourhood
        before = float("inf")
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            if a > b:
                before, (_, right) = a, self.split[a]
                if right == a:  # a single byte: only b can be undone
                    before, (left, _) = b + 1, self.split[b]
                    if left == b:
                        return True
                    b = left
                else:
                    a = right
            else:
                before, (left, _) = b + 1, self.split[b]
                if left == b:
                    before, (_, right) = a, self.split[a]
                    if right == a:
                        return True
                    a = right
                else:
                    b = left

    def piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest: list[int | None] = [None] * (n + 1)
        size = [0] * (n + 1)
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, token
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token, length, shorter, fit = 0, longest[0], self.length, self.shorter, self.fit
        while token is not None:
            last = out[-1] if out else None
            while True:
                end = at + length[token]
                if open_at[end] and (last is None or fit(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                if (token := shorter[token]) is None:
                    open_at[at] = 0
                    if last is not None:
                        out.pop()
                        at -= length[last]
                    token = last
                    break
        if at != n:
            raise ValueError("the vocabulary has no token for some byte of the text")
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(b): int(i) for b, i in map(bytes.split, filter(None, map(bytes.strip, f)))}


_made: dict[tuple[str, str], tuple] = {}


def codec(path: str, pattern: str) -> tuple:
    """(pieces of a text, encoder) of a vocabulary, made once in each Python worker."""
    if (path, pattern) not in _made:
        _made[path, pattern] = regex.compile(spelled_out(pattern)).findall, Encoder(read_ranks(path))
    return _made[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary): ids as little-endian unsigned 32-bit integers. path: a rank file present on every machine."""

    def run(batches):
        pieces, encoder = codec(path, pattern)
        known: dict[str, bytes] = {}

        def ids_of(piece: str) -> bytes:
            if (ids := known.get(piece)) is None:
                if len(known) >= KEPT:
                    known.clear()
                ids = np.array(encoder.piece(piece.encode()), "<u4").tobytes()
                if len(piece) < 100:
                    known[piece] = ids
            return ids

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(map(ids_of, pieces(t or ""))) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, decoded binary) of encode's rows."""

    def run(batches):
        of = codec(path, pattern)[1].bytes_of.__getitem__
        for b in batches:
            ids = b.column(1).to_pylist()
            back = [b"".join(map(of, np.frombuffer(x, "<u4").tolist())) for x in ids]
            digest = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), digest(ids), digest(back), pa.array(back, pa.binary())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded binary")

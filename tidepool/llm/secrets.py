"""Secret scan: base patterns, and credential values judged by the least number of guesses that finds them.

`scan` gives, for every row of a documents table, the spans of three base kinds (assign, access, hex) and of the kind
`guess`: a value in a credential context (password, token, pwd, auth, names that hold one, options and elements named so,
Bearer, a password before the @ of a URL, names in other languages, ...) whose cheapest segmentation into words, dates, repeats, keyboard walks and brute-force spans
still costs `min_log10` decimal digits of guesses. The value is what the quotes hold, or all up to white space. Words are
frequent passwords and the words of two public vocabularies by rank, so an ordinary word after a context stays; a value of
several words, or of a word that neither vocabulary has, may cost enough to be a span.

Null text counts as empty; empty text has no spans; repeated rows give repeated results; an empty table gives no rows;
further columns are ignored. Texts of any length are scanned whole. Offsets are code points, ends exclusive.
"""

import base64
import hashlib
import json
import math
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order of their listing, and the shape of each.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Names of credentials, in five languages; base names may stand inside longer ones, what follows after _ or - belongs to them.
NAME = r"(?:password|passwd|secret|token|api[_-]?key|passwort|kennwort|contrase[ñÑ]a|mot[\x20]de[\x20]passe|[Пп]ароль|(?<![a-z0-9])(?:pwd|passphrase|pass|credentials?|authorization|auth|bearer|private_?key|login))(?:[_-][a-z0-9]{1,24}){0,6}+"
CONTEXT = re.compile(
    NAME + r"""["']?(?:[\x20\t]*[:=][=>]?[\x20\t]*|[\x20\t]+is[\x20\t]+)(?:(?:bearer|basic)[\x20\t]+)?|(?<![a-z0-9])bearer[\x20\t]+|(?<!\S)--?(?:[a-z0-9]{1,24}-){0,4}?"""
    + NAME + r"""[\x20\t]+(?!-)""",
    re.I | re.A,
)
#: A value after its context: quoted (with or without escapes), or up to white space.
VALUE = re.compile(r"""\"((?:[^"\\\n]|\\.){6,}+)\"|'((?:[^'\\\n]|\\.){6,}+)'|"([^"\n]{6,})"|'([^'\n]{6,})'|"(?![^"\n]*")(\S{6,})|'(?![^'\n]*')(\S{6,})|(?!["'])(\S{6,})""")
#: A password inside a URL ends at the last @ before a slash, question mark, hash or white space; without an @ it is a port.
URL = re.compile(r"""(?<=[a-z0-9+.-])://[^\s:/@?#]*:([^\s/?#"'<>]{6,})@""", re.I | re.A)
#: What an element named after a credential holds, and a password that is glued to an option of a database's client.
ELEMENT = re.compile(r"<((?:[a-z][a-z0-9.-]*:)?" + NAME + r")(?:\s[^<>]*)?>\s*([^<\s]{6,})\s*</\1>", re.I | re.A)
GLUED = re.compile(r"(?<![a-z0-9])(?:mysql[a-z]*|mariadb[a-z-]*|sshpass)(?:[\x20\t]+(?!-p)\S+){0,16}+[\x20\t]+-p(\S{6,})", re.I | re.A)
HINTS = ("pwd", "pass", "cred", "auth", "bearer", "private", "login", "secret", "token", "apikey", "api_key", "kennwort", "contrase", "парол")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Frequent passwords and words in them, most frequent first.
WORDS = (
    "password 123456 qwerty letmein dragon monkey admin welcome login master hello shadow sunshine princess football baseball iloveyou trustno superman batman "
    "secret test user root guest pass default changeme hunter summer winter spring autumn love access flower freedom whatever ninja mustang michael jordan "
    "correct horse battery staple computer internet server database example sample temp demo public private key token the and for you that with"
).split()
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("013457@$!", "oleastasi")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


def corpus_words() -> list[str]:
    """Whole words of the two public vocabularies, each in the order of its merges, which follows their corpus frequency."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        pieces = [base64.b64decode(line.split()[0]).decode(errors="ignore") for line in f if line.strip()]
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [p[1:].lower() for p in pieces if p.startswith(" ")] + [p[:-4] for p in sorted(vocab, key=vocab.get) if p.endswith("</w>")]
    return [w for w in words if len(w) > 2 and w.isalpha()]


#: log10 of the rank of each word: the frequent passwords, then the words of the corpora.
RANK = {w: math.log10(k + 2) for k, w in enumerate(dict.fromkeys([*WORDS, *corpus_words()]))}
LONGEST = max(map(len, RANK))
HEADS = {w[:3] for w in RANK}
#: Neighbours on a row of the keyboard, and to which side the step goes.
STEP = {(row[k], row[k + d]): d for row in ROWS for k in range(len(row)) for d in (1, -1) if 0 <= k + d < len(row)}
UNITS = range(1, 9)  # lengths of what an attacker repeats


class Starts:
    """Where a repeat that ends here best starts: of starts i with cost b, the least b + log10(end - i).

    A later start is the better one at first, if at all, and an earlier one from some end on; so a stack that keeps those
    ends in order has the best start on top, and each start enters and leaves it once.
    """

    def __init__(self):
        self.stack: list[tuple[int, float]] = []

    @staticmethod
    def turn(a: tuple[int, float], b: tuple[int, float]) -> float:
        """The end from which the earlier start a is as good as b, which costs more."""
        return b[0] + (b[0] - a[0]) / (10 ** min(b[1] - a[1], 300.0) - 1)

    def add(self, i: int, cost: float) -> None:
        stack, new = self.stack, (i, cost)
        while stack and (cost <= stack[-1][1] or (len(stack) > 1 and self.turn(stack[-1], new) >= self.turn(stack[-2], stack[-1]))):
            stack.pop()
        stack.append(new)

    def best(self, end: int) -> float:
        stack = self.stack
        while len(stack) > 1 and self.turn(stack[-2], stack[-1]) <= end:
            stack.pop()
        return stack[-1][1] + math.log10(end - stack[-1][0])


def guesses(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes: a shortest path over its positions.

    Each segment but brute force also costs log10(2), for the attacker has to try where the next one starts. A brute-force
    character costs one digit, a word its rank and its variants, a date 4.6, a repeat its unit (of up to 8 characters) and
    log10 of its count, a keyboard walk along a row 1.7, and log10(2) for each turn and if it is longer than 4. Segments may
    end anywhere: a long repeat or walk may be left for a word. The work grows with the length, not its square.
    """
    n, cut = len(value), math.log10(2)
    low = value.lower()
    plain = low.translate(LEET) if len(low) == n else low
    if len(low) != n:  # a letter that lowers to two: words and walks are sought as it stands
        low = plain = value
    best = [0.0] + [math.inf] * n
    starts = {u: [Starts() for _ in range(u)] for u in UNITS}
    same = dict.fromkeys(UNITS, 0)  # how many characters up to here equal those one unit before
    turned = [0] * (n + 2)  # turns of walks before a position
    side, walk_from, walked = 0, 0, math.inf
    for end in range(n + 1):
        if end:
            here = value[end - 1]
            for u in UNITS:
                if end <= u or here != value[end - 1 - u]:
                    if same[u]:
                        same[u], starts[u] = 0, [Starts() for _ in range(u)]
                    continue
                same[u] += 1
                least = u * (3 if u == 1 else 2)
                if same[u] >= least - u:
                    of = starts[u][end % u]
                    of.add(end - least, best[end - least])
                    best[end] = min(best[end], of.best(end) - math.log10(u) + u + cut)
            step = STEP.get((low[end - 2], low[end - 1]), 0) if end > 1 else 0
            turned[end] = turned[end - 1] + (step * side < 0)
            side = step
            if not step:
                walk_from, walked = end - 1, math.inf
            for k in (end - 3, end - 4):
                if k >= walk_from:
                    best[end] = min(best[end], best[k] + 1.7 + cut * (1 + (end - k > 4) + turned[end] - turned[k + 2]))
            if (k := end - 5) >= walk_from:
                walked = min(walked, best[k] - cut * turned[k + 2])
                best[end] = min(best[end], walked + 1.7 + cut * (2 + turned[end]))
            best[end] = min(best[end], best[end - 1] + 1)
        here = best[end]
        if plain[end : end + 3] in HEADS or low[end : end + 3] in HEADS:
            for to in range(end + 3, min(n, end + LONGEST) + 1):
                if (word := low[end:to]) in RANK:
                    cost = RANK[word] + cut * (1 + (value[end:to] != word))
                elif (word := plain[end:to]) in RANK:
                    cost = RANK[word] + cut * (2 + (value[end:to] != low[end:to]))
                else:
                    continue
                best[to] = min(best[to], here + cost)
        if low[end : end + 1].isdigit():
            for to in (end + 4, end + 8, end + 10):
                if to <= n and DATE.fullmatch(low, end, to):
                    best[to] = min(best[to], here + 4.6 + cut)
    return best[n]


def spans_of(text: str, min_log10: float) -> tuple[list[tuple[int, int, int]], float]:
    """(start, kind, end) of each span in order, and the largest guess cost among credential values."""
    found: list[tuple[int, int, int]] = []
    most = 0.0
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                found.append((m.start(), 0, m.end()))
                most = max(most, guesses(m[2]))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for start, end in values(text, low):
        cost = guesses(text[start:end])
        most = max(most, cost)
        if cost >= min_log10:
            found.append((start, 3, end))
    return sorted(found), most


def values(text: str, low: str):
    """(start, end) of the credential values in text; a context inside a value has none of its own there."""
    if any(k in low for k in HINTS):
        at = 0
        for context in CONTEXT.finditer(text):
            if context.end() >= at and (m := VALUE.match(text, context.end())):
                at = m.end()
                yield m.span(m.lastindex)
        if "</" in text:
            yield from (m.span(2) for m in ELEMENT.finditer(text))
    if "://" in text:
        yield from (m.span(1) for m in URL.finditer(text))
    if " -p" in text:
        yield from (m.span(1) for m in GLUED.finditer(text))


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def scan(docs: DataFrame, min_log10: float = 6.0) -> DataFrame:
    """One row per row of docs (doc_id, text): counts, digest of the base spans, all spans, the largest guess cost."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "max_log10_guesses")}
            for text in b.column(1).to_pylist():
                found, most = spans_of(text or "", min_log10)
                kinds = [kind for _, kind, _ in found]
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(listed([x for x in found if x[1] < 3]).encode()).hexdigest())
                out["spans"].append(listed(found))
                out["max_log10_guesses"].append(round(most, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out.values())], names=["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, max_log10_guesses double")


def redact(docs: DataFrame, min_log10: float = 6.0, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with every span that costs min_log10 digits of guesses, base spans too, replaced by [secret:kind] (overlapping spans by one mark, that of the first), length renewed.

    All rows and columns stay; null text stays null. A table without the length column gets none.
    """
    names = docs.columns

    def run(batches):
        for b in batches:
            new = [t if t is None else masked(t, min_log10) for t in b.column(names.index(text)).to_pylist()]
            cols = list(b.columns)
            cols[names.index(text)] = pa.array(new, b.schema.field(names.index(text)).type)
            if length in names:
                kind = b.schema.field(names.index(length)).type
                old = cols[names.index(length)].to_pylist()
                cols[names.index(length)] = pa.array([x if t is None else len(t) for t, x in zip(new, old)], kind)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def masked(text: str, min_log10: float) -> str:
    """text with marks for its secrets: a base span is one if its value costs the guesses, as any other does."""
    parts, at = [], 0
    found, _ = spans_of(text, min_log10)
    for start, kind, end in found:
        if kind < 3 and guesses(ASSIGN.fullmatch(text, start, end)[2] if kind == 0 else text[start:end]) < min_log10:
            continue
        if start >= at:
            parts += [text[at:start], f"[secret:{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if found else text

"""Text helpers: content hash, query terms, folding, coverage, token estimate, entry lines."""

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidepool.functions.bind import let

#: English function words that a query does without.
STOP_WORDS = (
    "a an the is are was were be been being do does did have has had will would can could shall should may might must "
    "in on at to of for with by from about as and or but not i you he she it we they this that these those "
    "what which who whom whose my your his her its our their"
).split()
#: A query term is letters and digits with inner ' or -; an index token has letters and digits alone.
TERM = r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*"
TOKEN = r"[\p{L}\p{N}]+"
#: Fixed value: the characters that count as white space where contents are hashed.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _fold_table() -> tuple[str, str]:
    """Letters that decompose into one base character and combining marks, and their bases."""
    letters, bases = [], []
    for cp in range(0xC0, min(sys.maxunicode, 0xFFFF) + 1):
        whole = unicodedata.normalize("NFD", chr(cp)) if not 0xD800 <= cp < 0xE000 else ""
        if len(whole) > 1 and all("\u0300" <= c <= "\u036f" for c in whole[1:]):
            letters.append(chr(cp))
            bases.append(whole[0])
    return "".join(letters), "".join(bases)


FOLD_FROM, FOLD_TO = _fold_table()


def fold(c: Column) -> Column:
    """Without accents, in lower case. Texts in ASCII have no accents to look for."""
    bare = F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"[\u0300-\u036f]", "")
    return F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), bare).otherwise(c))


@functools.cache
def unstable() -> str:
    """A class of the characters that NFKC may change, alone or with what stands before them: those it replaces, combining
    marks, and second halves of compositions."""
    known = [chr(cp) for cp in range(0x80, sys.maxunicode + 1) if not 0xD800 <= cp < 0xE000]
    second = {chr(int(d.split()[1], 16)) for c in known if len((d := unicodedata.decomposition(c)).split()) == 2 and not d.startswith("<")}
    jamo = {chr(cp) for cp in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    odd = [ord(c) for c in known if unicodedata.combining(c) or c in second or c in jamo or unicodedata.normalize("NFKC", c) != c]
    starts = [cp for k, cp in enumerate(odd) if k == 0 or odd[k - 1] != cp - 1]
    ends = [cp for k, cp in enumerate(odd) if k + 1 == len(odd) or odd[k + 1] != cp + 1]
    ranges = [rf"\x{{{a:X}}}-\x{{{z:X}}}" for a, z in zip(starts, ends)]
    return f"[[^\\x00-\\x7F]&&[{''.join(ranges)}]]"  # ASCII is told first, the rest of the class is not looked at for it


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalized(c: Column) -> Column:
    """NFKC, white space collapsed and trimmed, lower case. Texts that NFKC leaves as they are, those with accented letters or
    in other scripts too, never leave the JVM's hands for it."""
    odd = c.rlike(unstable())
    return F.lower(F.trim(F.regexp_replace(F.coalesce(nfkc(F.when(odd, c)), c), SPACE + "+", " ")))


def content_hash(c: Column) -> Column:
    return F.sha2(F.concat(F.lit("v1\n"), normalized(c)), 256)


def content_terms(c: Column, limit: int = 32) -> Column:
    """The terms of a query without stop words, repeats kept."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.slice(F.filter(F.regexp_extract_all(c, F.lit(TERM), F.lit(0)), lambda t: ~F.array_contains(stop, F.lower(t))), 1, limit)


def tokens(c: Column) -> Column:
    """The tokens under which the index knows a text."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of a text's tokens, counted as runs of the sorted array: inside the row, without a shuffle."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        each = let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("tf"))))
        return F.when(F.size(s) > 0, each)

    return let(F.sort_array(tokens), runs)


def text_terms(c: Column) -> Column:
    """Distinct folded terms of a text, for coverage."""
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit(TERM), F.lit(0)))


def coverage(terms: Column, text_terms: Column, most: int = 5) -> Column:
    """Share of a query's folded terms among a text's, the denominator held to `most`; 1 without terms."""
    n = F.size(terms)
    hit = let(text_terms, lambda own: F.size(F.filter(terms, lambda t: F.array_contains(own, t))))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), hit / F.least(n, F.lit(most))))


def token_estimate(c: Column) -> Column:
    return F.ceil(F.octet_length(c) / 3).cast("int")


def entry_text(c: Column) -> Column:
    """One line that cannot pass for another entry."""
    return F.regexp_replace(F.regexp_replace(c, r"[\r\n\u2028\u2029]+", " "), r"^-( *\[)", "\u2010$1")


def entry_line(id: Column, scope: Column, created_at: Column, unreviewed: Column, text: Column) -> Column:
    day = F.date_format(F.timestamp_millis(created_at), "yyyy-MM-dd")
    return F.concat(F.lit("- ["), F.concat_ws(" | ", id, scope, day, F.when(unreviewed, F.lit("unreviewed import"))), F.lit("] "), entry_text(text))


def masked(value: Column, kind: Column) -> Column:
    """A preview that tells no secret: the first four characters of long values whose start is a public marker."""
    hidden = kind.isin("url-password", "generic-bearer", "env-secret", "aws-secret-access-key", "aws-session-token") | (F.length(value) < 20)
    return F.when(hidden, F.lit("*" * 8)).otherwise(F.concat(F.substring(value, 1, 4), F.lit("*" * 8)))

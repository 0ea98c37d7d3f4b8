"""Vector helpers, in double precision: cosine, length, normalising, the deterministic hash embedding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions.bind import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero; an error where lengths differ."""
    n = norm(a) * norm(b)
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    return F.coalesce(same, F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def normalized(a: Column) -> Column:
    """Of length 1; zero stays zero."""
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))))


def hash_embedding(text: Column, dim: int = 32) -> Column:
    """A vector that only the text decides: blocks of SHA-256 read as big-endian 32-bit integers, scaled to [-1, 1]."""
    hexes = F.concat(*[F.sha2(text if k == 0 else F.concat(text, F.lit(str(k))), 256) for k in range(-(-dim // 8))])
    word = lambda h, k: (F.conv(F.substring(h, 8 * k + 1, F.lit(8)), 16, 10).cast("double") / 4294967295.0 * 2.0 - 1.0).cast("float")
    words = let(hexes, lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: word(h, k)))
    return F.transform(normalized(words), lambda x: x.cast("float"))


def flaw(v: Column, dim: int) -> Column:
    """Why a vector cannot be stored, or null."""
    return (
        F.when(v.isNull(), "missing")
        .when(F.size(v) != dim, "dimension")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
        .when(norm(v) < 1e-6, "zero")
    )

"""Score helpers: decay, access boost, clamping, the blend of score parts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK_MS = 7 * 24 * 60 * 60 * 1000
#: The default weights.
WEIGHTS = {"relevance": 0.5, "recency": 0.25, "importance": 0.15, "access": 0.1}


def clamp01(c: Column) -> Column:
    """Within [0, 1]; NaN becomes 0, null stays null."""
    return F.when(F.isnan(c), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def decay(elapsed_ms: Column, half_life_ms: int = WEEK_MS) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0), elapsed_ms) / F.lit(float(half_life_ms)))


def access_boost(count: Column, last: Column, now: int, half_life_ms: int = WEEK_MS) -> Column:
    n = F.greatest(F.lit(0), count)
    return n / (n + 5) * F.when(last.isNull(), F.lit(0.0)).otherwise(decay(F.lit(now) - last, half_life_ms))


def parts(relevance: Column, now: int, half_life_ms: int = WEEK_MS) -> Column:
    """The four parts of a memory's score, each in [0, 1], as a struct."""
    return F.struct(
        clamp01(relevance).alias("relevance"),
        decay(F.lit(now) - F.col("created_at"), half_life_ms).alias("recency"),
        clamp01(F.col("importance")).alias("importance"),
        clamp01(access_boost(F.col("access_count"), F.col("last_accessed"), now, half_life_ms)).alias("access"),
    )


def blend(parts: Column, weights: dict[str, float] | None = None) -> Column:
    w = WEIGHTS | (weights or {})
    return sum((F.lit(float(w[k])) * parts[k] for k in WEIGHTS), F.lit(0.0))

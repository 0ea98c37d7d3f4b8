"""Time-ordered ids (UUID version 7): the time they hold, their form, and ids that a retried task makes again."""

from pyspark.sql import Column
from pyspark.sql import functions as F

FORM = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
#: 2020-01-01 in ms, and how far ahead of now an id may be.
EARLIEST_MS, AHEAD_MS = 1577836800000, 5 * 60 * 1000


def id_ms(id: Column) -> Column:
    """Milliseconds since the epoch; null for any other form."""
    return F.when(id.rlike(FORM), F.conv(F.substring(F.replace(id, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long"))


def mint(ms: Column, key: Column) -> Column:
    """The id of a row at a time: the same key always gives the same id."""
    time, h = F.lpad(F.lower(F.hex(ms)), 12, "0"), F.sha2(key, 256)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 4, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(time, 1, 8), F.lit("-"), F.substring(time, 9, 4), F.lit("-7"), F.substring(h, 1, 3), F.lit("-"), variant, F.substring(h, 5, 3), F.lit("-"), F.substring(h, 8, 12))


def plausible(id: Column, now: int) -> Column:
    ms = id_ms(id)
    return F.coalesce((ms >= EARLIEST_MS) & (ms <= now + AHEAD_MS), F.lit(False))

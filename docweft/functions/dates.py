"""Times as texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed format: a date and time with its offset.
DATE_TIME = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[Tt](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"


def iso_utc(time: Column) -> Column:
    """A time of a UTC session as ISO 8601 with Z, in whole seconds."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_date_time(text: Column) -> Column:
    """Whether a text is a strict date-time with an offset, of a day that exists."""
    day = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))
    return F.coalesce(text.rlike(DATE_TIME) & day.isNotNull(), F.lit(False))

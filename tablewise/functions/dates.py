"""Recognising and parsing dates held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats tried, in order of preference (strptime spelling, Spark spelling).
# Single letters accept one or two digits, as the strptime readers do.
FORMATS = (
    ("%Y-%m-%d %H:%M:%S", "y-M-d H:m:s"),
    ("%Y-%m-%dT%H:%M:%S", "y-M-d'T'H:m:s"),
    ("%Y-%m-%d", "y-M-d"),
    ("%Y/%m/%d", "y/M/d"),
    ("%m/%d/%Y %H:%M:%S", "M/d/y H:m:s"),
    ("%d/%m/%Y %H:%M:%S", "d/M/y H:m:s"),
    ("%m/%d/%Y", "M/d/y"),
    ("%d/%m/%Y", "d/M/y"),
    ("%m/%d/%y %H:%M:%S", "M/d/yy H:m:s"),
    ("%d/%m/%y %H:%M:%S", "d/M/yy H:m:s"),
    ("%m/%d/%y", "M/d/yy"),
    ("%d/%m/%y", "d/M/yy"),
    ("%d.%m.%Y", "d.M.y"),
    ("%d-%m-%Y", "d-M-y"),
)
SPARK_FORMAT = dict(FORMATS)
MATCH_SHARE = 0.95
MIN_YEAR, MAX_YEAR = 1000, 3000
MIN_VALUES = 3

#: Text this shape may be parsed. Longer digit runs make the parser overflow and fail the job.
SHAPE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}([ T]\d{1,2}:\d{1,2}:\d{1,2})?$"


def parse_date(text: Column, fmt: str) -> Column:
    """Timestamp without time zone, or null. Two-digit years run from 1970 to 2069."""
    shaped = F.when(text.rlike(SHAPE), text)
    parsed = F.try_to_timestamp(shaped, F.lit(SPARK_FORMAT[fmt])).cast("timestamp_ntz")
    if "%y" in fmt:
        century = F.make_ym_interval(F.lit(100), F.lit(0))
        parsed = F.when(F.year(parsed) >= 2070, parsed - century).otherwise(parsed)
    return parsed

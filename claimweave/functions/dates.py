"""Date coercion and formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strftime codes that occur in column metadata, with Spark's pattern letters.
STRFTIME_TO_SPARK = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%j": "DDD",
    "%b": "MMM",
    "%B": "MMMM",
}

DEFAULT_FORMATS = ("yyyyMMdd",)


def spark_pattern(strftime_format: str) -> str:
    """Spark datetime pattern of a strftime format such as ``%Y%m%d``."""
    pattern = strftime_format
    for code, letters in STRFTIME_TO_SPARK.items():
        pattern = pattern.replace(code, letters)
    if "%" in pattern:
        raise ValueError(f"unsupported date format: {strftime_format}")
    return pattern


def coerce_date(c: Column, formats: Sequence[str] = DEFAULT_FORMATS) -> Column:
    """Timestamp by the first format that fits, null when none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats])


def compact_date(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd")

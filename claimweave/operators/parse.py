"""Lines to columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import dates, text
from claimweave.functions.draws import key_hash
from claimweave.functions.masking import mask_digits
from claimweave.sources.layout import Field


def parse_fields(
    lines: DataFrame, fields: Sequence[Field], keep: Sequence[str] = (), value: str = "value"
) -> DataFrame:
    """One stripped text column per field. Empty fields are empty texts, not null."""
    columns = [text.field(F.col(value), f.start, f.length).alias(f.name) for f in fields]
    return lines.select(*keep, *columns)


def coerce_dates(
    df: DataFrame, columns: Sequence[str], formats: Sequence[str] = dates.DEFAULT_FORMATS
) -> DataFrame:
    """Texts to timestamps in those of ``columns`` that the table has."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: dates.coerce_date(F.col(c), formats) for c in present})


def normalise_nulls(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column, everything else as it is."""
    return df.select(
        *[text.null_if_missing(F.col(name), dtype).alias(name) for name, dtype in df.dtypes]
    )


def mask_columns(df: DataFrame, columns: Sequence[str], key: Sequence[str], seed: int = 0) -> DataFrame:
    """Random digits of equal length in ``columns``, drawn by the row's ``key`` columns."""
    keys = [F.col(k) for k in key]
    hashed = df.withColumns({f"_hash_{c}": key_hash(seed, c, keys) for c in columns})
    masked = hashed.withColumns({c: mask_digits(F.col(c), F.col(f"_hash_{c}")) for c in columns})
    return masked.select(*df.columns)


def sensitive_fields(fields: Sequence[Field]) -> list[str]:
    return [f.name for f in fields if f.sensitive]


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by ``order``; each task keeps n rows, nothing is sorted whole."""
    return df.orderBy(*order).limit(n)

"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.sources.storage import written

# The white space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
GAP_PATTERN = r"[\x20\x09-\x0D]+"
# Tables up to this size may be sent whole to every executor.
BROADCAST_BYTES = 64 << 20
# Rows go to Python and back in batches of about so many bytes, however long their texts are.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; of a null or blank text, none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP_PATTERN), "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(parts, "")


def windows_hashed(items: Column, size: int) -> Column:
    """A 64-bit hash of each run of `size` neighbours; items must be a column or a bound variable."""
    runs = F.slice(items, 1, F.greatest(F.size(items) - (size - 1), F.lit(0)))
    return F.transform(runs, lambda x, i: F.xxhash64(x, *(F.get(items, i + k) for k in range(1, size))))


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text, so that copies are looked at once."""
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("key2")]


KEY = ["key1", "key2"]


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, to be broadcast only if its counted rows prove that it is small."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Steps that are written inside hold few rows at a time, in Python and in the buffers that lead there."""
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


__all__ = ["GAP_PATTERN", "KEY", "let", "small", "small_batches", "text_key", "tokens", "windows_hashed", "words", "written"]

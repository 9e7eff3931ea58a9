"""Aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows that have both; null if either is constant.

    ``F.corr`` stops the job on a constant column when ANSI mode is on.
    """
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


SKETCH_BITS = 14


def distinct_estimate(c: Column) -> Column:
    """Number of distinct non-null values, about 1 % off, from one small sketch per task."""
    sketch = F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(SKETCH_BITS))
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0).cast("bigint"))

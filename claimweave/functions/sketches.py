"""Mergeable quantile sketches: one state of bounded size per column and task, merged in the aggregation's tree.

The states are KLL sketches. Merged in any order, the rank of a value is off by at most RANK_ERROR of the
rows with 99 % confidence, whatever their number; which ranks are off differs from run to run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size of a state; it holds some three times as many values, of any number of rows.
STATE_SIZE = 8192
# Published error of a KLL sketch of this size over all ranks (fixed values).
RANK_ERROR = 2.446 / STATE_SIZE**0.9433


def quantile_state(c: Column) -> Column:
    """Aggregate: the sketch of the non-null values of a double column."""
    return F.kll_sketch_agg_double(c, F.lit(STATE_SIZE))


def quantile_points(state: Column, steps: int) -> Column:
    """Quantiles at 0/steps ... steps/steps; null for a state without values."""
    places = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    held = F.kll_sketch_get_n_double(state) > 0
    return F.when(held, F.kll_sketch_get_quantile_double(F.when(held, state), places))


def ranks_of(state: Column, values: Column) -> Column:
    """Shares of rows up to and including each of the values."""
    return F.kll_sketch_get_rank_double(state, values)

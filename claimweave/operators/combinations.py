"""Column combinations that a synthetic table must keep as they occur."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.copula import fit, sample
from claimweave.sources.metadata import CATEGORICAL, Metadata, override_kind
from claimweave.sources.storage import numbered_rows


def synthesize_with_combinations(
    spark: SparkSession,
    real: DataFrame,
    metadata: Metadata,
    columns: Sequence[str],
    n: int = 1000,
    seed: int = 0,
    row_key: str | None = None,
) -> DataFrame:
    """``n`` rows like those of ``real``, with ``columns`` together only as they occur.

    The columns become categorical and one marginal: each combination is drawn by its
    share. If the table lacks any of them there is nothing to keep. ``row_key`` names a
    column for the number of the row, which is otherwise dropped.
    """
    chosen = override_kind(metadata, list(columns), CATEGORICAL)
    model = fit(real, chosen, fixed_combinations=[columns])
    name = row_key or "_row"
    rows = sample(model, numbered_rows(spark, n, name), [name], seed)
    return rows if row_key else rows.drop(name)


def unseen_combinations(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Combinations of the synthetic table that the real one lacks; nulls compare equal."""
    seen = real.select(*columns).distinct()
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    made = synthetic.select(*columns).distinct()
    return made.alias("s").join(seen.alias("r"), condition, "left_anti")

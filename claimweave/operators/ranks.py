"""Running counts and exact quantiles over all values of many columns at once.

A cumulative window over a whole column would pull it into one task. Here equal values are
counted first (map side, so a hot value is one row per task) and the counts written, the distinct
values are cut into ranges at sampled bounds, the few range totals are summed up, and the
running counts are completed inside each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.sources.storage import written

LOWEST, HIGHEST = float("-inf"), float("inf")
MOST_RANGES = 2000


def range_count(spark: SparkSession) -> int:
    """Ranges per column: some per shuffle partition, so that they grow with the cluster."""
    return max(8, min(MOST_RANGES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def as_number(df: DataFrame, column: str) -> Column:
    """Numbers as double; dates and timestamps as microseconds since 1970, as double."""
    dtype = dict(df.dtypes)[column]
    c = F.col(column)
    if dtype == "timestamp":
        return F.unix_micros(c).cast("double")
    if dtype in ("date", "timestamp_ntz"):
        moment = c.cast("timestamp_ntz")
        days = F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date"))
        seconds = F.hour(moment) * F.lit(3600) + F.minute(moment) * F.lit(60)
        micros = (F.extract(F.lit("SECOND"), moment) * F.lit(1_000_000)).cast("double")
        return days.cast("double") * F.lit(86400e6) + seconds.cast("double") * F.lit(1e6) + micros
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def from_number(c: Column, dtype: str) -> Column:
    """Back from the double of ``as_number`` to a value of the column's type."""
    if dtype == "timestamp":
        return F.timestamp_micros(F.round(c).cast("bigint"))
    if dtype in ("date", "timestamp_ntz"):
        days = F.floor(c / F.lit(86400e6))
        seconds = F.round(c - days * F.lit(86400e6)).cast("decimal(18,0)") / F.lit(1_000_000)
        start = F.lit("1970-01-01").cast("timestamp_ntz")
        none = F.lit(0)
        moment = start + F.make_dt_interval(days.cast("int"), none, none, seconds.cast("decimal(18,6)"))
        return moment.cast(dtype)
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return F.round(c).cast(dtype)
    return c.cast(dtype)


def numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[as_number(df, c).alias(c) for c in columns])


def splits_from(points: Sequence[float]) -> list[float]:
    """Bucketizer splits around the given points; at least one inner point."""
    inner = sorted({p for p in points if p is not None}) or [0.0]
    return [LOWEST, *inner, HIGHEST]


def count_values(
    df: DataFrame, columns: Sequence[str], counts: dict[str, Column], keep: Sequence[str] = ()
) -> DataFrame:
    """(column, value, one aggregate per entry of ``counts``) over the distinct values.

    The aggregates may use the columns in ``keep``. The one pass over the base table; all
    later steps read the counts, which are therefore written.
    """
    long = df.select(*keep, *columns).unpivot(list(keep), list(columns), "column", "value")
    counted = long.groupBy("column", "value").agg(*[c.alias(name) for name, c in counts.items()])
    return written(counted, "counts")


def value_bounds(counted: DataFrame, ranges: int) -> dict[str, list[float]]:
    """Per column about ``ranges`` values that cut its distinct values into similar parts.

    What reaches the driver is columns x ranges doubles. The bounds only balance the work,
    results do not depend on them.
    """
    shares = [i / ranges for i in range(1, ranges)]
    rows = counted.groupBy("column").agg(
        F.percentile_approx("value", shares, 10 * ranges).alias("bounds")
    )
    return {r["column"]: list(r["bounds"] or []) for r in rows.collect()}


def running_counts(counted: DataFrame, count_names: Sequence[str]) -> DataFrame:
    """Add ``before_<n>`` and ``total_<n>`` for each count: the counts of all lower values
    and of the whole column. ``counted`` has (column, value double, counts); null values
    are left out."""
    counted = counted.filter(F.col("value").isNotNull())
    bounds = value_bounds(counted, range_count(counted.sparkSession))
    columns = sorted(bounds) or [""]
    bounds = bounds or {"": []}
    splits = [splits_from(bounds[c]) for c in columns]
    wide = counted.withColumns(
        {f"_v{i}": F.when(F.col("column") == c, F.col("value")) for i, c in enumerate(columns)}
    )
    ranged = Bucketizer(
        splitsArray=splits,
        inputCols=[f"_v{i}" for i in range(len(columns))],
        outputCols=[f"_r{i}" for i in range(len(columns))],
    ).transform(wide)
    # Ranges are numbered through over all columns, so that one integer is the shuffle key.
    starts_at = [sum(len(s) - 1 for s in splits[:i]) for i in range(len(columns))]
    range_no = F.coalesce(*[F.col(f"_r{i}") + F.lit(float(n)) for i, n in enumerate(starts_at)])
    ranged = ranged.select(*counted.columns, range_no.cast("int").alias("range_no"))
    # Columns x ranges rows: small by construction, so windowed and broadcast.
    lower_ranges = (
        Window.partitionBy("column").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    )
    whole_column = Window.partitionBy("column")
    range_totals = ranged.groupBy("column", "range_no").agg(
        *[F.sum(n).alias(f"sum_{n}") for n in count_names]
    )
    range_starts = range_totals.select(
        "range_no",
        *[F.coalesce(F.sum(f"sum_{n}").over(lower_ranges), F.lit(0)).alias(f"start_{n}") for n in count_names],
        *[F.sum(f"sum_{n}").over(whole_column).alias(f"total_{n}") for n in count_names],
    )
    lower_values = (
        Window.partitionBy("range_no").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    )
    # Every value has its range; a left join spares testing the range for null first.
    joined = ranged.withColumns(
        {f"in_range_{n}": F.coalesce(F.sum(n).over(lower_values), F.lit(0)) for n in count_names}
    ).join(F.broadcast(range_starts), "range_no", "left")
    return joined.select(
        *counted.columns,
        *[(F.col(f"start_{n}") + F.col(f"in_range_{n}")).alias(f"before_{n}") for n in count_names],
        *[F.col(f"total_{n}") for n in count_names],
    )


def quantile_table(df: DataFrame, columns: Sequence[str], steps: int) -> DataFrame:
    """Exact quantiles at 0/steps ... steps/steps of every column.

    (column, idx, lower, quantile, n_rows): ``lower`` is the value at the rank's whole part,
    ``quantile`` interpolates linearly to the next value.
    """
    counted = count_values(numbers(df, columns), columns, {"n": F.count(F.lit(1))})
    return quantiles_of_ranked(running_counts(counted, ["n"]), steps)


def quantiles_of_ranked(ranked: DataFrame, steps: int) -> DataFrame:
    # The grid indices whose whole rank i * (total - 1) div steps lies in [rank, rank + n) run
    # from ceil(rank * steps / (total - 1)) up to the first index of the next value.
    last_rank = "greatest(total_n - 1, 1)"

    def first_index(rank: str) -> str:
        return f"((({rank}) * {steps} + {last_rank} - 1) div {last_rank})"

    def low(rank: str) -> Column:
        return F.expr(f"greatest({first_index(rank)}, 0L)")

    def high(rank: str) -> Column:
        # A single row holds all of them.
        return F.expr(
            f"if(total_n = 1, {steps}L, least({first_index(f'{rank} + n')} - 1, {steps}L))"
        )

    # Few values hold a grid point; the others are dropped before any array is built.
    places = ranked.select(
        "column", "value", "total_n",
        low("before_n").alias("low"), high("before_n").alias("high"),
        low("before_n - 1").alias("next_low"), high("before_n - 1").alias("next_high"),
    ).filter("low <= high or next_low <= next_high")

    def indices(low: str, high: str, is_lower: bool) -> Column:
        held = F.when(F.col(low) <= F.col(high), F.sequence(low, high)).otherwise(
            F.array().cast("array<bigint>")
        )
        return F.transform(
            held, lambda i: F.struct(i.alias("idx"), F.lit(is_lower).alias("is_lower"))
        )

    points = F.concat(indices("low", "high", True), indices("next_low", "next_high", False))
    hit = places.select("column", "value", "total_n", F.explode(points).alias("point"))
    grid = hit.groupBy("column", F.col("point.idx").cast("int").alias("idx")).agg(
        F.max(F.when(F.col("point.is_lower"), F.col("value"))).alias("lower"),
        F.max(F.when(~F.col("point.is_lower"), F.col("value"))).alias("upper"),
        F.max("total_n").alias("n_rows"),
    )
    position = F.col("idx") * (F.col("n_rows") - F.lit(1)) / F.lit(float(steps))
    fraction = position - F.floor(position)
    step_up = F.coalesce(F.col("upper") - F.col("lower"), F.lit(0.0))
    return grid.select(
        "column", "idx", "lower", (F.col("lower") + step_up * fraction).alias("quantile"), "n_rows"
    )

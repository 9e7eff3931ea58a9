"""Scores of a synthetic table against the real one, all between 0 and 1 (equal)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import sketches
from claimweave.functions.normal import literal_array
from claimweave.functions.statistics import correlation
from claimweave.operators import ranks
from claimweave.operators.profile import DATE_TYPES
from claimweave.sources.metadata import DATETIME, ID, NUMERICAL, Metadata
from claimweave.sources.storage import written

KS = "KSComplement"
TV = "TVComplement"
CORRELATION = "CorrelationSimilarity"
CONTINGENCY = "ContingencySimilarity"
BOUNDARY = "BoundaryAdherence"
CATEGORY = "CategoryAdherence"
STRUCTURE = "TableStructure"
IDS = "KeyUniqueness"

IS_REAL = "_is_real"
# Numeric columns are cut into this many ranges of equal width in pairs with categories.
PAIR_RANGES = 10
# Places at which sketched distribution functions are compared.
SKETCH_STEPS = 500


def stack(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both tables one below the other, flagged."""
    return real.select(F.lit(True).alias(IS_REAL), *columns).unionByName(
        synthetic.select(F.lit(False).alias(IS_REAL), *columns)
    )


def _source_counts() -> dict[str, Column]:
    flag = F.col(IS_REAL)
    return {"real": F.count_if(flag), "synthetic": F.count_if(~flag)}


def _value_counts(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value as text, real, synthetic), null being a value."""
    texts = both.select(IS_REAL, *[F.col(c).cast("string").alias(c) for c in columns])
    return (
        texts.unpivot([IS_REAL], list(columns), "column", "value")
        .groupBy("column", "value")
        .agg(*[c.alias(n) for n, c in _source_counts().items()])
    )


def _scores(column: Column, metric: str, score: Column) -> list[Column]:
    return [column.alias("column"), F.lit(metric).alias("metric"), score.alias("score")]


def ks_scores(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 - the largest distance of the two distribution functions, per numeric column."""
    counts = _source_counts()
    wide = ranks.numbers(both, columns, [IS_REAL])
    counted = ranks.count_values(wide, columns, counts, [IS_REAL])
    ranked = ranks.running_counts(counted, list(counts))

    def share_up_to(name: str) -> Column:
        return F.try_divide(F.col(f"before_{name}") + F.col(name), F.col(f"total_{name}"))

    gap = F.abs(share_up_to("real") - share_up_to("synthetic"))
    return ranked.groupBy("column").agg(F.max(gap).alias("distance")).select(
        *_scores(F.col("column"), KS, F.lit(1.0) - F.col("distance"))
    )


def ks_intervals(both: DataFrame, columns: Sequence[str], steps: int = SKETCH_STEPS) -> DataFrame:
    """(column, metric, low, high): an interval that holds the score of ``ks_scores``, without a shuffle of values.

    Each side's values go into one sketch per column. Between neighbouring places the functions can part by
    no more than one of them rises there; that and both sketches' errors widen the interval. It is null
    where a side has no values.
    """
    flag = F.col(IS_REAL)
    wide = ranks.numbers(both, columns, [IS_REAL])
    states = wide.agg(*[
        sketches.quantile_state(F.when(flag if side == "real" else ~flag, F.col(c))).alias(f"{side}{i}")
        for i, c in enumerate(columns) for side in ("real", "synthetic")
    ])
    states = written(states, "states")  # one row
    sides = [(F.col(f"real{i}"), F.col(f"synthetic{i}")) for i in range(len(columns))]
    row = states.select(*[sketches.quantile_points(s, steps).alias(f"{k}_{i}") for i, pair in enumerate(sides) for k, s in enumerate(pair)]).first()
    places = [sorted({*(row[f"0_{i}"] or []), *(row[f"1_{i}"] or [])}) for i in range(len(columns))]

    def interval(i: int) -> Column:
        at = places[i]
        if row[f"0_{i}"] is None or row[f"1_{i}"] is None:
            low = high = F.lit(None).cast("double")
        else:
            upto = [sketches.ranks_of(s, literal_array(at, "double")) for s in sides[i]]
            below = [sketches.ranks_of(s, literal_array([math.nextafter(x, -math.inf) for x in at], "double")) for s in sides[i]]
            # Before the first place both are 0, from the last one on both are 1.
            starts = [F.concat(F.array(F.lit(0.0)), u) for u in upto]
            ends = [F.concat(b, F.array(F.lit(1.0))) for b in below]
            apart = F.array_max(F.zip_with(upto[0], upto[1], lambda x, y: F.abs(x - y)))
            most = F.greatest(*[F.array_max(F.zip_with(ends[k], starts[1 - k], lambda x, y: x - y)) for k in (0, 1)])
            error = F.lit(2 * sketches.RANK_ERROR)
            low = F.greatest(F.lit(0.0), F.lit(1.0) - F.greatest(most, apart) - error)
            high = F.least(F.lit(1.0), F.lit(1.0) - apart + error)
        return F.struct(F.lit(columns[i]).alias("column"), F.lit(KS).alias("metric"), low.alias("low"), high.alias("high"))

    return states.select(F.inline(F.array(*[interval(i) for i in range(len(columns))])))


def _tv_of_counts(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total-variation complement from (keys, one row per value with both counts).

    Every key has all rows of both tables, so the totals are the sums of its counts.
    """
    totals = counted.groupBy(*keys).agg(
        F.sum("real").alias("total_real"), F.sum("synthetic").alias("total_synthetic")
    )
    # One row per column or pair.
    shares = counted.join(F.broadcast(totals), list(keys))
    gap = F.abs(
        F.try_divide(F.col("real"), F.col("total_real"))
        - F.try_divide(F.col("synthetic"), F.col("total_synthetic"))
    )
    return shares.groupBy(*keys).agg((F.lit(1.0) - F.sum(gap) / F.lit(2.0)).alias("score"))


def tv_scores(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 - half the summed differences of the value shares, null being a value."""
    counted = _value_counts(both, columns)
    scored = _tv_of_counts(counted, ["column"])
    return scored.select(*_scores(F.col("column"), TV, F.col("score")))


def correlation_scores(both: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(first, second, metric, score): 1 - half the difference of Pearson correlations."""
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    wide = ranks.numbers(both, columns, [IS_REAL])

    by_source = wide.groupBy(IS_REAL).agg(
        *[correlation(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    )

    def of_source(i: int, real: bool) -> Column:
        return F.max(F.when(F.col(IS_REAL) == real, F.col(f"c{i}")))

    scored = by_source.agg(
        *[
            (F.lit(1.0) - F.abs(of_source(i, True) - of_source(i, False)) / F.lit(2.0)).alias(f"p{i}")
            for i in range(len(pairs))
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("first"),
                F.lit(b).alias("second"),
                F.lit(CORRELATION).alias("metric"),
                F.col(f"p{i}").alias("score"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return scored.select(F.inline(rows))


def contingency_scores(
    both: DataFrame, pairs: Sequence[tuple[str, str]], numeric: Sequence[str] = ()
) -> DataFrame:
    """(first, second, metric, score): total-variation complement of the pairs' shares.

    Columns in ``numeric`` are cut into equal ranges between the real least and greatest.
    """
    both = _cut_numbers(both, [c for c in numeric if any(c in p for p in pairs)])
    long = both.select(
        IS_REAL,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).cast("smallint").alias("pair_no"),
                        F.col(a).cast("string").alias("a"),
                        F.col(b).cast("string").alias("b"),
                    )
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        ).alias("pair"),
    ).select(IS_REAL, "pair.*")
    # Rows carry the number of their pair; its names come back to the one row of each pair.
    counted = long.groupBy("pair_no", "a", "b").agg(
        *[c.alias(n) for n, c in _source_counts().items()]
    )
    scored = _tv_of_counts(counted, ["pair_no"])
    names = F.get(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in pairs]), F.col("pair_no"))
    return scored.select(names.alias("of"), "score").select("of.*", F.lit(CONTINGENCY).alias("metric"), "score")


def _cut_numbers(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns:
        return both
    numbers = {c: ranks.as_number(both, c) for c in columns}
    real = F.col(IS_REAL)
    limits = both.agg(
        *[F.min(F.when(real, n)).alias(f"low_{c}") for c, n in numbers.items()],
        *[F.max(F.when(real, n)).alias(f"high_{c}") for c, n in numbers.items()],
    ).first()
    cut = {}
    for c, n in numbers.items():
        low, high = limits[f"low_{c}"], limits[f"high_{c}"]
        if low is None or low == high:
            cut[c] = F.when(n.isNotNull(), F.lit(0))
        else:
            place = F.floor((n - F.lit(low)) * F.lit(PAIR_RANGES / (high - low)))
            cut[c] = F.greatest(F.lit(0), F.least(place, F.lit(PAIR_RANGES - 1)))
    return both.withColumns(cut)


def boundary_scores(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of synthetic values between the real least and greatest, per column.

    The limits are two numbers per column; a second pass over the synthetic rows tests them.
    """
    wide = ranks.numbers(both, columns, [IS_REAL])
    real = F.col(IS_REAL)
    limits = wide.agg(
        *[F.min(F.when(real, F.col(c))).alias(f"low{i}") for i, c in enumerate(columns)],
        *[F.max(F.when(real, F.col(c))).alias(f"high{i}") for i, c in enumerate(columns)],
    ).first()
    inside = []
    for i, c in enumerate(columns):
        low, high = (F.lit(limits[f"{side}{i}"]).cast("double") for side in ("low", "high"))
        ok = F.col(c).between(low, high).cast("double")
        inside.append(F.avg(F.when(~real & F.col(c).isNotNull(), F.coalesce(ok, F.lit(0.0)))).alias(c))
    shares = wide.agg(*inside).unpivot([], list(columns), "column", "score")
    return shares.select(*_scores(F.col("column"), BOUNDARY, F.col("score")))


def category_scores(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of synthetic rows whose value occurs in the real column; null counts as real."""
    counted = _value_counts(both, columns)
    known = (F.col("real") > 0) | F.col("value").isNull()
    kept = F.sum(F.when(known, F.col("synthetic")).otherwise(F.lit(0)))
    return counted.groupBy("column").agg(F.try_divide(kept, F.sum("synthetic")).alias("score")).select(
        *_scores(F.col("column"), CATEGORY, F.col("score"))
    )


def id_scores(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of synthetic rows with an id that no other row has and the real ones' width, per column."""
    texts = both.select(IS_REAL, *[F.col(c).cast("string").alias(c) for c in columns])
    values = texts.unpivot([IS_REAL], list(columns), "column", "value")
    counted = values.groupBy("column", "value").agg(*[c.alias(n) for n, c in _source_counts().items()])
    widths = counted.filter("real > 0").groupBy("column").agg(
        F.min(F.length("value")).alias("least"), F.max(F.length("value")).alias("most"))
    good = (F.col("synthetic") == 1) & F.length("value").between(F.col("least"), F.col("most"))
    # One row of widths per column.
    judged = counted.join(F.broadcast(widths), "column").groupBy("column").agg(
        F.try_divide(F.sum(good.cast("bigint")), F.sum("synthetic")).alias("score"))
    return judged.select(*_scores(F.col("column"), IDS, F.coalesce("score", F.lit(0.0))))


def structure_score(real: DataFrame, synthetic: DataFrame) -> float:
    """Share of columns that both tables have with the same type."""
    ours, theirs = set(real.dtypes), set(synthetic.dtypes)
    return len(ours & theirs) / max(1, len(ours | theirs))


def split_columns(real: DataFrame, metadata: Metadata) -> tuple[list[str], list[str]]:
    """Columns compared as numbers, and columns compared as categories; ids are neither."""
    types = dict(real.dtypes)
    numeric, other = [], []
    for c, spec in metadata.items():
        if c not in types or spec["sdtype"] == ID:
            continue
        as_numbers = spec["sdtype"] == NUMERICAL or (
            spec["sdtype"] == DATETIME and types[c] in DATE_TYPES
        )
        (numeric if as_numbers else other).append(c)
    return numeric, other


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def diagnostic(real: DataFrame, synthetic: DataFrame, metadata: Metadata) -> DataFrame:
    """(column, metric, score): are the synthetic columns and values possible ones?"""
    numeric, other = split_columns(real, metadata)
    both = stack(real, synthetic, [*numeric, *other])
    structure = real.sparkSession.range(1).select(
        *_scores(F.lit("*"), STRUCTURE, F.lit(structure_score(real, synthetic)))
    )
    parts = [structure]
    if numeric:
        parts.append(boundary_scores(both, numeric))
    if other:
        parts.append(category_scores(both, other))
    ids = [c for c, spec in metadata.items() if spec["sdtype"] == ID and c in real.columns]
    if ids:
        parts.append(id_scores(stack(real, synthetic, ids), ids))
    return _union(parts)


def column_shapes(real: DataFrame, synthetic: DataFrame, metadata: Metadata) -> DataFrame:
    """(column, metric, score): how alike the single columns are distributed."""
    numeric, other = split_columns(real, metadata)
    both = stack(real, synthetic, [*numeric, *other])
    parts = []
    if numeric:
        parts.append(ks_scores(both, numeric))
    if other:
        parts.append(tv_scores(both, other))
    return _union(parts)


def column_pairs(
    real: DataFrame,
    synthetic: DataFrame,
    metadata: Metadata,
    pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame | None:
    """(first, second, metric, score): how alike the pairs of columns depend on each other.

    All pairs unless some are named, which saves work on tables of very many columns.
    """
    numeric, other = split_columns(real, metadata)
    chosen = list(combinations([*numeric, *other], 2) if pairs is None else pairs)
    used = [c for c in [*numeric, *other] if any(c in p for p in chosen)]
    both = stack(real, synthetic, used)
    parts = []
    of_numbers = [p for p in chosen if set(p) <= set(numeric)]
    if of_numbers:
        parts.append(correlation_scores(both, of_numbers))
    mixed = [p for p in chosen if p not in of_numbers]
    if mixed:
        parts.append(contingency_scores(both, mixed, numeric))
    return _union(parts) if parts else None


def quality(
    real: DataFrame,
    synthetic: DataFrame,
    metadata: Metadata,
    pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """(property, score): mean of the column scores, of the pair scores, and of both."""
    shapes = column_shapes(real, synthetic, metadata).select(
        F.lit("Column Shapes").alias("property"), "score"
    )
    trends = column_pairs(real, synthetic, metadata, pairs)
    if trends is not None:
        shapes = shapes.unionByName(trends.select(F.lit("Column Pair Trends").alias("property"), "score"))
    by_property = shapes.groupBy("property").agg(F.avg("score").alias("score"))
    overall = by_property.agg(F.lit("Overall").alias("property"), F.avg("score").alias("score"))
    return by_property.unionByName(overall)

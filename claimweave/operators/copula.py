"""Gaussian copula over one table: fit the joint distribution, sample new rows.

Every column gets a marginal: a quantile grid for continuous numbers and dates, the share of
each value for categories and discrete numbers and dates, however many they are (the metadata
tells which, see ``is_discrete``). A row's values are turned
into normal scores by their place in the marginals; the correlation of the scores is the
joint part of the model. Sampling draws correlated normals by row key and goes the way back.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer, StringIndexerModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions import draws, sketches
from claimweave.functions.dates import coerce_date, spark_pattern
from claimweave.functions.normal import literal_array, normal_cdf, normal_level, normal_quantile
from claimweave.operators import ranks
from claimweave.operators.parse import normalise_nulls
from claimweave.operators.profile import DATE_TYPES, is_number
from claimweave.sources.metadata import DATETIME, ID, NUMERICAL, Metadata, is_discrete
from claimweave.sources.storage import written

GRID_STEPS = 1000
# Categories of one column that the model keeps on the driver; more stay a table.
COLLECTED_CATEGORIES = 10_000
# A category with more than this share of the rows is salted in joins.
HOT_SHARE = 0.001
HOT_SALTS = 64
# Correlations are kept to this many places, so that the order in which sums were added up
# on the cluster does not show in the model.
CORRELATION_PLACES = 6
LEAST_EIGENVALUE = 1e-9
# Above this number of columns the k * k correlations are taken as one matrix product.
MOST_CORR_COLUMNS = 12
# Above this number of columns the k * k terms of a draw are added up on Arrow batches.
MOST_MIXED_BY_COLUMN = 30
# Places of a fresh id that are drawn, by base, so that they fit 64 bits; more are filled with zeros.
MOST_ID_PLACES = {10: 18, 36: 12}
DAY_MICROS, SECOND_MICROS = 86400e6, 1e6
MOST_DECIMALS = 6
MOST_EXACT_NUMBER = 2.0**53


@dataclass(frozen=True)
class Grid:
    """Marginal of a continuous column: quantiles at equal steps of probability."""

    column: str
    data_type: str
    null_share: float
    points: list[float]
    # Values are multiples of this, as in the real column; 0 if it has no such unit.
    unit: float = 0.0
    # The rank of each point is off by this share of the rows at most, with 99 % confidence; 0 if exact.
    rank_error: float = 0.0

    @property
    def columns(self) -> list[str]:
        return [self.column]

    def pieces(self) -> tuple[list[float], list[float]]:
        """Distinct lower ends of value ranges and the middle probability of each range."""
        steps = len(self.points) - 1
        first: dict[float, int] = {}
        for i, p in enumerate(self.points[:-1]):
            first.setdefault(p, i)
        starts = list(first)
        ends = [first[p] for p in starts[1:]] + [steps]
        return starts, [(first[p] + e) / (2 * steps) for p, e in zip(starts, ends)]


@dataclass(frozen=True)
class Shares:
    """Marginal of categories or discrete numbers: each value with its count, in order.

    ``columns`` are several for a combination kept whole; a value is then a JSON text.
    Numbers and dates are in ``numbers`` instead of ``values``.
    """

    name: str
    columns: list[str]
    data_types: list[str]
    values: list[str | None]
    counts: list[int]
    numbers: list[float | None] | None = None

    def ends(self) -> list[float]:
        total, so_far, result = sum(self.counts), 0, []
        for n in self.counts:
            so_far += n
            result.append(so_far / total)
        return result

    def middles(self) -> list[float]:
        total, so_far, result = sum(self.counts), 0, []
        for n in self.counts:
            result.append((2 * so_far + n) / (2 * total))
            so_far += n
        return result


@dataclass(frozen=True)
class SharesTable:
    """As ``Shares``, with too many values for the driver: (value, n, before) as a table.

    Values are texts, of numbers and dates too, which come in the order of the numbers.
    """

    name: str
    columns: list[str]
    data_types: list[str]
    table: DataFrame
    total: int
    distinct: int
    hot: list[str | None] = field(default_factory=list)


@dataclass(frozen=True)
class Identifier:
    """Values that do not repeat: sampled as fresh ones, outside the joint distribution."""

    column: str
    data_type: str
    # Of texts: what all begin with, the width of the rest, and its letters (base 10 or 36).
    prefix: str = ""
    width: int = 0
    base: int = 10
    lower: bool = False

    @property
    def columns(self) -> list[str]:
        return [self.column]

    def capacity(self) -> int:
        """Number of different values of this form."""
        if self.data_type == "string":
            return self.base ** min(self.width, MOST_ID_PLACES[self.base])
        return 10 ** self.width


Marginal = Grid | Shares | SharesTable | Identifier


@dataclass(frozen=True)
class CopulaModel:
    column_order: list[str]
    marginals: list[Marginal]
    correlation: np.ndarray
    # Formats of date columns that are text in the table.
    text_dates: dict[str, str] = field(default_factory=dict)

    @property
    def modelled(self) -> list[Marginal]:
        return [m for m in self.marginals if not isinstance(m, Identifier)]

    def factor(self) -> np.ndarray:
        """Lower triangle whose product with its transpose is the correlation."""
        values, vectors = np.linalg.eigh(self.correlation)
        if values.min() < LEAST_EIGENVALUE:
            fixed = (vectors * np.maximum(values, LEAST_EIGENVALUE)) @ vectors.T
            scale = np.sqrt(np.diag(fixed))
            return np.linalg.cholesky(fixed / np.outer(scale, scale))
        return np.linalg.cholesky(self.correlation)


# ---------------------------------------------------------------- fit


def fit(
    df: DataFrame,
    metadata: Metadata,
    fixed_combinations: Sequence[Sequence[str]] = (),
    steps: int = GRID_STEPS,
    exact: bool = True,
) -> CopulaModel:
    """Model of the columns named in ``metadata``.

    Exact grids shuffle the distinct values of the continuous columns. Without ``exact`` they
    come from one mergeable sketch per column, in one pass; how far the points' ranks may be off
    is kept with the grid, and they may differ in that range from run to run.

    Columns of a fixed combination are one categorical together, so only combinations that
    occur are ever sampled. What reaches the driver per column is the grid or at most
    ``COLLECTED_CATEGORIES`` categories.
    """
    wanted = [c for c in df.columns if c in metadata]
    combined = [list(c) for c in fixed_combinations if set(c) <= set(wanted)]
    text_dates = {
        c: metadata[c]["datetime_format"]
        for c in wanted
        if metadata[c]["sdtype"] == DATETIME
        and dict(df.dtypes)[c] == "string"
        and "datetime_format" in metadata[c]
    }
    df = normalise_nulls(df).select(
        *[
            coerce_date(F.col(c), [spark_pattern(text_dates[c])]).alias(c)
            if c in text_dates
            else F.col(c)
            for c in wanted
        ]
    )
    types = dict(df.dtypes)
    inside = {c for group in combined for c in group}
    single = [c for c in wanted if c not in inside]
    numeric = [
        c
        for c in single
        if (metadata[c]["sdtype"] == NUMERICAL and is_number(types[c]))
        or (metadata[c]["sdtype"] == DATETIME and types[c] in DATE_TYPES)
    ]
    ids = [c for c in single if metadata[c]["sdtype"] == ID]
    discrete = [c for c in numeric if is_discrete(metadata[c], types[c])]
    continuous = [c for c in numeric if c not in discrete]
    numbers = (_fit_grids if exact else _sketch_grids)(df, continuous, steps)
    numbers.update(_fit_discrete(df, discrete))
    units = {c: [c] for c in single if c not in numbers and c not in ids}
    units.update({"+".join(group): group for group in combined})
    shares = _fit_shares(df, units)
    by_first = {m.columns[0]: m for m in [*numbers.values(), *shares.values()]}
    by_first.update(_fit_ids(df, ids))
    # A table without rows gives nulls.
    modelled_columns = {c for m in by_first.values() for c in m.columns}
    by_first.update(
        {c: Shares(c, [c], [types[c]], [None], [1]) for c in wanted if c not in modelled_columns}
    )
    marginals = [by_first[c] for c in wanted if c in by_first]
    modelled = [m for m in marginals if not isinstance(m, Identifier)]
    scores, names = normal_scores(df, modelled)
    return CopulaModel(wanted, marginals, correlations(scores, names), text_dates)


def _fit_ids(df: DataFrame, columns: Sequence[str]) -> dict[str, Marginal]:
    """Type, width and letters of id columns, from one aggregation."""
    if not columns:
        return {}
    types = dict(df.dtypes)
    row = df.agg(*[
        F.struct(
            F.min(F.col(c).cast("string")).alias("first"),
            F.max(F.col(c).cast("string")).alias("last"),
            F.max(F.length(F.col(c).cast("string"))).alias("width"),
            F.max(F.col(c).rlike("[A-Z]") if types[c] == "string" else F.lit(False)).alias("upper"),
            F.max(F.abs(F.col(c)).cast("decimal(38,0)") if types[c] != "string" else F.lit(None)).alias("most"),
        ).alias(f"id{i}")
        for i, c in enumerate(columns)
    ]).first()
    result: dict[str, Marginal] = {}
    letters = {}
    for i, c in enumerate(columns):
        r = row[f"id{i}"]
        if types[c] != "string":
            # As many digits as the greatest has, less one where that would leave the type.
            digits = len(str(r["most"] or 0))
            limit = {"tinyint": 2, "smallint": 4, "int": 9, "bigint": 18}.get(types[c], 18)
            result[c] = Identifier(c, types[c], width=min(digits, limit))
            continue
        first, last = r["first"] or "", r["last"] or ""
        shared = next((k for k, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
        letters[c] = (first[:shared], (r["width"] or 0) - shared, not r["upper"])
    if letters:
        rests = df.agg(*[
            F.max(F.substring(F.col(c), F.lit(len(p) + 1), F.length(c)).rlike("[^0-9]")).alias(f"r{i}")
            for i, (c, (p, _, _)) in enumerate(letters.items())
        ]).first()
        for i, (c, (prefix, width, lower)) in enumerate(letters.items()):
            result[c] = Identifier(c, "string", prefix, width, 36 if rests[f"r{i}"] else 10, lower)
    return result


def _fit_grids(df: DataFrame, columns: Sequence[str], steps: int) -> dict[str, Marginal]:
    """Exact grids, from the counts of the distinct values."""
    if not columns:
        return {}
    types = dict(df.dtypes)
    counted = ranks.count_values(ranks.numbers(df, columns), columns, {"n": F.count(F.lit(1))})
    stats = {
        r["column"]: r
        for r in counted.groupBy("column")
        .agg(
            F.count("value").alias("distinct"),
            F.sum("n").alias("total"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            *_unit_tests(F.col("value")),
        )
        .collect()
    }
    grid = ranks.quantiles_of_ranked(ranks.running_counts(counted, ["n"]), steps).collect()  # columns x (steps + 1)
    result: dict[str, Marginal] = {}
    for c, r in stats.items():
        points = [q for _, q in sorted((g["idx"], g["quantile"]) for g in grid if g["column"] == c)]
        result[c] = _grid(c, types[c], r["total"], r["nulls"], points, r)
    return result


def _grid(c: str, data_type: str, total: int, nulls: int, points: list[float], tested: Row, error: float = 0.0) -> Marginal:
    if nulls == total:
        return Shares(c, [c], [data_type], [None], [total], [None])
    return Grid(c, data_type, nulls / total, points, value_unit(tested, data_type), error)


def _sketch_grids(df: DataFrame, columns: Sequence[str], steps: int) -> dict[str, Marginal]:
    """Grids from quantile sketches: no shuffle of values, one state per column and task."""
    if not columns:
        return {}
    types = dict(df.dtypes)
    wide = ranks.numbers(df, columns)
    row = wide.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[sketches.quantile_points(sketches.quantile_state(F.col(c)), steps).alias(f"q{i}") for i, c in enumerate(columns)],
        *[F.struct(*_unit_tests(F.col(c))).alias(f"t{i}") for i, c in enumerate(columns)],
    ).first()
    if not row["n"]:
        return {}
    return {
        c: _grid(c, types[c], row["n"], row["n"] - row[f"n{i}"], list(row[f"q{i}"] or []), row[f"t{i}"], sketches.RANK_ERROR)
        for i, c in enumerate(columns)
    }


def _fit_discrete(df: DataFrame, columns: Sequence[str]) -> dict[str, Marginal]:
    """Shares of the values of discrete numbers and dates, in the order of the numbers.

    Up to ``COLLECTED_CATEGORIES`` values are collected, more stay a table; both hold the same
    values, counts and order. Numbers beyond 2**53 stay a table too, as doubles merge some of them.
    """
    if not columns:
        return {}
    types = dict(df.dtypes)
    pairs = df.select(*[
        F.struct(ranks.as_number(df, c).alias("number"), F.col(c).cast("string").alias("value")).alias(c) for c in columns
    ])
    long = pairs.unpivot([], list(columns), "unit", "pair").select("unit", "pair.value", "pair.number")
    counted = written(
        long.groupBy("unit", "value").agg(F.max("number").alias("number"), F.count(F.lit(1)).alias("n")), "numbers")
    sizes = {
        r["unit"]: r
        for r in counted.groupBy("unit")
        .agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"), F.max(F.abs("number")).alias("most"))
        .collect()
    }
    collected = {
        c: [] for c, r in sizes.items()
        if r["distinct"] <= COLLECTED_CATEGORIES and (r["most"] or 0.0) < MOST_EXACT_NUMBER
    }
    if collected:
        for r in counted.filter(F.col("unit").isin(list(collected))).collect():
            collected[r["unit"]].append((r["number"], r["n"]))
    result: dict[str, Marginal] = {}
    for c, r in sizes.items():
        if c in collected:
            rows = sorted(collected[c], key=lambda v: ranks.LOWEST if v[0] is None else v[0])
            result[c] = Shares(c, [c], [types[c]], [None] * len(rows), [n for _, n in rows], [v for v, _ in rows])
        else:
            table = counted.filter(F.col("unit") == c).select("value", "n", "number")
            result[c] = _as_table(c, [c], [types[c]], table, r["total"], r["distinct"], ["number", "value"])
    return result


def _as_table(
    name: str, columns: list[str], data_types: list[str], table: DataFrame, total: int, distinct: int, order: list[str]
) -> SharesTable:
    hot = table.filter(F.col("n") > HOT_SHARE * total)  # fewer than 1 / HOT_SHARE
    hot_values = [r["value"] for r in hot.select("value").collect()]
    return SharesTable(name, columns, data_types, sorted_running_counts(table, order), total, distinct, hot_values)


def _unit_tests(value: Column) -> list[Column]:
    """Whether all values of a column are multiples of a day, a second, 1, 0.1, 0.01 ..."""
    tests = {"day": value % DAY_MICROS == 0, "second": value % SECOND_MICROS == 0}
    for places in range(MOST_DECIMALS + 1):
        off = F.abs(value - F.round(value, places))
        tests[f"p{places}"] = off <= F.greatest(F.abs(value), F.lit(1.0)) * 1e-12
    return [F.coalesce(F.min(t), F.lit(True)).alias(name) for name, t in tests.items()]


def value_unit(tested: Row, data_type: str) -> float:
    """Largest usual unit that all values are multiples of; 0 if there is none."""
    if data_type in DATE_TYPES:
        return DAY_MICROS if tested["day"] else SECOND_MICROS if tested["second"] else 1.0
    places = (p for p in range(MOST_DECIMALS + 1) if tested[f"p{p}"])
    return next((10.0**-p for p in places), 0.0)


def unit_key(columns: Sequence[str]) -> Column:
    """A categorical's value as one text: the column's own, or the combination as JSON."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))


def _fit_shares(df: DataFrame, units: dict[str, list[str]]) -> dict[str, Marginal]:
    if not units:
        return {}
    types = dict(df.dtypes)
    texts = df.select(*[unit_key(cols).alias(name) for name, cols in units.items()])
    long = texts.unpivot([], list(units), "unit", "value")
    counted = written(long.groupBy("unit", "value").agg(F.count(F.lit(1)).alias("n")), "shares")
    sizes = {
        r["unit"]: r
        for r in counted.groupBy("unit")
        .agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"))
        .collect()
    }
    small = [u for u in units if u in sizes and sizes[u]["distinct"] <= COLLECTED_CATEGORIES]
    collected: dict[str, list] = {u: [] for u in small}
    if small:
        for r in counted.filter(F.col("unit").isin(small)).collect():
            collected[r["unit"]].append((r["value"], r["n"]))
    result: dict[str, Marginal] = {}
    for name, cols in units.items():
        data_types = [types[c] for c in cols]
        if name in collected:
            rows = sorted(collected[name], key=lambda r: (r[0] is not None, r[0] or ""))
            result[name] = Shares(name, list(cols), data_types, [v for v, _ in rows], [n for _, n in rows])
        elif name in sizes:
            table = counted.filter(F.col("unit") == name).select("value", "n")
            result[name] = _as_table(
                name, cols, data_types, table, sizes[name]["total"], sizes[name]["distinct"], ["value"])
    return result


def shares_table(spark: SparkSession, m: Shares | SharesTable) -> DataFrame:
    """(value, n, before) of a categorical marginal, wherever it is kept."""
    if isinstance(m, SharesTable):
        return m.table
    before = itertools.accumulate(m.counts[:-1], initial=0)
    return spark.createDataFrame(list(zip(m.values, m.counts, before)), "value string, n long, before long")


def sorted_running_counts(table: DataFrame, order: Sequence[str] = ("value",)) -> DataFrame:
    """(value, n) -> (value, n, before): counts summed up in the given order, null first.

    That is the order of collected categories too, so the model does not depend on where they
    are kept. Ranges of values are cut by sampling and written with their number; the range totals
    are summed up and joined back, so no window spans the table.
    """
    ranges = ranks.range_count(table.sparkSession)
    by = [F.col(c).asc_nulls_first() for c in order]
    ordered = table.repartitionByRange(ranges, *by)
    ranged = written(ordered.withColumn("range_no", F.spark_partition_id()), "ranges")
    lower = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    starts = (
        ranged.groupBy("range_no")
        .agg(F.sum("n").alias("in_range"))
        .select("range_no", F.coalesce(F.sum("in_range").over(lower), F.lit(0)).alias("start"))
    )
    inside = (
        Window.partitionBy("range_no")
        .orderBy(*by)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = ranged.join(F.broadcast(starts), "range_no").select(
        "value",
        "n",
        (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"),
    )
    return written(counted, "running_counts")


def normal_scores(df: DataFrame, marginals: Sequence[Marginal]) -> tuple[DataFrame, list[str]]:
    """One column of normal scores per marginal, named as in the list returned."""
    names = [f"z{i}" for i in range(len(marginals))]
    grids = [(n, m) for n, m in zip(names, marginals) if isinstance(m, Grid)]
    stepped = [
        (n, m) for n, m in zip(names, marginals) if isinstance(m, Shares) and m.numbers is not None
    ]
    numeric = [
        (n, m.columns[0], m.pieces()[0], _grid_levels(m), _grid_null_level(m)) for n, m in grids
    ] + [(n, m.columns[0], *_stepped_levels(m)) for n, m in stepped]
    result = df
    if numeric:
        result = result.withColumns(
            {f"_{n}": ranks.as_number(df, c) for n, c, *_ in numeric}
        )
        result = Bucketizer(
            splitsArray=[ranks.splits_from(starts[1:] or [starts[0]]) for _, _, starts, _, _ in numeric],
            inputCols=[f"_{n}" for n, *_ in numeric],
            outputCols=[f"_{n}_at" for n, *_ in numeric],
        ).transform(result)
        result = result.withColumns(
            {
                n: F.when(F.col(f"_{n}").isNull(), F.lit(null_level)).otherwise(
                    F.element_at(
                        literal_array(levels, "double"),
                        F.least(F.col(f"_{n}_at").cast("int") + F.lit(1), F.lit(len(levels))),
                    )
                )
                for n, _, _, levels, null_level in numeric
            }
        )
    categories = [
        (n, m) for n, m in zip(names, marginals) if isinstance(m, Shares) and m.numbers is None
    ]
    if categories:
        result = _category_scores(result, categories)
    for n, m in zip(names, marginals):
        if isinstance(m, SharesTable):
            result = _table_scores(result, n, m)
    return result.select(*names), names


def _grid_levels(m: Grid) -> list[float]:
    p = m.null_share
    return [normal_level(p + (1.0 - p) * u) for u in m.pieces()[1]]


def _grid_null_level(m: Grid) -> float:
    return normal_level(m.null_share / 2.0) if m.null_share > 0 else 0.0


def _stepped_levels(m: Shares) -> tuple[list[float], list[float], float]:
    levels = [normal_level(u) for u in m.middles()]
    if m.numbers[0] is None:
        return m.numbers[1:] or [0.0], levels[1:] or [0.0], levels[0]
    return m.numbers, levels, 0.0


def _category_scores(df: DataFrame, categories: Sequence[tuple[str, Shares]]) -> DataFrame:
    """Scores of all collected categoricals, by hash lookup of their indices in one projection."""
    known = [[v for v in m.values if v is not None] for _, m in categories]
    named = [(n, values) for (n, _), values in zip(categories, known) if values]
    result = df.withColumns({f"_{n}": unit_key(m.columns) for n, m in categories})
    if named:
        # Null, which is the only value not among the labels, gets the index after the last.
        indexer = StringIndexerModel.from_arrays_of_labels(
            [values for _, values in named], [f"_{n}" for n, _ in named], handleInvalid="keep"
        )
        result = indexer.setOutputCols([f"_{n}_at" for n, _ in named]).transform(result)
    scores = {}
    for n, m in categories:
        levels = {v: normal_level(u) for v, u in zip(m.values, m.middles())} if len(m.values) > 1 else {}
        ordered = [levels.get(v, 0.0) for v in m.values if v is not None] + [levels.get(None, 0.0)]
        at = F.col(f"_{n}_at").cast("int") + F.lit(1) if len(ordered) > 1 else F.lit(1)
        scores[n] = F.element_at(literal_array(ordered, "double"), at)
    return result.withColumns(scores)


def _table_scores(df: DataFrame, name: str, m: SharesTable) -> DataFrame:
    """Score through a shuffled join; values that many rows share are spread over salts."""
    middle = (F.col("before") + F.col("n") / F.lit(2.0)) / F.lit(float(m.total))
    table = m.table.select(F.col("value").alias("_value"), normal_quantile(middle).alias(name))

    def is_hot(value: Column) -> Column:
        texts = [v for v in m.hot if v is not None]
        null_hot = value.isNull() & F.lit(None in m.hot)
        return F.coalesce(value.isin(texts) if texts else F.lit(False), F.lit(False)) | null_hot

    none = F.lit(0).cast("bigint")
    # By the place of the row: equal rows, which a hot value has many of, get different salts.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(HOT_SALTS))
    rows = df.withColumn("_key", unit_key(m.columns))
    rows = rows.withColumn("_salt", F.when(is_hot(F.col("_key")), salt).otherwise(none))
    salts = F.when(
        is_hot(F.col("_value")), F.sequence(none, F.lit(HOT_SALTS - 1).cast("bigint"))
    ).otherwise(F.array(none))
    table = table.withColumn("_table_salt", F.explode(salts))
    joined = rows.join(
        table,
        F.col("_key").eqNullSafe(F.col("_value")) & (F.col("_salt") == F.col("_table_salt")),
        "left",
    )
    return joined.drop("_key", "_salt", "_value", "_table_salt")


def correlations(scores: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Pearson correlations of the score columns; 0 where a column is constant."""
    k = len(names)
    matrix = np.eye(k)
    if k < 2 or scores.limit(2).count() < 2:
        return matrix
    if k <= MOST_CORR_COLUMNS:
        pairs = list(combinations(range(k), 2))
        # Scores have no nulls, so one spread per column serves all its pairs.
        row = scores.agg(
            *[F.stddev_pop(n).alias(f"s{i}") for i, n in enumerate(names)],
            *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs],
        ).first()
        for i, j in pairs:
            spread = (row[f"s{i}"] or 0.0) * (row[f"s{j}"] or 0.0)
            matrix[i, j] = matrix[j, i] = row[f"c{i}_{j}"] / spread if spread > 0 else 0.0
    else:
        vectors = scores.select(array_to_vector(F.array(*names)).alias("features"))
        matrix = Correlation.corr(vectors, "features").first()[0].toArray()
    matrix = np.nan_to_num(matrix, nan=0.0)
    np.fill_diagonal(matrix, 1.0)
    return np.round(matrix, CORRELATION_PLACES)


# ---------------------------------------------------------------- sample


def sample(model: CopulaModel, rows: DataFrame, key: Sequence[str], seed: int = 0) -> DataFrame:
    """One synthetic row per row of ``rows``: its key columns and the model's columns.

    Draws depend on seed and key only. ``rows`` may be the real table's own keys, which
    keeps its number of rows per file, or ``spark.range(n)``.
    """
    taken = {c.lower() for c in model.column_order} & {k.lower() for k in key}
    if taken:
        raise ValueError(f"key columns are also columns of the model: {sorted(taken)}")
    keys = [F.col(k) for k in key]
    modelled = model.modelled
    result = rows.select(*key)
    if any(isinstance(m, Identifier) for m in model.marginals):
        result = numbered(result, "_number")
    if modelled:
        result = _uniform_columns(result, keys, model.factor(), seed)
    shares = [(i, m) for i, m in enumerate(modelled) if isinstance(m, Shares)]
    several = [(i, m) for i, m in shares if len(m.values) > 1]
    if several:
        result = Bucketizer(
            splitsArray=[ranks.splits_from(m.ends()[:-1]) for _, m in several],
            inputCols=[f"_u{i}" for i, _ in several],
            outputCols=[f"_at{i}" for i, _ in several],
        ).transform(result)
    columns: dict[str, Column] = {}
    for i, m in enumerate(modelled):
        if isinstance(m, Grid):
            columns[m.column] = _grid_value(m, F.col(f"_u{i}"))
        elif isinstance(m, Shares):
            at = F.col(f"_at{i}").cast("int") + F.lit(1) if len(m.values) > 1 else F.lit(1)
            if m.numbers is not None:
                number = F.element_at(literal_array(m.numbers, "double"), at)
                columns[m.columns[0]] = ranks.from_number(number, m.data_types[0])
            else:
                value = F.element_at(literal_array(m.values, "string"), at)
                columns.update(_restored(m, value))
        else:
            result = draw_from_table(result, f"_u{i}", m, f"_v{i}")
            columns.update(_restored(m, F.col(f"_v{i}")))
    ids = [m for m in model.marginals if isinstance(m, Identifier)]
    columns.update({m.column: _fresh_id(m, F.col("_number"), seed) for m in ids})
    for c, strftime in model.text_dates.items():
        columns[c] = F.date_format(columns[c], spark_pattern(strftime))
    return result.select(*key, *[columns[c].alias(c) for c in model.column_order])


def _uniform_columns(
    rows: DataFrame, keys: list[Column], factor: np.ndarray, seed: int
) -> DataFrame:
    """Add ``_u0`` ...: uniforms with the copula's dependence."""
    k = len(factor)
    normals: dict[str, Column] = {}
    digests = {f"_d{p}": draws.key_hash(seed, f"normal{p}", keys) for p in range((k + 1) // 2)}
    for p in range((k + 1) // 2):
        pair = draws.normal_pair(F.col(f"_d{p}"))
        for side in range(2):
            if 2 * p + side < k:
                normals[f"_e{2 * p + side}"] = pair[side]
    independent = rows.withColumns(digests).withColumns(normals)
    if k <= MOST_MIXED_BY_COLUMN:
        mixed = independent.withColumns({f"_z{i}": _mixture(factor[i, : i + 1]) for i in range(k)})
        scores = [F.col(f"_z{i}") for i in range(k)]
    else:
        several = F.array(*[F.col(f"_e{i}") for i in range(k)])
        mixed = independent.withColumn("_z", mixing_by_array(factor)(several))
        scores = [F.element_at("_z", i + 1) for i in range(k)]
    uniforms = {f"_u{i}": normal_cdf(z) for i, z in enumerate(scores)}
    return mixed.withColumns(uniforms).select(*rows.columns, *uniforms)


def _mixture(weights: np.ndarray) -> Column:
    terms = [F.col(f"_e{j}") * F.lit(float(w)) for j, w in enumerate(weights) if w != 0.0]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def mixing_by_array(factor: np.ndarray):
    """The factor times an array column, for so many columns that k * k terms are no plan.

    Terms are added in the order of the columns, so that a row's result does not depend on
    the batch it comes in.
    """

    @F.pandas_udf("array<double>")
    def mixed(normals: pd.Series) -> pd.Series:
        draws_of_rows = np.vstack(normals.to_numpy())
        total = np.zeros_like(draws_of_rows)
        for j in range(len(factor)):
            total += draws_of_rows[:, j : j + 1] * factor[:, j]
        return pd.Series(list(total))

    return mixed


def _grid_value(m: Grid, u: Column) -> Column:
    """Value at probability ``u``, linear between the grid points, in the column's unit."""
    steps = len(m.points) - 1
    share = (u - F.lit(m.null_share)) / F.lit(1.0 - m.null_share) if m.null_share > 0 else u
    position = share * F.lit(float(steps))
    at = F.greatest(F.lit(0), F.least(F.floor(position), F.lit(steps - 1))).cast("int")
    points = literal_array(m.points, "double")
    low, high = F.element_at(points, at + F.lit(1)), F.element_at(points, at + F.lit(2))
    value = low + (high - low) * (position - at)
    if m.unit >= 1.0:
        value = F.round(value / F.lit(m.unit)) * F.lit(m.unit)
    elif m.unit > 0.0:
        value = F.round(value, round(-math.log10(m.unit)))
    value = ranks.from_number(value, m.data_type)
    return F.when(u >= m.null_share, value) if m.null_share > 0 else value


def _restored(m: Shares | SharesTable, value: Column) -> dict[str, Column]:
    """The typed columns of a categorical's text."""
    if len(m.columns) == 1:
        return {m.columns[0]: value.cast(m.data_types[0])}
    parts = F.from_json(value, "array<string>")
    return {
        c: F.element_at(parts, i + 1).cast(t)
        for i, (c, t) in enumerate(zip(m.columns, m.data_types))
    }


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a number from 0 to n - 1: the place in the partition after the rows before it.

    ``rows`` must be a table on storage or made by number, as its partitions are counted first.
    """
    placed = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    shifts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")).select(
        "_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift"))
    return placed.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_id") + F.col("_shift")).drop(
        "_id", "_part", "_shift")


def _fresh_id(m: Identifier, number: Column, seed: int) -> Column:
    """A value of the column's form, another one for each row number below the capacity.

    Numbers are permuted by ``(a * number + b) mod capacity`` with a and the capacity coprime.
    Rows beyond the capacity (more rows than values of this form) stop the job.
    """
    capacity = m.capacity()
    drawn = random.Random(f"{seed}|{m.column}")
    factor = next(a for a in iter(lambda: drawn.randrange(capacity // 3, capacity) | 1, None)
                  if math.gcd(a, capacity) == 1) if capacity > 10 else 1
    wide = "decimal(38,0)"
    place = F.pmod(number.cast(wide) * F.lit(factor).cast(wide) + F.lit(drawn.randrange(capacity)).cast(wide),
                   F.lit(capacity).cast(wide)).cast("bigint")
    message = F.lit(f"more rows than values of the form of column {m.column}")
    place = F.when(number < F.lit(capacity), place).otherwise(F.raise_error(message).cast("bigint"))
    if m.data_type != "string":
        return place.cast(m.data_type)
    text = F.conv(place.cast("string"), 10, m.base)
    rest = F.lpad(F.lower(text) if m.lower else text, m.width, "0")
    return F.concat(F.lit(m.prefix), rest) if m.width else F.lit(m.prefix)


def draw_from_table(rows: DataFrame, u: str, m: SharesTable, name: str) -> DataFrame:
    """Add the value whose slice of [0, 1) holds the uniform ``u``, from a large table.

    Draws and slices are cut into ranges that hold few of either, slices over a cut are
    repeated on both sides, and a window per range carries the slice forward to the draws
    behind its start. No draw is ever paired with more than its own slice.
    """
    spark = rows.sparkSession
    ranges = ranks.range_count(spark)
    total = m.total
    by_slices = m.table.agg(
        F.percentile_approx("before", [i / ranges for i in range(1, ranges)], 10 * ranges)
    ).first()[0]
    by_draws = [total * i // ranges for i in range(1, ranges)]
    cuts = sorted({c for c in [*by_slices, *by_draws] if 0 < c < total})
    starts = [0, *cuts]

    position = F.least(F.floor(F.col(u) * F.lit(float(total))), F.lit(total - 1)).cast("bigint")
    drawn = _in_range(rows.withColumn("_position", position), "_position", "_range", cuts)
    slices = m.table.withColumn("_last", F.col("before") + F.col("n") - F.lit(1))
    slices = _in_range(_in_range(slices, "before", "_first_range", cuts), "_last", "_last_range", cuts)
    slices = slices.withColumn("_range", F.explode(F.sequence("_first_range", "_last_range")))
    range_start = F.element_at(literal_array(starts, "bigint"), F.col("_range") + F.lit(1))
    slices = slices.select(
        "_range",
        F.greatest(F.col("before"), range_start).alias("_position"),
        F.lit(0).alias("_is_draw"),
        F.struct(F.col("value")).alias("_slice"),
    )
    both = drawn.withColumn("_is_draw", F.lit(1)).unionByName(slices, allowMissingColumns=True)
    so_far = (
        Window.partitionBy("_range")
        .orderBy("_position", "_is_draw")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = both.withColumn("_found", F.last("_slice", ignorenulls=True).over(so_far))
    return found.filter(F.col("_is_draw") == 1).select(
        *rows.columns, F.col("_found.value").alias(name)
    )


def _in_range(df: DataFrame, column: str, name: str, cuts: list[int]) -> DataFrame:
    if not cuts:
        return df.withColumn(name, F.lit(0))
    out = Bucketizer(
        splits=ranks.splits_from(cuts), inputCol=f"{column}_number", outputCol=f"{name}_number"
    ).transform(df.withColumn(f"{column}_number", F.col(column).cast("double")))
    return out.withColumn(name, F.col(f"{name}_number").cast("int")).drop(
        f"{column}_number", f"{name}_number"
    )

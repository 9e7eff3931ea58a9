"""Column profiles: non-null counts and kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.dates import DEFAULT_FORMATS, STRFTIME_TO_SPARK, coerce_date
from claimweave.functions.statistics import distinct_estimate
from claimweave.sources.metadata import CATEGORICAL, DATETIME, ID, NUMERICAL, Metadata

DATE_TYPES = ("date", "timestamp", "timestamp_ntz")
INTEGER_TYPES = ("tinyint", "smallint", "int", "bigint")

# Integers with at most this many distinct values are codes rather than quantities.
MOST_CODES = 10
# Sketched share of distinct values from which a column's values are counted exactly; far enough
# below 1 that no column without repeats is missed.
SHORTLIST_SHARE = 0.9


def non_null_counts(df: DataFrame) -> DataFrame:
    """(column, non_null) in one pass over the table."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "non_null")


def is_number(dtype: str) -> bool:
    return dtype in ("float", "double") or dtype.startswith("decimal") or dtype in INTEGER_TYPES


def _votes(df: DataFrame, column: str, formats: Sequence[str]) -> Column:
    """Per format the number of texts of a column that are dates in it."""
    if dict(df.dtypes)[column] != "string":
        return F.array(*[F.lit(0).cast("bigint") for _ in formats])
    return F.array(*[F.count(coerce_date(F.col(column), [f])) for f in formats])


def format_votes(df: DataFrame, date_formats: Sequence[str] = DEFAULT_FORMATS) -> DataFrame:
    """(column, datetime_format, votes, won) of every text column and format, in one pass.

    The format of most texts wins, of several the first in ``date_formats``; without any date none does.
    """
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, datetime_format string, votes long, won boolean")
    votes = df.agg(*[_votes(df, c, date_formats).alias(c) for c in texts]).unpivot([], texts, "column", "all")
    names = F.array(*[F.lit(_strftime(f)) for f in date_formats])
    counted = votes.select("column", "all", F.posexplode("all").alias("at", "votes"))
    return counted.select(
        "column", F.element_at(names, F.col("at") + 1).alias("datetime_format"), "votes",
        ((F.col("votes") > 0) & (F.array_position("all", F.array_max("all")) == F.col("at") + 1)).alias("won"))


def column_kinds(
    df: DataFrame, exact: bool = False, date_formats: Sequence[str] = DEFAULT_FORMATS
) -> DataFrame:
    """(column, kind, non_null, n_distinct, datetime_format, format_conflicts) of every column.

    Dates and texts that all parse as dates are ``datetime``; whole numbers and texts without
    repeats are ``id``; other numbers are ``numerical`` unless they are a few integer codes;
    the rest is ``categorical``. Texts may parse in several formats: the one of most texts is the column's
    (see ``format_votes``), and ``format_conflicts`` counts the texts that it does not fit. Whether a column has
    repeats is always known exactly: a sketch in the one pass over the table tells which columns are
    worth counting, and one more pass counts all of these. ``exact`` gives exact numbers of distinct
    values for all columns too.
    """
    types = dict(df.dtypes)
    no_sketch = F.lit(0).cast("bigint")
    parsed = lambda c: F.count(coerce_date(F.col(c), date_formats)) if types[c] == "string" else no_sketch
    stats = df.agg(
        *[
            F.struct(
                F.count(c).alias("non_null"),
                (no_sketch if exact else distinct_estimate(F.col(c))).alias("n_distinct"),
                parsed(c).alias("n_dates"),
                _votes(df, c, date_formats).alias("votes"),
                F.lit(types[c]).alias("data_type"),
            ).alias(c)
            for c in df.columns
        ]
    ).unpivot([], df.columns, "column", "stat")
    stats = stats.select("column", "stat.*")
    if exact:
        counted = list(df.columns)
    else:
        stats = df.sparkSession.createDataFrame(stats.collect(), stats.schema)  # one row per column
        near = (F.col("non_null") > 1) & (F.col("n_distinct") >= F.col("non_null") * F.lit(SHORTLIST_SHARE))
        could = F.col("data_type").isin("string", *INTEGER_TYPES)
        counted = [r["column"] for r in stats.filter(near & could).collect()]
    stats = stats.withColumnRenamed("n_distinct", "sketched").join(
        F.broadcast(_distinct_counts(df, counted)), "column", "left"
    ).withColumn("n_distinct", F.coalesce("exactly", "sketched" if not exact else no_sketch))

    dtype, non_null, n_distinct = F.col("data_type"), F.col("non_null"), F.col("n_distinct")
    integer = dtype.isin(*INTEGER_TYPES)
    number = integer | dtype.isin("float", "double") | dtype.startswith("decimal")
    text_date = (dtype == "string") & (non_null > 0) & (F.col("n_dates") == non_null)
    unique = (non_null > 1) & (F.col("exactly") == non_null)
    kind = (
        F.when(dtype.isin(*DATE_TYPES) | text_date, F.lit(DATETIME))
        .when((integer | (dtype == "string")) & unique, F.lit(ID))
        .when(integer & (n_distinct <= MOST_CODES), F.lit(CATEGORICAL))
        .when(number, F.lit(NUMERICAL))
        .otherwise(F.lit(CATEGORICAL))
    )
    names = F.array(*[F.lit(_strftime(f)) for f in date_formats])
    most = F.array_max("votes")
    text_format = F.when(text_date, F.element_at(names, F.array_position("votes", most).cast("int")))
    return stats.select(
        "column", kind.alias("kind"), "non_null", "n_distinct", text_format.alias("datetime_format"),
        F.when(text_date, non_null - most).otherwise(no_sketch).alias("format_conflicts"),
    )


def _distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, exactly): distinct non-null values of all columns, by one scan and one shuffle.

    Values go by their column's number and 128 bits of hash; equal ones are merged before the shuffle.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, exactly long")
    keys = F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(
            F.lit(i).alias("at"), F.xxhash64(F.col(c)).alias("h1"), F.xxhash64(F.lit(1), F.col(c), F.lit(2)).alias("h2")))
        for i, c in enumerate(columns)
    ])
    values = df.select(F.explode(F.array_compact(keys)).alias("key")).select("key.*").distinct()
    names = F.array(*[F.lit(c) for c in columns])
    return values.groupBy("at").agg(F.count(F.lit(1)).alias("exactly")).select(
        F.element_at(names, F.col("at") + 1).alias("column"), "exactly")


def _strftime(pattern: str) -> str:
    for code, letters in STRFTIME_TO_SPARK.items():
        pattern = pattern.replace(letters, code)
    return pattern


def detect_metadata(
    df: DataFrame, exact: bool = False, date_formats: Sequence[str] = DEFAULT_FORMATS
) -> Metadata:
    """Kinds of all columns as a mapping, in the table's column order."""
    found = {r["column"]: r for r in column_kinds(df, exact, date_formats).collect()}
    metadata: Metadata = {}
    for c in df.columns:
        metadata[c] = {"sdtype": found[c]["kind"]}
        if found[c]["datetime_format"]:
            metadata[c]["datetime_format"] = found[c]["datetime_format"]
    return metadata

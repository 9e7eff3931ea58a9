"""Column metadata: kinds of columns, kept as numbered JSON versions."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPEC_VERSION = "SINGLE_TABLE_V1"
DOCUMENT_SCHEMA = (
    "METADATA_SPEC_VERSION string, "
    "columns map<string, struct<sdtype: string, datetime_format: string, distribution: string>>"
)

CATEGORICAL = "categorical"
NUMERICAL = "numerical"
DATETIME = "datetime"
ID = "id"

# How numbers and dates are distributed. Discrete ones only take values that occur, however many
# those are; continuous ones take any value between them.
DISCRETE = "discrete"
CONTINUOUS = "continuous"
DISCRETE_TYPES = ("tinyint", "smallint", "int", "bigint", "date")

# Column name -> {"sdtype": kind, "datetime_format": strftime format, if a date,
# "distribution": discrete or continuous, if a number or date; by default as ``is_discrete`` has it}
Metadata = dict[str, dict[str, str]]


def latest_versions(versions: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Per key the last version reachable from 1 without a gap, null if 1 is missing.

    A version is the last one if its successor does not exist, so every version marks
    itself and its predecessor, and the least unsucceeded version is the answer. Two
    aggregations; no group's versions are ever sorted or gathered.
    """
    marks = F.explode(
        F.array(
            F.struct(F.col(version).alias("v"), F.lit(True).alias("present")),
            F.struct((F.col(version) - 1).alias("v"), F.lit(False).alias("present")),
        )
    )
    by_version = (
        versions.select(*keys, marks.alias("mark"))
        .groupBy(*keys, F.col("mark.v").alias("v"))
        .agg(
            F.max(F.col("mark.present")).alias("present"),
            F.max(~F.col("mark.present")).alias("succeeded"),
        )
    )
    is_last = F.col("present") & ~F.col("succeeded") & (F.col("v") >= 1)
    return by_version.groupBy(*keys).agg(
        F.when(
            F.max(F.when(F.col("v") == 1, F.col("present"))),
            F.min(F.when(is_last, F.col("v"))),
        ).alias("latest_version")
    )


def version_of(path, base: str):
    """Version number in a path ``<base>_v<N>.json``, which may be a folder of parts."""
    pattern = rf"{base}_v([1-9][0-9]*)\.json(/[^/]*)?$"
    return F.regexp_extract(path, pattern, 1)


def metadata_path(base: str, kind: str, version: int) -> str:
    return f"{base}_{kind}_v{version}.json"


def latest_metadata_version(spark: SparkSession, base: str, kind: str) -> int | None:
    """Latest contiguous version on storage, or None. Only the listing is read."""
    name = f"{base.rstrip('/').rsplit('/', 1)[-1]}_{kind}"
    try:
        files = spark.read.format("binaryFile").load(f"{base}_{kind}_v*.json").select("path")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    found = files.select(
        F.lit(kind).alias("kind"),
        F.nullif(version_of(F.col("path"), _quoted(name)), F.lit("")).cast("int").alias("version"),
    ).filter("version is not null")
    row = latest_versions(found, ["kind"]).first()
    return row["latest_version"] if row else None


def is_discrete(spec: dict[str, str], data_type: str) -> bool:
    """By the metadata; without an entry there whole numbers and days are discrete, all else is not."""
    found = spec.get("distribution")
    if found not in (None, DISCRETE, CONTINUOUS):
        raise ValueError(f"unknown distribution: {found}")
    return found == DISCRETE if found else data_type in DISCRETE_TYPES


def _quoted(name: str) -> str:
    return "\\Q" + name + "\\E"


def read_metadata_table(spark: SparkSession, path: str) -> DataFrame:
    """(column, sdtype, datetime_format, distribution) of one metadata document."""
    document = spark.read.text(path, wholetext=True).select(
        F.from_json("value", DOCUMENT_SCHEMA).alias("document")
    )
    return document.select(F.explode("document.columns").alias("column", "spec")).select(
        "column", "spec.sdtype", "spec.datetime_format", "spec.distribution"
    )


def read_metadata(spark: SparkSession, path: str) -> Metadata:
    """Metadata as a mapping; it has one entry per column of a table."""
    return {
        r["column"]: {k: v for k, v in r.asDict().items() if k != "column" and v is not None}
        for r in read_metadata_table(spark, path).collect()
    }


def save_metadata(spark: SparkSession, base: str, kind: str, metadata: Metadata) -> str:
    """Write the next version and return its path. An existing path is never replaced."""
    version = (latest_metadata_version(spark, base, kind) or 0) + 1
    path = metadata_path(base, kind, version)
    document = json.dumps({"METADATA_SPEC_VERSION": SPEC_VERSION, "columns": metadata}, indent=4)
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.mode("error").text(path)
    return path


def override_kind(metadata: Metadata, columns: list[str], kind: str = CATEGORICAL) -> Metadata:
    """Set the kind of ``columns``, only if the table has all of them."""
    if not set(columns) <= set(metadata):
        return metadata
    return {c: ({"sdtype": kind} if c in columns else spec) for c, spec in metadata.items()}

"""Layout tables: which field lies where on a line."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns of a layout file ("DataTtype" is spelled so in the files).
LAYOUT_COLUMNS = {
    "ColID": "int",
    "Column_Name": "string",
    "DataTtype": "string",
    "Length": "int",
    "Type": "string",
    "IsSensitive": "string",
    "Block_ID": "string",
}
ROW = "Row"
HEADER_SECTION = "HDR"
DETAIL_SECTION = "DE"
SENSITIVE_MARKS = ("y", "yes", "true", "1")


@dataclass(frozen=True)
class Field:
    """One field of a line; ``start`` counts from 1."""

    name: str
    start: int
    length: int
    sensitive: bool = False


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Layout file as a table, with ``Row``, the place of a row in the file.

    Columns a file variant lacks are null. The file is read whole, in one task, as its order counts.
    """
    raw = strip_column_names(spark.read.option("header", True).csv(path))
    columns = []
    for name, data_type in LAYOUT_COLUMNS.items():
        value = F.trim(F.col(name)) if name in raw.columns else F.lit(None)
        columns.append(value.cast(data_type).alias(name))
    return raw.coalesce(1).select(*columns, F.monotonically_increasing_id().alias("Row"))


def section_of(layout: DataFrame, section: str) -> DataFrame:
    return layout.filter(F.col("Type") == section)


def with_offsets(layout: DataFrame) -> DataFrame:
    """Add ``Start`` (from 1): running sum of the widths of the rows before, within each section."""
    before = (
        Window.partitionBy("Type")
        .orderBy(ROW)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum("Length").over(before), F.lit(0)) + 1
    return layout.withColumn("Start", start.cast("int"))


def fields_of(layout: DataFrame, section: str | None = None) -> list[Field]:
    """Fields of one section, or of a layout without sections, in order.

    A layout has tens of rows; it is collected to build the projection over the lines.
    """
    chosen = layout if section is None else section_of(layout, section)
    rows = with_offsets(chosen).orderBy(ROW).collect()
    return _checked(
        [
            Field(
                r["Column_Name"],
                r["Start"],
                r["Length"],
                (r["IsSensitive"] or "").lower() in SENSITIVE_MARKS,
            )
            for r in rows
        ]
    )


def fields_from_widths(widths: Sequence[tuple[str, int]]) -> list[Field]:
    fields, start = [], 1
    for name, length in widths:
        fields.append(Field(name, start, length))
        start += length
    return _checked(fields)


def _checked(fields: list[Field]) -> list[Field]:
    names = [f.name for f in fields]
    if None in names or len({str(n).lower() for n in names}) != len(names):
        raise ValueError(f"layout field names must be given and unique: {names}")
    for f in fields:
        if f.length is None or f.length <= 0:
            raise ValueError(f"layout field {f.name} needs a positive length")
    return fields

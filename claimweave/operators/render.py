"""Columns to lines, and files of ordered sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.dates import compact_date
from claimweave.functions.text import ljust, strip
from claimweave.sources.layout import Field

# Order of the sections in a file.
SECTION_ORDER = {"header": 0, "detail": 1, "control": 2, "trailer": 3}

KEEP = "keep"
TRUNCATE = "truncate"
ERROR = "error"


def render_field(
    value: Column, field: Field, is_date: bool = False, overflow: str = KEEP
) -> Column:
    """Text of a value, padded to the field's width; null gives blanks.

    Texts over the width stay whole and shift the fields after them (``keep``), are cut
    (``truncate``), or stop the job (``error``).
    """
    shown = compact_date(value) if is_date else value.cast("string")
    padded = ljust(F.coalesce(shown, F.lit("")), field.length)
    if overflow == KEEP:
        return padded
    if overflow == TRUNCATE:
        return F.left(padded, F.lit(field.length))
    if overflow == ERROR:
        message = F.concat(F.lit(f"value too long for field {field.name}: "), shown)
        return F.when(F.length(padded) <= field.length, padded).otherwise(F.raise_error(message))
    raise ValueError(f"unknown overflow rule: {overflow}")


def render_line(
    fields: Sequence[Field], date_columns: Sequence[str] = (), overflow: str = KEEP
) -> Column:
    """One line from the columns named by the layout."""
    return F.concat(
        *[render_field(F.col(f.name), f, f.name in date_columns, overflow) for f in fields]
    )


def section_lines(df: DataFrame, section: str, line: Column, file: Column, seq: Column) -> DataFrame:
    """(file, section_no, seq, line): a piece of an output file."""
    return df.select(
        file.cast("string").alias("file"),
        F.lit(SECTION_ORDER[section]).alias("section_no"),
        seq.cast("bigint").alias("seq"),
        line.alias("line"),
    )


def control_line(value: Column) -> Column:
    return strip(value)


def join_sections(*sections: DataFrame) -> DataFrame:
    result = sections[0]
    for s in sections[1:]:
        result = result.unionByName(s)
    return result


def write_sections(sections: DataFrame, path: str, partitions: int | None = None) -> None:
    """Text parts in file order, below ``file=<output path>`` for each file.

    Slashes of the path are written as %2F, as in all names of partitions.

    Rows are range partitioned by their whole position, so a file larger than the others is
    spread over as many tasks as its share; parts concatenate in name order to the file.
    """
    position = ["file", "section_no", "seq"]
    ranged = (
        sections.repartitionByRange(partitions, *position)
        if partitions
        else sections.repartitionByRange(*position)
    )
    (
        ranged.sortWithinPartitions(*position)
        .select("file", "line")
        .write.mode("overwrite")
        .partitionBy("file")
        .text(path)
    )


def synthetic_name(input_path: str) -> str:
    """Path of the output for an input path: its ``.txt`` ending becomes ``_syn.txt``.

    Inputs with other endings keep them before it, and those without any get ``_syn``, so
    that different inputs have different outputs.
    """
    folder, slash, name = input_path.rpartition("/")
    if name.endswith(".txt") and len(name) > 4:
        name = f"{name[:-4]}_syn.txt"
    else:
        name = f"{name}_syn.txt" if "." in name.lstrip(".") else f"{name}_syn"
    return f"{folder}{slash}{name}"


def synthetic_name_column(path: Column) -> Column:
    """As ``synthetic_name``, for a column of paths."""
    return (
        F.when(path.rlike(r"[^/]\.txt$"), F.regexp_replace(path, r"\.txt$", "_syn.txt"))
        .when(path.rlike(r"[^/.][^/]*\.[^/]*$"), F.concat(path, F.lit("_syn.txt")))
        .otherwise(F.concat(path, F.lit("_syn")))
    )


def decoded_path(file: Column) -> Column:
    """Path of a file as on storage; scans name files in URL form, with %20 for a blank."""
    return F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))


def common_folder(first: str, last: str) -> str:
    """Folder that holds all paths between the least and the greatest of them."""
    shared = len(first) if first == last else next(
        (i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
    return first[: first.rfind("/", 0, shared) + 1]


def relative_outputs(files: DataFrame) -> DataFrame:
    """(file, output): the output path of each input file, below the folder that all share."""
    paths = files.select("file", decoded_path(F.col("file")).alias("path"))
    ends = paths.agg(F.min("path").alias("first"), F.max("path").alias("last")).first()
    start = len(common_folder(ends["first"] or "", ends["last"] or ""))
    relative = F.substring(F.col("path"), start + 1, F.length("path"))
    return paths.select("file", synthetic_name_column(relative).alias("output"))

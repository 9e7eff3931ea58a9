"""Delimited tables in and out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession


def read_delimited(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. Types are inferred by a pass over the data unless given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_delimited(
    df: DataFrame,
    path: str,
    date_pattern: str = "yyyy-MM-dd",
    line_end: str = "\n",
) -> None:
    """CSV with a header, overwriting. Null and empty text are both written as nothing.

    Each task writes its own part file, in the order of the table's partitions.
    """
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("timestampFormat", date_pattern)
        .option("timestampNTZFormat", date_pattern)
        .option("dateFormat", date_pattern)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("escape", '"')
        .option("lineSep", line_end)
        .csv(path)
    )


# Fixed value: ending of the output names of table jobs.
RUN_ENDING = "_CTGAN_gen_synthetic.csv"


def run_output_name(input_path: str, at: datetime) -> str:
    """Output path of one run on an input: its name, the time to seconds, a fixed ending."""
    return f"{input_path}_{at:%Y%m%d%H%M%S}{RUN_ENDING}"

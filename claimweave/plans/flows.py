"""The three jobs from input files to output files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from claimweave.operators import compare
from claimweave.operators.combinations import synthesize_with_combinations
from claimweave.operators.copula import fit, sample
from claimweave.operators.generate import generate_claims, parse_claims
from claimweave.operators.parse import coerce_dates, mask_columns, parse_fields, sensitive_fields
from claimweave.operators.profile import detect_metadata, non_null_counts
from claimweave.operators.render import (
    KEEP,
    control_line,
    join_sections,
    render_line,
    section_lines,
    relative_outputs,
    write_sections,
)
from claimweave.operators.trailer import ZERO, page_trailers, trailer_line
from claimweave.sources.delimited import read_delimited, run_output_name, write_delimited
from claimweave.sources.layout import DETAIL_SECTION, HEADER_SECTION, Field, fields_of, read_layout, strip_column_names
from claimweave.sources.lines import CONTROL, DETAIL, HEADER, read_lines, route
from claimweave.sources.metadata import (
    Metadata,
    latest_metadata_version,
    metadata_path,
    read_metadata,
    save_metadata,
)
from claimweave.sources.storage import written

LINE_KEY = ["file", "line_no"]
HEAD_ROWS = 5


@dataclass(frozen=True)
class Sections:
    """Parsed sections of positional files, each with its (file, line_no)."""

    header: DataFrame
    detail: DataFrame
    control: DataFrame
    files: DataFrame
    header_fields: list[Field]
    detail_fields: list[Field]


@dataclass(frozen=True)
class FileSynthesis:
    real: DataFrame
    synthetic: DataFrame
    metadata: Metadata
    text_path: str
    # (diagnostic, quality) of the header and of the detail table
    header_scores: tuple[DataFrame, DataFrame] | None = None
    detail_scores: tuple[DataFrame, DataFrame] | None = None


def read_fields(
    spark: SparkSession, layout_path: str, header_layout_path: str | None = None
) -> tuple[list[Field], list[Field]]:
    """Header and detail fields of one layout with sections, or of two layouts."""
    layout = read_layout(spark, layout_path)
    if header_layout_path is None:
        return fields_of(layout, HEADER_SECTION), fields_of(layout, DETAIL_SECTION)
    return fields_of(read_layout(spark, header_layout_path)), fields_of(layout)


def read_positional(
    spark: SparkSession,
    paths: str | Sequence[str],
    layout_path: str,
    date_columns: Sequence[str] = (),
    header_layout_path: str | None = None,
    control_prefix: str = "CD",
    detail_exclude: Sequence[str] = ("CD",),
    stored: bool = False,
) -> Sections:
    """Route and parse positional files by one layout with sections, or by two layouts.

    ``stored`` writes the routed lines once, by section, for jobs that read the sections
    again and again; the files are then scanned no more.
    """
    header_fields, detail_fields = read_fields(spark, layout_path, header_layout_path)
    lines = route(read_lines(spark, paths), control_prefix, detail_exclude)
    if stored:
        lines = written(lines, "lines", "section")

    def part(section: str) -> DataFrame:
        return lines.filter(F.col("section") == section)

    detail = parse_fields(part(DETAIL), detail_fields, LINE_KEY)
    return Sections(
        header=parse_fields(part(HEADER), header_fields, LINE_KEY),
        detail=coerce_dates(detail, date_columns),
        control=part(CONTROL).select(*LINE_KEY, control_line(F.col("value")).alias("CD_Record")),
        files=lines.filter(F.col("line_no") == 1).select("file"),
        header_fields=header_fields,
        detail_fields=detail_fields,
    )


def stored_or_detected(
    df: DataFrame, base: str, kind: str, use_same_metadata_version: bool = True
) -> Metadata:
    """The latest stored metadata, or that of the table, saved as a new version."""
    spark = df.sparkSession
    latest = latest_metadata_version(spark, base, kind)
    if latest and use_same_metadata_version:
        return read_metadata(spark, metadata_path(base, kind, latest))
    metadata = detect_metadata(df)
    save_metadata(spark, base, kind, metadata)
    return metadata


def synthesize_headers(headers: DataFrame, metadata: Metadata, seed: int) -> DataFrame:
    """A synthetic header for each file, from the table of all headers."""
    return sample(fit(headers.drop(*LINE_KEY), metadata), headers, LINE_KEY, seed)


def output_sections(
    sections: Sections,
    header: DataFrame,
    detail: DataFrame,
    date_columns: Sequence[str] = (),
    amounts: str = ZERO,
    overflow: str = KEEP,
) -> DataFrame:
    """(file, section_no, seq, line) of the output files, one per input: header, detail, control, trailer."""
    outputs = relative_outputs(sections.files)
    no_rows = trailer_line(*[F.lit(0)] * 4)
    trailers = sections.files.join(page_trailers(detail, ["file"], amounts), "file", "left")
    file, place = F.col("file"), F.col("line_no")
    pieces = join_sections(
        section_lines(header, "header", render_line(sections.header_fields, (), overflow), file, place),
        section_lines(
            detail, "detail", render_line(sections.detail_fields, date_columns, overflow), file, place
        ),
        section_lines(sections.control, "control", F.col("CD_Record"), file, place),
        section_lines(trailers, "trailer", F.coalesce("line", no_rows), file, F.lit(0)),
    )
    named = pieces.join(outputs, "file")
    return named.select(F.col("output").alias("file"), "section_no", "seq", "line")


def synthesize_file(
    spark: SparkSession,
    paths: str | Sequence[str],
    layout_path: str,
    metadata_base: str,
    output: str,
    date_columns: Sequence[str] = (),
    header_layout_path: str | None = None,
    use_same_metadata_version: bool = True,
    mask: bool | Sequence[str] = False,
    amounts: str = ZERO,
    overflow: str = KEEP,
    control_prefix: str = "CD",
    detail_exclude: Sequence[str] = ("CD",),
    evaluate: bool = True,
    seed: int = 0,
    exact: bool = True,
) -> FileSynthesis:
    """Positional files to synthetic positional files of the same sections and row counts.

    ``mask`` replaces identifiers before anything is learned from them: a list of columns,
    or True for those that the layout marks as sensitive. ``exact`` is that of ``fit``.
    """
    sections = read_positional(
        spark,
        paths,
        layout_path,
        date_columns,
        header_layout_path,
        control_prefix,
        detail_exclude,
        stored=True,
    )

    header_metadata = stored_or_detected(
        sections.header.drop(*LINE_KEY), metadata_base, "header", use_same_metadata_version
    )
    header = synthesize_headers(sections.header, header_metadata, seed)

    masked = sensitive_fields(sections.detail_fields) if mask is True else list(mask or ())
    real = mask_columns(sections.detail, masked, LINE_KEY, seed)
    real = written(real.sortWithinPartitions(*LINE_KEY), "detail")
    write_delimited(real.drop(*LINE_KEY), f"{output}/detail.csv")

    metadata = stored_or_detected(
        real.drop(*LINE_KEY), metadata_base, "data", use_same_metadata_version
    )
    model = fit(real.drop(*LINE_KEY), metadata, exact=exact)
    synthetic = written(sample(model, real, LINE_KEY, seed), "synthetic")
    write_delimited(synthetic.drop(*LINE_KEY), f"{output}/synthetic.csv")

    text_path = f"{output}/files"
    pieces = output_sections(sections, header, synthetic, date_columns, amounts, overflow)
    write_sections(pieces, text_path)
    if not evaluate:
        return FileSynthesis(real, synthetic, metadata, text_path)
    return FileSynthesis(
        real,
        synthetic,
        metadata,
        text_path,
        evaluate_tables(sections.header, header, header_metadata),
        evaluate_tables(real, synthetic, metadata),
    )


def evaluate_tables(
    real: DataFrame, synthetic: DataFrame, metadata: Metadata
) -> tuple[DataFrame, DataFrame]:
    """Diagnostic and quality of a synthetic table."""
    return (
        compare.diagnostic(real, synthetic, metadata),
        compare.quality(real, synthetic, metadata),
    )


@dataclass(frozen=True)
class TableSynthesis:
    counts: DataFrame
    synthetic: DataFrame
    output_path: str | None
    # First rows of the real and of the synthetic table.
    real_head: list[Row]
    synthetic_head: list[Row]
    diagnostic: DataFrame | None = None
    quality: DataFrame | None = None
    shapes: DataFrame | None = None


def synthesize_table(
    spark: SparkSession,
    path: str,
    fixed: Sequence[str],
    n: int = 1000,
    export: bool = True,
    diagnose: bool = False,
    at: datetime | None = None,
    schema: str | None = None,
    seed: int = 0,
) -> TableSynthesis:
    """Delimited table to ``n`` synthetic rows that keep the ``fixed`` column combinations."""
    real = written(strip_column_names(read_delimited(spark, path, schema)), "table")
    metadata = detect_metadata(real)
    made = synthesize_with_combinations(spark, real, metadata, fixed, n, seed)
    synthetic = written(made, "synthetic")
    heads = real.head(HEAD_ROWS), synthetic.head(HEAD_ROWS)
    output_path = run_output_name(path, at or datetime.now()) if export else None
    if output_path:
        write_delimited(synthetic, output_path)
    if not diagnose:
        return TableSynthesis(non_null_counts(real), synthetic, output_path, *heads)
    return TableSynthesis(
        non_null_counts(real),
        synthetic,
        output_path,
        *heads,
        *evaluate_tables(real, synthetic, metadata),
        compare.column_shapes(real, synthetic, metadata),
    )


def generate_file(spark: SparkSession, path: str, n: int = 50_000, seed: int = 0) -> None:
    """Text parts of ``n`` random claim lines; parts in name order hold ids in order."""
    generate_claims(spark, n, seed).select("value").write.mode("overwrite").text(path)


def positional_to_csv(
    spark: SparkSession, paths: str | Sequence[str], output: str, ordered: bool = False
) -> None:
    """Claim lines to CSV parts with CRLF line ends.

    Rows keep their order within a split; ``ordered`` also puts the parts in file order, at
    the price of a range shuffle.
    """
    if ordered:
        lines = read_lines(spark, paths)
        rows = parse_claims(lines, LINE_KEY)
        rows = rows.repartitionByRange(*LINE_KEY).sortWithinPartitions(*LINE_KEY).drop(*LINE_KEY)
    else:
        rows = parse_claims(spark.read.text(paths))
    write_delimited(rows, output, line_end="\r\n")

"""Random claims, one line per row of a keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import draws
from claimweave.functions.text import fit_width, rjust
from claimweave.operators.parse import parse_fields
from claimweave.sources.layout import fields_from_widths
from claimweave.sources.storage import numbered_rows

# Name, width and kind of the fields of a claim line, in order.
CLAIM_FIELDS = (
    ("claim_number", 10, "string"),
    ("patient_id", 8, "string"),
    ("provider_id", 6, "string"),
    ("service_date", 10, "date"),
    ("admission_date", 10, "date"),
    ("diagnosis_code", 7, "string"),
    ("procedure_code", 5, "string"),
    ("amount_due", 10, "amount"),
    ("claim_status", 1, "string"),
    ("payer_id", 6, "string"),
    ("date_of_birth", 10, "date"),
    ("discharge_date", 10, "date"),
    ("net_amount_due", 10, "amount"),
    ("social_security_number", 9, "ssn"),
    ("credit_card_number", 16, "credit_card"),
    ("phone_number", 10, "phone"),
)
# Dates run over 2000-01-01 to 2023-12-31, the last day excluded.
FIRST_DATE, DATE_SPAN_DAYS = "2000-01-01", 8765

CLAIM_LAYOUT = fields_from_widths([(name, width) for name, width, _ in CLAIM_FIELDS])


def random_value(kind: str, width: int, seed: int, tag: str, key: draws.Key) -> Column:
    """Random text of one kind; a kind that is not known gives blanks."""
    if kind == "string":
        return draws.random_text(seed, tag, key, width)
    if kind == "date":
        return draws.random_date(seed, tag, key, FIRST_DATE, DATE_SPAN_DAYS)
    if kind == "amount":
        return rjust(draws.random_integer(seed, tag, key, 1, 100_000).cast("string"), width)
    if kind == "ssn":
        return draws.random_integer(seed, tag, key, 10**8, 9 * 10**8).cast("string")
    if kind == "credit_card":
        return draws.random_digits(seed, tag, key, 16)
    if kind == "phone":
        return draws.random_integer(seed, tag, key, 10**9, 9 * 10**9).cast("string")
    return F.repeat(F.lit(" "), F.lit(width))


def claim_columns(
    rows: DataFrame,
    key: Sequence[str],
    seed: int = 0,
    fields: Sequence[tuple[str, int, str]] = CLAIM_FIELDS,
) -> DataFrame:
    """The key columns and one random column per field, each of its full width."""
    keys = [F.col(k) for k in key]
    columns = [
        fit_width(random_value(kind, width, seed, name, keys), width).alias(name)
        for name, width, kind in fields
    ]
    return rows.select(*key, *columns)


def claim_lines(
    rows: DataFrame,
    key: Sequence[str],
    seed: int = 0,
    fields: Sequence[tuple[str, int, str]] = CLAIM_FIELDS,
) -> DataFrame:
    """The key columns and one positional line per row."""
    line = F.concat(*[F.col(name) for name, _, _ in fields])
    return claim_columns(rows, key, seed, fields).select(*key, line.alias("value"))


def generate_claims(spark: SparkSession, n: int = 50_000, seed: int = 0) -> DataFrame:
    """``n`` random claim lines (id, value); row i is the same for any n."""
    return claim_lines(numbered_rows(spark, n), ["id"], seed)


def parse_claims(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Claim lines to columns: one row per line, whatever its prefix."""
    return parse_fields(lines, CLAIM_LAYOUT, keep)

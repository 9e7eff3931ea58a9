"""Page trailers: record count and amount totals of each file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.amounts import decode_amount
from claimweave.functions.text import fit_width, ljust, to_number, zfill

# Parts of a trailer line and the amounts it sums.
MARK, NET_END, GROSS_END, PATIENT_END = "PT", "A", "G", "D"
COUNT_WIDTH, AMOUNT_WIDTH, TRAILER_WIDTH = 10, 11, 48
AMOUNT_COLUMNS = ("net_amount_due", "gross_amount_due", "patient_pay_amount")

ZERO = "zero"
DECODE = "decode"
NUMBERS = "numbers"
# Sums of this type are exact, so totals do not depend on the order of the rows. It holds
# amounts and totals of 34 digits before the point; a total beyond stops the job.
SUM_TYPE = "decimal(38,4)"


def trailer_line(count: Column, net: Column, gross: Column, patient: Column) -> Column:
    line = F.concat(
        F.lit(MARK),
        zfill(count.cast("string"), COUNT_WIDTH),
        *[
            part
            for total, end in ((net, NET_END), (gross, GROSS_END), (patient, PATIENT_END))
            for part in (zfill(total.cast("string"), AMOUNT_WIDTH), F.lit(end))
        ],
    )
    return fit_width(ljust(line, TRAILER_WIDTH), TRAILER_WIDTH)


def whole_total(df: DataFrame, column: str, amounts: str) -> Column:
    """Sum of a column cut to a whole number; 0 if the table lacks it or amounts are off."""
    if amounts == ZERO or column not in df.columns:
        return F.lit(0).cast("decimal(38,0)")
    value = F.col(column)
    if dict(df.dtypes)[column] == "string" and amounts == NUMBERS:
        value = to_number(value)
    elif dict(df.dtypes)[column] == "string":
        value = decode_amount(value, SUM_TYPE)
    total = F.coalesce(F.sum(value.cast(SUM_TYPE)), F.lit(0))
    # Toward zero, as a cast to a whole number would round.
    whole = F.floor(F.abs(total))
    return F.when(total < 0, -whole).otherwise(whole).cast("decimal(38,0)")


def page_trailers(
    df: DataFrame,
    by: Sequence[str] = (),
    amounts: str = ZERO,
    amount_columns: Sequence[str] = AMOUNT_COLUMNS,
) -> DataFrame:
    """One trailer per file (``by``), or one for the table.

    With ``amounts="zero"`` all totals are 0, as the files this job reproduces have them;
    ``"decode"`` sums overpunched texts and numbers, ``"numbers"`` plain numbers in texts,
    where what is none counts as nothing.
    """
    totals = [
        whole_total(df, c, amounts).alias(f"total_{i}") for i, c in enumerate(amount_columns)
    ]
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("record_count"), *totals)
    line = trailer_line(F.col("record_count"), *[F.col(f"total_{i}") for i in range(3)])
    return counted.select(*by, line.alias("line"))


def decode_totals(df: DataFrame, amount: str, by: Sequence[str] = ()) -> DataFrame:
    """Decode an amount column: rows, total, and rejects (values that do not decode)."""
    decoded = df.withColumn("decoded", decode_amount(F.col(amount), SUM_TYPE))
    return decoded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("decoded"), F.lit(0)).cast("double").alias("total"),
        F.count_if(F.col("decoded").isNull()).alias("rejects"),
    )

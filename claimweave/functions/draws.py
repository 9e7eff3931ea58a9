"""Random draws as a pure function of (seed, tag, row key).

A draw depends on the row's key alone, so results are the same for any partitioning and
when a lost task runs again. 52 bits of an md5 make one uniform.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet of random texts is that of base 36.
ALPHABET_SIZE = 36
DRAW_STEPS = 4503599627370496  # 2 ** 52

Key = Column | Sequence[Column]


def key_hash(seed: int, tag: str, key: Key) -> Column:
    """32 hex digits from the seed, a tag naming the draw, and the row key."""
    parts = [key] if isinstance(key, Column) else list(key)
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{tag}"), *texts))


def hex_number(digest: Column, start: int, length: int) -> Column:
    """``length`` (at most 15) hex digits of a digest as bigint."""
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def uniform(digest: Column, start: int = 1) -> Column:
    """Uniform in [0, 1) from 13 hex digits of a digest."""
    return hex_number(digest, start, 13).cast("double") / F.lit(float(DRAW_STEPS))


def normal_pair(digest: Column) -> tuple[Column, Column]:
    """Two independent standard normals from one digest (Box and Muller)."""
    u1 = (hex_number(digest, 1, 13).cast("double") + F.lit(1.0)) / F.lit(float(DRAW_STEPS))
    angle = uniform(digest, 14) * F.lit(2.0 * math.pi)
    radius = F.sqrt(F.log(u1) * F.lit(-2.0))
    return radius * F.cos(angle), radius * F.sin(angle)


def random_text(seed: int, tag: str, key: Key, length: int) -> Column:
    """Random text over A-Z and 0-9: base-36 digits of the digest, ten at a time."""
    parts = []
    for block, done in enumerate(range(0, length, 10)):
        n = min(10, length - done)
        digest = key_hash(seed, f"{tag}#{block}" if block else tag, key)
        value = F.pmod(hex_number(digest, 1, 15), F.lit(ALPHABET_SIZE**n))
        parts.append(F.lpad(F.conv(value.cast("string"), 10, ALPHABET_SIZE), n, "0"))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def random_integer(seed: int, tag: str, key: Key, low: int, count: int) -> Column:
    """Integer in [low, low + count)."""
    u = uniform(key_hash(seed, tag, key))
    return F.lit(low).cast("bigint") + F.floor(u * F.lit(float(count)))


def random_digits(seed: int, tag: str, key: Key, length: int) -> Column:
    """Text of digits, leading zeros allowed, eight digits per draw."""
    parts = []
    for block, done in enumerate(range(0, length, 8)):
        n = min(8, length - done)
        value = random_integer(seed, f"{tag}#{block}", key, 0, 10**n)
        parts.append(F.lpad(value.cast("string"), n, "0"))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def random_date(seed: int, tag: str, key: Key, start: str, days: int) -> Column:
    """Date in [start, start + days) as yyyyMMdd."""
    u = uniform(key_hash(seed, tag, key))
    offset = F.floor(u * F.lit(float(days))).cast("int")
    return F.date_format(F.date_add(F.lit(start).cast("date"), offset), "yyyyMMdd")

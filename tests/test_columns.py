"""Column expressions against their plain meaning."""

import pytest
from pyspark.sql import functions as F

from claimweave.functions import amounts, dates, draws, text
from claimweave.functions.masking import mask_digits
from claimweave.functions.normal import normal_cdf, normal_level, normal_quantile
from claimweave.functions.statistics import correlation, distinct_estimate


def applied(spark, values, make, data_type="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {data_type}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def decoded_by_rule(value):
    """The decoder's rule, restated; None where it has no result."""
    if not value:
        return None
    last = value[-1]
    if last in "}ABCDEFGHI":
        sign, digit = -1, "}ABCDEFGHI".index(last)
    elif last in "{JKLMNOPQR":
        sign, digit = 1, "{JKLMNOPQR".index(last)
    elif last in "0123456789":
        sign, digit = 1, int(last)
    else:
        return 0.0
    try:
        return sign * float(value.replace(last, str(digit)))
    except ValueError:
        return None


def test_decoder_table(spark):
    values = [f"0012{c}" for c in "}{ABCDEFGHIJKLMNOPQR0123456789"]
    values += ["0015083H", "0000839I", "1A2A", "1B2A", "5Z", "", "-5J", "1.5C", "+7", "x", "A", "{", "12 ", "0x1p3", "0x1", "Infinity1", "1e2", " 7", "1.2.3", "1e"]
    got = applied(spark, values, amounts.decode_amount)
    assert got == [decoded_by_rule(v) for v in values]
    assert dict(zip(values, got))["0015083H"] == -150838.0
    assert dict(zip(values, got))["1A2A"] == -1121.0
    assert dict(zip(values, got))["-5J"] == -51.0
    exact = applied(spark, ["0000012}", "1B2A", "5Z"], lambda c: amounts.decode_amount(c, "decimal(28,4)"))
    assert [None if x is None else float(x) for x in exact] == [-120.0, None, 0.0]


def test_decoder_takes_another_sign_table(spark):
    got = applied(
        spark, ["12A", "12J"], lambda c: amounts.decode_amount(c, negative="}JKLMNOPQR", positive="{ABCDEFGHI")
    )
    assert got == [121.0, -121.0]


def test_numbers_from_text(spark):
    values = ["1", " 2.5 ", "-3e2", ".5", "1d", "1_0", "nan", "", None, "abc", "7."]
    expected = [1.0, 2.5, -300.0, 0.5, None, None, None, None, None, None, 7.0]
    assert applied(spark, values, text.to_number) == expected


@pytest.mark.parametrize("width", [0, 3, 8])
def test_padding_is_that_of_python(spark, width):
    values = ["", "7", "-83", "+5", "12345", "-123456789", "x-"]
    assert applied(spark, values, lambda c: text.zfill(c, width)) == [v.zfill(width) for v in values]
    assert applied(spark, values, lambda c: text.ljust(c, width)) == [v.ljust(width) for v in values]
    assert applied(spark, values, lambda c: text.rjust(c, width)) == [v.rjust(width) for v in values]


def test_strip_is_that_of_python(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    assert sorted(text.WHITESPACE) == sorted(spaces)
    values = ["", " a ", *[f"{s}x{s} y{s}" for s in spaces], "​z"]
    assert applied(spark, values, text.strip) == [v.strip() for v in values]
    lines = [v.ljust(9, "\t") + "rest" for v in values] + ["plain    rest", "tab\n"]
    assert applied(spark, lines, lambda c: text.field(c, 1, 9)) == [v[:9].strip() for v in lines]


def test_dates(spark):
    values = ["20011024", "2001-10-24", "20011345", "", None, "  "]
    got = applied(spark, values, lambda c: F.date_format(dates.coerce_date(c), "yyyy-MM-dd"))
    assert got == ["2001-10-24", None, None, None, None, None]
    both = applied(
        spark, values, lambda c: F.date_format(dates.coerce_date(c, ("yyyyMMdd", "yyyy-MM-dd")), "yyyyMMdd")
    )
    assert both[:2] == ["20011024", "20011024"]
    assert dates.spark_pattern("%Y%m%d") == "yyyyMMdd"
    with pytest.raises(ValueError):
        dates.spark_pattern("%Q")


def test_masks(spark):
    values = ["A" * n for n in (1, 2, 9, 25, 26, 49, 50, 80)] + ["", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v string")
    masked = rows.orderBy("k").select(mask_digits(F.col("v"), draws.key_hash(1, "v", F.col("k"))).alias("m"))
    got = [r["m"] for r in masked.collect()]
    assert [len(m) for m in got] == [1, 2, 9, 25, 26, 49, 50, 80, 1, 1]
    assert got[-2:] == ["0", "0"]
    assert all(m.isdigit() and m[0] != "0" for m in got[:-2])
    assert [r["m"] for r in masked.collect()] == got
    other = rows.orderBy("k").select(
        mask_digits(F.col("v"), draws.key_hash(2, "v", F.col("k"))).alias("m")
    )
    assert [r["m"] for r in other.collect()][2:8] != got[2:8]


def test_draws_do_not_depend_on_partitions(spark):
    def drawn(parts):
        rows = spark.range(0, 500, 1, parts)
        return sorted(
            rows.select(
                "id",
                draws.random_text(3, "t", F.col("id"), 13),
                draws.random_digits(3, "d", F.col("id"), 16),
                draws.uniform(draws.key_hash(3, "u", F.col("id"))),
            ).collect()
        )

    assert drawn(1) == drawn(4) == drawn(17)
    assert all(len(r[1]) == 13 and len(r[2]) == 16 and 0 <= r[3] < 1 for r in drawn(4))


def test_draws_are_spread_evenly(spark):
    n = 20000
    rows = spark.range(n)
    pair = draws.normal_pair(draws.key_hash(0, "n", F.col("id")))
    stats = rows.select(
        draws.random_text(0, "t", F.col("id"), 1).alias("t"),
        draws.random_date(0, "d", F.col("id"), "2000-01-01", 8765).alias("d"),
        draws.random_integer(0, "a", F.col("id"), 1, 100).alias("a"),
        pair[0].alias("x"), pair[1].alias("y"),
    )
    counts = stats.groupBy("t").count().collect()
    assert len(counts) == 36 and all(abs(r["count"] - n / 36) < 150 for r in counts)
    row = stats.agg(
        F.min("d"), F.max("d"), F.min("a"), F.max("a"), F.avg("x"), F.stddev("x"), F.avg("y"),
        F.stddev("y"), correlation(F.col("x"), F.col("y")),
    ).first()
    assert "20000101" <= row[0] and row[1] <= "20231230"
    assert (row[2], row[3]) == (1, 100)
    assert abs(row[4]) < 0.03 and abs(row[5] - 1) < 0.03
    assert abs(row[6]) < 0.03 and abs(row[7] - 1) < 0.03 and abs(row[8]) < 0.03


def test_normal_distribution(spark):
    from statistics import NormalDist

    us = [1e-9, 1e-4, 0.01, 0.02425, 0.3, 0.5, 0.77, 0.9757, 0.999, 1 - 1e-9]
    got = applied(spark, us, normal_quantile, "double")
    assert got == pytest.approx([normal_level(u) for u in us], rel=2e-9, abs=1e-9)
    zs = [-6.0, -2.5, -0.1, 0.0, 0.7, 3.0, 6.0]
    cdf = applied(spark, zs, normal_cdf, "double")
    assert cdf == pytest.approx([NormalDist().cdf(z) for z in zs], abs=1e-7)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, 3.0, None), (1.0, 5.0, 3.0)], "a double, b double, c double")
    row = df.agg(
        correlation(F.col("a"), F.col("b")), correlation(F.col("b"), F.col("c")), distinct_estimate(F.col("c"))
    ).first()
    assert row[0] is None and row[1] == pytest.approx(1.0) and row[2] == 2

"""Metadata, profiles, synthesis and scores of tables."""

import math
from pathlib import Path

import numpy as np
import pytest
from conftest import SF, text_of
from fixtures import DATA_COLUMNS, write_metadata
from pyspark.sql import functions as F

from claimweave.operators import compare, copula, ranks
from claimweave.operators.combinations import synthesize_with_combinations, unseen_combinations
from claimweave.operators.parse import head, normalise_nulls
from claimweave.operators.profile import _distinct_counts, column_kinds, detect_metadata, format_votes, non_null_counts
from claimweave.operators.trailer import page_trailers
from claimweave.plans import flows
from claimweave.sources.metadata import (
    latest_metadata_version,
    latest_versions,
    override_kind,
    read_metadata,
    read_metadata_table,
    save_metadata,
)


def test_metadata_versions(spark, folder):
    base = write_metadata(folder, "data", {k: v for k, v in DATA_COLUMNS.items() if k != "due"}, 1)
    write_metadata(folder, "data", DATA_COLUMNS, 2)
    write_metadata(folder, "data", DATA_COLUMNS, 4)
    write_metadata(folder, "late", DATA_COLUMNS, 2)
    assert latest_metadata_version(spark, base, "data") == 2
    assert latest_metadata_version(spark, base, "late") is None
    assert latest_metadata_version(spark, base, "none") is None
    assert read_metadata(spark, f"{base}_data_v2.json") == DATA_COLUMNS
    table = {r["column"]: r for r in read_metadata_table(spark, f"{base}_data_v2.json").collect()}
    assert table["due"]["datetime_format"] == "%Y%m%d"
    assert save_metadata(spark, base, "data", DATA_COLUMNS).endswith("_data_v3.json")
    assert latest_metadata_version(spark, base, "data") == 4
    assert save_metadata(spark, base, "new", DATA_COLUMNS).endswith("_new_v1.json")
    assert read_metadata(spark, f"{base}_new_v1.json") == DATA_COLUMNS


def test_latest_versions_against_counting_up(spark):
    found = {"a": [1, 2, 3, 5], "b": [2, 3], "c": [1], "d": [0, 1, 2], "e": [1, 1, 2, 2]}
    rows = [(k, v) for k, vs in found.items() for v in vs]
    df = spark.createDataFrame(rows, "name string, version int")
    got = {r["name"]: r["latest_version"] for r in latest_versions(df, ["name"]).collect()}
    assert got == {"a": 3, "b": None, "c": 1, "d": 2, "e": 2}


def test_kinds(spark):
    rows = [(i, f"n{i}", f"2001010{i % 9 + 1}", i % 3, i * 1.5, "x" if i % 2 else None, None) for i in range(40)]
    df = spark.createDataFrame(
        rows, "key long, name string, day string, code int, amount double, flag string, void string"
    ).withColumn("at", F.lit("2001-01-01").cast("timestamp"))
    expected = {
        "key": "id", "name": "id", "day": "datetime", "code": "categorical", "amount": "numerical",
        "flag": "categorical", "void": "categorical", "at": "datetime",
    }
    for exact in (True, False):
        assert {r["column"]: r["kind"] for r in column_kinds(df, exact).collect()} == expected
    metadata = detect_metadata(df)
    assert metadata["day"] == {"sdtype": "datetime", "datetime_format": "%Y%m%d"}
    assert list(metadata) == df.columns
    counts = {r["column"]: r["non_null"] for r in non_null_counts(df).collect()}
    assert (counts["flag"], counts["void"], counts["key"]) == (20, 0, 40)
    assert override_kind(metadata, ["key", "code"])["key"] == {"sdtype": "categorical"}
    assert override_kind(metadata, ["key", "gone"]) == metadata


def test_nulls_and_head(spark):
    df = spark.createDataFrame([(1, math.nan, ""), (2, None, None), (3, 1.0, "a")], "k int, x double, s string")
    assert normalise_nulls(df).orderBy("k").collect() == [(1, None, ""), (2, None, None), (3, 1.0, "a")]
    assert [r["k"] for r in head(df, ["k"], 2).collect()] == [1, 2]


def test_trailer_totals(spark):
    df = spark.createDataFrame(
        [("0000010}", 2.75), ("0000001{", -5.5), ("bad", None)], "net_amount_due string, gross_amount_due double"
    )
    assert page_trailers(df).first()[0] == "PT000000000300000000000A00000000000G00000000000D"
    decoded = page_trailers(df, amounts="decode").first()[0]
    assert decoded == "PT0000000003-0000000090A-0000000002G00000000000D"
    assert page_trailers(df.limit(0)).first()[0][:12] == "PT0000000000"


def skewed(spark, n=20000):
    """A third of the rows share one value in every column."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.when(hot, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(100000)) / 8.0).alias("x"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(9000)))).alias("c"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 4).alias("k"),
        "id",
    )


def test_quantiles_against_numpy(spark):
    df = skewed(spark).withColumn("tiny", F.when(F.col("id") == 5, 2.5)).withColumn("void", F.lit(None).cast("double"))
    got = ranks.quantile_table(df, ["x", "k", "tiny", "void"], 50).collect()
    for c in ("x", "k", "tiny"):
        values = [r[c] for r in df.select(c).collect() if r[c] is not None]
        mine = [r["quantile"] for r in sorted(got, key=lambda r: r["idx"]) if r["column"] == c]
        assert mine == pytest.approx(list(np.quantile(values, np.linspace(0, 1, 51))))
    assert not [r for r in got if r["column"] == "void"]


def test_scores_against_brute_force(spark):
    real, other = skewed(spark, 3000), skewed(spark, 5000).filter("id >= 1500")
    r, s = real.toPandas(), other.toPandas()
    both = compare.stack(real, other, ["x", "c", "k"])
    points = np.union1d(r["x"], s["x"])
    cdf = [np.searchsorted(np.sort(d["x"]), points, side="right") / len(d) for d in (r, s)]
    ks = compare.ks_scores(both, ["x"]).first()["score"]
    assert ks == pytest.approx(1 - np.abs(cdf[0] - cdf[1]).max())
    shares = [d["c"].value_counts(normalize=True) for d in (r, s)]
    tv = compare.tv_scores(both, ["c"]).first()["score"]
    assert tv == pytest.approx(1 - shares[0].subtract(shares[1], fill_value=0).abs().sum() / 2)
    adherence = compare.category_scores(both, ["c"]).first()["score"]
    assert adherence == pytest.approx(s["c"].isin(set(r["c"])).mean())
    same = compare.stack(real, real, ["x", "c", "k"])
    scores = [x["score"] for x in compare.ks_scores(same, ["x", "k"]).collect()]
    scores += [x["score"] for x in compare.tv_scores(same, ["c", "k"]).collect()]
    assert scores == pytest.approx([1.0] * 4)


ITEM_KINDS = {
    "l_quantity": {"sdtype": "numerical"},
    "l_extendedprice": {"sdtype": "numerical"},
    "net": {"sdtype": "numerical"},
    "l_returnflag": {"sdtype": "categorical"},
    "l_shipdate": {"sdtype": "datetime"},
    "l_orderkey": {"sdtype": "id"},
}


def items(spark):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    flag = F.when(F.col("l_linenumber") < 3, None).otherwise(F.col("l_returnflag"))
    return (
        spark.read.parquet(f"{SF}/lineitem.parquet")
        .withColumn("net", net)
        .withColumn("l_returnflag", flag)
        .withColumn("l_quantity", F.when(F.col("l_linenumber") != 5, F.col("l_quantity")))
    )


def test_sampled_table_is_like_the_real_one(spark):
    real = items(spark).select(*ITEM_KINDS)
    model = copula.fit(real, ITEM_KINDS)
    made = copula.sample(model, spark.range(6000), ["id"], seed=5)
    assert made.drop("id").dtypes == real.dtypes
    synthetic = made.drop("id")
    shapes = {r["column"]: r["score"] for r in compare.column_shapes(real, synthetic, ITEM_KINDS).collect()}
    assert set(shapes) == set(ITEM_KINDS) - {"l_orderkey"}
    assert min(shapes.values()) > 0.96
    pairs = {
        (r["first"], r["second"]): r["score"]
        for r in compare.column_pairs(real, synthetic, ITEM_KINDS).collect()
    }
    assert pairs[("l_extendedprice", "net")] > 0.99
    assert min(pairs.values()) > 0.85
    for r in compare.diagnostic(real, synthetic, ITEM_KINDS).collect():
        assert r["score"] == 1.0, r
    nulls = synthetic.agg(F.avg(F.col("l_quantity").isNull().cast("int"))).first()[0]
    real_nulls = real.agg(F.avg(F.col("l_quantity").isNull().cast("int"))).first()[0]
    assert abs(nulls - real_nulls) < 0.02
    assert synthetic.select("l_orderkey").distinct().count() == 6000
    # Values keep the unit of the real ones.
    assert synthetic.filter("l_quantity <> floor(l_quantity)").count() == 0
    assert synthetic.filter("l_shipdate <> date_trunc('day', l_shipdate)").count() == 0
    assert synthetic.filter("abs(l_extendedprice * 100 - round(l_extendedprice * 100)) > 1e-6").count() == 0


def test_sketched_grids_are_near_the_exact_ones(spark):
    real = items(spark).select("l_quantity", "l_extendedprice", "l_shipdate")
    kinds = {c: ITEM_KINDS[c] for c in real.columns}
    exact, sketched = (copula.fit(real, kinds, steps=50, exact=e).marginals for e in (True, False))
    assert [type(m) for m in exact] == [type(m) for m in sketched]
    for a, b in zip(exact, sketched):
        if isinstance(a, copula.Grid):
            assert a.null_share == pytest.approx(b.null_share) and a.unit == b.unit
            span = a.points[-1] - a.points[0]
            assert max(abs(x - y) for x, y in zip(a.points, b.points)) < 0.01 * span
        else:
            assert (a.numbers, a.counts) == (b.numbers, b.counts)


def test_samples_do_not_depend_on_partitions(spark):
    model = copula.fit(items(spark).select(*ITEM_KINDS), ITEM_KINDS, steps=50)
    results = [
        sorted(map(str, copula.sample(model, spark.range(0, 300, 1, n), ["id"]).collect())) for n in (1, 4, 17)
    ]
    assert results[0] == results[1] == results[2]


def test_model_with_duplicate_and_constant_columns(spark):
    df = spark.range(500).select(
        F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"),
        F.lit(3.0).alias("fixed"), F.lit(None).cast("double").alias("void"),
    )
    kinds = {c: {"sdtype": "numerical"} for c in df.columns}
    made = copula.sample(copula.fit(df, kinds, steps=20), spark.range(200), ["id"])
    rows = made.collect()
    assert all(r["fixed"] == 3.0 and r["void"] is None and abs(r["a"] - r["b"]) < 1 for r in rows)


def test_key_must_not_be_a_model_column(spark):
    df = spark.createDataFrame([(1, "a")], "Id int, c string")
    model = copula.fit(df, {"Id": {"sdtype": "categorical"}})
    with pytest.raises(ValueError, match="key columns"):
        copula.sample(model, spark.range(2), ["id"])


def test_one_row_gives_itself(spark):
    df = spark.createDataFrame([("PA", "22", None)], "a string, b string, c string")
    model = copula.fit(df, {c: {"sdtype": "categorical"} for c in df.columns})
    assert copula.sample(model, spark.range(2), ["id"]).drop("id").collect() == [("PA", "22", None)] * 2


def test_table_without_rows(spark):
    df = spark.createDataFrame([], "a string, x double, d string, p int, q int")
    kinds = {
        "a": {"sdtype": "categorical"}, "x": {"sdtype": "numerical"}, "p": {"sdtype": "categorical"},
        "q": {"sdtype": "categorical"}, "d": {"sdtype": "datetime", "datetime_format": "%Y%m%d"},
    }
    model = copula.fit(df, kinds, [["p", "q"]])
    made = copula.sample(model, spark.range(2), ["id"]).drop("id")
    assert made.dtypes == df.dtypes and made.distinct().collect() == [(None,) * 5]


def test_text_dates_come_back_as_text(spark):
    df = spark.createDataFrame([("20010101",), ("20010103",), ("bad",), ("20010102",)] * 30, "day string")
    kinds = {"day": {"sdtype": "datetime", "datetime_format": "%Y%m%d"}}
    made = copula.sample(copula.fit(df, kinds), spark.range(400), ["id"])
    got = {r["day"]: r["count"] for r in made.groupBy("day").count().collect()}
    assert set(got) == {"20010101", "20010102", "20010103", None}
    assert min(got.values()) > 60


def test_many_categories_stay_on_the_cluster(spark, monkeypatch):
    """The path for more categories than the driver collects gives the same shares."""
    df = skewed(spark).select("c", "x")
    kinds = {"c": {"sdtype": "categorical"}, "x": {"sdtype": "numerical"}}
    monkeypatch.setattr(copula, "COLLECTED_CATEGORIES", 100)
    model = copula.fit(df, kinds)
    table = model.marginals[0]
    assert isinstance(table, copula.SharesTable) and table.hot == ["hot"]
    rows = sorted((r["before"], r["n"]) for r in table.table.collect())
    assert rows[0][0] == 0 and rows[-1][0] + rows[-1][1] == table.total == 20000
    assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))

    n = 5000
    made = copula.sample(model, spark.range(n), ["id"])
    assert made.count() == n
    assert unseen_combinations(df, made, ["c"]).count() == 0
    hot = made.filter("c = 'hot'").count() / n
    assert abs(hot - 1 / 3) < 0.03
    # Brute force: each draw lies in the slice of its value.
    uniforms = copula._uniform_columns(spark.range(n), [F.col("id")], model.factor(), 0)
    place = {r["value"]: (r["before"], r["n"]) for r in table.table.collect()}
    drawn = {r["id"]: r["c"] for r in made.select("id", "c").collect()}
    for r in uniforms.collect():
        before, count = place[drawn[r["id"]]]
        assert before <= math.floor(r["_u0"] * 20000) < before + count

    scores, names = copula.normal_scores(df, model.modelled)
    assert scores.count() == 20000
    assert scores.filter(" or ".join(f"{z} is null" for z in names)).count() == 0
    hot_level = scores.groupBy("z0").count().orderBy(F.desc("count")).first()
    assert hot_level["count"] == df.filter("c = 'hot'").count()


def test_category_scores_are_the_normal_places(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("v"), F.col("id") % 200)).alias("c"),
        F.lit(None).cast("string").alias("void"), F.lit("one").alias("one"),
    )
    model = copula.fit(df, {c: {"sdtype": "categorical"} for c in df.columns})
    scores = [tuple(r) for r in copula.normal_scores(df, model.modelled)[0].collect()]
    middles = [copula.normal_level(u) for u in model.marginals[0].middles()]
    counts = dict(zip(middles, model.marginals[0].counts))
    found = {z: sum(1 for s in scores if s[0] == z) for z in {s[0] for s in scores}}
    assert found == counts and len(scores) == 4000
    assert {s[1:] for s in scores} == {(0.0, 0.0)}


def test_many_columns_mix_like_few(spark, monkeypatch):
    rng = np.random.default_rng(1)
    factor = np.linalg.cholesky(np.corrcoef(rng.normal(size=(6, 50))))
    few = copula._uniform_columns(spark.range(500), [F.col("id")], factor, 0).collect()
    monkeypatch.setattr(copula, "MOST_MIXED_BY_COLUMN", 2)
    many = copula._uniform_columns(spark.range(500), [F.col("id")], factor, 0).collect()
    assert np.allclose(sorted(map(tuple, few)), sorted(map(tuple, many)), atol=1e-12)


def test_wide_tables_use_one_matrix(spark, monkeypatch):
    scores = items(spark).select("l_extendedprice", "net", F.lit(1.0).alias("one"))
    names = scores.columns
    few = copula.correlations(scores, names)
    monkeypatch.setattr(copula, "MOST_CORR_COLUMNS", 2)
    assert np.allclose(copula.correlations(scores, names), few, atol=2e-6)


def test_fixed_combinations_are_kept(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").withColumn(
        "p_size", F.when(F.col("p_size") > 25, F.col("p_size"))
    )
    kinds = detect_metadata(parts)
    made = synthesize_with_combinations(spark, parts, kinds, ["p_brand", "p_size"], 1000)
    assert made.count() == 1000 and made.dtypes == parts.dtypes
    assert unseen_combinations(parts, made, ["p_brand", "p_size"]).count() == 0
    assert unseen_combinations(parts, made, ["p_brand", "p_type", "p_size"]).count() > 0
    assert made.filter("p_size is null").count() > 0


def test_table_flow(spark, folder):
    rows = "\n".join(f"{i},{i % 5},{i % 5 * 2.5},{'ab'[i % 2]}" for i in range(200))
    Path(folder, "stock.csv").write_text(f" Id ,Boxes,Unit Load,Name\n{rows}\n")
    result = flows.synthesize_table(
        spark, f"{folder}/stock.csv", ["Boxes", "Unit Load"], n=150, diagnose=True
    )
    assert "_CTGAN_gen_synthetic.csv" in result.output_path
    assert text_of(result.output_path).decode().startswith("Id,Boxes,Unit Load,Name\n")
    assert result.synthetic.count() == 150
    assert [r["Id"] for r in result.real_head] == [0, 1, 2, 3, 4] and len(result.synthetic_head) == 5
    assert result.synthetic.filter("`Unit Load` <> Boxes * 2.5").count() == 0
    assert {r["column"]: r["non_null"] for r in result.counts.collect()}["Boxes"] == 200
    assert {r["column"] for r in result.shapes.collect()} == {"Boxes", "Unit Load", "Name"}
    assert {r["property"] for r in result.quality.collect()} >= {"Overall", "Column Shapes"}
    assert {r["score"] for r in result.diagnostic.collect()} == {1.0}
    none = flows.synthesize_table(spark, f"{folder}/stock.csv", ["Boxes"], n=10, export=False)
    assert none.output_path is None and none.quality is None


@pytest.mark.parametrize("distinct", [1000, 1001, 20_000])
def test_discrete_numbers_give_real_values_only(spark, distinct):
    """However many they are, and beyond the whole numbers that doubles hold."""
    real = spark.range(40_000).select(
        (F.col("id") % distinct * 7 - 1000).alias("whole"),
        ((F.col("id") % distinct * 3 + 1) / 8).alias("part"),
        F.when(F.col("id") % 11 != 0, F.col("id") % distinct + 2**60).alias("large"),
        F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") % distinct * 2).cast("int")).alias("day"),
    )
    kinds = {c: {"sdtype": "numerical"} for c in ("whole", "part", "large")}
    kinds["part"]["distribution"] = "discrete"
    kinds["day"] = {"sdtype": "datetime"}
    model = copula.fit(real, kinds, steps=50)
    assert all(not isinstance(m, copula.Grid) for m in model.marginals)
    made = copula.sample(model, spark.range(3000), ["id"])
    assert [t for c, t in made.dtypes if c != "id"] == [t for _, t in real.dtypes]
    for c in real.columns:
        assert made.filter(F.col(c).isNotNull()).join(real, c, "left_anti").count() == 0, c
        assert made.select(c).distinct().count() > 500
    assert 150 < made.filter("large IS NULL").count() < 400
    assert made.stat.corr("whole", "part") > 0.99


def test_metadata_decides_between_values_and_grid(spark, folder):
    real = spark.range(300).select(F.col("id").alias("n"), (F.col("id") * 1.0).alias("x"))
    kinds = {c: {"sdtype": "numerical"} for c in real.columns}
    assert [type(m).__name__ for m in copula.fit(real, kinds, steps=1000).marginals] == ["Shares", "Grid"]
    kinds["n"]["distribution"], kinds["x"]["distribution"] = "continuous", "discrete"
    stored = save_metadata(spark, f"{folder}/m", "data", kinds)
    assert read_metadata(spark, stored) == kinds
    for exact in (True, False):
        assert [type(m).__name__ for m in copula.fit(real, kinds, steps=1000, exact=exact).marginals] == ["Grid", "Shares"]
    with pytest.raises(ValueError, match="distribution"):
        copula.fit(real, {"n": {"sdtype": "numerical", "distribution": "other"}})


def test_sketched_intervals_hold_the_exact_scores(spark):
    both = spark.range(30_000).select(
        (F.col("id") % 3 == 0).alias(compare.IS_REAL), (F.col("id") % 9).cast("double").alias("few"),
        F.sqrt(F.col("id") * F.when(F.col("id") % 3 == 0, 1.0).otherwise(1.5)).alias("moved"), F.lit(4.0).alias("one"),
        F.when(F.col("id") % 3 == 0, 1.0).alias("real_only"))
    columns = ["few", "moved", "one", "real_only"]
    exact = {r["column"]: r["score"] for r in compare.ks_scores(both, columns).collect()}
    got = {r["column"]: (r["low"], r["high"]) for r in compare.ks_intervals(both, columns).collect()}
    for c in columns[:3]:
        low, high = got[c]
        assert low <= exact[c] <= high and high - low < 0.01, (c, got[c], exact[c])
    assert got["real_only"] == (None, None)


def test_formats_are_voted_on_and_conflicts_counted(spark):
    rows = [("20200101", "2020-01-01", "20200101", None), ("2020-01-02", "2020-01-02", "2020-01-02", None),
            ("2020-01-03", "20200103", "x", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "most string, tie_less string, broken string, void string").withColumn("n", F.lit(1))
    formats = ("yyyyMMdd", "yyyy-MM-dd")
    found = {r["column"]: r for r in column_kinds(df, date_formats=formats).collect()}
    assert (found["most"]["kind"], found["most"]["datetime_format"], found["most"]["format_conflicts"]) == ("datetime", "%Y-%m-%d", 1)
    assert found["broken"]["kind"] != "datetime" and found["broken"]["datetime_format"] is None
    assert detect_metadata(df, date_formats=formats)["most"]["datetime_format"] == "%Y-%m-%d"
    votes = {(r["column"], r["datetime_format"]): (r["votes"], r["won"]) for r in format_votes(df, formats).collect()}
    assert votes["broken", "%Y%m%d"] == (1, True) and votes["broken", "%Y-%m-%d"] == (1, False)
    assert votes["void", "%Y%m%d"] == (0, False) and ("n", "%Y%m%d") not in votes


def test_distinct_counts_of_all_columns_take_one_shuffle(spark):
    df = spark.range(5000).select(*[(F.col("id") % k).alias(f"c{k}") for k in range(1, 30)], F.lit(None).cast("string").alias("void"))
    found = {r["column"]: r["n_distinct"] for r in column_kinds(df, exact=True).collect()}
    assert found == {**{f"c{k}": k for k in range(1, 30)}, "void": 0}
    plan = _distinct_counts(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("Exchange hashpartitioning") == 2

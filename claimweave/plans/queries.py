"""Each operator over the test tables: name -> (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import sketches
from claimweave.functions.amounts import NEGATIVE_SIGNS, POSITIVE_SIGNS, decode_amount
from claimweave.functions.dates import coerce_date
from claimweave.operators import compare, copula, ranks
from claimweave.operators.combinations import synthesize_with_combinations
from claimweave.operators.generate import (
    CLAIM_FIELDS,
    claim_columns,
    claim_lines,
    parse_claims,
)
from claimweave.operators.parse import head, mask_columns, normalise_nulls, parse_fields
from claimweave.operators.profile import column_kinds, format_votes, non_null_counts
from claimweave.operators.reconcile import reconciled
from claimweave.operators.render import control_line, join_sections, render_line, section_lines, write_sections
from claimweave.operators.trailer import DECODE, NUMBERS, ZERO, decode_totals, page_trailers
from claimweave.plans.flows import LINE_KEY, generate_file, stored_or_detected, synthesize_headers
from claimweave.sources.delimited import read_delimited, write_delimited
from claimweave.sources.layout import ROW, fields_from_widths, with_offsets
from claimweave.sources.layout import read_layout
from claimweave.sources.lines import CONTROL, HEADER, read_lines, route
from claimweave.sources.metadata import (
    CATEGORICAL,
    DATETIME,
    DISCRETE,
    ID,
    NUMERICAL,
    latest_metadata_version,
    latest_versions,
    metadata_path,
    override_kind,
    read_metadata_table,
    save_metadata,
)
from claimweave.sources.storage import numbered_rows, shared_folder, spread, written

ORDER_WIDTHS = (
    ("o_orderkey", 10),
    ("o_custkey", 8),
    ("o_orderstatus", 1),
    ("cents", 12),
    ("o_orderdate", 8),
    ("o_orderpriority", 15),
)
ORDER_FIELDS = fields_from_widths(ORDER_WIDTHS)
GRID_STEPS = copula.GRID_STEPS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def overpunched(value: Column, width: int) -> Column:
    """Whole number as digits with its last digit and sign in one character."""
    digits = F.lpad(F.abs(value).cast("string"), width, "0")
    place = F.right(digits, F.lit(1)).cast("int") + F.lit(1)
    signs = F.when(value < 0, F.lit(NEGATIVE_SIGNS)).otherwise(F.lit(POSITIVE_SIGNS))
    return F.concat(F.left(digits, F.lit(width - 1)), F.substr(signs, place, F.lit(1)))


def order_values(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with amounts in cents; the status of pending ones is null."""
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        cents(F.col("o_totalprice")).alias("cents"),
        "o_orderdate",
        "o_orderpriority",
        F.col("o_orderstatus").alias("file"),
    )


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = render_line(ORDER_FIELDS, ["o_orderdate"])
    return order_values(spark, folder).select("file", "o_orderkey", line.alias("value"))


# ---------------------------------------------------------------- layout, lines, columns


def layout_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Widths measured over whole tables as a layout of two sections, with offsets."""
    orders = table(spark, folder, "orders")
    items = table(spark, folder, "lineitem")
    shown = {
        "HDR": orders.select(
            "o_orderkey", "o_custkey", "o_orderstatus",
            cents(F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority",
        ),
        "DE": items.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            cents(F.col("l_extendedprice")).alias("l_extendedprice"), "l_returnflag", "l_linestatus",
        ),
    }
    parts, first_id = [], 1
    for section, df in shown.items():
        widths = df.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in df.columns])
        order = F.create_map(
            *[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(first_id + i))]
        )
        parts.append(
            widths.unpivot([], df.columns, "Column_Name", "Length").select(
                order[F.col("Column_Name")].alias("ColID"),
                order[F.col("Column_Name")].cast("bigint").alias(ROW),
                "Column_Name",
                F.col("Length").cast("int").alias("Length"),
                F.lit(section).alias("Type"),
            )
        )
        first_id += len(df.columns)
    return with_offsets(parts[0].unionByName(parts[1])).drop(ROW)


def render_lines(spark: SparkSession, folder: str) -> DataFrame:
    return order_lines(spark, folder).select("o_orderkey", F.col("value").alias("line"))


def parse_lines(spark: SparkSession, folder: str) -> DataFrame:
    return parse_fields(order_lines(spark, folder), ORDER_FIELDS)


def raw_file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One file per order status: header, order lines, a control line and a trailer."""
    lines = order_lines(spark, folder)
    per_file = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key")
    )

    def extra(part: int, text: Column) -> DataFrame:
        return per_file.select(
            "file", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("seq"), text.alias("value")
        )

    count = F.lpad(F.col("n").cast("string"), 10, "0")
    return join_sections(
        extra(0, F.concat(F.lit("PA"), F.col("file"), count)),
        lines.select("file", F.lit(1).alias("part"), F.col("o_orderkey").alias("seq"), "value"),
        extra(2, F.concat(F.lit("CD100"), F.col("last_key").cast("string"), F.lit(" \t "))),
        extra(3, F.concat(F.lit("PT"), count)),
    )


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"


def order_files(spark: SparkSession, folder: str) -> str:
    """Text files of ``raw_file_lines``, one per order status, as the jobs get them."""
    path = new_path(spark, "orders")
    lines = raw_file_lines(spark, folder).repartition("file").sortWithinPartitions("file", "part", "seq")
    lines.select("file", "value").write.partitionBy("file").text(path)
    return f"{path}/file=*/*.txt"


def status_of(file: Column) -> Column:
    return F.regexp_extract(file, "file=([^/]*)/", 1)


def route_records(spark: SparkSession, folder: str) -> DataFrame:
    routed = route(read_lines(spark, order_files(spark, folder)))
    record = F.when(F.col("section") == CONTROL, control_line(F.col("value"))).otherwise(F.col("value"))
    return routed.select(status_of(F.col("file")).alias("file"), "line_no", "section", record.alias("record"))


def header_synthesis(spark: SparkSession, folder: str) -> DataFrame:
    """A synthetic header for each of several files."""
    lines = route(read_lines(spark, order_files(spark, folder)))
    fields = fields_from_widths([("mark", 2), ("status", 1), ("rows", 10)])
    headers = written(parse_fields(lines.filter(F.col("section") == HEADER), fields, LINE_KEY), "headers")
    made = synthesize_headers(headers, {f.name: {"sdtype": CATEGORICAL} for f in fields}, seed=0)
    return made.select(status_of(F.col("file")).alias("file"), "line_no", "mark", F.length("rows").alias("width"))


def numeric_trailers(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of amounts that come as plain numbers in texts, some of them none."""
    whole = F.floor("o_totalprice").cast("string")
    broken = F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).when(F.col("o_orderkey") % 7 == 0, F.lit(""))
    claims = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("file"), F.coalesce(broken, F.concat(F.lit(" "), whole)).alias("net_amount_due"))
    return page_trailers(claims, ["file"], NUMBERS)


def layout_file(spark: SparkSession, folder: str) -> DataFrame:
    """The layout of q01 as a file without numbers, whose rows give the order."""
    path = new_path(spark, "layout.csv")
    layout = layout_offsets(spark, folder).coalesce(1).sortWithinPartitions("ColID")
    write_delimited(layout.select(F.col("Column_Name").alias(" Column_Name "), F.lit("varchar").alias("DataTtype"), "Length", "Type"), path)
    found = with_offsets(read_layout(spark, path))
    return found.select("Column_Name", "Length", "Type", "Start", F.col("ColID").isNull().alias("unnumbered"))


def written_sections(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "sections")
    write_sections(claim_file(spark, folder), path)
    return spark.read.text(path).select("file", F.col("value").alias("line"))


def delimited_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "customer.csv")
    write_delimited(table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    read = read_delimited(spark, path)
    kinds = {c: F.lit(t).alias(f"{c}_type") for c, t in read.dtypes}
    return read.select("c_custkey", "c_name", "c_acctbal", kinds["c_custkey"], kinds["c_acctbal"])


def stored_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata that a job detects and stores, and that the next one finds."""
    parts, base = table(spark, folder, "part"), new_path(spark, "metadata")
    stored_or_detected(parts, base, "part")
    save_metadata(spark, base, "part", {"p_size": {"sdtype": CATEGORICAL}})
    steps = {"first": metadata_path(base, "part", 1)}
    steps["latest"] = metadata_path(base, "part", latest_metadata_version(spark, base, "part"))
    tables = [read_metadata_table(spark, p).select(F.lit(s).alias("step"), "column", "sdtype") for s, p in steps.items()]
    return tables[0].unionByName(tables[1])


def generated_file(spark: SparkSession, folder: str) -> DataFrame:
    """As many claims as there are orders, written and read again."""
    path = new_path(spark, "claims")
    generate_file(spark, path, table(spark, folder, "orders").count())
    return parse_claims(spark.read.text(path))


def fresh_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Forms of real and of as many synthetic ids: rows, different ones, least and greatest width."""
    real = table(spark, folder, "customer").select("c_custkey", "c_name")
    model = copula.fit(real, {c: {"sdtype": ID} for c in real.columns})
    made = copula.sample(model, numbered_rows(spark, real.count()), ["id"])
    shown = made.select("c_name", F.col("c_custkey").cast("string").alias("c_custkey"))
    forms = shown.unpivot([], ["c_custkey", "c_name"], "column", "value")
    widest = F.max(F.length("value"))
    return forms.groupBy("column").agg(
        F.count("value").alias("n"), F.count_distinct("value").alias("n_distinct"), widest.alias("width"),
        F.max(F.regexp_replace("value", "[0-9]+$", "")).alias("prefix"),
    )


def id_diagnostic(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that are sampled are possible ones; ids that repeat, or are wider, are not."""
    real = table(spark, folder, "customer").select("c_custkey", "c_name")
    repeated = real.select((F.col("c_custkey") % 2 + 1).alias("c_custkey"), F.concat("c_name", F.lit("0")).alias("c_name"))
    kinds = {c: {"sdtype": ID} for c in real.columns}
    made = copula.sample(copula.fit(real, kinds), numbered_rows(spark, real.count()), ["id"]).drop("id")
    cases = [compare.diagnostic(real, other, kinds).withColumn("case_name", F.lit(case))
             for case, other in (("sampled", made), ("repeated", repeated))]
    return rounded_scores(cases[0].unionByName(cases[1]))


def category_marginal(spark: SparkSession, folder: str) -> DataFrame:
    """Running counts of a column of 12,000 categories and null, in the order of the texts."""
    key = F.col("o_orderkey") % 12000
    orders = table(spark, folder, "orders").select(F.when(key != 7, F.concat(F.lit("k"), key)).alias("code"))
    model = copula.fit(orders, {"code": {"sdtype": CATEGORICAL}})
    return copula.shares_table(spark, model.marginals[0])


def date_coerce(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = (
        F.when(key % 21 == 0, F.lit("N/A"))
        .when(key % 21 == 7, F.lit("20011345"))
        .when(key % 21 == 14, F.lit(""))
        .otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    )
    return table(spark, folder, "orders").select(
        "o_orderkey", text.alias("date_text"), coerce_date(text).alias("parsed")
    )


def coded_balances(spark: SparkSession, folder: str) -> DataFrame:
    """Balances as overpunched cents, some of them broken in each of the ways that occur."""
    key = F.col("c_custkey")
    value = cents(F.col("c_acctbal"))
    text = (
        F.when(key % 11 == 0, F.lit("1B2A"))
        .when(key % 13 == 5, F.lit(""))
        .when(key % 17 == 3, F.lpad(F.abs(value).cast("string"), 10, "0"))
        .when(key % 19 == 7, F.lit("1A2A"))
        .when(key % 23 == 9, F.lit("5Z"))
        .otherwise(overpunched(value, 10))
    )
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey", text.alias("amount"))


def amount_decode(spark: SparkSession, folder: str) -> DataFrame:
    return decode_totals(coded_balances(spark, folder), "amount", ["c_nationkey"])


def amount_values(spark: SparkSession, folder: str) -> DataFrame:
    return coded_balances(spark, folder).select(
        "c_custkey", "amount", decode_amount(F.col("amount")).alias("value")
    )


def mask_ids(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        "c_custkey",
        "c_name",
        F.col("c_custkey").cast("string").alias("id_text"),
        F.concat("c_name", "c_mktsegment", "c_name").alias("long_id"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.replace("c_mktsegment", F.lit("MACHINERY"), F.lit("")).alias("blank"),
    )
    return mask_columns(
        customers, ["c_name", "id_text", "long_id", "segment", "blank"], ["c_custkey"]
    )


def with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    price = F.when(status == "F", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.nullif(status, F.lit("P")).alias("o_orderstatus"),
        price.alias("o_totalprice"),
        F.when(status == "O", F.lit("")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )


def null_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_nulls(with_gaps(spark, folder))


def non_null(spark: SparkSession, folder: str) -> DataFrame:
    return non_null_counts(normalise_nulls(with_gaps(spark, folder)))


def claim_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as claims: net amount overpunched, negative for finished ones, gross as number."""
    value = cents(F.col("o_totalprice"))
    net = F.when(F.col("o_orderstatus") == "F", -value).otherwise(value)
    return table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("file"),
        overpunched(net, 11).alias("net_amount_due"),
        F.col("o_totalprice").alias("gross_amount_due"),
    )


def page_trailer(spark: SparkSession, folder: str) -> DataFrame:
    claims = claim_amounts(spark, folder)
    zero, decoded = (
        page_trailers(claims, ["file"], mode).withColumn("mode", F.lit(mode))
        for mode in (ZERO, DECODE)
    )
    return zero.unionByName(decoded)


# ---------------------------------------------------------------- generated claims


def keyed_orders(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "orders").select("o_orderkey"))


def generate_claims(spark: SparkSession, folder: str) -> DataFrame:
    return claim_lines(keyed_orders(spark, folder), ["o_orderkey"]).withColumnRenamed("value", "line")


def positional_to_table(spark: SparkSession, folder: str) -> DataFrame:
    return parse_claims(claim_lines(keyed_orders(spark, folder), ["o_orderkey"]), ["o_orderkey"])


def claims_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Per field: rows, and rows whose parsed value is the generated one."""
    names = [name for name, _, _ in CLAIM_FIELDS]
    made = claim_columns(keyed_orders(spark, folder), ["o_orderkey"])
    lines = made.withColumn("value", F.concat(*names))
    kept = lines.select("value", *[F.trim(n).alias(f"made_{n}") for n in names])
    parsed = parse_claims(kept, [f"made_{n}" for n in names])
    equal = parsed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(n) == F.col(f"made_{n}")).alias(n) for n in names],
    )
    return equal.unpivot(["n_rows"], names, "field", "n_equal")


# ---------------------------------------------------------------- synthesis


def priced_items(spark: SparkSession, folder: str) -> DataFrame:
    net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    items = table(spark, folder, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )
    return spread(items).withColumn("net", net)


def detect_kinds(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        column_kinds(spread(table(spark, folder, name)), exact=True).select(
            F.lit(name).alias("table_name"), "column", "kind", "non_null", "n_distinct"
        )
        for name in ("lineitem", "part")
    ]
    return parts[0].unionByName(parts[1])


def kind_override(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of the parts' columns before and after an override, and one that cannot apply."""
    parts = table(spark, folder, "part")
    found = {
        r["column"]: {"sdtype": r["kind"]}
        for r in column_kinds(parts, exact=True).select("column", "kind").collect()
    }
    cases = {
        "detected": found,
        "overridden": override_kind(found, ["p_size", "p_retailprice"]),
        "not_applicable": override_kind(found, ["p_size", "p_missing"]),
    }
    rows = [
        (case, column, spec["sdtype"]) for case, kinds in cases.items() for column, spec in kinds.items()
    ]
    return spark.createDataFrame(rows, "case_name string, column string, kind string")


def copula_marginals(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "l_partkey"]
    grid = ranks.quantile_table(priced_items(spark, folder), columns, GRID_STEPS)
    return grid.select(
        "column", "idx", F.round("quantile", 6).alias("quantile"), F.round("lower", 6).alias("lower")
    )


def price_model(spark: SparkSession, folder: str) -> tuple[DataFrame, copula.CopulaModel]:
    items = priced_items(spark, folder).select("l_quantity", "l_extendedprice", "net")
    kinds = {c: {"sdtype": NUMERICAL} for c in items.columns}
    kinds["l_quantity"]["distribution"] = DISCRETE
    return items, copula.fit(items, kinds, steps=GRID_STEPS)


def copula_correlation(spark: SparkSession, folder: str) -> DataFrame:
    items, model = price_model(spark, folder)
    rows = [
        (a, b, float(model.correlation[i, j]))
        for i, a in enumerate(items.columns)
        for j, b in enumerate(items.columns)
        if i < j
    ]
    return spark.createDataFrame(rows, "first string, second string, correlation double")


def copula_sample(spark: SparkSession, folder: str) -> DataFrame:
    items, model = price_model(spark, folder)
    made = copula.sample(model, numbered_rows(spark, items.count()), ["id"])
    return made.select(
        "id", "l_quantity", F.round("l_extendedprice", 2).alias("l_extendedprice"),
        F.round("net", 4).alias("net"),
    )


def discrete_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Draws from discrete numbers, of 1,000, of 1,001 and of any number of values; all of them are real values."""
    key = F.col("l_partkey") * 7919 + F.col("l_orderkey")
    items = spread(table(spark, folder, "lineitem")).select(
        (key % 1000).alias("thousand"), (key % 1001).alias("one_more"), F.col("l_orderkey").alias("many"))
    n = table(spark, folder, "orders").count()
    parts = []
    for c in items.columns:
        model = copula.fit(items, {c: {"sdtype": NUMERICAL}}, steps=GRID_STEPS)
        made = copula.sample(model, numbered_rows(spark, n), ["id"])
        parts.append(made.select(F.lit(c).alias("column"), "id", F.col(c).alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sketched_marginals(spark: SparkSession, folder: str) -> DataFrame:
    """Grids from sketches: whether every point's exact rank is as near as the model says."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "net"]
    items = priced_items(spark, folder).select(*columns)
    model = copula.fit(items, {c: {"sdtype": NUMERICAL} for c in columns}, steps=GRID_STEPS, exact=False)
    points = [(m.column, i / GRID_STEPS, p, m.rank_error) for m in model.marginals for i, p in enumerate(m.points)]
    grid = spark.createDataFrame(points, "column string, place double, value double, rank_error double")
    ranked = ranks.running_counts(ranks.count_values(ranks.numbers(items, columns), columns, {"n": F.count(F.lit(1))}), ["n"])
    found = grid.join(ranked, ["column", "value"], "left")
    low, high = F.col("before_n") / F.col("total_n"), (F.col("before_n") + F.col("n")) / F.col("total_n")
    off = F.greatest(low - F.col("place"), F.col("place") - high, F.lit(0.0))
    return found.groupBy("column").agg(
        F.count("n").alias("real_points"), F.max("total_n").alias("n_rows"),
        (F.max(off) <= F.max("rank_error") + F.lit(1e-12)).alias("within"))


def sketched_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the sketched interval of each Kolmogorov-Smirnov score holds the exact one, and is narrow."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "l_partkey"]
    both = compare.stack(*flagged_items(spark, folder), columns)
    found = compare.ks_intervals(both, columns).drop("metric")
    scores = compare.ks_scores(both, columns).join(found, "column")
    bound = 4 * sketches.RANK_ERROR + 4 / compare.SKETCH_STEPS
    held = (F.col("low") <= F.col("score")) & (F.col("score") <= F.col("high"))
    return rounded_scores(scores.select("column", "score", held.alias("held"), (F.col("high") - F.col("low") <= bound).alias("narrow")))


def date_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with dates in two formats: mostly the one, mostly the other, both alike, and none."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    first, second = F.date_format(day, "yyyyMMdd"), F.date_format(day, "yyyy-MM-dd")
    texts = table(spark, folder, "orders").select(
        F.when(key % 3 == 0, second).otherwise(first).alias("mostly_first"),
        F.when(key % 3 == 0, first).otherwise(second).alias("mostly_second"),
        F.when(key % 5 == 0, F.lit("none")).otherwise(first).alias("partly"), F.col("o_orderpriority"))
    formats = ("yyyyMMdd", "yyyy-MM-dd")
    kinds = column_kinds(texts, date_formats=formats).select("column", "kind", F.col("datetime_format").alias("stored"), "format_conflicts")
    return format_votes(texts, formats).join(kinds, "column")


def fixed_combinations(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_brand", "p_type")
    kinds = {c: {"sdtype": CATEGORICAL} for c in parts.columns}
    return synthesize_with_combinations(
        spark, parts, kinds, ["p_brand", "p_type"], n=1000, row_key="id"
    )


# ---------------------------------------------------------------- evaluation


def flagged_items(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    items = priced_items(spark, folder)
    return items.filter("l_returnflag = 'A'"), items.filter("l_returnflag <> 'A'")


def order_halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders")
    return orders.filter("o_orderstatus = 'O'"), orders.filter("o_orderstatus <> 'O'")


def rounded_scores(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 9))


def shape_numeric(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "l_partkey"]
    return rounded_scores(
        compare.ks_scores(compare.stack(*flagged_items(spark, folder), columns), columns)
    )


def shape_categorical(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["o_orderpriority", "o_custkey", "o_orderdate"]
    return rounded_scores(
        compare.tv_scores(compare.stack(*order_halves(spark, folder), columns), columns)
    )


def pair_correlation(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "net"]
    both = compare.stack(*flagged_items(spark, folder), columns)
    return rounded_scores(compare.correlation_scores(both, list(combinations(columns, 2))))


def pair_contingency(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["o_orderpriority", "o_custkey", "o_totalprice"]
    pairs = [("o_orderpriority", "o_custkey"), ("o_totalprice", "o_orderpriority")]
    both = compare.stack(*order_halves(spark, folder), columns)
    return rounded_scores(compare.contingency_scores(both, pairs, ["o_totalprice"]))


ORDER_KINDS = {
    "o_custkey": {"sdtype": CATEGORICAL},
    "o_orderpriority": {"sdtype": CATEGORICAL},
    "o_totalprice": {"sdtype": NUMERICAL},
    "o_orderdate": {"sdtype": DATETIME},
}


def diagnostic(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_scores(compare.diagnostic(*order_halves(spark, folder), ORDER_KINDS))


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_scores(compare.quality(*order_halves(spark, folder), ORDER_KINDS))


# ---------------------------------------------------------------- files, versions, head


def claim_file(spark: SparkSession, folder: str) -> DataFrame:
    """One output file per order status: header, order lines, control line, trailer."""
    raw = raw_file_lines(spark, folder)
    orders = order_values(spark, folder).withColumnRenamed("cents", "net_amount_due")
    header = raw.filter(F.col("part") == 0)
    control = raw.filter(F.col("part") == 2)
    file = F.col("file")
    return join_sections(
        section_lines(header, "header", F.col("value"), file, F.col("seq")),
        section_lines(
            order_values(spark, folder),
            "detail",
            render_line(ORDER_FIELDS, ["o_orderdate"]),
            file,
            F.col("o_orderkey"),
        ),
        section_lines(control, "control", control_line(F.col("value")), file, F.col("seq")),
        section_lines(page_trailers(orders, ["file"], DECODE), "trailer", F.col("line"), file, F.lit(0)),
    )


def trailer_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """Files of several pages, some of whose trailers declare too much or nothing, against their lines."""
    page = F.floor(F.col("o_orderkey") / 500)
    orders = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("file"), (F.col("o_orderkey") * 2).alias("line_no"), page.alias("page"), cents(F.col("o_totalprice")).alias("amount"))
    details = orders.select("file", "line_no", F.concat(F.lit("DE"), F.col("amount").cast("string")).alias("value"), "amount")
    counted = orders.where("file <> 'P' OR page % 9 <> 4").groupBy("file", "page").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    n = F.col("n") + F.when(F.col("page") % 7 == 3, F.lit(1)).otherwise(F.lit(0))
    total = F.col("total") + F.when(F.col("page") % 5 == 2, F.lit(100)).otherwise(F.lit(0))
    line = F.concat(F.lit("PT"), F.lpad(n.cast("string"), 10, "0"), F.lpad(total.cast("string"), 11, "0"), F.lit("A"))
    broken = F.when(F.col("page") % 11 == 6, F.lit("PTnone")).otherwise(line)
    trailers = counted.select("file", (F.col("page") * 1000 + 999).alias("line_no"), broken.alias("value"), F.lit(None).cast("long").alias("amount"))
    return reconciled(details.unionByName(trailers))


def metadata_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as stored versions: the brand names a document, the size is its version."""
    parts = table(spark, folder, "part").select("p_brand", F.col("p_size").alias("version"))
    return latest_versions(parts, ["p_brand"])


def head_rows(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    return head(items, items.columns, 10)


def trailers_of_parsed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines to columns to decoded totals: one trailer per file of positional lines."""
    claims = claim_amounts(spark, folder)
    fields = fields_from_widths([("net_amount_due", 11), ("gross_amount_due", 12)])
    texts = claims.withColumn("gross_amount_due", cents(F.col("gross_amount_due")))
    lines = texts.select("file", render_line(fields).alias("value"))
    return page_trailers(parse_fields(lines, fields, ["file"]), ["file"], DECODE)


QUERIES = {
    "q01_layout_offsets": layout_offsets,
    "q02_render_lines": render_lines,
    "q03_parse_lines": parse_lines,
    "q04_route_records": route_records,
    "q05_date_coerce": date_coerce,
    "q06_amount_decode": amount_decode,
    "q07_mask_ids": mask_ids,
    "q08_null_normalise": null_normalise,
    "q09_non_null_counts": non_null,
    "q10_page_trailer": page_trailer,
    "q11_positional_to_table": positional_to_table,
    "q12_generate_claims": generate_claims,
    "q13_detect_kinds": detect_kinds,
    "q14_copula_marginals": copula_marginals,
    "q15_copula_correlation": copula_correlation,
    "q16_copula_sample": copula_sample,
    "q17_fixed_combinations": fixed_combinations,
    "q18_shape_numeric": shape_numeric,
    "q19_shape_categorical": shape_categorical,
    "q20_pair_correlation": pair_correlation,
    "q21_pair_contingency": pair_contingency,
    "q22_diagnostic": diagnostic,
    "q23_claim_file": claim_file,
    "q24_metadata_versions": metadata_versions,
    "q25_head": head_rows,
    "q26_claims_roundtrip": claims_roundtrip,
    "q27_kind_override": kind_override,
    "q28_amount_values": amount_values,
    "q29_quality_report": quality_report,
    "q30_parsed_trailers": trailers_of_parsed_lines,
    "q31_layout_file": layout_file,
    "q32_written_sections": written_sections,
    "q33_delimited_roundtrip": delimited_roundtrip,
    "q34_stored_metadata": stored_metadata,
    "q35_generated_file": generated_file,
    "q36_fresh_ids": fresh_ids,
    "q37_header_synthesis": header_synthesis,
    "q38_category_marginal": category_marginal,
    "q39_numeric_trailers": numeric_trailers,
    "q40_id_diagnostic": id_diagnostic,
    "q41_discrete_numbers": discrete_numbers,
    "q42_sketched_marginals": sketched_marginals,
    "q43_sketched_shapes": sketched_shapes,
    "q44_date_votes": date_votes,
    "q45_trailer_reconciliation": trailer_reconciliation,
}

"""Rows per second of single jobs on local[$BENCH_CPUS]: python throughput.py [claims]"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from claimweave.operators import compare, copula, generate, parse, render, trailer  # noqa: E402
from claimweave.plans import flows, queries  # noqa: E402
from claimweave.session import configured  # noqa: E402
from claimweave.sources.lines import read_lines, route  # noqa: E402
from claimweave.sources.metadata import NUMERICAL  # noqa: E402
from claimweave.sources.storage import written  # noqa: E402


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 1_000_000
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        configured(SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]"))
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")

    def timed(job, rows, run):
        start = time.perf_counter()
        result = run()
        seconds = time.perf_counter() - start
        print(json.dumps({"job": job, "rows": rows, "sec": round(seconds, 2), "rows_per_sec": int(rows / seconds)}), flush=True)
        return result

    timed("generate claims, written", 50_000, lambda: flows.generate_file(spark, f"{out}/small", 50_000))
    timed("generate claims, written", n, lambda: flows.generate_file(spark, f"{out}/claims", n))
    lines = spark.read.text(f"{out}/claims")
    timed("parse 16 fields", n, lambda: noop(generate.parse_claims(lines)))
    timed("number and route lines", n, lambda: noop(route(read_lines(spark, f"{out}/claims"))))
    timed("claims to csv, written", n, lambda: flows.positional_to_csv(spark, f"{out}/claims", f"{out}/csv"))
    claims = generate.parse_claims(lines)
    table = written(claims.withColumn("row", F.monotonically_increasing_id()), "claims")
    ids = ["claim_number", "patient_id", "social_security_number", "credit_card_number"]
    timed("mask 4 columns", n, lambda: noop(parse.mask_columns(table, ids, ["row"])))
    line = render.render_line(generate.CLAIM_LAYOUT)
    timed("render lines", n, lambda: noop(table.select(line)))
    timed("decoded trailer", n, lambda: noop(trailer.page_trailers(table, amounts="decode")))
    sections = render.section_lines(table, "detail", line, F.lit("claims"), F.col("row"))
    timed("ordered sections, written", n, lambda: render.write_sections(sections, f"{out}/sections"))

    items = written(queries.priced_items(spark, folder), "items")
    rows = items.count()
    for columns in (
        ["l_quantity", "l_extendedprice", "net"],
        ["l_quantity", "l_extendedprice", "net", "l_discount", "l_tax", "l_partkey"],
    ):
        real = items.select(*columns)
        kinds = {c: {"sdtype": NUMERICAL} for c in columns}
        k = len(columns)
        model = timed(f"copula fit, {k} columns", rows, lambda: copula.fit(real, kinds))
        timed(f"copula fit from sketches, {k} columns", rows, lambda: copula.fit(real, kinds, exact=False))
        made = timed(
            f"copula sample, {k} columns, written",
            rows,
            lambda: written(copula.sample(model, spark.range(rows), ["id"]).drop("id"), "made"),
        )
        timed(f"quality, {k} columns", rows, lambda: noop(compare.quality(real, made, kinds)))
    spark.stop()


if __name__ == "__main__":
    main()

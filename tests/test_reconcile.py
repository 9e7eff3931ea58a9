"""Page trailers held against the lines before them."""

import random

from pyspark.sql import functions as F

from claimweave.operators import ranks
from claimweave.operators.reconcile import reconciled

SCHEMA = "file string, line_no long, value string, amount long"


def brute(rows):
    out = []
    for file in {r[0] for r in rows}:
        n = total = 0
        for _, line_no, value, amount in sorted((r for r in rows if r[0] == file), key=lambda r: r[1]):
            if not value or not value.startswith("PT"):
                n, total = n + 1, total + (amount or 0)
                continue
            whole = int(total)
            if value == "PTnone":
                out.append((file, line_no, None, n, None, whole, "unreadable"))
            else:
                d, t = int(value[2:12]), int(value[12:23])
                status = {(True, True): "equal", (False, True): "rows", (True, False): "total", (False, False): "both"}[d == n, t == whole]
                out.append((file, line_no, d, n, t, whole, status))
            n = total = 0
        if n:
            out.append((file, None, None, n, None, int(total), "unclosed"))
    return sorted(out, key=str)


def got(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).repartition(3)
    found = reconciled(frame).collect()
    return sorted((tuple(int(v) if i in (4, 5) and v is not None else v for i, v in enumerate(r)) for r in found), key=str)


def test_pages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranks, "range_count", lambda spark: 17)
    rng = random.Random(3)
    rows = []
    for file, lines in (("long", 900), ("short", 5), ("pages", 60), ("none", 40)):
        n = total = 0
        for line_no in range(lines):
            if file != "none" and rng.random() < (0.5 if file == "pages" else 0.06):
                shown = n + (rng.random() < 0.2), int(total) + (rng.random() < 0.2)
                rows.append((file, line_no, "PTnone" if rng.random() < 0.1 else f"PT{shown[0]:010}{shown[1]:011}A", None))
                n = total = 0
            else:
                amount = rng.choice([None, rng.randrange(-500, 2000)])
                rows.append((file, line_no, rng.choice(["DE1", "", None]), amount))
                n, total = n + 1, total + (amount or 0)
    want = brute(rows)
    assert got(spark, rows) == want and len({r[6] for r in want}) == 6


def test_reconciling_no_lines(spark):
    assert got(spark, []) == []

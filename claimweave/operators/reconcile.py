"""Page trailers against the detail lines before them: what each declares, and what its page holds.

A page is the detail lines of a file between one trailer and the next. Lines are cut into ranges by file and line
number, counts and totals run within each range, and what a file has in earlier ranges is added from one row per file and
range. So a file of any length is spread over tasks, and no line is joined with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators import ranks
from claimweave.operators.trailer import AMOUNT_WIDTH, COUNT_WIDTH, MARK, SUM_TYPE
from claimweave.sources.storage import written

EQUAL, ROWS, TOTAL, BOTH, UNCLOSED, UNREADABLE = "equal", "rows", "total", "both", "unclosed", "unreadable"


def declared(line: Column) -> tuple[Column, Column]:
    """Record count and first amount of a trailer line; null where they are no numbers."""
    start = len(MARK) + 1
    count = F.substring(line, start, COUNT_WIDTH)
    amount = F.substring(line, start + COUNT_WIDTH, AMOUNT_WIDTH)
    return F.try_to_number(count, F.lit("9" * COUNT_WIDTH)).cast("long"), F.try_to_number(amount, F.lit("S" + "9" * AMOUNT_WIDTH)).cast("decimal(38,0)")


def reconciled(lines: DataFrame) -> DataFrame:
    """(file, line_no, declared_rows, counted_rows, declared_total, counted_total, status) per trailer.

    lines: (file, line_no, value, amount); lines that begin with the trailer's mark are trailers, all others details,
    with a null amount counting as a row without amount. Totals are cut to whole numbers, as trailers have them. Details
    after a file's last trailer are a page without line number, ``unclosed``; a trailer without numbers is
    ``unreadable``. A trailer that follows another at once closes a page of no rows.
    """
    is_trailer = F.coalesce(F.col("value").startswith(MARK), F.lit(False))
    rows, total = declared(F.col("value"))
    none = F.lit(0).cast(SUM_TYPE)
    marked = lines.select(
        "file", "line_no", is_trailer.alias("is_trailer"),
        F.when(is_trailer, rows).alias("declared_rows"), F.when(is_trailer, total).alias("declared_total"),
        F.when(is_trailer, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n"),
        F.when(is_trailer, none).otherwise(F.coalesce(F.col("amount").cast(SUM_TYPE), none)).alias("amount"))
    ordered = marked.repartitionByRange(ranks.range_count(lines.sparkSession), "file", "line_no")
    ranged = written(ordered.withColumn("range_no", F.spark_partition_id()), "ranges")
    # One row per file and range that it has lines in.
    sums = ranged.groupBy("file", "range_no").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    earlier = Window.partitionBy("file").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sums.select(
        "file", "range_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start_n"),
        F.coalesce(F.sum("amount").over(earlier), F.lit(0)).cast("decimal(38,4)").alias("start_amount"),
        F.sum("n").over(Window.partitionBy("file")).alias("all_n"),
        F.sum("amount").over(Window.partitionBy("file")).alias("all_amount")), "starts")
    here = Window.partitionBy("file", "range_no").orderBy("line_no")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranged.withColumns({"in_n": F.sum("n").over(upto), "in_amount": F.sum("amount").over(upto)}).where("is_trailer")
    trailers = written(running.join(starts, ["file", "range_no"]).select(
        "file", "range_no", "line_no", "declared_rows", "declared_total", (F.col("start_n") + F.col("in_n")).alias("n"),
        (F.col("start_amount") + F.col("in_amount")).alias("amount")), "trailers")
    # The trailer before: in the same range, or the last one of the file's earlier ranges.
    lasts = trailers.groupBy("file", "range_no").agg(F.max_by(F.struct("n", "amount"), "line_no").alias("last"))
    lasts = starts.select("file", "range_no").join(lasts, ["file", "range_no"], "left").select(
        "file", "range_no", F.last("last", ignorenulls=True).over(earlier).alias("before"), F.last("last", ignorenulls=True).over(
            Window.partitionBy("file").orderBy("range_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("final"))
    lasts = written(lasts, "lasts")
    previous = F.coalesce(F.lag(F.struct("n", "amount")).over(here), F.col("before"))
    pages = trailers.join(lasts.drop("final"), ["file", "range_no"]).withColumn("previous", previous).select(
        "file", "line_no", "declared_rows", (F.col("n") - F.coalesce("previous.n", F.lit(0))).alias("counted_rows"),
        "declared_total", (F.col("amount") - F.coalesce("previous.amount", F.lit(0))).alias("amount"), F.lit(False).alias("open"))
    whole_file = starts.join(lasts.drop("before"), ["file", "range_no"]).select(
        "file", (F.col("all_n") - F.coalesce("final.n", F.lit(0))).alias("counted_rows"),
        (F.col("all_amount") - F.coalesce("final.amount", F.lit(0))).alias("amount")).distinct()
    unclosed = whole_file.where("counted_rows > 0").withColumn("open", F.lit(True))
    found = pages.unionByName(unclosed, allowMissingColumns=True)
    whole = F.floor(F.abs("amount"))
    found = found.withColumn("counted_total", F.when(F.col("amount") < 0, -whole).otherwise(whole).cast("decimal(38,0)"))
    same_rows, same_total = F.col("declared_rows") == F.col("counted_rows"), F.col("declared_total") == F.col("counted_total")
    status = (
        F.when(F.col("open"), UNCLOSED).when(F.col("declared_rows").isNull() | F.col("declared_total").isNull(), UNREADABLE)
        .when(same_rows & same_total, EQUAL).when(same_total, ROWS).when(same_rows, TOTAL).otherwise(BOTH))
    return found.select("file", "line_no", "declared_rows", "counted_rows", "declared_total", "counted_total", status.alias("status"))

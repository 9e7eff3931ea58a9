"""Mix sources to target weights by pivotal dependent rounding.

Every document of a source is wanted `target / source size` times: a whole number of copies and
a fraction. Fractions are rounded by pairs: two documents exchange mass (fraction times words) at
random, each keeping its expected fraction, until one of them is 0 or 1. So the words taken from
a source never move. The words of the last document of a source left with a fraction go to the largest
documents of the whole source that took none and fit, so what is missing is less than the least of these.

Pairs are made along a reduction tree. Documents of a source are dealt to blocks of about `BLOCK`
by a hash of their key, a block is reduced by one fold to decisions and a single carry, and the
carries are the documents of the next level. A source of a third of all rows has more blocks.
Everything is drawn from hashes of seed, level and document, so reruns agree.

Defined results: a null or blank text has size 0 and takes 0. Null sources are one source, which
comes last. Rows of equal id, source and size are counted and told apart by their number. A source
without words has target 0. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import small, words, written

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
BLOCK = 64
# A fraction this near to 0 or 1 is taken as it.
NEAR = 1e-9
UNIFORM = 1 << 52
HASHES, PARTS = 1 << 40, 1 << 10


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row per source.

    Sharing an excess again by weight until no target is above its limit ends at
    least(limit, level * weight) for the one level that uses up all words. With limits in order
    of limit / weight the level is the greatest of (words not taken by the limits before) /
    (weights from here on).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.get(F.array(*(F.lit(w) for w in weights)), (F.row_number().over(order) - 1) % len(weights))
    ranked = sources.withColumn("weight", share).withColumn("limit", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    leveled = ranked.withColumn("level", level)
    top = F.max("level").over(everything)
    target = F.least(F.col("limit").cast("double"), top * F.col("weight"))
    return leveled.select("source", "source_size", target.cast("double").alias("target"))


def _draw(seed: int, level: int, *key: Column) -> Column:
    """A uniform number in [0, 1) that belongs to a key."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), *key), F.lit(UNIFORM)) / F.lit(float(UNIFORM))


def _fold(items: Column, seed: int, level: int) -> Column:
    """Pair the documents of a block in order; the result has their decisions and the carry."""

    def step(acc: Column, item: Column) -> Column:
        c = acc["carry"]
        left, right = c["p"] * c["size"], item["p"] * item["size"]
        # Words that can move from the item to the carry, and back, until one is 0 or 1.
        up = F.least((1 - c["p"]) * c["size"], right)
        down = F.least(left, (1 - item["p"]) * item["size"])
        go_up = _draw(seed, level, c["id"], c["copy"], item["id"], item["copy"]) * (up + down) < down
        moved = F.when(go_up, up).otherwise(-down)
        near = lambda p: F.when(p < NEAR, F.lit(0.0)).when(p > 1 - NEAR, F.lit(1.0)).otherwise(p)
        p, q = near((left + moved) / c["size"]), near((right - moved) / item["size"])

        def decided(pq: Column) -> Column:
            whole = lambda x: (x == 0.0) | (x == 1.0)
            a, b = c.withField("p", pq["p"]), item.withField("p", pq["q"])
            done = F.filter(F.array(a, b), lambda x: whole(x["p"]))
            rest = F.filter(F.array(a, b), lambda x: ~whole(x["p"]))
            return F.struct(F.get(rest, F.lit(0)).alias("carry"), F.concat(acc["done"], done).alias("done"))

        pair = F.transform(F.array(F.struct(p.alias("p"), q.alias("q"))), decided)
        # Without a carry (both were decided by the last pair) the item is the next one.
        return F.when(c.isNull(), F.struct(item.alias("carry"), acc["done"].alias("done"))).otherwise(F.get(pair, F.lit(0)))

    first = F.get(items, F.lit(0))
    none = F.filter(items, lambda x: F.lit(False))
    start = F.struct(F.when(F.lit(False), first).alias("carry"), none.alias("done"))
    return F.aggregate(items, start, step)


def _given(decided: DataFrame, left: DataFrame, seed: int) -> DataFrame:
    """(source, id, copy, size) of decided documents that took none and are given the words left, largest first.

    left: (source, rest), one row per source. What is given is counted by size, so that the walk
    from large to small is one row per source and size; the documents of a size are those of least hash.
    """
    left = written(left.withColumnRenamed("source", "s"), "left")
    mine = F.col("source").eqNullSafe(F.col("s"))
    free = decided.where("extra = 0").join(small(left, 32), mine).where(F.col("size") <= F.col("rest") + 0.5)
    free = written(free.select("source", "id", "copy", "size", "rest",
                               F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), "id", "copy"), F.lit(HASHES)).alias("hash")), "free")
    sizes = free.groupBy("source", "size", "rest").agg(F.count("*").alias("n"))
    listed = sizes.groupBy("source", "rest").agg(F.reverse(F.sort_array(F.collect_list(F.struct("size", "n")))).alias("sizes"))

    def give(acc: Column, x: Column) -> Column:
        n = F.least(F.floor((acc["rest"] + 0.5) / x["size"]), x["n"])
        out = F.when(n > 0, F.concat(acc["out"], F.array(F.struct(x["size"].alias("z"), n.alias("take"))))).otherwise(acc["out"])
        return F.struct((acc["rest"] - n * x["size"]).alias("rest"), out.alias("out"))

    start = F.struct(F.col("rest"), F.expr("cast(array() as array<struct<z: bigint, take: bigint>>)").alias("out"))
    takes = written(listed.select(F.col("source").alias("s"), F.inline(F.aggregate("sizes", start, give)["out"])), "takes")
    wanted = free.join(small(takes, 48), mine & (F.col("size") == F.col("z"))).drop("s", "z")
    # Of each size the hashes are dealt to parts, so that no task orders all documents of a size.
    wanted = wanted.withColumn("part", F.floor(F.col("hash") / (HASHES // PARTS)))
    counts = wanted.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(
        Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("of"), before.alias("before"))
    starts = small(written(starts, "starts"), 64)
    wanted = wanted.join(starts, mine & (F.col("size") == F.col("z")) & (F.col("part") == F.col("of"))).where("before < take")
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("hash", "id", "copy"))
    return wanted.withColumn("rank", rank).where("before + rank <= take").select("source", "id", "copy", "size")


def rounded(rows: DataFrame, seed: int) -> DataFrame:
    """(source, id, copy, size, extra): 1 where a fraction became 1, else 0.

    rows: (source, id, copy, size, p) with 0 < p < 1 and size > 0.
    """
    item = ["id", "copy", "size", "p"]
    open_rows, results, lefts, level = rows, [], [], 0

    def decisions(exploded: DataFrame) -> DataFrame:
        return exploded.select("source", "d.id", "d.copy", "d.size", F.col("d.p").cast("long").alias("extra"))

    while True:
        counts = open_rows.groupBy("source").agg(F.count("*").alias("n"))
        known = counts.select(F.col("source").alias("s"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
        dealt = open_rows.join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn(
            "block", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "id", "copy"), F.col("blocks")))
        ordered = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("large_first"), *item)))
        folded = dealt.groupBy("source", "block", "blocks").agg(ordered.alias("items")).select(
            "source", "blocks", _fold(F.transform(F.col("items"), lambda x: F.struct(*(x[c].alias(c) for c in item))),
                                      seed, level).alias("r"))
        folded = written(folded, f"rounding{level}")
        results.append(decisions(folded.select("source", F.explode("r.done").alias("d"))))
        carries = folded.where("r.carry IS NOT NULL").select("source", "blocks", "r.carry.*")
        # A source with one block is done, on whichever level that is: its carry takes none, and its words are left.
        last = carries.where("blocks = 1")
        results.append(last.select("source", *item[:3], F.lit(0).cast("long").alias("extra")))
        lefts.append(last.select("source", (F.col("p") * F.col("size")).alias("rest")))
        if folded.where("blocks > 1").isEmpty():
            break
        open_rows, level = carries.where("blocks > 1").select("source", *item), level + 1
    decided = reduce(DataFrame.unionByName, results)
    given = written(_given(decided, reduce(DataFrame.unionByName, lefts), seed), "given").toDF("s", "i", "c", "z")
    same = (F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i"))
            & (F.col("copy") == F.col("c")) & (F.col("size") == F.col("z")))
    extra = F.when(F.col("z").isNotNull(), 1).otherwise(F.col("extra")).cast("long").alias("extra")
    return decided.join(small(given, 64), same, "left").select("source", "id", "copy", "size", extra)


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """(id, size, source_size, target, taken, source, copies): how often each document is taken."""
    sized = docs.select(F.col(id_column).alias("id"), F.col(source).cast("string").alias("source"),
                        F.size(words(F.col(text))).cast("long").alias("size"))
    counted = written(sized.groupBy("id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = written(targets(sources, weights, most), "targets")
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    renamed = aims.withColumnRenamed("source", "s")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each = each.join(renamed, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("wanted", wanted)
    whole = F.floor(F.col("wanted") + NEAR)
    each = each.withColumn("whole", whole).withColumn("p", F.greatest(F.col("wanted") - F.col("whole"), F.lit(0.0)))
    each = written(each, "wanted")
    extra = rounded(each.where((F.col("p") > NEAR) & (F.col("size") > 0)).select("source", "id", "copy", "size", "p"), seed)
    extra = extra.toDF("s", "i", "c", "z", "extra")
    same = (F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i"))
            & (F.col("copy") == F.col("c")) & (F.col("size") == F.col("z")))
    copies = (F.col("whole") + F.coalesce(F.col("extra"), F.lit(0))).alias("copies")
    return each.join(extra, same, "left").select(
        F.col("id").alias(id_column), "size", "source_size", "target",
        (copies * F.col("size")).cast("long").alias("taken"), F.col("source").alias(source), copies)

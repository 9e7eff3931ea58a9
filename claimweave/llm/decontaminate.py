"""Benchmark decontamination: SimHash of item-sized windows, looked up by Hamming distance.

Texts are lower-cased runs of letters and digits. A window is as long as a benchmark item, shorter only
at a text's end. Windows are cut for a text and an item that share an anchor: the item's rarest
shingles (five words), as many as leave less than the threshold's weight to the others, so every similar
window holds one. A shared shingle at place p of the item and position q of the text puts the item's start at
q - p. Over the shared shingles that one window can hold, every start from the least to the greatest
of these is taken: a window further left begins, one further right ends with a shingle that the
item lacks, and moving it by one word towards them makes it no less similar. Windows that the text's end
cuts short are best where they begin with a shared shingle; these are taken too. So words inserted, deleted
or replaced anywhere in an item lose no window.

Windows and items have 64-bit SimHash fingerprints of their words. Items are indexed by every value within
two bits of each of their eight 8-bit blocks, so each fingerprint within 23 bits of an item shares an index
key with it: were all blocks three bits apart, it would be 24. A window looks up the items that it was
cut for, so its candidates do not grow with the benchmark. Pairs within the radius are verified by weighted Jaccard similarity of
their shingles, at 0.75 or more; a shingle weighs ln(1 + items / items that contain it). Words of
texts at that similarity have a cosine of about 0.86 or more, 11 of 64 bits on average, with a deviation
of 3; the radius is four deviations further.

Equal texts are looked at once. The benchmark's anchors are broadcast only if their counted rows
are few, and joined by shuffle otherwise.

Defined results: null and empty texts and items match nothing. Items shorter than a shingle are one
shingle, their whole sequence. Repeated items of one id count as one item each. Documents
without an id are reported with a null id. Empty tables give no rows. Other columns are ignored by
`matches` and kept by `clean_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import KEY, let, small, text_key, tokens, windows_hashed, written

SHINGLE = 5
SIMILARITY = 0.75
BITS, BLOCK_BITS, FLIPS = 64, 8, 2
BLOCKS = BITS // BLOCK_BITS
RADIUS = BLOCKS * (FLIPS + 1) - 1
# Differences of a block that the index holds.
MASKS = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= FLIPS]


def simhash(words: Column) -> Column:
    """64 bits; each is set if more words (repeats counted) have it set in their hash than not."""

    def bit(hashes: Column, b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda n, h: n + 2 * F.call_function("shiftrightunsigned", h, b).bitwiseAND(1).cast("int") - 1)
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    def folded(hashes: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"),
                           lambda bits, b: bits.bitwiseOR(bit(hashes, b)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), folded)


def _blocks(fingerprint: Column) -> Column:
    return F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fingerprint, b * BLOCK_BITS)
                              .bitwiseAND((1 << BLOCK_BITS) - 1).alias("value")) for b in range(BLOCKS)))


def _shingles(words: Column, size: int) -> Column:
    return let(words, lambda w: windows_hashed(w, size))


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, m, size, words): items with words; `item` tells repeated ids apart by text."""
    read = benchmark.select(F.col(item_id).alias("item_id"), tokens(F.col(text)).alias("words")).where("size(words) > 0")
    item = F.xxhash64("item_id", "words").alias("item")
    m = F.size("words")
    return read.select(item, "item_id", m.alias("m"), F.least(m, F.lit(SHINGLE)).alias("size"), "words").dropDuplicates(["item"])


def _item_shingles(items: DataFrame, sizes: list[int]) -> DataFrame:
    """(item, m, size, place, h), one row per shingle of an item."""
    parts = [items.where(F.col("size") == s).select("item", "m", "size", F.posexplode(_shingles(F.col("words"), s)).alias("place", "h"))
             for s in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _weights(item_shingles: DataFrame) -> DataFrame:
    """(h, weight) of the benchmark's shingles, and the greatest weight, that of a shingle of one item or none."""
    total = item_shingles.select("item").distinct().count()
    df = item_shingles.groupBy("h").agg(F.countDistinct("item").alias("df"))
    return df.select("h", F.log1p(F.lit(total) / F.col("df")).alias("weight"), F.log1p(F.lit(float(total))).alias("most"))


def _anchors(item_shingles: DataFrame, weights: DataFrame) -> DataFrame:
    """(h, item, size): of each item the rarest shingles, until the others weigh less than the threshold."""
    of = item_shingles.groupBy("item", "size", "h").agg(F.count("*").alias("n")).join(weights, "h")
    heavy = of.withColumn("w", F.col("n") * F.col("weight"))
    last = Window.partitionBy("item").orderBy(F.col("weight").asc(), "h")
    upto = heavy.withColumn("upto", F.sum("w").over(last.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "all", F.sum("w").over(Window.partitionBy("item")))
    return upto.where(F.col("upto") >= F.col("all") * (SIMILARITY - 1e-6)).select("h", "item", "size")


def _anchored(texts: DataFrame, anchors: DataFrame, sizes: list[int]) -> DataFrame:
    """(key1, key2, item) of texts and items that share an anchor."""
    anchors = small(anchors, 24)
    found = [texts.select(*KEY, F.explode(_shingles(tokens(F.col("text")), s)).alias("h")).join(
        anchors.where(F.col("size") == s), "h").select(*KEY, "item") for s in sizes]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def _starts(texts: DataFrame, pairs: DataFrame, item_shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(key1, key2, item, m, size, start): the windows of each text and item; texts have (key1, key2, all)."""
    wanted = pairs.join(item_shingles, "item")
    parts = []
    for s in sizes:
        at = texts.select(*KEY, F.size("all").alias("length"), F.posexplode(_shingles(F.col("all"), s)).alias("at", "h"))
        parts.append(at.join(wanted.where(F.col("size") == s), [*KEY, "h"]))
    shared = parts[0]
    for p in parts[1:]:
        shared = shared.unionByName(p)
    order = Window.partitionBy(*KEY, "item").orderBy("at")
    apart = F.col("at") - F.lag("at").over(order) > F.col("m") - F.col("size")
    runs = shared.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn(
        "run", F.sum("apart").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    aligned = F.greatest(F.col("at") - F.col("place"), F.lit(0))
    cut_short = F.when(F.col("at") > F.col("length") - F.col("m"), F.col("at"))
    hulls = runs.groupBy(*KEY, "item", "m", "size", "run").agg(
        F.sequence(F.min(aligned), F.max(aligned)).alias("between"), F.collect_set(cut_short).alias("ends"))
    return hulls.select(*KEY, "item", "m", "size", F.explode(F.array_union("between", "ends")).alias("start")).distinct()


def _similarity(candidates: DataFrame, item_shingles: DataFrame, weights: DataFrame, sizes: list[int]) -> DataFrame:
    """Weighted Jaccard similarity of each candidate (window, item) on its shingles."""
    parts = []
    for s in sizes:
        of = candidates.where(F.col("size") == s)
        parts.append(of.select("window", "item", F.explode(_shingles(F.col("words"), s)).alias("h"), F.lit(1).alias("w"), F.lit(0).alias("i")))
        parts.append(of.select("window", "item").join(item_shingles.select("item", "h"), "item").select(
            "window", "item", "h", F.lit(0).alias("w"), F.lit(1).alias("i")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    counts = rows.groupBy("window", "item", "h").agg(F.sum("w").alias("w"), F.sum("i").alias("i"))
    most = F.max("most").over(Window.partitionBy("window", "item"))
    weighed = counts.join(small(weights, 24), "h", "left").withColumn("weight", F.coalesce("weight", most))
    return weighed.groupBy("window", "item").agg(
        F.round(F.sum(F.least("w", "i") * F.col("weight")) / F.sum(F.greatest("w", "i") * F.col("weight")), 9).alias("similarity"))


def matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, similarity, distance, start, n_words, key1, key2): the best window of each document and item.

    start counts the document's lower-case runs of letters and digits, from 0.
    """
    items = written(_items(benchmark, item_id, item_text).withColumn("item_print", simhash(F.col("words"))), "items")
    # At most SHINGLE sizes, mostly one.
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    body = F.col(text).cast("string")
    # Without items there are no shingles, hence no windows and no matches.
    sizes = sizes or [SHINGLE]
    shingles = written(_item_shingles(items, sizes), "item_shingles")
    weights = written(_weights(shingles), "weights")
    texts = docs.select(*text_key(body), body.alias("text"))
    pairs = written(_anchored(texts, written(_anchors(shingles, weights), "anchors"), sizes), "pairs")
    keys = small(written(pairs.select(*KEY).distinct(), "keys"), 32)
    # One text of each key: copies are equal, and only texts with an anchor get here.
    one = texts.join(keys, KEY, "left_semi").groupBy(*KEY).agg(F.first("text").alias("text"))
    one = written(one.select(*KEY, tokens(F.col("text")).alias("all")), "anchored")
    starts = written(_starts(one, pairs, shingles, sizes), "windows")
    cut = one.join(starts.select(*KEY, "start", "m", "size").distinct(), KEY)
    cut = cut.select(*KEY, "start", "m", "size", F.slice("all", F.col("start") + 1, F.col("m")).alias("words"))
    window = F.xxhash64(*KEY, "start", "m").alias("window")
    cut = written(cut.where(F.size("words") >= F.col("size")).select(
        window, "*", simhash(F.col("words")).alias("window_print")), "fingerprints")
    masks = F.explode(F.array(*(F.lit(m) for m in MASKS)))
    index = items.select("item", "item_print", F.explode(_blocks(F.col("item_print"))).alias("b")).select(
        "item", "item_print", "b.block", "b.value", masks.alias("mask")).select(
        "item", "item_print", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    probes = starts.select("item", window).join(cut.select("window", "window_print"), "window").select(
        "item", "window", "window_print", F.explode(_blocks(F.col("window_print"))).alias("b")).select(
        "item", "window", "window_print", "b.*")
    distance = F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print"))).alias("distance")
    near = probes.join(index, ["item", "block", "value"]).select("window", "item", distance).where(F.col("distance") <= RADIUS).distinct()
    near = written(near, "near")
    candidates = near.join(cut.select("window", "size", "words"), "window")
    similar = _similarity(candidates, shingles, weights, sizes).where(F.col("similarity") >= SIMILARITY)
    found = similar.join(near, ["window", "item"]).join(cut.select("window", *KEY, "start", "m"), "window").join(
        items.select("item", "item_id"), "item")
    best = found.groupBy(*KEY, "item_id").agg(F.max(F.struct(
        "similarity", (-F.col("distance")).alias("d"), (-F.col("start")).alias("s"), F.col("m").alias("m"))).alias("b"))
    best = small(written(best, "matches"), 64)
    return docs.select(F.col(id_column).alias("_id"), *text_key(body)).join(best, KEY).select(
        F.col("_id").alias(id_column), "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.d")).alias("distance"),
        (-F.col("b.s")).alias("start"), F.col("b.m").alias("n_words"), *KEY)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
                    item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a match, with all their columns."""
    found = matches(docs, benchmark, id_column, text, item_id, item_text)
    gone = small(written(found.select(*KEY).distinct(), "contaminated"), 32).toDF("_k1", "_k2")
    keyed = docs.withColumns(dict(zip(("_key1", "_key2"), text_key(F.col(text).cast("string")))))
    same = (F.col("_key1") == F.col("_k1")) & (F.col("_key2") == F.col("_k2"))
    return keyed.join(gone, same, "left_anti").drop("_key1", "_key2")
